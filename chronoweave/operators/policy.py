"""Task similarity: reuse or isolate, and which edges to freeze."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import PolicyConfig
from ..functions.lineage import cut

TILE = 1024  # signatures, and tasks, that are compared at once
MOST_BITS = 8192  # bits of a signature
TASKS, ASKED = 1 << 16, 1 << 14  # tasks, and signatures, of a tile where all edges have bits of their own
BLOCK = 1 << 20  # numbers of a product of two blocks of such a tile


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def best_matches(asked: list[np.ndarray], tasks: list[np.ndarray], names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each asked set of small integers the task (a position, by least name of equal ones) with the greatest Jaccard similarity, and that; -1 and 0 where none shares anything.

    Sets are compared as bits.  Up to MOST_BITS different integers the bits are
    exact; beyond, integers share bits, so that common bits only bound what is
    common from above, and tasks are looked at in order of that bound until it
    falls below the best that was found.
    """
    vocabulary = max((int(x.max()) for x in [*asked, *tasks] if len(x)), default=-1) + 1
    width = min(MOST_BITS, max(64, -(-vocabulary // 64) * 64))
    exact = vocabulary <= width

    def bits(sets: list[np.ndarray]) -> np.ndarray:
        grid = np.zeros((len(sets), width), bool)
        grid[np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate([*sets, np.zeros(0, np.int64)]) % width] = True
        return np.packbits(grid, axis=1).view(np.uint64)

    theirs, sizes, rank = bits(tasks), np.array([len(x) for x in tasks]), np.argsort(np.argsort(names, kind="stable"), kind="stable")
    found, score = np.full(len(asked), -1), np.zeros(len(asked))
    for i, (mine, own) in enumerate(zip(bits(asked), asked, strict=True)):
        common = np.minimum(_bound(theirs, mine, sizes, len(own)), np.minimum(sizes, len(own)))
        bound = common / np.maximum(sizes + len(own) - common, 1)
        if exact:
            j = np.lexsort((rank, -bound))[0] if len(bound) else -1
            if j >= 0 and bound[j] > 0:
                found[i], score[i] = j, bound[j]
            continue
        for j in np.lexsort((rank, -bound)):
            if bound[j] <= 0 or bound[j] < score[i]:
                break
            both = len(np.intersect1d(own, tasks[j], assume_unique=True))
            likeness = both / (sizes[j] + len(own) - both)
            if likeness > score[i] or likeness == score[i] > 0 and rank[j] < rank[found[i]]:
                found[i], score[i] = j, likeness
    return found, score


def _bound(theirs: np.ndarray, mine: np.ndarray, sizes: np.ndarray, size: int) -> np.ndarray:
    """At least what sets have in common whose elements may share bits: each common bit, and the elements that stand behind others' bits on both sides."""
    both = np.bitwise_count(theirs & mine).sum(1, dtype=np.int64)
    hidden = np.minimum(sizes - np.bitwise_count(theirs).sum(1, dtype=np.int64), size - int(np.bitwise_count(mine).sum()))
    return both + hidden


def nearest(asked: np.ndarray, own: np.ndarray, tasks: np.ndarray, sizes: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """best_matches() of sets given as packed bits, each element a bit of its own, and their sizes.

    What two sets have in common is a product of their bits, made block by block.
    Of tasks of one size the one with most in common is the most similar, so a
    quotient is made for each size and not for each task.
    """
    found, score, least = np.full(len(asked), -1), np.zeros(len(asked)), np.full(len(asked), np.iinfo(np.int64).max)
    order = np.lexsort((rank, sizes))
    wide = max(1, asked.shape[1] * 8)
    step = max(1, min(8192, 8 * BLOCK // wide))
    rows = max(1, min(BLOCK // step, 8 * BLOCK // wide))
    for lo in range(0, len(order), step):
        part = order[lo : lo + step]
        theirs = np.unpackbits(tasks[part], axis=1).astype(np.float32).T
        ends = np.append(np.flatnonzero(np.diff(sizes[part], prepend=-1)), len(part))
        for i in range(0, len(asked), rows):
            common = np.unpackbits(asked[i : i + rows], axis=1).astype(np.float32) @ theirs
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                most = common[:, a:b].max(1).astype(np.int64)
                likeness = most / np.maximum(sizes[part[a]] + own[i : i + rows] - most, 1)
                better = np.flatnonzero((likeness > 0) & (likeness >= score[i : i + rows]))
                at = part[a + common[better, a:b].argmax(1)]
                better, at = (x[(likeness[better] > score[i + better]) | (rank[at] < least[i + better])] for x in (better, at))
                found[i + better], score[i + better], least[i + better] = at, likeness[better], rank[at]
    return found, score


def _packed(rows: DataFrame, bit: dict[str, int], columns: str) -> DataFrame:
    """rows (e, ...) with e as (bits, size): a bit for each edge that bit knows, and the number of all; columns names the others with their types."""
    width = max(8, -(-len(bit) // 64) * 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            sizes = pc.list_value_length(lists).to_numpy()
            place = np.array([bit.get(x, -1) for x in lists.flatten().to_pylist()], np.int64)
            owner, known = np.repeat(np.arange(len(batch)), sizes), place >= 0
            grid = np.zeros((len(batch), width), np.uint8)
            np.bitwise_or.at(grid, (owner[known], place[known] >> 3), (128 >> (place[known] & 7)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in grid], pa.binary()), pa.array(sizes, pa.int32()), *batch.columns[1:]], ["bits", "size", *batch.schema.names[1:]])

    return rows.mapInArrow(run, f"bits binary, size int{columns}")


def _by_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one (x, y) after another, of rows sorted by them."""
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        x, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        ends = np.flatnonzero((np.diff(x) != 0) | (np.diff(y) != 0)) + 1
        for lo, hi in zip([0, *ends], [*ends, len(x)], strict=True):
            if lo < hi:
                if held and (x[lo], y[lo]) != at:
                    yield pa.Table.from_batches(held)
                    held = []
                at = (x[lo], y[lo])
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _by_bits(strong: DataFrame, asked: DataFrame, bit: dict[str, int]) -> DataFrame:
    """(new_id, task_id, similarity) where each edge of strong (e, name) has a bit; asked is (new_id, e)."""
    kind, own = strong.schema["name"].dataType.simpleString(), asked.schema["new_id"].dataType.simpleString()
    theirs = _packed(strong.select("e", "name"), bit, f", name {kind}")
    named = cut(_packed(asked.select("e", "new_id"), bit, f", new_id {own}"))
    mine = cut(named.select("bits", "size").distinct())
    across, down = max(1, -(-strong.count() // TASKS)), max(1, -(-mine.count() // ASKED))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sides = theirs.select(F.pmod(F.xxhash64("name"), F.lit(across)).cast("int").alias("x"), every(down).alias("y"), F.lit(1).alias("side"), "bits", "size", "name")
    sides = sides.unionByName(mine.select(every(across).alias("x"), F.pmod(F.xxhash64("bits", "size"), F.lit(down)).cast("int").alias("y"), F.lit(0).alias("side"), "bits", "size", F.lit(None).cast(kind).alias("name")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_tile(batches):
            side, packed, sizes = table["side"].to_numpy(), table["bits"].combine_chunks(), table["size"].to_numpy().astype(np.int64)
            grid = np.frombuffer(b"".join(packed.to_pylist()), np.uint8).reshape(len(side), -1)
            ours, others = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            names = table["name"].combine_chunks().take(pa.array(others))
            order = pc.sort_indices(names).to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            found, score = nearest(grid[ours], sizes[ours], grid[others], sizes[others], rank)
            some = found >= 0
            yield pa.RecordBatch.from_arrays([packed.take(pa.array(ours[some])), pa.array(sizes[ours[some]], pa.int32()), names.take(pa.array(found[some])), pa.array(score[some])], ["bits", "size", "task_id", "similarity"])

    scored = sides.repartition(across * down, "x", "y").sortWithinPartitions("x", "y").mapInArrow(compare, f"bits binary, size int, task_id {kind}, similarity double")
    best = scored.groupBy("bits", "size").agg(F.min_by(F.struct("task_id", "similarity"), F.struct(-F.col("similarity"), F.col("task_id"))).alias("b"))
    return named.join(best, ["bits", "size"], "left").select("new_id", "b.task_id", F.coalesce("b.similarity", F.lit(0.0)).alias("similarity"))


def decide(tasks: DataFrame, new: DataFrame, cfg: PolicyConfig | None = None) -> DataFrame:
    """(new_id, action, task_id, similarity) for new signatures (new_id, edge_id) against tasks (task_id, edge_id, reliability).

    The best task is wanted even below the threshold, so every signature asked
    for is compared with every task: equal signatures are one, both sides are
    cut into runs, each two runs are a task's work on bits, and of a tile only
    the best of each signature goes on.  Up to MOST_BITS different edges of
    tasks each has a bit of its own, and rows are those bits; beyond, runs are
    of TILE and a tile numbers its own edges.
    """
    cfg = cfg or PolicyConfig()
    listed = lambda df, by: df.groupBy(by).agg(F.array_sort(F.collect_set(F.col("edge_id").cast("string"))).alias("e"))
    strong = cut(listed(tasks.where(F.col("reliability") + cfg.epsilon >= cfg.cutoff), "task_id").groupBy("e").agg(F.min("task_id").alias("name")))
    asked = cut(listed(new, "new_id"))
    edges = [r[0] for r in strong.select(F.explode("e")).distinct().limit(MOST_BITS + 1).collect()]
    out = _by_bits(strong, asked, {x: i for i, x in enumerate(sorted(edges))}) if len(edges) <= MOST_BITS else _by_lists(strong, asked)
    reuse = F.col("task_id").isNotNull() & (F.col("similarity") >= cfg.similarity_threshold)
    return out.select("new_id", F.when(reuse, "REUSE").otherwise("ISOLATE").alias("action"), F.when(reuse, F.col("task_id")).alias("task_id"), "similarity")


def _by_lists(strong: DataFrame, asked: DataFrame) -> DataFrame:
    """_by_bits() of any number of edges."""
    across, down = (max(1, -(-x.count() // TILE)) for x in (strong, asked))
    tile = lambda n: F.pmod(F.xxhash64("e"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sides = strong.select(tile(across).alias("x"), every(down).alias("y"), F.lit(1).alias("side"), "e", "name")
    sides = sides.unionByName(asked.select("e").distinct().select(every(across).alias("x"), tile(down).alias("y"), F.lit(0).alias("side"), "e", F.lit(None).cast(strong.schema["name"].dataType).alias("name")))
    kind = strong.schema["name"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_tile(batches):
            yield from judged(table)

    def judged(table: pa.Table) -> Iterator[pa.RecordBatch]:
        side, lists = table["side"].to_numpy(), table["e"].combine_chunks()
        coded = lists.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        sets = [np.sort(coded[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        mine, theirs = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(mine) or not len(theirs):
            return
        names = table["name"].combine_chunks().take(pa.array(theirs))
        order = pc.sort_indices(names).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        found, score = best_matches([sets[i] for i in mine], [sets[i] for i in theirs], rank)
        some = found >= 0
        yield pa.RecordBatch.from_arrays([lists.take(pa.array(mine[some])), names.take(pa.array(found[some])), pa.array(score[some])], ["e", "task_id", "similarity"])

    scored = sides.repartition("x", "y").sortWithinPartitions("x", "y").mapInArrow(compare, f"e array<string>, task_id {kind}, similarity double")
    best = scored.groupBy("e").agg(F.min_by(F.struct("task_id", "similarity"), F.struct(-F.col("similarity"), F.col("task_id"))).alias("b"))
    return asked.join(best, "e", "left").select("new_id", "b.task_id", F.coalesce("b.similarity", F.lit(0.0)).alias("similarity"))


def plan_freeze(tasks: DataFrame, cfg: PolicyConfig | None = None) -> DataFrame:
    """(task_id, edge_id, strength): the top fraction of each task's edges at the cutoff or above."""
    cfg = cfg or PolicyConfig()
    strong = tasks.where(F.col("reliability") + cfg.epsilon >= cfg.cutoff)
    rank = F.row_number().over(W.partitionBy("task_id").orderBy(F.desc("reliability"), "edge_id"))
    size = F.count(F.lit(1)).over(W.partitionBy("task_id"))
    return strong.withColumn("rank", rank).withColumn("size", size).where(F.col("rank") <= F.ceil(F.col("size") * cfg.top_fraction)).select("task_id", "edge_id", F.lit(cfg.freeze_strength).alias("strength"))


def resisted(delta: Column, strength: Column, mode: str = "resistance") -> Column:
    """An update under freezing: scaled down by its strength, or none if frozen edges are immutable."""
    if mode == "immutable":
        return F.when(strength > 0, 0.0).otherwise(delta)
    return F.when(strength.isNotNull(), delta * (1 - strength)).otherwise(delta)


def region_tag(prefix: str, task: Column) -> Column:
    return F.concat(F.lit(f"{prefix}:"), task)
