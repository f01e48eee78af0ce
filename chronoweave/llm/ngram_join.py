"""N-gram Jaccard join: groups of documents whose sets of word n-grams are similar.

Two documents link when 100 * |A n B| >= percent * |A u B|, over the distinct
n-grams of their whole lower-cased texts; the result is each document's
component.  The join is exact:

1. Equal sets collapse to one node, the hash of the set.
2. Linked sets share one of their first n-grams (n - ceil(t n) + 1 of n) in any
   common order, and k + 1 of them when each takes k more; k grows with the size.
   The order puts frequent n-grams last, by counts over all documents, so what
   sets share is seldom common text.  These n-grams are the keys of candidate
   groups.
3. A group of some sets gives its pairs, and a pair stays that shares as many
   keys as a linked one must.  What shares fewer there, but links, shares a key
   of a larger group.  A larger group is parted into bands of sizes, of which
   only the same and neighbouring ones can link, and each band into runs of
   bounded size; two runs, or one with itself, are a tile.  A tile compares
   hashed bitmap signatures first: each bit is the parity of the n-grams hashed
   to it, so the bits in which two signatures differ are at most the n-grams in
   which the sets differ, which bounds the overlap from above.
4. What passes is decided by intersecting the exact sorted arrays.

A tile keeps a forest: a pair that its links already connect isn't looked at, so
it gives fewer links than it has sets.  The first round compares each run with
itself only, by few keys of each set, which is linear in the group and joins near
copies; runs are drawn anew for each key.  Signatures alone say which sets' arrays
a tile needs.  After the components of those links are known, the second
round compares, in groups that still have several, every set outside the
group's largest component with all others of its band and the neighbouring ones.
So no link between different components is lost, a group of near copies costs
its size, and what remains quadratic is the number of sets of a group outside
its largest component, times the group.

Cases: null and blank texts have no n-grams, link with nothing and are their own
component; a text of fewer words is one n-gram; repeated rows and equal sets
share a component; an empty table gives an empty result; other columns are not
read.  N-grams are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from . import textscan as ts
from .components import components
from .idfilter import bitmap, passes
from .memory import tidy
from .stage import cut, drop, free_prefix

SMALL_GROUP = 32  # sets of a group that gives all its pairs
TILE = 1024  # sets of a run, about
RUN_BYTES = 4 << 20  # and bytes of their arrays, about; a set beyond is a run of its own
FIRST_KEYS = 3  # of a set's large groups, in the first round
HOT = 4096  # documents of an n-gram whose group is known to be large before it is counted
HOT_PARTS = 64  # parts over which such a group's rows are dealt
FREQUENT = 200_000  # n-grams whose frequency the order knows
LOCAL_FREQUENT = 32_768  # of these, how many a task reports of some millions that it reads
SPARE = 50  # n-grams of a set for each key that it takes beyond the first

_U = np.uint64


def sets_of(raw: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, sorted within it, and the bounds of each text's run."""
    starts, ends, first = ts.spans(raw, offsets)
    words = ts.span_hashes(raw, starts, ends, lower=True)
    at, text = ts.gram_rows(first, n)
    hashes = ts.grams(words, n)[at] if len(at) else np.zeros(0, np.uint64)
    counts = np.diff(first)
    if len(few := np.flatnonzero((counts > 0) & (counts < n))):
        # the whole sequence as one; the number of words sets it apart from longer ones
        short = np.array([ts.mix64(np.array([sum(int(h) * pow(3, k + 1, 1 << 64) for k, h in enumerate(words[first[i] : first[i + 1]])) + int(counts[i]) & (1 << 64) - 1], np.uint64))[0] for i in few], np.uint64)
        hashes, text = np.concatenate([hashes, short]), np.concatenate([text, few])
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    hashes, text = hashes[fresh], text[fresh]
    return hashes, np.searchsorted(text, np.arange(len(offsets)))


def set_ids(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(ts.mix64(hashes), out=total[1:])
    return ts.mix64(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Parity bits of a set, as bytes; a power of two of at least 256, about twice the set's size."""
    width = min(8192, max(256, 1 << int(np.ceil(np.log2(max(1, 2 * len(hashes)))))))
    bits = np.bincount(((hashes >> _U(20)) % _U(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8))


def least_difference(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """At least so many n-grams are in one set only; signatures of equal width, as 64-bit words."""
    return np.bitwise_count(one ^ many).sum(-1, dtype=np.int64)


def most_difference(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Linked sets of these sizes differ in at most so many n-grams."""
    return (100 - percent) * (a + b) // (100 + percent)


def _fold(bits: np.ndarray, words: int) -> np.ndarray:
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def _scan(docs: DataFrame, work, ddl: str) -> DataFrame:
    """docs' (doc_id, text) through work(ids, hashes, bounds, state), block by block; state lasts for the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            for a, b, raw, offsets in ts.blocks(*ts.utf8_block(batch.column(1))):
                yield from work(batch.column(0).slice(a, b - a), raw, offsets, state)
        yield from work(None, None, None, state)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), ddl)


def _rows(docs: DataFrame, n: int) -> DataFrame:
    """What one scan tells: (kind, a, b, c), for rows 0, doc_id, size and sid; for frequent n-grams 1, hash and count."""

    def work(ids, raw, offsets, state):
        if ids is not None:
            hashes, bounds = sets_of(raw, offsets, n)
            state.setdefault("all", []).append(hashes)
            state["held"] = state.get("held", 0) + len(hashes)
            yield batch(0, ids, np.diff(bounds), set_ids(hashes, bounds))
        if state.get("held") and (ids is None or state["held"] > 1 << 20):
            hashes, counts = np.unique(np.concatenate(state.pop("all")), return_counts=True)
            state["held"] = 0
            hashes, counts = hashes[counts > 1], counts[counts > 1]
            top = np.argsort(-counts, kind="stable")[:LOCAL_FREQUENT]
            yield batch(1, hashes[top].view(np.int64), counts[top], np.zeros(len(top), np.int64))

    def batch(kind, a, b, c):
        return pa.RecordBatch.from_pydict({"kind": np.full(len(b), kind, np.int32), "a": a, "b": b, "c": c})

    return cut(_scan(docs, work, "kind int, a long, b long, c long"))


def _frequent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams by documents, sorted by hash, with their counts; a list of at most FREQUENT."""
    counted = rows.where("kind = 1").groupBy("a").agg(F.sum("b").alias("b")).withColumn("level", F.floor(F.log2("b") * 16))
    levels = sorted(((r["level"], r["n"]) for r in counted.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    total, least = 0, None
    for level, many in levels:
        total += many
        if total > FREQUENT:
            break
        least = level
    top = counted.where(F.lit(False) if least is None else F.col("level") >= least).select("a", "b").toPandas()
    hashes, counts = top["a"].to_numpy(np.int64).view(np.uint64), top["b"].to_numpy(np.int64)
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def _keys(docs: DataFrame, n: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(key, part, sid, size): the first n-grams of each set in the common order; a task gives equal sets once.

    part is 0, but for n-grams of HOT documents or more, whose rows have one of HOT_PARTS.
    """
    (known, counts), hot = frequent, HOT

    def work(ids, raw, offsets, state):
        if ids is None:
            return
        hashes, bounds = sets_of(raw, offsets, n)
        sid, size = set_ids(hashes, bounds), np.diff(bounds)
        seen = state.setdefault("seen", set())
        fresh = np.zeros(len(sid), bool)
        for i, s in enumerate(sid.tolist()):
            if size[i] and s not in seen:
                seen.add(s)
                fresh[i] = True
        take = np.repeat(fresh, size)
        text = np.repeat(np.arange(len(sid)), size)[take]
        hashes = hashes[take]
        rank = np.zeros(len(hashes), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            rank = np.where(known[at] == hashes, counts[at], 0)
        order = np.lexsort((hashes, rank, text))
        hashes, text, rank = hashes[order], text[order], rank[order]
        first = np.searchsorted(text, text)
        keep = np.arange(len(text)) - first < (size - -(-percent * size // 100) + 1 + size // SPARE)[text]
        own = sid[text[keep]]
        part = np.where(rank[keep] >= hot, 1 + ts.mix64(own.view(np.uint64)) % _U(HOT_PARTS), _U(0)).astype(np.int32)
        yield pa.RecordBatch.from_pydict({"key": hashes[keep].view(np.int64), "part": part, "sid": own, "size": size[text[keep]].astype(np.int32)})

    return _scan(docs, work, "key long, part int, sid long, size int")


def _arrays(docs: DataFrame, n: int, sids: DataFrame) -> DataFrame:
    """(sid, size, bits, grams) of the sets in sids: signatures and exact sorted arrays."""
    words = bitmap(sids, "sid")

    def work(ids, raw, offsets, state):
        if ids is None:
            return
        hashes, bounds = sets_of(raw, offsets, n)
        sid = set_ids(hashes, bounds)
        wanted = passes(words, sid) & (np.diff(bounds) > 0)
        seen = state.setdefault("seen", set())
        rows = []
        for i in np.flatnonzero(wanted).tolist():
            if (s := int(sid[i])) not in seen:
                seen.add(s)
                own = hashes[bounds[i] : bounds[i + 1]]
                rows.append((s, len(own), signature(own).tobytes(), own.tobytes()))
        if rows:
            a, b, c, d = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.binary()), pa.array(d, pa.binary())], ["sid", "size", "bits", "grams"])

    return cut(_scan(docs, work, "sid long, size int, bits binary, grams binary").dropDuplicates(["sid"]))


def _verified(pairs: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link: bounded by signatures, then decided by their arrays."""

    def sides(columns: list[str], rows: DataFrame) -> DataFrame:
        for x in ("a", "b"):
            rows = rows.join(arrays.select(F.col("sid").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns]), x)
        return rows

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, xa, nb, xb in zip(*(batch.column(c).to_pylist() for c in ("size_a", "bits_a", "size_b", "bits_b")), strict=True):
                one, two = (np.frombuffer(x, np.uint64) for x in (xa, xb))
                words = min(len(one), len(two))
                keep.append(bool(least_difference(_fold(one, words), _fold(two, words)) <= most_difference(na, nb, percent)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_linked(*(np.frombuffer(x.as_buffer(), np.uint64) for x in both), percent) for both in zip(batch.column("grams_a"), batch.column("grams_b"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    close = F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * percent
    near = sides(["size", "bits"], pairs).where(close).mapInArrow(tidy(bound), "a long, b long")
    return cut(sides(["grams"], near).mapInArrow(tidy(decide), "a long, b long"))


def _linked(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(one, two, assume_unique=True))
    return bool(100 * both >= percent * (len(one) + len(two) - both))


class _Near:
    """What of a tile may link with one of its sets: of one run with itself what comes later, or of those marked first with the others."""

    def __init__(self, first: np.ndarray, size: np.ndarray, bits: list[bytes], percent: int) -> None:
        self.own = np.flatnonzero(first)
        other = self.own if first.all() else np.flatnonzero(~first)
        self.inner, self.size, self.bits, self.percent = first.all(), size, bits, percent
        words = np.array([len(x) // 8 for x in bits])
        self.groups = [(int(w), other[words[other] == w]) for w in np.unique(words[other])]
        self.folded: dict[tuple[int, int], np.ndarray] = {}

    def of(self, i: int, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sets of other components whose sizes and signatures let them link with set i, and the least number of n-grams in which each differs from it."""
        mine, size = np.frombuffer(self.bits[i], np.uint64), self.size
        found, least = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for w, js in self.groups:
            near = (comp[js] != comp[i]) & (np.minimum(size[js], size[i]) * 100 >= np.maximum(size[js], size[i]) * self.percent)
            if self.inner:
                near &= js > i
            if not near.any():
                continue
            width = min(w, len(mine))
            if (w, width) not in self.folded:
                self.folded[w, width] = _fold(np.stack([np.frombuffer(self.bits[j], np.uint64) for j in js]), width)
            apart = least_difference(_fold(mine, width), self.folded[w, width][near])
            fits = apart <= most_difference(size[js[near]], size[i], self.percent)
            found.append(js[near][fits])
            least.append(apart[fits])
        return np.concatenate(found), np.concatenate(least)


def tile_links(first: np.ndarray, sid: np.ndarray, comp: np.ndarray, size: np.ndarray, bits: list[bytes], grams: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Links that connect all sets of a tile that its links and components connect."""
    near, comp, out = _Near(first, size, bits, percent), comp.copy(), []
    for i in near.own:
        js, apart = near.of(i, comp)
        array = np.frombuffer(grams[i], np.uint64)
        for j in js[np.argsort(apart / (size[js] + size[i]), kind="stable")]:
            if comp[j] != comp[i] and _linked(array, np.frombuffer(grams[j], np.uint64), percent):
                out.append((int(sid[i]), int(sid[j])))
                comp[comp == comp[j]] = comp[i]
    return out


def tile_candidates(first: np.ndarray, comp: np.ndarray, size: np.ndarray, bits: list[bytes], percent: int) -> np.ndarray:
    """Which sets of a tile have another that they may link with."""
    near, out = _Near(first, size, bits, percent), np.zeros(len(size), bool)
    for i in near.own:
        js, _ = near.of(i, comp)
        out[js] = True
        out[i] |= len(js) > 0
    return out


_ROW = {"key": pa.int64(), "lo": pa.int64(), "hi": pa.int64(), "run": pa.int64(), "sid": pa.int64(), "component": pa.int64(), "size": pa.int32(), "bits": pa.binary()}


def _tiles(rows: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) inside tiles, from rows (key, lo, hi, run, sid, component) and arrays (sid, size, bits, grams).

    Signatures go to every tile of a set, its array only to those in which a
    signature lets it link.
    """

    def by_tile(work, columns: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            name, held = None, []
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                    if row[:3] != name:
                        yield from whole(name, held)
                        name, held = row[:3], []
                    held.append(row)
            yield from whole(name, held)

        def whole(name: tuple, held: list[tuple]) -> Iterator[pa.RecordBatch]:
            if len(held) < 2:
                return
            run_, sid, comp, size = (np.array([r[i] for r in held], np.int64) for i in range(3, 7))
            first = run_ == name[1]
            if name[1] == name[2] or not first.all():
                yield from work(held, first, sid, comp, size)

        return tidy(run)

    def candidates(held, first, sid, comp, size) -> Iterator[pa.RecordBatch]:
        own = [held[i] for i in np.flatnonzero(tile_candidates(first, comp, size, [r[7] for r in held], percent))]
        if own:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*own, strict=True), _ROW.values(), strict=True)], list(_ROW))

    def links(held, first, sid, comp, size) -> Iterator[pa.RecordBatch]:
        if made := tile_links(first, sid, comp, size, [r[7] for r in held], [r[8] for r in held], percent):
            one, two = zip(*made, strict=True)
            yield pa.RecordBatch.from_pydict({"a": np.minimum(one, two), "b": np.maximum(one, two)})

    dealt = lambda df: df.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "size", "sid")
    signed = dealt(rows.join(arrays.select("sid", "size", "bits"), "sid")).select(*_ROW)
    ddl = "key long, lo long, hi long, run long, sid long, component long, size int, bits binary"
    found = cut(signed.mapInArrow(by_tile(candidates, list(_ROW)), ddl))
    whole = dealt(found.join(arrays.select("sid", "grams"), "sid")).select(*_ROW, "grams")
    return drop(cut(whole.mapInArrow(by_tile(links, [*_ROW, "grams"]), "a long, b long").distinct()), found)


def _band(percent: int) -> Column:
    """Sizes that can link have the same band or neighbouring ones; a group that fits a tile has one band."""
    band = F.floor(F.log("size") / (np.log(100 / percent) * (1 + 1e-9))).cast("long") if percent < 100 else F.col("size").cast("long")
    return F.when(F.col("members") > TILE, band).otherwise(F.lit(0).cast("long"))


def _cells(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, runs): into how many runs the sets of each cell are parted."""
    n, grams = F.count(F.lit(1)), F.sum("size")
    return rows.groupBy(*by).agg(F.greatest(F.ceil(n / TILE), F.ceil(grams * 8 / RUN_BYTES)).cast("long").alias("runs"))


def _run(kind: Column, band: Column, number: Column) -> Column:
    """A run's name within its key."""
    return F.shiftleft(kind.cast("long"), 62) + F.shiftleft(band.cast("long"), 32) + number


def _within_runs(large: DataFrame, percent: int) -> DataFrame:
    """large (key, sid, size, members) dealt to tiles of each run with itself, each set by FIRST_KEYS of its keys.

    These have the least hashes, so sets that share most keys mostly take the same.
    """
    order = W.partitionBy("sid").orderBy(F.xxhash64("key"), "key")
    banded = large.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= FIRST_KEYS).drop("nth")
    banded = banded.withColumn("band", _band(percent))
    cells = _cells(banded, ["key", "band"])
    number = F.pmod(F.xxhash64("sid", "key"), F.col("runs"))
    run = banded.join(cells, ["key", "band"]).withColumn("run", _run(F.lit(0), F.col("band"), number))
    return run.select("key", F.col("run").alias("lo"), F.col("run").alias("hi"), "run", "sid", F.col("sid").alias("component"))


def _across(labelled: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """labelled (key, sid, size, members, component), of keys with several components, dealt to tiles that pair each set outside the key's largest component with all that it can link with; and the table that this reads."""
    most = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    kind = F.when(F.col("members") > TILE, F.col("component") == F.col("main")).otherwise(F.lit(False)).cast("long")
    rows = labelled.join(most.select("key", "main"), "key").select("key", "sid", "size", "component", kind.alias("kind"), _band(percent).alias("band"))
    rows = cut(rows)
    cells = _cells(rows, ["key", "kind", "band"]).groupBy("key").agg(F.collect_list(F.struct("kind", "band", "runs")).alias("cells"))
    own = rows.join(cells, "key").withColumn("runs", F.filter("cells", lambda c: (c["kind"] == F.col("kind")) & (c["band"] == F.col("band")))[0]["runs"])
    own = own.withColumn("run", _run(F.col("kind"), F.col("band"), F.pmod(F.xxhash64("sid", "key"), F.col("runs"))))
    meets = F.filter("cells", lambda c: (F.abs(c["band"] - F.col("band")) <= 1) & (c["kind"] * F.col("kind") == 0))
    named = F.flatten(F.transform(meets, lambda c: F.transform(F.sequence(F.lit(0).cast("long"), c["runs"] - 1), lambda x: _run(c["kind"], c["band"], x))))
    dealt = own.select("key", "run", "sid", "component", F.explode(named).alias("with"))
    return dealt.select("key", F.least("run", "with").alias("lo"), F.greatest("run", "with").alias("hi"), "run", "sid", "component"), rows


def similar_groups(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row; component_id is the smallest doc_id of the row's group."""
    rows, known = _known(docs, n, percent, id_col, text_col, ("doc_id", "n_shingles"))
    # written, so that the join reads both sides from exchanges of its own and can split a group with much of all rows
    least = cut(known.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    own = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return known.join(least, "component", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).unionByName(own)


def _known(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str, names: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, sid) of all rows, and the named ones of these with the component of each row that has words."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scanned = _rows(docs, n)
    rows = scanned.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"), F.col("c").alias("sid"))
    found = linked_sets(docs, n, percent, _frequent(scanned))
    known = rows.where("n_shingles > 0").join(found.select(F.col("node").alias("sid"), "component"), "sid", "left")
    return rows, drop(cut(known.select(*names, F.coalesce("component", "sid").alias("component"))), found)


def linked_sets(docs: DataFrame, n: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(node, component) of the sets that have a link to a different set."""
    if not 1 <= percent <= 100:
        raise ValueError("percent is from 1 to 100")
    # a hot n-gram's group is large, so its rows need no count and are dealt in parts
    inside = W.partitionBy("key", "part")
    groups = _keys(docs, n, percent, frequent).withColumn("lowest", F.min("sid").over(inside)).withColumn("highest", F.max("sid").over(inside)).withColumn("members", F.when(F.col("part") > 0, max(SMALL_GROUP, TILE) + 1).otherwise(F.count(F.lit(1)).over(inside)))
    groups = cut(groups.where("part > 0 OR lowest <> highest").select("key", "sid", "size", "members"))
    small = groups.where(F.col("members") <= SMALL_GROUP)
    one, two = (small.select("key", F.col("sid").alias(x), F.col("size").alias(f"size_{x}")) for x in "ab")
    close = F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * percent
    pairs = one.join(two, "key").where("a < b").where(close)
    pairs = cut(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.min(F.least("size_a", "size_b")).alias("size")).where(F.expr(f"shared >= 1 + size div {SPARE}")).select("a", "b"))
    large = cut(groups.where(F.col("members") > SMALL_GROUP).select("key", "sid", "size", "members").distinct())
    drop(large, groups)
    arrays = _arrays(docs, n, pairs.select(F.explode(F.array("a", "b")).alias("sid")).unionByName(large.select("sid")))
    linked = _verified(pairs, arrays, percent)
    near = _tiles(_within_runs(large, percent), arrays, percent)
    found = cut(components(linked.unionByName(near)))
    drop(found, pairs, linked, near)
    labelled = large.join(found.select(F.col("node").alias("sid"), "component"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    dealt, rows = _across(labelled, percent)
    more = _tiles(dealt, arrays, percent)
    drop(more, rows, large, arrays)
    out = cut(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)))
    return drop(out, found, more)


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group, the one with the smallest id; rows without words stay.

    Null ids come after all others.  Of the texts of one id in a group the one
    with the smallest set hash stays, and of exact repeats one, so it is a row
    and not an id that is kept or dropped.
    """
    own = free_prefix(docs)
    key, key_set, stays, times, sid, turn = (own + x for x in ("id", "set", "first", "rows", "sid", "turn"))
    rows, known = _known(docs, n, percent, id_col, text_col, ("doc_id", "sid"))
    many = known.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sid")).alias("first")).where("n > 1").drop("n")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("sid") == F.col("first.sid"))
    many = cut(many)
    listed = known.join(many, "component").groupBy(F.col("doc_id").alias(key), F.col("sid").alias(key_set)).agg(F.first(same).alias(stays), F.count(F.lit(1)).alias(times))
    listed = drop(cut(listed), rows, known, many)
    # rows that the bitmap clears need no join, so most texts are not shuffled
    words, at, text_at = bitmap(listed.where(F.col(key).isNotNull()), key), docs.columns.index(id_col), docs.columns.index(text_col)
    names = docs.columns

    def side(within: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(at).cast(pa.int64())
                hit = passes(words, ids.fill_null(0).to_numpy(zero_copy_only=False)) | np.asarray(ids.is_null())
                batch = batch.filter(pa.array(hit == within))
                if not within:
                    yield batch
                elif batch.num_rows:
                    sets = [set_ids(*sets_of(raw, offsets, n)) for _, _, raw, offsets in ts.blocks(*ts.utf8_block(batch.column(text_at)))]
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(sets).view(np.int64), pa.int64())], [*names, sid])

        return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField(sid, T.LongType())]) if within else docs.schema)

    judged = side(True).join(listed, F.col(id_col).cast("long").eqNullSafe(F.col(key)) & (F.col(sid) == F.col(key_set)), "left")
    alone = judged.where(F.col(stays).isNull() | (F.col(stays) & (F.col(times) == 1))).select(*names)
    order = F.row_number().over(W.partitionBy(key, key_set).orderBy(F.xxhash64(text_col), text_col))
    repeated = judged.where(F.col(stays) & (F.col(times) > 1)).withColumn(turn, order).where(F.col(turn) == 1).select(*names)
    return side(False).unionByName(alone).unionByName(repeated)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
