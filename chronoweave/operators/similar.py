"""Groups of vectors with close directions, by signed random projections in bands.

A vector's bits say on which side of random planes it lies; two at an angle a
agree in a bit with the chance 1 - a / pi.  Bits are taken in bands, vectors that
agree in a whole band are candidates, and every candidate is decided by its exact
cosine.  plan() chooses the bits so that a band's buckets hold few unrelated
vectors however many there are, and the bands so that two at the very threshold
become candidates with the wanted chance; closer ones do more often, and a group
needs only a chain of links.

Where the bits tell little, as at low thresholds, bands without end would cost
more than all pairs do, and grow as fast.  There vectors are compared in blocks,
and the groups are exact: all with a bounded number of anchors first, then those
that the anchors' largest group of their dimension didn't take with all.  What is
left out lies within that one group.

Equal directions are one vector.  A bucket of any size is parted into runs, of
which each two are a tile, so no task holds a bucket; a tile gives links that
connect what its links connect, not all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.components import components
from ..functions.lineage import cut, drop

RUN = 1024  # vectors of a run, about
LEAST_BITS, MOST_BITS = 4, 62
IN_BUCKET = 64  # unrelated vectors in a bucket, about
BLOCK = 8192  # vectors of a block where all are compared, about
ANCHORS = 8192  # of each dimension, about
ROW_PAIRS = 3000  # pairs compared in a block in the time that a vector takes in a band, about
SLICE = 1 << 22  # products of a tile at once


def plan(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits, bands) for n vectors."""
    if not 0 < threshold <= 1 or not 0 < recall < 1:
        raise ValueError("threshold lies above 0 and up to 1, recall between 0 and 1")
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, n / IN_BUCKET)))))
    chance = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, 1 if chance > 1 - 1e-12 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - chance)))


def directions(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, dim, x): unit vectors as packed float64; those without a direction, or with anything but numbers, are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = v.values.cast(pa.float64()).fill_null(float("nan")).to_numpy() if v.is_valid else np.zeros(0)
                top = np.abs(x).max() if len(x) else 0.0
                if 0 < top < np.inf:
                    x = x / top  # so that no square is beyond float64
                    rows.append((i, len(x), (x / np.sqrt((x * x).sum()) + 0.0).tobytes()))
            if rows:
                a, b, c = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.binary())], ["id", "dim", "x"])

    return vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v")).where("id is not null").mapInArrow(run, "id bigint, dim int, x binary")


def banded(rows: DataFrame, bits: int, bands: int, seed: int) -> DataFrame:
    """(dim, band, code, id) of rows (id, dim, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, bits * bands))
                at = np.flatnonzero(dims == dim)
                x = np.stack([np.frombuffer(batch.column(2)[i].as_buffer(), np.float64) for i in at.tolist()])
                side = ((x @ planes[dim]) > 0).reshape(len(at), bands, bits)
                code = (side * (1 << np.arange(bits, dtype=np.int64))).sum(2).ravel()
                n = len(code)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, dim, np.int32)), pa.array(np.tile(np.arange(bands, dtype=np.int32), len(at))), pa.array(code), batch.column(0).take(pa.array(np.repeat(at, bands)))], ["dim", "band", "code", "id"])

    return rows.mapInArrow(run, "dim int, band int, code bigint, id bigint")


def tile_links(first: np.ndarray, ids: np.ndarray, x: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links that connect what the tile's close pairs connect: of all its vectors, or of those marked first with the others."""
    own = np.flatnonzero(first)
    other = own if first.all() else np.flatnonzero(~first)
    there, comp, out = x[other].T, np.arange(len(ids)), []
    step = max(1, SLICE // max(1, len(other)))
    for lo in range(0, len(own), step):
        close = x[own[lo : lo + step]] @ there >= threshold
        for k in np.flatnonzero(close.any(1)):
            i = own[lo + k]
            for j in other[close[k]]:
                if comp[j] != comp[i]:
                    out.append((int(ids[i]), int(ids[j])))
                    comp[comp == comp[j]] = comp[i]
    return out


def _judged(dealt: DataFrame, key: list[str], threshold: float) -> DataFrame:
    """(a, b) of tiles of rows (*key, first, id, x): of those marked first with the others, or of all where all are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in (*key, "first", "alone", "id", "x")), strict=True):
                if row[: len(key)] != name:
                    yield from judged(held)
                    name, held = row[: len(key)], []
                held.append(row[len(key) :])
        yield from judged(held)

    def judged(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(held) < 2:
            return
        first = np.array([r[0] for r in held])
        if first.all() and not held[0][1]:
            return
        made = tile_links(first, np.array([r[2] for r in held]), np.stack([np.frombuffer(r[3], np.float64) for r in held]), threshold)
        if made:
            a, b = zip(*made, strict=True)
            yield pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return dealt.repartition(*key).sortWithinPartitions(*key, "id").select(*key, "first", "alone", "id", "x").mapInArrow(run, "a bigint, b bigint").distinct()


def links(rows: DataFrame, buckets: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of close rows (id, dim, x) that share one of buckets (dim, band, code, id)."""
    key = ["dim", "band", "code"]
    sizes = buckets.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    runs = F.ceil(F.col("n") / RUN).cast("int")
    own = buckets.join(sizes, key).withColumn("run", F.pmod(F.xxhash64("id", "band"), runs).cast("int"))
    tile = F.explode(F.transform(F.sequence(F.lit(0), runs - 1), lambda r: F.struct(F.least(r, F.col("run")).alias("lo"), F.greatest(r, F.col("run")).alias("hi"))))
    dealt = own.select(*key, "id", "run", tile.alias("tile")).select(*key, "tile.lo", "tile.hi", (F.col("run") == F.col("tile.lo")).alias("first"), (F.col("tile.lo") == F.col("tile.hi")).alias("alone"), "id").join(rows.select("id", "x"), "id")
    return _judged(dealt, [*key, "lo", "hi"], threshold)


def crossed(some: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of close rows (id, dim, x) of which one is in some (id, dim, x), in tiles of a block of each."""
    blocks = lambda df, name: df.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    sizes = F.broadcast(blocks(some, "los").join(blocks(rows, "his"), "dim"))
    in_block = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = some.join(sizes, "dim").select("dim", in_block("los", 1).alias("lo"), each("his").alias("hi"), F.lit(True).alias("first"), "id", "x")
    two = rows.join(sizes, "dim").select("dim", each("los").alias("lo"), in_block("his", 2).alias("hi"), F.lit(False).alias("first"), "id", "x")
    return _judged(one.unionByName(two).withColumn("alone", F.lit(False)), ["dim", "lo", "hi"], threshold)


def every_link(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b) that connect what all close rows (id, dim, x) connect."""
    sizes = F.broadcast(rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")))
    anchors = rows.join(sizes, "dim").where(F.pmod(F.xxhash64("id", F.lit(0)), F.ceil(F.col("n") / ANCHORS)) == 0).select(*rows.columns)
    near = cut(crossed(anchors, rows, threshold))
    found = cut(components(near).join(rows.select(F.col("id").alias("node"), "dim"), "node"))
    largest = found.groupBy("dim", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("dim").agg(F.max_by("component", F.struct("n", "component")).alias("component"))
    inside = found.join(F.broadcast(largest), ["dim", "component"], "left_semi").select(F.col("node").alias("id"))
    left = cut(rows.join(inside, "id", "left_anti").select(*rows.columns))
    made = cut(crossed(left, rows, threshold).unionByName(near).distinct())
    return drop(made, near, found, left)


def in_bands(n: int, bands: int) -> bool:
    """Whether bands cost n vectors less than all pairs do."""
    return bands * ROW_PAIRS < n / 2


def groups(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.95, seed: int = 0, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(id, group_id) of every id: the smallest id that close vectors lead to, its own where there is none.

    ``recall`` is the least chance for two vectors at the threshold.  Vectors of
    different lengths are never close; one without a direction is its own group.
    An id that stands for several vectors joins all of their groups.
    """
    every = cut(directions(vectors, id_col, vector_col))
    whole = cut(every.groupBy("dim", "x").agg(F.min("id").alias("rep")))
    # a number of their own, as an id may stand for several
    rows = cut(whole.select(F.xxhash64("dim", "x").alias("id"), "dim", "x", "rep"))
    n = rows.count()
    bits, bands = plan(n, threshold, recall)
    if in_bands(n, bands):
        buckets = cut(banded(rows, bits, bands, seed))
        near = drop(cut(links(rows, buckets, threshold)), buckets)
    else:
        near = every_link(rows, threshold)
    named = near.join(rows.select(F.col("id").alias("a"), F.col("rep").alias("x")), "a").join(rows.select(F.col("id").alias("b"), F.col("rep").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    equal = every.join(whole, ["dim", "x"]).select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct()
    found = cut(components(named.unionByName(equal)))
    drop(found, near, rows, whole, every)
    ids = vectors.select(F.col(id_col).cast("bigint").alias("id")).distinct()
    return ids.join(found, ids["id"] == found["node"], "left").select("id", F.coalesce("component", "id").alias("group_id"))
