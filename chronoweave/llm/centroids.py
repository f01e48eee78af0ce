"""Centroid clustering: k-means over integer vectors, exact whatever the order of the sums.

Components become integers floor(scale * x), kept as float64, in which each of
them is exact.  A task compares blocks of vectors with all centroids by
|x|^2 - 2 x.c + |c|^2, the middle term being one matrix product in float64.  A
vector goes that way only where dim * (|x|max + |c|max)^2 < 2^53, which bounds
every partial sum of the three terms, so the products are exact in any order;
others are compared in 64-bit integers below 2^62 and in Python's integers
beyond.  Each task adds its vectors up by centroid in exact integers, and
RDD.treeAggregate combines these k by dim sums; only they reach the driver.

The integers are written once to the shared folder, so that a round reads them
back and a lost executor costs its tasks only.  Sums being exact, results don't
depend on partitions, retries or the number of executors.  No vector is a key of
a shuffle, so many equal ones or a full cluster weigh on no single task.

Cases: a vector that is null, of another length, or with a component that is
null, not finite or beyond float64 when scaled, is left out; a null id stays but
starts no centroid; repeated rows count as often as they stand, and of rows with
one id the one with the smaller packed bytes comes first as a start; with fewer
vectors than k there are fewer centroids; equal distances go to the smaller
number; a centroid without vectors stays where it is; an empty table, or one without
an id to start from, gives an empty result; distances and inertias beyond 2^63 - 1 are null; other columns
aren't read.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .memory import tidy
from .stage import cut

BLOCK = 4096  # vectors of one matrix product
EXACT, WIDE, LONG = float(1 << 53), float(1 << 62), (1 << 63) - 1
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"

Sums = tuple[np.ndarray, np.ndarray, np.ndarray]  # vectors, sums of components and sums of distances of each centroid, in Python's integers


@dataclass(frozen=True)
class Model:
    """Centroids of exact integers, and the summed distances of all vectors to the nearest, by centroid."""

    centroids: list[list[int]]
    inertias: list[int]

    def digests(self) -> list[str]:
        """The hex digest of each centroid's components in decimal, joined by commas."""
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.centroids]


def integers(vectors: DataFrame, dim: int = 64, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): the whole vectors' integers as packed float64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.equal(pc.list_value_length(batch.column(1)), dim))  # a null length fails as well
            x = batch.column(1).flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy().reshape(-1, dim)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(x * scale) + 0.0  # no negative zero
            whole = np.isfinite(x).all(1)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(whole)), _packed(x[whole])], ["vec_id", "x"])

    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("x")).mapInArrow(tidy(run), "vec_id long, x binary")


def _packed(x: np.ndarray) -> pa.Array:
    ends = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * 8)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x))])


def _unpacked(column: pa.Array, dim: int) -> np.ndarray:
    data = column.buffers()[2]
    if not len(column):
        return np.zeros((0, dim))
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(data, np.float64, len(column) * dim, at).reshape(-1, dim)


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row of x and its squared distance; distances are int64, or Python's integers where one is beyond."""
    exact = np.array(centroids, dtype=object)
    most = max(abs(v) for c in centroids for v in c)
    dim = x.shape[1]
    # float(most) may round down, and the bound's own rounding is far below one part in 2^40
    bound = dim * (np.abs(x).max(1) + float(most)) ** 2 * (1 + 2.0**-40)
    cluster, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    small = bound < EXACT
    if small.any():
        c, rows = exact.astype(np.float64), x if small.all() else x[small]
        d = np.einsum("ij,ij->i", rows, rows)[:, None] - 2.0 * (rows @ c.T) + np.einsum("ij,ij->i", c, c)[None, :]
        own = d.argmin(1)
        cluster[small], distance[small] = own, d[np.arange(len(d)), own].astype(np.int64)
    wide = ~small & (bound < WIDE)
    if wide.any():
        c, at = exact.astype(np.int64), np.flatnonzero(wide)
        for part in np.array_split(at, -(-len(at) // 256)):
            d = ((x[part].astype(np.int64)[:, None, :] - c[None]) ** 2).sum(-1)
            cluster[part] = d.argmin(1)
            distance[part] = d.min(1)
    beyond = np.flatnonzero(~small & ~wide)
    if len(beyond):
        distance = distance.astype(object)
        for i in beyond:
            d = [sum((int(a) - b) ** 2 for a, b in zip(x[i], c, strict=True)) for c in centroids]
            cluster[i] = min(range(len(d)), key=d.__getitem__)
            distance[i] = d[cluster[i]]
    return cluster, distance


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part.column(0), _unpacked(part.column(1), dim)


def _zero(k: int, dim: int) -> Sums:
    return np.zeros(k, object), np.zeros((k, dim), object), np.zeros(k, object)


def _plus(one: Sums, two: Sums) -> Sums:
    return one[0] + two[0], one[1] + two[1], one[2] + two[2]


def _block_sums(x: np.ndarray, cluster: np.ndarray, distance: np.ndarray, k: int) -> Sums:
    out = _zero(k, x.shape[1])
    out[0][:] = [int(n) for n in np.bincount(cluster, minlength=k)]
    if np.abs(x).max() * len(x) < EXACT:
        member = np.zeros((k, len(x)))
        member[cluster, np.arange(len(x))] = 1.0
        out[1][:] = (member @ x).astype(np.int64)
    else:
        for row, own in zip(x, cluster, strict=True):
            out[1][own] += np.array([int(v) for v in row], object)
    for own in np.unique(cluster):
        d = distance[cluster == own]
        out[2][own] = int(d.sum()) if d.dtype != object and int(d.max()) * len(d) <= LONG else sum(map(int, d))
    return out


def add_up(kept: DataFrame, centroids: list[list[int]]) -> Sums:
    """What the vectors nearest to each centroid sum to."""
    k, dim = len(centroids), len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _zero(k, dim)
        for _, x in _blocks(batches, dim):
            total = _plus(total, _block_sums(x, *nearest(x, centroids), k))
        yield pa.RecordBatch.from_pydict({"part": pa.array([pickle.dumps(total)], pa.binary())})

    parts = kept.mapInArrow(tidy(run), "part binary").rdd.map(lambda row: pickle.loads(row.part))
    return parts.treeAggregate(_zero(k, dim), _plus, _plus)


def starts(kept: DataFrame, k: int, salt: str, dim: int) -> list[list[int]]:
    """The k vectors whose salted ids have the smallest hashes, in ascending order of these."""
    rows = kept.where("vec_id is not null").orderBy(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256), "x").limit(k).collect()
    return [[int(v) for v in np.frombuffer(bytes(row.x), np.float64, dim)] for row in rows]


def fit(kept: DataFrame, k: int = 16, rounds: int = 3, salt: str = "1:", dim: int = 64) -> Model | None:
    """The model after some rounds over the integer vectors; None where no vector can start one."""
    centroids = starts(kept, k, salt, dim)
    if not centroids:
        return None
    for _ in range(rounds):
        counts, sums, _ = add_up(kept, centroids)
        centroids = [[int(s // n) for s in own] if n else old for n, own, old in zip(counts, sums, centroids, strict=True)]
    return Model(centroids, [int(v) for v in add_up(kept, centroids)[2]])


def assign(kept: DataFrame, model: Model | None) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each integer vector."""
    if model is None:
        return kept.sparkSession.createDataFrame([], RESULT)
    digests, inertias, total = model.digests(), _longs(np.array(model.inertias, object)), _longs(np.array([sum(model.inertias)], object))
    dim = len(model.centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches, dim):
            cluster, distance = nearest(x, model.centroids)
            at = pa.array(cluster)
            columns = [ids, at.cast(pa.int32()), _longs(distance), inertias.take(at), total.take(pa.array(np.zeros(len(x), np.int64))), pa.array(digests).take(at)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return kept.mapInArrow(tidy(run), RESULT)


def _longs(values: np.ndarray) -> pa.Array:
    """As 64-bit integers; null beyond."""
    return pa.array([v if v <= LONG else None for v in map(int, values)], pa.int64()) if values.dtype == object else pa.array(values)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: float = 64.0, salt: str = "1:", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Fit and assign; see the module's docstring."""
    kept = cut(integers(vectors, dim, scale, id_col, vector_col))
    return assign(kept, fit(kept, k, rounds, salt, dim))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _round_sql(r: int) -> str:
    """Assignment to the centroids of round r, and the centroids after it."""
    return f"""
a{r} AS MATERIALIZED (SELECT key, vec_id, x, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
  SELECT key, vec_id, x, c, list_sum(list_transform(list_zip(x, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{r}) GROUP BY key, vec_id, x),
s{r} AS (SELECT c, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, 65)) AS i) GROUP BY c, i),
m{r} AS (SELECT c, list((s - (s % n + n) % n) // n ORDER BY i) AS m FROM s{r} GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m{r}.m, c{r}.m) AS m FROM c{r} LEFT JOIN m{r} USING (c))"""


OP11_SQL = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS key, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, x AS m FROM v WHERE vec_id IS NOT NULL ORDER BY c LIMIT 16),
{",".join(_round_sql(r) for r in range(4))}
SELECT vec_id, a3.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a3.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c3.m, ',')) AS centroid_sha256
FROM a3 JOIN c3 ON a3.c = c3.c
"""
