"""Scores of candidate edges by the closeness of their delays, and conflicts between close heads of one neuron.

Of the heads of a neuron that lie within ``rho`` of each other the one with the
greater score stays, of equal ones the earlier; a head that stays takes all others
within rho, and a head that none takes stays.  That is the choice of going through
all heads by score.  It is made for all neurons at once in rounds: what beats all
that is undecided within rho stays, what is near it goes, and the rest go on.
Each round decides the best head of every run of undecided ones, and a busy
neuron is spread over buckets of time that overlap by rho.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.lineage import cut

#: width of a bucket, in rho
BUCKET = 64
#: digits to which scores count, so that the order doesn't hang on the last bits of sums
DIGITS = 9


def coherent(tail: Column, delta: int) -> Column:
    """The tail's times lie within delta of each other."""
    times = F.transform(tail, lambda v: v["t"])
    return F.array_max(times) - F.array_min(times) <= delta


def priority(head_t: Column, tail: Column, delay_min: int, delay_max: int, k_max: int, w_delay: float = 0.7, w_size: float = 0.3) -> Column:
    """w_delay times the mean closeness of delays to the middle of their window, and w_size times what the size is short of k_max."""
    middle, span = (delay_min + delay_max) / 2, max(1, delay_max - delay_min)
    near = F.transform(tail, lambda v: 1.0 - F.abs(head_t - v["t"] - middle) / span)
    closeness = F.aggregate(near, F.lit(0.0), lambda a, x: a + x) / F.size(tail)
    return F.round(w_delay * closeness + w_size * (1 - F.size(tail) / k_max), DIGITS)


def _beaten(rows: DataFrame, rho: int, of: Column) -> DataFrame:
    """rows (n, t, ...) with ``best``, the greatest of a struct over the rows of the neuron within rho, itself included."""
    width = max(1, BUCKET * rho)
    bucket = lambda x: F.floor(x / width).cast("long")
    spread = rows.withColumn("__bucket", F.explode(F.array_distinct(F.array(bucket(F.col("t") - rho), bucket(F.col("t")), bucket(F.col("t") + rho)))))
    near = W.partitionBy("n", "__bucket").orderBy("t").rangeBetween(-rho, rho)
    return spread.withColumn("best", F.max(of).over(near)).where(F.col("__bucket") == bucket(F.col("t"))).drop("__bucket")


def resolve(heads: DataFrame, rho: int) -> DataFrame:
    """The heads (n, t) of heads (n, t, score) that stay; repeated ones count once, by their best score."""
    undecided = cut(heads.groupBy("n", "t").agg(F.max("score").alias("score")))
    if rho <= 0:
        return undecided.select("n", "t")
    own = F.struct("score", (-F.col("t")).alias("early"))
    stays: list[DataFrame] = []
    while not undecided.isEmpty():
        judged = _beaten(undecided, rho, own).withColumn("stays", F.col("best") == own).drop("best")
        told = cut(_beaten(judged, rho, F.struct(F.col("stays").alias("near"))).select("n", "t", "score", "stays", F.col("best.near").alias("near")))
        stays.append(told.where("stays").select("n", "t"))
        undecided = told.where("NOT near").select("n", "t", "score")
    out = heads.select("n", "t").limit(0)
    for part in stays:
        out = out.unionByName(part)
    return out


def admitted(edges: DataFrame, score: Column, rho: int) -> DataFrame:
    """edges without those whose head is taken by another of its neuron; a head counts by the best of its edges."""
    heads = edges.select(F.col("head.n").alias("n"), F.col("head.t").alias("t"), score.alias("score"))
    kept = resolve(heads, rho)
    return edges.join(kept, (F.col("head.n") == kept["n"]) & (F.col("head.t") == kept["t"]), "left_semi")
