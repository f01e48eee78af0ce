"""Encoders of events as sparse spikes (bin, col, n, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .transforms import bin_index, global_rank, time_window


def n_bins(t0: int, t1: int, width: int) -> int:
    return max(0, (t1 - t0) // width + 1)


def neuron_columns(events: DataFrame, n_baseline: int = 0) -> DataFrame:
    """(n, col): the neurons seen, and the ids below n_baseline, numbered in order."""
    seen = events.select("n").distinct()
    if n_baseline:
        seen = seen.unionByName(events.sparkSession.range(n_baseline).select(F.col("id").alias("n"))).distinct()
    return global_rank(seen, "n").select("n", F.col("rank").cast("long").alias("col"))


def binner(events: DataFrame, t0: int, t1: int, width: int, binary: bool = True) -> DataFrame:
    """Spikes a bin and neuron; only neurons seen in the window have columns."""
    inside = time_window(events, t0, t1)
    count = F.count(F.lit(1)).cast("double")
    cells = inside.groupBy(bin_index(t0, width).alias("bin"), "n").agg((F.least(F.lit(1.0), count) if binary else count).alias("value"))
    return cells.join(neuron_columns(inside), "n").select("bin", "col", "n", "value")


def latency(events: DataFrame, t0: int, t1: int, width: int, clamp: bool = True, n_baseline: int = 0) -> DataFrame:
    """One spike a neuron, at the bin of its first event; first events outside are clamped or left out."""
    first = events.groupBy("n").agg(F.min("t").alias("t"))
    first = first.withColumn("t", F.greatest(F.lit(t0), F.least(F.lit(t1), "t"))) if clamp else time_window(first, t0, t1)
    return first.join(neuron_columns(events, n_baseline), "n").select(bin_index(t0, width).alias("bin"), "col", "n", F.lit(1.0).alias("value"))


def rate(events: DataFrame, t0: int, t1: int, width: int, normalize: bool = True, n_baseline: int = 0) -> DataFrame:
    """Counts a bin and neuron, over the neuron's largest if normalised."""
    cells = time_window(events, t0, t1).groupBy(bin_index(t0, width).alias("bin"), "n").agg(F.count(F.lit(1)).cast("double").alias("value"))
    if normalize:
        cells = cells.withColumn("value", F.col("value") / F.max("value").over(W.partitionBy("n")))
    return cells.join(neuron_columns(events, n_baseline), "n").select("bin", "col", "n", "value")


def rate_summary(events: DataFrame, t0: int, t1: int) -> DataFrame:
    return time_window(events, t0, t1).groupBy("n").agg(F.count(F.lit(1)).alias("total"))


def poisson(rates: DataFrame, seed: int = 0) -> DataFrame:
    """Spikes drawn with each cell's rate as probability; the draw depends on the cell and the seed alone."""
    draw = (F.pmod(F.xxhash64("bin", "n", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)).cast("double")
    return rates.where(draw < F.least(F.lit(1.0), "value")).withColumn("value", F.lit(1.0))


ENCODERS = {"binner": binner, "simple": binner, "latency": latency, "rate": rate}


def get_encoder(name: str):
    if name not in ENCODERS:
        raise ValueError(f"no such encoder: {name}")
    return ENCODERS[name]
