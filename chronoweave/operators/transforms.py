"""Event transforms.  Events have n (neuron), t (time) and any other columns, which pass through."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def time_window(events: DataFrame, t0: int, t1: int) -> DataFrame:
    """Closed window; empty if t1 < t0."""
    return events.where(F.col("t").between(t0, t1))


def neuron_filter(events: DataFrame, allow: DataFrame | list[int] | None = None, deny: DataFrame | list[int] | None = None) -> DataFrame:
    """Allow list, then deny list; a DataFrame with column n is joined, a short list is a predicate."""
    for given, kind in ((allow, "left_semi"), (deny, "left_anti")):
        if isinstance(given, DataFrame):
            events = events.join(given.select("n"), "n", kind)
        elif given is not None:
            events = events.where(F.col("n").isin(list(given)) if kind == "left_semi" else ~F.col("n").isin(list(given)))
    return events


def time_normalize(events: DataFrame, t0: int | None = None) -> DataFrame:
    """Times less t0, by default the first time."""
    if t0 is None:
        t0 = events.agg(F.min("t")).first()[0] or 0
    return events.withColumn("t", F.col("t") - F.lit(t0))


def sort_events(events: DataFrame) -> DataFrame:
    return events.orderBy("t", "n")


def global_rank(events: DataFrame, *order: str) -> DataFrame:
    """events with ``rank``, from 0, in a total order: ranges of the first column, counted, then ranked inside.

    No task sees more than one range, unlike a window without partitions.
    """
    spark = events.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(events.approxQuantile(order[0], [i / n for i in range(1, n)], 0.01))) if n > 1 else []
    part = F.lit(0)
    for c in cuts:
        part = part + (F.col(order[0]) > F.lit(c)).cast("int")
    parted = events.withColumn("__part", part)
    counts = {r["__part"]: r["n"] for r in parted.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for i in range(len(cuts) + 1):
        before.append(F.lit(total).cast("long"))
        total += counts.get(i, 0)
    inside = F.row_number().over(W.partitionBy("__part").orderBy(*order)) - 1
    return parted.withColumn("rank", F.get(F.array(*before), F.col("__part")) + inside).drop("__part")


def subsample(events: DataFrame, stride: int) -> DataFrame:
    """Every stride-th event in the order of (t, n); unchanged if stride <= 1."""
    if stride <= 1:
        return events
    return global_rank(events, "t", "n").where(F.col("rank") % stride == 0).drop("rank")


def bin_index(t0: int, width: int, t=None):
    return F.floor(((F.col("t") if t is None else t) - t0) / width).cast("long")


def chunk_by_bins(events: DataFrame, t0: int, t1: int, width: int) -> DataFrame:
    """(bin, events sorted by t, n) of the closed window."""
    inside = time_window(events, t0, t1).withColumn("bin", bin_index(t0, width))
    return inside.groupBy("bin").agg(F.array_sort(F.collect_list(F.struct("t", "n"))).alias("events"))


def bin_counts(events: DataFrame, t0: int, t1: int, width: int) -> DataFrame:
    """The bins' sizes and bounds, for bins too large to hold."""
    return time_window(events, t0, t1).withColumn("bin", bin_index(t0, width)).groupBy("bin").agg(F.count(F.lit(1)).alias("n_events"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def sliding_windows(events: DataFrame, size: int, step: int, t0: int, t1: int) -> DataFrame:
    """(start, stop, n_events, first_t, last_t) of windows closed at both ends; empty ones stand too.

    Each event names the windows it falls in, so the join is an aggregation.
    """
    spark = events.sparkSession
    starts = spark.range(t0, t1 + 1, step).select(F.col("id").alias("start"), F.least(F.lit(t1), F.col("id") + size).alias("stop"))
    low = F.greatest(F.lit(0), F.ceil((F.col("t") - t0 - size) / step)).cast("long")
    high = F.floor((F.col("t") - t0) / step).cast("long")
    own = time_window(events, t0, t1).where(low <= high).select("t", F.explode(F.sequence(low, high)).alias("k"))
    found = own.groupBy((F.col("k") * step + t0).alias("start")).agg(F.count(F.lit(1)).alias("n_events"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    return starts.join(found, "start", "left").withColumn("n_events", F.coalesce("n_events", F.lit(0).cast("long")))
