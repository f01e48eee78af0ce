"""Comparison of run artifacts and reports over runs.

An artifact is a record of numbers by name and of edges with reliabilities; a
table of artifacts has one row a run and name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def close(a: Column, b: Column, tol: float) -> Column:
    """Equal within tol; two nulls are equal, one is not."""
    return F.coalesce(F.abs(a - b) <= tol, a.isNull() & b.isNull())


def compare_metrics(one: DataFrame, two: DataFrame, tol: float = 1e-9) -> DataFrame:
    """(metric, a, b, equal) of the metrics (metric, value) that both have."""
    both = one.select("metric", F.col("value").alias("a")).join(two.select("metric", F.col("value").alias("b")), "metric")
    return both.withColumn("equal", close(F.col("a"), F.col("b"), tol))


def compare_edges(one: DataFrame, two: DataFrame, tol: float = 1e-9) -> DataFrame:
    """(id, a, b, equal) of edges (id, reliability) of either side; an edge of one side only is unequal."""
    a = one.select("id", F.col("reliability").alias("a"), F.lit(True).alias("in_a"))
    b = two.select("id", F.col("reliability").alias("b"), F.lit(True).alias("in_b"))
    both = a.join(b, "id", "full")
    return both.select("id", "a", "b", (F.coalesce(F.col("in_a") & F.col("in_b"), F.lit(False)) & close(F.col("a"), F.col("b"), tol)).alias("equal"))


def equal(compared: DataFrame) -> DataFrame:
    """One row: whether all are equal, how many there are and how many differ."""
    return compared.agg(F.coalesce(F.bool_and("equal"), F.lit(True)).alias("ok"), F.count(F.lit(1)).alias("n"), F.count_if(~F.col("equal")).alias("n_different"))


def reliability_series(records: DataFrame) -> DataFrame:
    """(run, seq, mean, lo, hi, n_edges) from edges (run, seq, mean, lo, hi).

    The interval is the mean of the edges' bounds; an edge without bounds stands for its own mean.
    """
    return records.groupBy("run", "seq").agg(
        F.avg("mean").alias("mean"), F.avg(F.coalesce("lo", "mean")).alias("lo"), F.avg(F.coalesce("hi", "mean")).alias("hi"), F.count(F.lit(1)).alias("n_edges")
    )


def latest_by_name(runs: DataFrame) -> DataFrame:
    """Of the rows of one name (name, seq, ...), the last."""
    last = F.row_number().over(W.partitionBy("name").orderBy(F.desc("seq")))
    return runs.withColumn("__rank", last).where("__rank = 1").drop("__rank")


def step_totals(steps: DataFrame) -> DataFrame:
    """(metric, total, n) over step counters in long form (step, metric, value)."""
    return steps.groupBy("metric").agg(F.sum("value").alias("total"), F.count("value").alias("n"))


def latency(times: DataFrame, ps: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """(name, mean, median, p50, p95, ...) of (name, value); percentiles are values that occur, at rank ceil(p n)."""
    out = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)").alias(f"p{round(p * 100)}") for p in ps]
    return times.groupBy("name").agg(F.avg("value").alias("mean"), F.median("value").alias("median"), *out)
