"""Predictions that wait for their head: watchers, and how they end.

A pattern says that after an event of neuron ``pre`` one of neuron ``n`` follows
within [delay_min, delay_max], none of which is negative.  Each event of ``pre`` opens a watcher, named by
its edge and time.  It is confirmed by the first event of its head neuron from
``open`` to ``close``, both included, and missed once the watermark has reached
``close`` without one; until then it is pending.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.asof import first_within

WATCHER = "edge string, n bigint, at bigint, open bigint, close bigint, weight double"
PENDING, CONFIRMED, MISSED = "pending", "confirmed", "missed"


def watchers(events: DataFrame, patterns: DataFrame) -> DataFrame:
    """(edge, n, at, open, close, weight) of events (n, t) by patterns (edge, pre, n, delay_min, delay_max); one of each edge and time."""
    seen = events.select(F.col("n").alias("pre"), F.col("t").alias("at")).distinct()
    made = seen.join(patterns, "pre").select("edge", patterns["n"], "at", (F.col("at") + F.col("delay_min")).alias("open"), (F.col("at") + F.col("delay_max")).alias("close"), F.lit(1.0).alias("weight"))
    return made.where("open >= at AND close >= open").dropDuplicates(["edge", "at"])


def outcomes(watching: DataFrame, events: DataFrame, watermark: int | None = None) -> DataFrame:
    """watching (WATCHER) with status and resolved_at; the watermark is the last event's time unless given."""
    if watermark is None:
        watermark = events.agg(F.max("t")).first()[0]
    found = first_within(watching.select("edge", "n", "at", "open", "close", "weight"), events.select("n", "t"), ["n"])
    confirmed, over = F.col("hit").isNotNull(), F.lit(watermark is not None) & (F.col("close") <= F.lit(watermark))
    status = F.when(confirmed, CONFIRMED).when(over, MISSED).otherwise(PENDING)
    return found.select("edge", "n", "at", "open", "close", "weight", status.alias("status"), F.when(confirmed, F.col("hit")).when(over, F.col("close")).alias("resolved_at"))
