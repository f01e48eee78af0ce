"""Freezes that expire, three-way decisions and regions.

A freeze is an interval [start, stop) of an edge; what an edge may learn at a
time follows from the intervals alone, so nothing is rewritten when one ends.
For ``review`` after its last freeze an edge learns slowly, unless it is frozen
anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import IsolationConfig
from ..functions.ranking import best

FROZEN, REVIEW, OPEN = "frozen", "review", "open"


def mode(similarity: Column, cfg: IsolationConfig | None = None) -> Column:
    """REUSE from the upper threshold on, ISOLATE up to the lower one, HYBRID between them; an unknown similarity isolates."""
    cfg = cfg or IsolationConfig()
    return F.when(similarity >= cfg.reuse, "REUSE").when(similarity > cfg.isolate, "HYBRID").otherwise("ISOLATE")


def freezes(decisions: DataFrame, edges: DataFrame, now: int, cfg: IsolationConfig | None = None) -> DataFrame:
    """(id, task_id, start, stop) of decisions (task_id, mode) over edges (task_id, id, reliability, uses).

    An edge is the more critical the greater its reliability times its share of
    its task's most used edge.  ISOLATE protects the first protect_share of a
    task's edges, HYBRID hybrid_share of those, both rounded up and at most
    protect_most; REUSE freezes none.
    """
    cfg = cfg or IsolationConfig()
    sizes = edges.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"), F.max("uses").alias("most"))
    share = F.when(F.col("mode") == "ISOLATE", cfg.protect_share).when(F.col("mode") == "HYBRID", cfg.protect_share * cfg.hybrid_share).otherwise(0.0)
    quota = decisions.join(sizes, "task_id").withColumn("quota", F.least(F.lit(cfg.protect_most), F.ceil(F.round(F.col("n") * share, 6)))).where("quota > 0")
    score = F.col("reliability") * F.coalesce(F.col("uses") / F.nullif(F.col("most"), F.lit(0)), F.lit(0.0))
    rows = edges.join(quota.select("task_id", "most", "quota"), "task_id").select("task_id", "id", "quota", score.alias("score"))
    # the quota differs by task, so the best are those that any task may have, ranked once more
    order = [F.desc("score"), F.col("id")]
    top = best(rows, ["task_id"], order, cfg.protect_most, "id").withColumn("rank", F.row_number().over(W.partitionBy("task_id").orderBy(*order)))
    return top.where("rank <= quota").select("id", "task_id", F.lit(now).cast("bigint").alias("start"), F.lit(now + cfg.ttl).cast("bigint").alias("stop"))


def merged(frozen: DataFrame) -> DataFrame:
    """Intervals (id, start, stop) of each edge that touch or overlap, as one; those without length are none."""
    before = W.partitionBy("id").orderBy("start", "stop").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy("id").orderBy("start", "stop")
    rows = frozen.where("start < stop").select("id", "start", "stop").distinct().withColumn("reach", F.max("stop").over(before))
    islands = rows.withColumn("island", F.sum((F.col("reach").isNull() | (F.col("start") > F.col("reach"))).cast("int")).over(upto))
    return islands.groupBy("id", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def states(asked: DataFrame, frozen: DataFrame, cfg: IsolationConfig | None = None) -> DataFrame:
    """asked (id, t, ...) with the edge's state at t: frozen, review or open.

    Merged intervals don't overlap, so the last one that began decides: intervals
    and times are sorted together, and a time takes the interval that it follows.
    """
    cfg = cfg or IsolationConfig()
    names = asked.columns
    kept = F.struct(*names)
    rows = asked.select("id", "t", F.lit(1).alias("kind"), kept.alias("row"), F.lit(None).cast("bigint").alias("stop"))
    whole = merged(frozen).select("id", F.col("start").alias("t"), F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"), "stop")
    last = F.last("stop", ignorenulls=True).over(W.partitionBy("id").orderBy("t", "kind").rowsBetween(W.unboundedPreceding, W.currentRow))
    found = whole.unionByName(rows).withColumn("stop", last).where("kind = 1")
    state = F.when(F.col("t") < F.col("stop"), FROZEN).when(F.col("t") < F.col("stop") + cfg.review, REVIEW).otherwise(OPEN)
    return found.withColumn("state", state).select("row.*", "state")


def alpha(state: Column, usual: float, cfg: IsolationConfig | None = None) -> Column:
    """The step size of learning in a state."""
    cfg = cfg or IsolationConfig()
    return F.when(state == FROZEN, 0.0).when(state == REVIEW, cfg.review_alpha).otherwise(usual)


def spans(edges: DataFrame, regions: DataFrame) -> DataFrame:
    """edges with the region of their head and the number of regions that head and tails have, by regions (n, region); neurons without one are in none."""
    ends = edges.select("id", F.col("head.n").alias("n"), F.lit(True).alias("is_head")).unionByName(edges.select("id", F.explode("tail").alias("v")).select("id", "v.n", F.lit(False).alias("is_head")))
    own = ends.join(regions, "n", "left").groupBy("id").agg(F.max(F.when(F.col("is_head"), F.col("region"))).alias("region"), F.count_distinct("region").alias("span"))
    return edges.join(own, "id")


def within_leak(edges: DataFrame, regions: DataFrame, cfg: IsolationConfig | None = None) -> DataFrame:
    """edges that regions admit: all of one region, and of each head neuron's others the best, up to ``leak`` of its edges, rounded down.

    The best have the greatest reliability less span_penalty for each region beyond the first.
    """
    cfg = cfg or IsolationConfig()
    rows = spans(edges, regions).withColumn("hn", F.col("head.n"))
    rows = rows.withColumn("score", F.col("reliability") - cfg.span_penalty * (F.col("span") - 1))
    sizes = rows.groupBy("hn").agg(F.floor(F.round(F.count(F.lit(1)) * cfg.leak, 6)).alias("quota"))
    order = [F.desc("score"), F.col("id")]
    across = rows.where("span > 1").join(sizes, "hn")
    # numbered in parts by the score's order within each, which a neuron's quota cuts first
    part = F.pmod(F.xxhash64("id"), F.lit(32))
    first = across.withColumn("rank", F.row_number().over(W.partitionBy("hn", part).orderBy(*order))).where("rank <= quota")
    kept = first.withColumn("rank", F.row_number().over(W.partitionBy("hn").orderBy(*order))).where("rank <= quota")
    return rows.where("span <= 1").select(*edges.columns, "region", "span").unionByName(kept.select(*edges.columns, "region", "span"))
