"""Ordered, time-gapped templates over events, their versions, and templates made of templates.

A template is a list of steps.  A match begins with an event of the first step's
kind; each further step takes the first event of its kind, of the same neuron,
within its gap after the step before.  The version that counts is the one in
force when the match begins.  A match is itself an event of kind ``T:template``
at its last step, of which templates of a higher level are made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import ids
from ..functions.asof import first_within
from ..functions.lineage import cut

TEMPLATE = "template string, version int, level int, valid_from bigint, step int, kind string, gap_min bigint, gap_max bigint"
MATCH = "template string, version int, level int, n bigint, start bigint, stop bigint, times array<bigint>"
PREFIX = "T:"


def _versions(templates: DataFrame) -> DataFrame:
    """First steps, each with the time at which its template's next version replaces it."""
    after = F.lead("valid_from").over(W.partitionBy("template").orderBy("valid_from", "version"))
    return templates.where("step = 0").select("template", "version", "level", "kind", "valid_from", after.alias("valid_to"))


def matches(events: DataFrame, templates: DataFrame) -> DataFrame:
    """MATCH rows of events (n, kind, t) and templates (TEMPLATE), all of one level or another.

    All templates grow together, a step at a time, by one sort of the step's
    states and events; states that find no event are gone.
    """
    first = _versions(templates)
    began = events.select("n", "kind", "t").distinct().join(first, "kind").where("t >= valid_from AND (valid_to IS NULL OR t < valid_to)")
    steps = templates.groupBy("template", "version").agg(F.max("step").alias("last"))
    state = cut(began.join(steps, ["template", "version"]).select("template", "version", "level", "n", F.array("t").alias("times"), "last"))
    done = [state.where("last = 0")]
    longest = templates.agg(F.max("step")).first()[0] or 0
    for step in range(1, longest + 1):
        wanted = templates.where(F.col("step") == step).select("template", "version", "kind", "gap_min", "gap_max")
        at = F.element_at("times", -1)
        asked = state.where(F.col("last") >= step).join(wanted, ["template", "version"]).select("template", "version", "level", "n", "times", "last", "kind", (at + F.col("gap_min")).alias("open"), (at + F.col("gap_max")).alias("close"))
        found = first_within(asked.where("close >= open"), events.select("n", "kind", "t"), ["n", "kind"]).where("hit IS NOT NULL")
        state = cut(found.select("template", "version", "level", "n", F.array_append("times", F.col("hit")).alias("times"), "last"))
        done.append(state.where(F.col("last") == step))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("template", "version", "level", "n", F.get("times", F.lit(0)).alias("start"), F.element_at("times", -1).alias("stop"), "times")


def as_events(found: DataFrame) -> DataFrame:
    """Matches as events (n, kind, t); several that end together are one."""
    return found.select("n", F.concat(F.lit(PREFIX), "template").alias("kind"), F.col("stop").alias("t")).distinct()


def composed(events: DataFrame, templates: DataFrame) -> DataFrame:
    """MATCH rows of all levels, each over the events and the matches of the levels below."""
    levels = [r[0] for r in templates.select("level").distinct().orderBy("level").collect()]
    seen, out = events.select("n", "kind", "t"), None
    for level in levels:
        found = cut(matches(seen, templates.where(F.col("level") == level)))
        seen = seen.unionByName(as_events(found))
        out = found if out is None else out.unionByName(found)
    return out if out is not None else events.sparkSession.createDataFrame([], MATCH)


def as_edges(found: DataFrame, reliability: float = 0.1) -> DataFrame:
    """A higher-order edge for each match of more than one time: from all its earlier events to its last."""
    rows = found.withColumn("before", F.array_distinct(F.filter("times", lambda t: t < F.col("stop")))).where("size(before) > 0")
    head, tail = F.struct("n", F.col("stop").alias("t")), F.transform("before", lambda t: F.struct(F.col("n").alias("n"), t.alias("t")))
    made = rows.select(
        ids.edge_id(head, tail).alias("id"), head.alias("head"), tail.alias("tail"), (F.col("stop") - F.array_max("before")).alias("delta_min"), (F.col("stop") - F.array_min("before")).alias("delta_max"), F.lit(0).cast("bigint").alias("rho"),
        F.lit(reliability).alias("reliability"), F.lit(0).cast("bigint").alias("counts_success"), F.lit(0).cast("bigint").alias("counts_miss"), F.lit(None).cast("bigint").alias("last_update_t"),
        F.concat(F.lit("template:"), "template", F.lit("@"), F.col("version").cast("string")).alias("provenance"), F.lit(False).alias("frozen"),
    )
    one = F.row_number().over(W.partitionBy("id").orderBy("provenance"))
    return made.withColumn("__rank", one).where("__rank = 1").drop("__rank")
