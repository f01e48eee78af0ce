"""A sampled beam search back from targets, reproducible and distributed.

At each level a state draws up to ``branch`` edges without replacement, with
chances that follow the softmax of its candidates' scores: each gets its score
over the temperature plus a Gumbel number, and the greatest are drawn.  The
Gumbel number comes from a digest of the seed, the target, the path so far and
the edge, so a run on any number of tasks, or a task run again, draws the same.
The best ``beam_size`` states of each target go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import WalkConfig
from ..functions import ids
from ..functions.lineage import cut
from ..functions.ranking import best
from .grow import connected

DIGITS = 13  # hex digits of a digest that make a number, 52 bits


def uniform(*parts: Column) -> Column:
    """A number above 0 and below 1 from the digest of the parts' text, joined by bars."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, DIGITS), 16, 10).cast("double")
    return (drawn + 0.5) / float(16**DIGITS)


def gumbel(u: Column) -> Column:
    return -F.log(-F.log(u))


def score(age: Column, cfg: WalkConfig) -> Column:
    """Of a candidate edge with reliability, rule and similar, and its head's age."""
    return cfg.w_reliability * F.log("reliability") + cfg.w_recent * F.exp(-cfg.lambda_recent * age) + cfg.w_rule * F.col("rule") + cfg.w_similar * F.col("similar")


def usable(edges: DataFrame, cfg: WalkConfig) -> DataFrame:
    """Candidates by head vertex, its most reliable incoming_cap; edges may have rule and similar, each from 0 to 1, and of no reliability none is drawn."""
    more = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in edges.columns else F.lit(0.0).alias(c) for c in ("rule", "similar")]
    tail = F.array_sort(F.transform("tail", lambda v: F.struct(v["t"].alias("t"), v["n"].alias("n"))))
    rows = edges.where("reliability > 0").select(F.col("head.n").alias("hn"), F.col("head.t").alias("ht"), F.col("id").alias("edge"), tail.alias("new"), "reliability", *more)
    return best(rows, ["hn", "ht"], [F.desc("reliability"), F.col("edge")], cfg.incoming_cap, "edge")


def _fits(cfg: WalkConfig) -> Column:
    """Whether a candidate enters a state's vertex v and starts within the target's horizon."""
    fits = (F.col("v.n") == F.col("hn")) & (F.col("v.t") == F.col("ht"))
    return fits & (F.col("target.t") - F.get(F.col("new"), F.lit(0))["t"] <= cfg.horizon) if cfg.horizon > 0 else fits


def walk(edges: DataFrame, vertices: DataFrame, targets: DataFrame, cfg: WalkConfig | None = None, checked: bool = False, closing: bool = False) -> DataFrame:
    """(target, edges, score, length, label) of the best drawn path of each target and label.

    A state expands the latest-added vertex of its frontier, as in traverse();
    one whose vertex has no candidate within the horizon ends as a path, and what
    is open after ``depth`` levels is given up; ``closing`` looks at the states
    that the last level grew once more, and those that end there are paths too.
    ``checked`` edges are known to have all their tail vertices.
    """
    cfg = cfg or WalkConfig()
    given = cut(usable(edges if checked else connected(edges, vertices), cfg))
    target = F.struct("n", "t")
    beam = cut(targets.select("n", "t").distinct().select(target.alias("target"), F.array(F.struct("t", "n")).alias("frontier"), F.expr("cast(array() as array<string>)").alias("edges"), F.lit(1.0).alias("score")))
    done: list[DataFrame] = []
    drawn = W.partitionBy("target", "edges").orderBy(F.desc("draw"), "edge")
    order = W.partitionBy("target", "ends").orderBy(F.desc("score"), "edges")
    for _ in range(cfg.depth + 1):
        at = beam.withColumn("v", F.element_at("frontier", -1))
        u = uniform(F.lit(str(cfg.seed)), ids.vertex_id(F.col("target")), F.array_join("edges", ","), F.col("edge"))
        chance = score(F.col("target.t") - F.col("ht"), cfg) / cfg.temperature + gumbel(u)
        tried = at.join(given, _fits(cfg), "left").withColumn("ends", F.col("edge").isNull()).withColumn("draw", F.when(~F.col("ends"), chance))
        taken = tried.withColumn("turn", F.row_number().over(drawn)).where(F.col("ends") | (F.col("turn") <= cfg.branch))
        grown = taken.select(
            "target",
            F.when(~F.col("ends"), F.array_union(F.array_remove("frontier", F.col("v")), F.col("new"))).alias("frontier"),
            F.when(~F.col("ends"), F.array_append("edges", F.col("edge"))).otherwise(F.col("edges")).alias("edges"),
            (F.col("score") * F.coalesce("reliability", F.lit(1.0))).alias("score"),
            "ends",
        )
        step = cut(grown.withColumn("rank", F.row_number().over(order)).where(F.col("ends") | (F.col("rank") <= cfg.beam_size)).drop("rank"))
        done.append(step.where("ends").select("target", "edges", "score"))
        beam = step.where("not ends").select("target", "frontier", "edges", "score")
        if beam.isEmpty():
            break
    else:
        if closing:
            at = beam.withColumn("v", F.element_at("frontier", -1))
            done.append(cut(at.join(given, _fits(cfg), "left_anti").select("target", "edges", "score")))
    paths = done[0]
    for more in done[1:]:
        paths = paths.unionByName(more)
    # a path has an edge a level at most; the JVM's pow() may miss the nearest double
    penalty = F.get(F.array(*(F.lit(float(cfg.length_penalty_base**k)) for k in range(cfg.depth + 2))), F.size("edges"))
    paths = paths.withColumn("length", F.size("edges")).withColumn("label", ids.path_label(F.col("edges"))).withColumn("score", F.col("score") * penalty)
    top = F.row_number().over(W.partitionBy("target", "label").orderBy(F.desc("score"), "edges"))
    return paths.withColumn("rank", top).where("rank = 1").select("target", "edges", "score", "length", "label")
