"""Backward beam search from targets over incoming hyperedges, all targets at once, a join a level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import TraverseConfig
from ..functions import ids
from ..functions.lineage import bucketed, cut, drop
from .grow import connected


def within(edges: DataFrame, targets: DataFrame, cfg: TraverseConfig) -> DataFrame:
    """Edges all of whose tails some target's horizon reaches; of those a search can take none is left out."""
    if cfg.horizon <= 0:
        return edges
    first = targets.agg(F.min("t")).first()[0]
    return edges.limit(0) if first is None else edges.where(F.forall("tail", lambda v: v["t"] >= first - cfg.horizon))


def traverse(edges: DataFrame, vertices: DataFrame, targets: DataFrame, cfg: TraverseConfig | None = None, checked: bool = False) -> DataFrame:
    """(target, edges, score, length, label) of the best path of each target and label.

    A state expands the latest-added vertex of its frontier; new tails join it in
    order of time, those it holds already don't.  A state whose vertex has no
    edge within the horizon ends as a path, the empty one included.  Ties of
    the beam go by the list of edges.  ``checked`` edges are known to have all
    their tail vertices.  Edges with a tail beyond the horizon of every target
    are left out before any of it; the others are dealt by their heads once, not
    a level.
    """
    cfg = cfg or TraverseConfig()
    usable = within(edges, targets, cfg)
    usable = usable if checked else connected(usable, vertices)
    usable, table = bucketed(usable.select(F.col("head.n").alias("hn"), F.col("head.t").alias("ht"), F.col("id").alias("edge"), F.array_sort(F.transform("tail", lambda v: F.struct(v["t"].alias("t"), v["n"].alias("n")))).alias("new"), "reliability"), "hn", "ht")
    target = F.struct("n", "t")
    beam = targets.select("n", "t").distinct().select(target.alias("target"), F.array(F.struct("t", "n")).alias("frontier"), F.expr("cast(array() as array<string>)").alias("edges"), F.lit(1.0).alias("score"))
    beam, done = cut(beam), []
    levels = max(1, 8 * cfg.beam_size) if cfg.beam_size > 0 else 0
    order = W.partitionBy("target", "ends").orderBy(F.desc("score"), "edges")
    # paths of one label have one length, so they end in one level
    final = F.col("score") * F.pow(F.lit(cfg.length_penalty_base), F.size("edges"))
    best = W.partitionBy("target", "ends", "label").orderBy(F.desc("final"), "edges")
    for _ in range(levels):
        at = beam.withColumn("v", F.element_at("frontier", -1))
        fits = (F.col("v.n") == F.col("hn")) & (F.col("v.t") == F.col("ht"))
        if cfg.horizon > 0:
            fits &= F.col("target.t") - F.get(F.col("new"), F.lit(0))["t"] <= cfg.horizon
        # a state with no fitting edge comes out of the left join once, and ends as a path
        grown = at.join(usable, fits, "left").select(
            "target",
            F.when(F.col("edge").isNotNull(), F.array_union(F.array_remove("frontier", F.col("v")), F.col("new"))).alias("frontier"),
            F.when(F.col("edge").isNotNull(), F.array_append("edges", F.col("edge"))).otherwise(F.col("edges")).alias("edges"),
            (F.col("score") * F.coalesce("reliability", F.lit(1.0))).alias("score"),
            F.col("edge").isNull().alias("ends"),
        )
        kept = grown.withColumn("rank", F.row_number().over(order)).where(F.col("ends") | (F.col("rank") <= cfg.beam_size))
        kept = kept.withColumn("label", F.when(F.col("ends"), ids.path_label(F.col("edges")))).withColumn("final", final)
        step = cut(kept.withColumn("rank", F.row_number().over(best)).where(~F.col("ends") | (F.col("rank") == 1)).drop("rank", "label", "final"))
        done.append(step.where("ends").select("target", "edges", final.alias("score")))
        beam = step.where("not ends").select("target", "frontier", "edges", "score")
        if beam.isEmpty():
            break
    drop(beam, usable)
    edges.sparkSession.sql(f"DROP TABLE {table}")
    if not done:
        return beam.limit(0).select("target", "edges", "score", F.size("edges").alias("length"), ids.path_label(F.col("edges")).alias("label"))
    paths = done[0]
    for more in done[1:]:
        paths = paths.unionByName(more)
    return paths.select("target", "edges", "score", F.size("edges").alias("length"), ids.path_label(F.col("edges")).alias("label"))
