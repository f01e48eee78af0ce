"""Promotion of paths to higher-order edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import AbstractionConfig
from ..functions import ids
from .grow import admit, edge_key


def higher_order(paths: DataFrame, edges: DataFrame, cfg: AbstractionConfig | None = None) -> DataFrame:
    """An edge for each path: head of the path, tails that no edge of the path has as head, observed delays, aggregated reliability.

    Paths without edges or without sources make none.  Paths that carry their
    edges as ``parts``, and the target's rho as ``rho``, are not joined with edges.
    """
    cfg = cfg or AbstractionConfig()
    made = _held(paths, cfg) if "parts" in paths.columns else _gathered(paths, edges, cfg)
    made = made.withColumn("tail", F.array_sort(F.array_distinct(F.array_except("tails", "heads")))).where("size(tail) > 0")
    if "rho" not in made.columns:
        rho = edges.groupBy("head").agg(F.min_by("rho", "id").alias("rho"))
        made = made.join(rho.withColumnRenamed("head", "target"), "target", "left")
    delays = F.transform("tail", lambda v: F.col("target.t") - v["t"])
    return made.select(
        ids.edge_id(F.col("target"), F.col("tail")).alias("id"),
        F.col("target").alias("head"),
        "tail",
        F.array_min(delays).alias("delta_min"),
        F.array_max(delays).alias("delta_max"),
        F.coalesce("rho", F.lit(0).cast("long")).alias("rho"),
        F.greatest(F.lit(cfg.floor), F.least(F.lit(1.0), "r")).alias("reliability"),
        F.lit(0).cast("long").alias("counts_success"),
        F.lit(0).cast("long").alias("counts_miss"),
        F.lit(None).cast("long").alias("last_update_t"),
        F.lit("abstraction").alias("provenance"),
        F.lit(False).alias("frozen"),
        F.col("label").alias("hoe_label"),
        "hoe_from_edges",
    )


def _gathered(paths: DataFrame, edges: DataFrame, cfg: AbstractionConfig) -> DataFrame:
    """(target, label, tails, heads, hoe_from_edges, r) of paths, by their edges' ids."""
    # two hashes stand for a label, which is as long as all ids together; it goes with the first edge only, so that edge must stay
    marks = [F.xxhash64("label").alias("mark"), F.xxhash64(F.lit(1), "label").alias("other")]
    parts = paths.select("target", "label", *marks, F.posexplode("edges").alias("pos", "id"))
    parts = parts.select("target", "mark", "other", F.when(F.col("pos") == 0, F.col("label")).alias("label"), "id")
    parts = parts.join(edges.select("id", "head", "tail", "reliability"), "id", "left")
    parts = parts.repartition("target")  # as rho is, so that what is made isn't shuffled again
    r, own = F.col("reliability"), F.when(F.col("head").isNotNull(), F.col("id"))
    mean = {"min": F.min(r), "mean": F.avg(r), "geo": F.when(F.min(r) <= 0, 0.0).otherwise(F.exp(F.avg(F.log(F.when(r > 0, r)))))}[cfg.reliability]
    made = parts.groupBy("target", "mark", "other").agg(F.max("label").alias("label"), F.flatten(F.collect_list("tail")).alias("tails"), F.collect_list("head").alias("heads"), F.array_sort(F.collect_list(own)).alias("hoe_from_edges"), mean.alias("r"))
    return made.drop("mark", "other")


def _held(paths: DataFrame, cfg: AbstractionConfig) -> DataFrame:
    """The same of paths with parts, row by row, and with their rho if they have it."""
    of = lambda name: F.transform("parts", lambda e: e[name])
    r = F.array_compact(of("reliability"))
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)
    value = {"min": F.array_min(r), "mean": mean(r), "geo": F.when(F.array_min(r) <= 0, 0.0).otherwise(F.exp(mean(F.transform(r, lambda v: F.log(v)))))}[cfg.reliability]
    rho = ["rho"] if "rho" in paths.columns else []
    return paths.where("size(parts) > 0").select("target", "label", F.flatten(of("tail")).alias("tails"), of("head").alias("heads"), F.array_sort(of("id")).alias("hoe_from_edges"), value.alias("r"), *rho)


def _strongest(made: DataFrame) -> DataFrame:
    """Of edges with one head and tails the most reliable, as if those of later paths raised that of the first."""
    first = F.row_number().over(W.partitionBy("key_head", "key_tail").orderBy(F.desc("reliability"), "id"))
    return edge_key(made).withColumn("__rank", first).where("__rank = 1").select(*made.columns)


def promote(paths: DataFrame, edges: DataFrame, cfg: AbstractionConfig | None = None, eps: float = 1e-6) -> DataFrame:
    """edges with the paths' higher-order edges: new ones inserted, known ones raised to the new reliability if above theirs."""
    made = _strongest(higher_order(paths, edges, cfg).select(*edges.columns))
    raised = edge_key(made).groupBy("key_head", "key_tail").agg(F.max("reliability").alias("to"))
    return raise_known(edges, raised, eps).unionByName(admit(edges, made))


def promotions(paths: DataFrame, edges: DataFrame, cfg: AbstractionConfig | None = None, eps: float = 1e-6) -> DataFrame:
    """The rows of promote() that are new or not as in edges."""
    made = _strongest(higher_order(paths, edges, cfg).select(*edges.columns))
    raised = edge_key(made).groupBy("key_head", "key_tail").agg(F.max("reliability").alias("to"))
    up = edge_key(edges).join(raised, ["key_head", "key_tail"]).where(F.col("to") > F.col("reliability") + eps).withColumn("reliability", F.col("to"))
    return up.select(*edges.columns).unionByName(admit(edges, made))


def raise_known(edges: DataFrame, raised: DataFrame, eps: float = 1e-6) -> DataFrame:
    """edges, those of raised (key_head, key_tail, to) at the new reliability if it is above theirs."""
    kept = edge_key(edges).join(raised, ["key_head", "key_tail"], "left").withColumn("reliability", F.when(F.col("to") > F.col("reliability") + eps, F.col("to")).otherwise(F.col("reliability")))
    return kept.select(*edges.columns)


def label_paths(paths: DataFrame, edges: DataFrame, time_resolution: float = 1.0) -> DataFrame:
    """paths with their structural labels, which shifts in time leave alone."""
    # two hashes stand for a label, which is as long as all ids together; the path's own columns go with its first edge only
    marks = [F.xxhash64("label").alias("mark"), F.xxhash64(F.lit(1), "label").alias("other")]
    parts = paths.select("target", *marks, F.struct(*paths.columns).alias("path"), F.posexplode_outer("edges").alias("pos", "id"))
    parts = parts.select("target", "mark", "other", F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("path")).alias("path"), "id")
    parts = parts.join(edges.select("id", "head", "tail"), "id", "left")
    part = F.when(F.col("head").isNotNull(), F.struct("head", "tail"))
    shape = parts.groupBy("target", "mark", "other").agg(F.collect_list("path").alias("paths"), F.collect_list(part).alias("parts"))
    shape = shape.select("paths", ids.structural_label(F.col("target"), F.col("parts"), time_resolution).alias("structure"))
    return shape.select(F.explode("paths").alias("path"), "structure").select("path.*", "structure")
