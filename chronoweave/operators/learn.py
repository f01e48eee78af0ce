"""Evidence from paths, reliability updates and pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LearnConfig
from ..functions import ids


def evidence(paths: DataFrame) -> DataFrame:
    """(id, share): the weight of the paths with an edge over the weight of all, the empty path's included."""
    weighted = paths.where("score > 0")
    total = weighted.agg(F.sum("score").alias("total"))
    part = weighted.select(F.explode(F.array_distinct("edges")).alias("id"), "score").groupBy("id").agg(F.sum("score").alias("weight"))
    return part.join(F.broadcast(total), F.lit(True)).select("id", (F.col("weight") / F.col("total")).alias("share"))


def update(edges: DataFrame, paths: DataFrame, sign: int, now_t: int, cfg: LearnConfig | None = None, freeze: bool = False) -> DataFrame:
    """edges after learning from paths; edges on no path stay as they are."""
    cfg = cfg or LearnConfig()
    if cfg.impl == "beta" and (sign == 0 or freeze and cfg.respect_freeze):
        return edges
    with_share = edges.join(evidence(paths), "id", "left")
    touched, s = F.col("share").isNotNull(), F.coalesce("share", F.lit(0.0))
    if cfg.impl == "ema":
        new = ids.clamp(F.col("reliability") * (1 - cfg.ema_alpha) + (F.col("reliability") + s * sign) * cfg.ema_alpha, cfg.clamp_min, cfg.clamp_max)
        up, down = F.lit(1 if sign > 0 else 0), F.lit(0 if sign > 0 else 1)
    else:
        got = s if sign > 0 else s * cfg.share_negative
        a, b = (F.col("counts_success") + cfg.alpha0 + (got if sign > 0 else 0), F.col("counts_miss") + cfg.beta0 + (0 if sign > 0 else got))
        new = ids.clamp(a / (a + b), 0.0, 1.0)
        up, down = (F.bround(got), F.lit(0)) if sign > 0 else (F.lit(0), F.bround(got))
    out = with_share.withColumn("reliability", F.when(touched, new).otherwise(F.col("reliability")))
    out = out.withColumn("counts_success", F.col("counts_success") + F.when(touched, up).otherwise(0).cast("long")).withColumn("counts_miss", F.col("counts_miss") + F.when(touched, down).otherwise(0).cast("long"))
    return out.withColumn("last_update_t", F.when(touched, F.lit(now_t)).otherwise(F.col("last_update_t"))).select(*edges.columns)


def prune(edges: DataFrame, threshold: float) -> DataFrame:
    """Edges that stay: reliability not below the threshold."""
    return edges.where(F.col("reliability") >= threshold)


def pruned(edges: DataFrame, threshold: float) -> DataFrame:
    """Edges that prune() takes."""
    return edges.where(F.col("reliability") < threshold)


def latest(edges: DataFrame, max_edges: int = 10) -> DataFrame:
    """The edges updated last, then the most reliable."""
    return edges.orderBy(F.desc(F.coalesce("last_update_t", F.lit(-1))), F.desc("reliability"), "id").limit(max(0, max_edges))


def summarize(edges: DataFrame, max_edges: int = 10, alpha0: float = 1.0, beta0: float = 1.0) -> DataFrame:
    """The latest updated edges with their posterior means."""
    mean = ids.posterior_mean(F.col("counts_success"), F.col("counts_miss"), alpha0, beta0)
    return latest(edges, max_edges).select("id", mean.alias("mean"), (F.col("counts_success") + alpha0).alias("alpha"), (F.col("counts_miss") + beta0).alias("beta"))
