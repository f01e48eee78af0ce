"""Counts and reliabilities that fade with time, kept as of their last touch and evaluated in closed form.

Nothing is rewritten as time goes by: a count or a reliability is stored with
the time to which it holds, and what it is now follows from the time since.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DecayConfig
from ..functions import ids
from ..functions.lineage import cut
from ..functions.ranking import best
from . import watch


def _fade(share: float, since: Column, unit: int) -> Column:
    """share to the power of the time since, in units; time that hasn't come counts as none."""
    return F.pow(F.lit(share), F.greatest(since, F.lit(0)) / unit)


def counts(outcomes: DataFrame, now: int, cfg: DecayConfig | None = None) -> DataFrame:
    """(edge, pos, neg, uses, as_of) of resolved watchers, discounted to now; added up before they are shuffled."""
    cfg = cfg or DecayConfig()
    weight = F.col("weight") * _fade(cfg.count_keep, F.lit(now) - F.col("resolved_at"), cfg.unit)
    done = outcomes.where(F.col("status").isin(watch.CONFIRMED, watch.MISSED))
    total = lambda status: F.sum(F.when(F.col("status") == status, weight).otherwise(0.0))
    return done.groupBy("edge").agg(total(watch.CONFIRMED).alias("pos"), total(watch.MISSED).alias("neg"), F.count(F.lit(1)).alias("uses")).withColumn("as_of", F.lit(now).cast("long"))


def merged(old: DataFrame, new: DataFrame, cfg: DecayConfig | None = None) -> DataFrame:
    """Counts (edge, pos, neg, uses, as_of) of both, each edge's as of the later of its two times."""
    cfg = cfg or DecayConfig()
    both = old.alias("o").join(new.alias("w"), F.col("o.edge") == F.col("w.edge"), "full")
    at = F.greatest("o.as_of", "w.as_of")
    faded = lambda name: sum((F.coalesce(F.col(f"{x}.{name}") * _fade(cfg.count_keep, at - F.col(f"{x}.as_of"), cfg.unit), F.lit(0.0)) for x in "ow"), F.lit(0.0))
    uses = F.coalesce("o.uses", F.lit(0)) + F.coalesce("w.uses", F.lit(0))
    return both.select(F.coalesce("o.edge", "w.edge").alias("edge"), faded("pos").alias("pos"), faded("neg").alias("neg"), uses.alias("uses"), at.alias("as_of"))


def reliability_at(now: int, cfg: DecayConfig | None = None) -> Column:
    """An edge's reliability now: relaxed toward the prior since it was last updated, or since its head; a frozen one stays."""
    cfg = cfg or DecayConfig()
    since = F.lit(now) - F.coalesce("last_update_t", "head.t")
    relaxed = F.lit(cfg.prior) + (F.col("reliability") - cfg.prior) * _fade(1 - cfg.relax, since, cfg.unit)
    return F.when(F.col("frozen"), F.col("reliability")).otherwise(relaxed)


def as_of(edges: DataFrame, now: int, cfg: DecayConfig | None = None) -> DataFrame:
    """edges with their reliabilities now."""
    return edges.withColumn("reliability", reliability_at(now, cfg))


def learn(edges: DataFrame, local: DataFrame, now: int, cfg: DecayConfig | None = None, paths: DataFrame | None = None) -> DataFrame:
    """edges after their counts local (edge, pos, neg, ...), discounted to now, and the evidence of paths (id, share), if given.

    The target is pos / (pos + neg + stabilizer), blended with the paths' share
    where an edge has one; an edge with neither only relaxes with time, at
    read, and its row stays as it is.  Frozen edges stay.
    """
    cfg = cfg or DecayConfig()
    rows = edges.join(local.select(F.col("edge").alias("id"), *(F.col(c).alias(f"__{c}") for c in ("pos", "neg", "as_of"))), "id", "left")
    rows = rows.join(paths.select("id", F.col("share").alias("__share")), "id", "left") if paths is not None else rows.withColumn("__share", F.lit(None).cast("double"))
    keep = _fade(cfg.count_keep, F.lit(now) - F.col("__as_of"), cfg.unit)
    pos, neg = F.col("__pos") * keep, F.col("__neg") * keep
    own = pos / (pos + neg + cfg.stabilizer)
    both = F.when(F.col("__share").isNull(), own).when(own.isNull(), F.col("__share")).otherwise(cfg.path_share * F.col("__share") + (1 - cfg.path_share) * own)
    new = ids.clamp((1 - cfg.alpha) * reliability_at(now, cfg) + cfg.alpha * both, cfg.reliability_min, cfg.reliability_max)
    touched = both.isNotNull() & ~F.col("frozen")
    rows = rows.withColumn("__new", F.when(touched, new)).withColumn("reliability", F.coalesce("__new", "reliability"))
    return rows.withColumn("last_update_t", F.when(F.col("__new").isNotNull(), F.lit(now).cast("long")).otherwise(F.col("last_update_t"))).select(*edges.columns)


def evicted(edges: DataFrame, keep: int, score: Column) -> DataFrame:
    """Edges (id) beyond the best ``keep`` of each head neuron; equal scores go by id."""
    rows = cut(edges.select("id", F.col("head.n").alias("n"), score.alias("score")))
    return rows.join(best(rows, ["n"], [F.desc("score"), F.col("id")], keep, "id").select("id"), "id", "left_anti").select("id")


def pruned(edges: DataFrame, now: int, cfg: DecayConfig | None = None) -> DataFrame:
    """(id, reason) of the edges to go: threshold, else idle, else budget; frozen ones stay.

    threshold: the reliability now is below the threshold, and the edge is not
    fresh, that is, neither younger than prune_age nor used less than prune_uses.
    idle: not updated, or made, within ``idle``; edges of abstractions stay.
    budget: beyond the head's best by reliability times exp(-age_lambda age).
    """
    cfg = cfg or DecayConfig()
    age = F.lit(now) - F.col("head.t")
    rows = as_of(edges.where("not frozen"), now, cfg)
    fresh = (age < cfg.prune_age) | (F.col("counts_success") + F.col("counts_miss") < cfg.prune_uses)
    weak = (F.col("reliability") < cfg.prune_threshold) & ~fresh
    still = (F.lit(now) - F.coalesce("last_update_t", "head.t") > cfg.idle) & (F.col("provenance") != "abstraction")
    rows = rows.withColumn("reason", F.when(weak, "threshold").when(still, "idle"))
    over = evicted(rows.where("reason is null"), cfg.budget_per_head, F.col("reliability") * F.exp(-cfg.age_lambda * age / cfg.unit))
    return rows.where("reason is not null").select("id", "reason").unionByName(over.withColumn("reason", F.lit("budget")))
