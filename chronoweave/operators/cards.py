"""Rule cards of promoted labels: how reliable a path is as a rule.

A card's reliability is the distribution of the product of its edges' Beta
posteriors.  The mean is exact, the product of posterior means; the interval is
sampled.  It depends on the edges' counts alone, so a task samples it once for
each set of counts, not for each path, from generators seeded by the counts:
reruns agree on any number of tasks, and so do paths with equal counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CardConfig
from ..functions import ids


def rule_id(label: Column, edges: Column) -> Column:
    """First 16 hex digits of SHA-256 over the label and the edge ids, joined by bars."""
    return F.substring(F.sha2(F.concat_ws("|", label, edges), 256), 1, 16)


def _seed(*parts: object) -> int:
    return int.from_bytes(hashlib.sha256("|".join(map(str, parts)).encode()).digest()[:8], "little")


KEPT = 1 << 16  # intervals that a task remembers


def interval(cfg: CardConfig):
    """Column function (alphas, betas) -> struct(sampled_mean, lo, hi) of the product of the Betas, in any order."""
    tail = (1 - cfg.level) / 2

    def sampled(pairs: tuple[tuple[float, float], ...]) -> tuple[float, float, float]:
        product = np.ones(cfg.samples)
        for k, (x, y) in enumerate(pairs):
            product *= np.random.default_rng(_seed(pairs, k)).beta(x, y, cfg.samples)
        lo, hi = np.quantile(product, [tail, 1 - tail])
        return float(product.mean()), float(lo), float(hi)

    @F.pandas_udf("sampled_mean double, lo double, hi double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        known = lru_cache(KEPT)(sampled)
        for alphas, betas in batches:
            rows = [known(tuple(sorted(zip(a.tolist(), b.tolist(), strict=True)))) for a, b in zip(alphas, betas, strict=True)]
            yield pd.DataFrame(rows, columns=["sampled_mean", "lo", "hi"])

    return run


def cards(paths: DataFrame, edges: DataFrame, cfg: CardConfig | None = None) -> DataFrame:
    """(rule_id, label, edges, mean, lo, hi, kind, text) of each path with edges that exist.

    kind is Frozen at a mean of frozen_threshold or more, else Plastic.  Paths
    that carry their edges as ``parts`` are not joined with edges.
    """
    cfg = cfg or CardConfig()
    own = _held(paths, cfg) if "parts" in paths.columns else _gathered(paths, edges, cfg)
    mean = F.aggregate(F.zip_with("a", "b", lambda x, y: x / (x + y)), F.lit(1.0), lambda s, x: s * x)
    made = own.withColumn("rule_id", rule_id(F.col("label"), F.col("edges"))).withColumn("mean", mean)
    made = made.withColumn("ci", interval(cfg)("a", "b"))
    kind = F.when(F.col("mean") >= cfg.frozen_threshold, "Frozen").otherwise("Plastic")
    text = F.format_string("%s: reliability %.2f%% (%.2f%% to %.2f%%)", F.col("label"), F.col("mean") * 100, F.col("ci.lo") * 100, F.col("ci.hi") * 100)
    return made.select("rule_id", "label", "edges", "mean", "ci.lo", "ci.hi", kind.alias("kind"), text.alias("text"))


def _gathered(paths: DataFrame, edges: DataFrame, cfg: CardConfig) -> DataFrame:
    """(label, edges, a, b) of paths, by their edges' ids."""
    parts = paths.select("target", "label", F.posexplode("edges").alias("pos", "id")).join(edges.select("id", "counts_success", "counts_miss"), "id")
    a, b = F.col("counts_success") + cfg.alpha0, F.col("counts_miss") + cfg.beta0
    own = parts.groupBy("target", "label").agg(F.array_sort(F.collect_list(F.struct("pos", "id", a.alias("a"), b.alias("b")))).alias("p"))
    return own.select("label", F.col("p.id").alias("edges"), F.col("p.a").alias("a"), F.col("p.b").alias("b"))


def _held(paths: DataFrame, cfg: CardConfig) -> DataFrame:
    """The same of paths with parts, row by row."""
    of = lambda value: F.transform("parts", value)
    a, b = of(lambda e: e["counts_success"] + cfg.alpha0), of(lambda e: e["counts_miss"] + cfg.beta0)
    return paths.where("size(parts) > 0").select("label", of(lambda e: e["id"]).alias("edges"), a.alias("a"), b.alias("b"))


def beta_interval(edges: DataFrame, cfg: CardConfig | None = None) -> DataFrame:
    """(id, mean, lo, hi) of each edge; sampled once for each distinct pair of counts, not for each edge."""
    cfg = cfg or CardConfig()
    a, b = F.col("counts_success") + cfg.alpha0, F.col("counts_miss") + cfg.beta0
    pairs = edges.select("counts_success", "counts_miss").distinct()
    ci = pairs.withColumn("ci", interval(cfg)(F.array(a), F.array(b)))
    mean = ids.posterior_mean(F.col("counts_success"), F.col("counts_miss"), cfg.alpha0, cfg.beta0)
    return edges.join(ci, ["counts_success", "counts_miss"]).select("id", mean.alias("mean"), "ci.lo", "ci.hi")
