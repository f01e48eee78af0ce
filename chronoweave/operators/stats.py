"""Effect sizes, tests and corrections."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.special import normal_two_sided, t_quantile, t_two_sided
from .transforms import global_rank


def mean_ci(values: DataFrame, alpha: float = 0.05) -> tuple[float, float, float]:
    """Mean and Student-t interval of a column ``value``; three numbers come to the driver."""
    r = values.agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.count("value").alias("n")).first()
    if not r["n"]:
        return math.nan, math.nan, math.nan
    half = 0.0 if r["n"] < 2 else t_quantile(1 - alpha / 2, r["n"] - 1) * r["s"] / math.sqrt(r["n"])
    return r["m"], r["m"] - half, r["m"] + half


def bootstrap_ci(values: list[float], alpha: float = 0.05, n_boot: int = 10_000, seed: int = 0) -> tuple[float, float, float]:
    """Percentile interval of a small sample's mean."""
    x = np.asarray(values, float)
    rng = np.random.default_rng(seed)
    run = max(1, (1 << 22) // max(1, len(x)))  # samples that are drawn together
    means = np.concatenate([x[rng.integers(0, len(x), (min(run, n_boot - i), len(x)))].mean(1) for i in range(0, n_boot, run)])
    return float(x.mean()), *map(float, np.percentile(means, [100 * alpha / 2, 100 * (1 - alpha / 2)]))


def paired_ttest(pairs: DataFrame, alpha: float = 0.05) -> dict:
    """Of columns x and y."""
    d = F.col("x") - F.col("y")
    r = pairs.agg(F.avg(d).alias("m"), F.stddev_samp(d).alias("s"), F.count(d).alias("n")).first()
    t = r["m"] / (r["s"] / math.sqrt(r["n"])) if r["s"] else math.copysign(math.inf, r["m"]) if r["m"] else 0.0
    p = t_two_sided(t, r["n"] - 1) if r["m"] else 1.0
    return {"t": t, "p": p, "reject": p < alpha, "d": r["m"] / r["s"] if r["s"] else 0.0}


def wilcoxon(pairs: DataFrame, alpha: float = 0.05) -> dict:
    """Signed ranks of x - y without zeros, ties at their mean rank; the normal approximation with tie correction."""
    d = pairs.select((F.col("x") - F.col("y")).alias("d")).where("d <> 0").groupBy(F.abs("d").alias("a")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") > 0).alias("up"))
    ranked = global_cumulative(d.select(F.col("a").alias("value"), F.lit(0).alias("nx"), F.col("n").alias("ny"), "n", "up")).withColumn("rank", F.col("below") + (F.col("n") + 1) / 2)
    r = ranked.agg(F.sum(F.col("rank") * F.col("up")).alias("w"), F.sum("n").alias("n"), F.sum(F.pow("n", 3) - F.col("n")).alias("ties")).first()
    n = r["n"] or 0
    if not n:
        return {"w": 0.0, "p": 1.0, "reject": False, "r": 0.0}
    var = n * (n + 1) * (2 * n + 1) / 24 - r["ties"] / 48
    z = (r["w"] - n * (n + 1) / 4) / math.sqrt(var)
    p = normal_two_sided(z)
    return {"w": min(r["w"], n * (n + 1) / 2 - r["w"]), "p": p, "reject": p < alpha, "r": z / math.sqrt(n)}


def cohens_d(pairs: DataFrame) -> DataFrame:
    d = F.col("x") - F.col("y")
    return pairs.agg(F.coalesce(F.avg(d) / F.nullif(F.stddev_samp(d), F.lit(0.0)), F.lit(0.0)).alias("cohens_d"))


def cliffs_delta(values: DataFrame) -> DataFrame:
    """delta = (#(x > y) - #(x < y)) / (nx ny) of values (side, value), side x or y; by ranks, not by pairs."""
    counts = values.groupBy("value").agg(F.count_if(F.col("side") == "x").alias("nx"), F.count_if(F.col("side") == "y").alias("ny"))
    ranked = global_cumulative(counts)
    gain = F.sum(F.col("nx") * (2 * F.col("below") + F.col("ny")))
    nx, ny = F.sum("nx"), F.sum("ny")
    return ranked.agg((gain / (nx * ny) - 1).alias("cliffs_delta"))


def global_cumulative(counts: DataFrame) -> DataFrame:
    """counts (value, nx, ny) with ``below``, the sum of ny at smaller values, by ranges of the value."""
    spark = counts.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(counts.approxQuantile("value", [i / n for i in range(1, n)], 0.01))) if n > 1 else []
    part = F.lit(0)
    for c in cuts:
        part = part + (F.col("value") > F.lit(c)).cast("int")
    parted = counts.withColumn("part", part)
    sums = {r["part"]: r["s"] for r in parted.groupBy("part").agg(F.sum("ny").alias("s")).collect()}
    before, total = [], 0
    for i in range(len(cuts) + 1):
        before.append(F.lit(total).cast("long"))
        total += sums.get(i, 0)
    inside = F.coalesce(F.sum("ny").over(W.partitionBy("part").orderBy("value").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return parted.withColumn("below", F.get(F.array(*before), F.col("part")) + inside)


def benjamini_hochberg(tests: DataFrame, q: float = 0.05) -> DataFrame:
    """tests (test_id, p) with (adjusted, reject): the smallest p m / rank from the rank up, at most 1."""
    m = tests.count()
    ranked = global_rank(tests, "p", "test_id").withColumn("raw", F.col("p") * m / (F.col("rank") + 1))
    parts = max(1, min(1000, m // 10_000))
    run = ranked.withColumn("part", F.floor(F.col("rank") * parts / F.lit(max(m, 1))).cast("int"))
    later = {r["part"]: r["least"] for r in run.groupBy("part").agg(F.min("raw").alias("least")).collect()}
    after, best = {}, 1.0
    for i in reversed(range(parts)):
        after[i] = best
        best = min(best, later.get(i, 1.0))
    inside = F.min("raw").over(W.partitionBy("part").orderBy("rank").rowsBetween(W.currentRow, W.unboundedFollowing))
    adjusted = F.least(inside, F.get(F.array(*[F.lit(after[i]) for i in range(parts)]), F.col("part")), F.lit(1.0))
    return run.select("test_id", "p", adjusted.alias("adjusted"), (adjusted <= q).alias("reject"))


def beta_samples(alpha: float, beta: float, n: int, seed: int | None = None) -> list[float]:
    rng = random.Random(seed)
    return [rng.betavariate(alpha, beta) for _ in range(n)]


def quantile(sorted_x: list[float], p: float) -> float:
    """Linear between the two nearest order statistics."""
    at = p * (len(sorted_x) - 1)
    lo = int(math.floor(at))
    hi = min(lo + 1, len(sorted_x) - 1)
    return sorted_x[lo] + (at - lo) * (sorted_x[hi] - sorted_x[lo])


def beta_interval(alpha: float, beta: float, level: float = 0.95, n: int = 20_000, seed: int | None = 0) -> tuple[float, float]:
    x = sorted(beta_samples(alpha, beta, n, seed))
    return quantile(x, (1 - level) / 2), quantile(x, (1 + level) / 2)


def effect_sizes(a: DataFrame, b: DataFrame, z: float = 1.959963984540054) -> DataFrame:
    """(name, cohen_d, hedges_g) of records (name, mean, ci_lo, ci_hi, n) of one name."""
    both = a.alias("a").join(b.alias("b"), F.col("a.name") == F.col("b.name"))
    sd = lambda s: (F.col(f"{s}.ci_hi") - F.col(f"{s}.ci_lo")) / (2 * z) * F.sqrt(F.col(f"{s}.n"))
    dof = F.col("a.n") + F.col("b.n") - 2
    pooled = F.sqrt(((F.col("a.n") - 1) * sd("a") ** 2 + (F.col("b.n") - 1) * sd("b") ** 2) / dof)
    d = F.when(pooled > 0, (F.col("b.mean") - F.col("a.mean")) / pooled).otherwise(0.0)
    return both.select(F.col("a.name").alias("name"), d.alias("cohen_d"), (d * (1 - 3 / (4 * dof - 1))).alias("hedges_g"))


def stratified_folds(rows: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """rows (id, label) with a fold: round robin in a seeded order within each label.

    The order is that of digests, so a label's rows are numbered within parts by
    a digest's first digits, and each part goes on from the sizes of those before
    it: a label with most of the rows is no single task.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")))
    parted = rows.withColumn("__digest", digest).withColumn("__part", F.conv(F.substring("__digest", 1, FOLD_DIGITS), 16, 10).cast("int"))
    sizes = parted.groupBy(F.col("label").alias("__label"), F.col("__part").alias("__of")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.partitionBy("__label").orderBy("__of").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("__label", "__of", F.coalesce(before, F.lit(0)).alias("__before"))
    own = F.row_number().over(W.partitionBy("label", "__part").orderBy("__digest", "id")) - 1
    placed = parted.withColumn("__own", own).join(starts, F.col("label").eqNullSafe(F.col("__label")) & (F.col("__part") == F.col("__of")))
    return placed.withColumn("fold", ((F.col("__before") + F.col("__own")) % k).cast("long")).select(*rows.columns, "fold")


#: hex digits that number the parts of a label in stratified_folds()
FOLD_DIGITS = 3
