"""Evaluation of predictions and of runs: label checks, bundles of metrics, and their aggregates over runs and groups.

A bundle is a table in long form, (metric, k, value): k is the class of a
per-class metric and null for a scalar; top-k accuracies are scalars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CardConfig
from . import cards, learn, metrics
from .transforms import global_rank

#: a number this close to an integer is one
INTEGER_EPS = 1e-12
STEP_LIMIT = (1, 100)


def integer_labels(rows: DataFrame, *columns: str, n_classes: int | None = None) -> DataFrame:
    """rows with the columns as bigint; fails at run time on nulls, numbers that aren't integers, and labels outside [0, n_classes).

    Booleans are no labels, whatever their values.
    """
    kinds = dict(rows.dtypes)
    for c in columns:
        if kinds[c] == "boolean":
            raise ValueError(f"{c} must hold integer labels, not booleans")
        x = F.col(c).cast("double")
        ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(1 << 53)) & (F.abs(x - F.bround(x)) <= INTEGER_EPS)
        if n_classes is not None:
            ok &= (F.bround(x) >= 0) & (F.bround(x) < n_classes)
        rows = rows.withColumn(c, F.when(ok, F.bround(x).cast("bigint")).otherwise(F.raise_error(F.format_string(f"%s is no label of {c}", F.col(c).cast("string"))).cast("bigint")))
    return rows


def bundle(cm: DataFrame) -> DataFrame:
    """(metric, k, value) of a confusion table (actual, pred, n)."""
    each, none = metrics.per_class(cm), F.lit(None).cast("bigint")
    hits = cm.agg((F.sum(F.when(F.col("actual") == F.col("pred"), F.col("n")).otherwise(0)) / F.greatest(F.sum("n"), F.lit(metrics.EPS))).alias("accuracy"))
    long = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), none.alias("k"), F.col(c).cast("double").alias("value")) for c in df.columns])).alias("m")).select("m.*")
    classes = each.select(F.explode(F.array(*[F.struct(F.lit(f"{c}_per_class").alias("metric"), F.col("cls").alias("k"), F.col(c).cast("double").alias("value")) for c in ("precision", "recall", "f1", "support")])).alias("m")).select("m.*")
    return long(hits).unionByName(long(metrics.macro(each))).unionByName(long(metrics.micro(cm))).unionByName(classes)


def evaluate(rows: DataFrame, pred: str | None = None, scores: str | None = None, n_classes: int | None = None, ks: tuple[int, ...] = ()) -> DataFrame:
    """The bundle of rows (y_true and either predictions or scores, an array by class); predictions from scores are the first largest."""
    if (pred is None) == (scores is None):
        raise ValueError("give either predictions or scores")
    if scores is None and ks:
        raise ValueError("top-k needs scores")
    if scores is not None:
        width = rows.agg(F.min(F.size(scores)).alias("a"), F.max(F.size(scores)).alias("b")).first()
        if not width["a"] or width["a"] != width["b"] or n_classes not in (None, width["a"]):
            raise ValueError("scores hold a number for each class")
        if any(not 1 <= k <= width["a"] for k in ks):
            raise ValueError("k is from 1 to the number of classes")
        n_classes = width["a"]
        rows = rows.withColumn("y_pred", metrics.argmax(F.col(scores)))
    else:
        rows = rows.withColumn("y_pred", F.col(pred))
        if rows.isEmpty():
            raise ValueError("there are no rows")
    rows = integer_labels(rows, "y_true", "y_pred", n_classes=n_classes)
    out = bundle(metrics.confusion(rows, n_classes))
    if ks:
        top = metrics.top_k(rows, list(ks), scores)
        out = out.unionByName(top.select(F.explode(F.array(*[F.struct(F.lit(f"top{k}").alias("metric"), F.lit(None).cast("bigint").alias("k"), F.col(f"top_{k}").alias("value")) for k in ks])).alias("m")).select("m.*"))
    return out


class Running:
    """A confusion table that grows by batches, of a fixed number of classes or of those seen so far."""

    def __init__(self, n_classes: int | None = None) -> None:
        if n_classes is not None and n_classes <= 0:
            raise ValueError("the number of classes is positive")
        self.n_classes, self.counts = n_classes, {}

    def add(self, batch: DataFrame) -> None:
        """Add a batch (y_true, y_pred); one row a pair of classes comes to the driver."""
        rows = integer_labels(batch, "y_true", "y_pred", n_classes=self.n_classes)
        for r in rows.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n")).collect():
            self.counts[r["y_true"], r["y_pred"]] = self.counts.get((r["y_true"], r["y_pred"]), 0) + r["n"]

    def confusion(self, spark) -> DataFrame:
        if not self.counts:
            raise ValueError("no rows were added")
        size = self.n_classes or 1 + max(max(pair) for pair in self.counts)
        return spark.createDataFrame([(a, b, self.counts.get((a, b), 0)) for a in range(size) for b in range(size)], "actual bigint, pred bigint, n bigint")

    def finish(self, spark) -> DataFrame:
        return bundle(self.confusion(spark))


def aggregate(bundles: DataFrame) -> DataFrame:
    """(metric, k, mean, std, n) over runs' bundles (run, metric, k, value): scalars with their deviation, per-class metrics by class.

    A metric that some runs lack is averaged over those that have it; the
    deviation of one run is 0.
    """
    return bundles.groupBy("metric", "k").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.count("value").alias("n"))


def sum_confusions(cms: DataFrame) -> DataFrame:
    """(actual, pred, n) summed over runs' tables (run, actual, pred, n); tables of different sizes are an error."""
    sizes = cms.groupBy("run").agg(F.count(F.lit(1)).alias("cells")).agg(F.count_distinct("cells")).first()[0]
    if sizes > 1:
        raise ValueError("confusion tables differ in size")
    return cms.groupBy("actual", "pred").agg(F.sum("n").alias("n"))


def reliability_summary(edges: DataFrame, max_edges: int = 10, cfg: CardConfig | None = None) -> DataFrame:
    """One row (mean_reliability, edges): the latest edges with posterior means and sampled intervals, and the mean of the means; 0 without edges."""
    cfg = cfg or CardConfig(samples=2000)
    top = learn.latest(edges, max_edges)
    each = cards.beta_interval(top, cfg)
    items = F.array_sort(F.collect_list(F.struct("id", "mean", F.array("lo", "hi").alias("ci"))))
    return each.agg(F.coalesce(F.avg("mean"), F.lit(0.0)).alias("mean_reliability"), items.alias("edges"))


def aggregate_groups(records: DataFrame) -> DataFrame:
    """(grp, n, group_mean, series) of records (grp, seq, label, mean, lo, hi), one a run: each group's mean of means and its runs in order."""
    item = F.struct("seq", "label", "mean", "lo", "hi")
    return records.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.avg("mean").alias("group_mean"), F.array_sort(F.collect_list(item)).alias("series"))


def record_label(fingerprint: Column, injected: Column, name: Column, idx: Column) -> Column:
    """The first that is set of the configuration's fingerprint, the injected name and the name, else t and the index."""
    given = [F.nullif(x, F.lit("")) for x in (fingerprint, injected, name)]
    return F.coalesce(*given, F.concat(F.lit("t"), idx.cast("string")))


def aligned(a: DataFrame, b: DataFrame, by: str = "index") -> DataFrame:
    """(name_a, name_b, a, b) of records (seq, label, ...): by place, up to the shorter side, or by label, the last of repeated ones."""
    rows = lambda df: F.struct(*[F.col(c) for c in df.columns if c not in ("seq", "label")])
    if by == "index":
        # seq numbers the records of a side in order, from any start, with gaps or without
        numbered = [global_rank(df, "seq").select(F.col("rank").alias("at"), F.col("label").alias(f"name_{s}"), rows(df).alias(s)) for df, s in ((a, "a"), (b, "b"))]
        return numbered[0].join(numbered[1], "at").select("name_a", "name_b", "a", "b")
    if by != "name":
        raise ValueError("records are aligned by index or by name")
    last = [df.groupBy("label").agg(F.max_by(rows(df), "seq").alias(s)) for df, s in ((a, "a"), (b, "b"))]
    return last[0].join(last[1], "label").select(F.col("label").alias("name_a"), F.col("label").alias("name_b"), "a", "b")


def effect_sizes(a: DataFrame, b: DataFrame, by: str = "index", z: float = 1.959963984540054) -> DataFrame:
    """(name_a, name_b, cohen_d, hedges_g) of records (seq, label, mean, lo, hi), means of proportions with their intervals.

    A deviation is its interval's width over 2 z, two are pooled by their mean
    square, and the counts of the small-sample correction are those at which a
    proportion's standard error is the deviation: p (1 - p) / deviation^2.
    """
    pairs = aligned(a.select("seq", "label", "mean", "lo", "hi"), b.select("seq", "label", "mean", "lo", "hi"), by)

    def sided(s: str) -> tuple[Column, Column]:
        sd = F.greatest(F.lit(0.0), (F.col(f"{s}.hi") - F.col(f"{s}.lo")) / (2 * z))
        p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col(f"{s}.mean")))
        return sd, F.when(sd > 0, p * (1 - p) / (sd * sd)).otherwise(F.lit(float("inf")))

    (sa, na), (sb, nb) = sided("a"), sided("b")
    pooled = F.sqrt((sa * sa + sb * sb) / 2)
    d = F.when(pooled > 0, (F.col("a.mean") - F.col("b.mean")) / pooled).otherwise(0.0)
    dof = F.greatest(F.lit(1.0), na + nb - 2)
    j = F.when(dof > 3, 1 - 3 / (4 * dof - 1)).otherwise(1.0)
    return pairs.select("name_a", "name_b", d.alias("cohen_d"), (d * j).alias("hedges_g"))


def mean_interval(edges: DataFrame) -> DataFrame:
    """(run, seq, mean, lo, hi) of runs' edges (run, seq, mean, lo, hi): the bounds' means, within [0, 1].

    Edges without an interval don't count for the bounds; a run without any, or
    with bounds in the wrong order, has its mean for both.
    """
    whole = F.col("lo").isNotNull() & F.col("hi").isNotNull()
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    sums = edges.groupBy("run", "seq").agg(F.avg("mean").alias("mean"), *[unit(F.avg(F.when(whole, F.col(c)))).alias(c) for c in ("lo", "hi")], F.count_if(whole).alias("n"))
    good = (F.col("n") > 0) & (F.col("lo") <= F.col("hi"))
    return sums.select("run", "seq", "mean", *[F.when(good, F.col(c)).otherwise(unit(F.col("mean"))).alias(c) for c in ("lo", "hi")])


def step_limit(n: int) -> int:
    """A step's number of events, kept from 1 to 100."""
    return max(STEP_LIMIT[0], min(STEP_LIMIT[1], int(n)))


def split(folds: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """(train, val) of rows (id, fold): the fold is val, and train is all without val's ids."""
    val = folds.where(F.col("fold") == fold)
    return folds.join(val.select("id"), "id", "left_anti"), val
