"""Classification metrics from predictions (y_true, y_pred) or scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-12


def check_labels(rows: DataFrame, n_classes: int, *columns: str) -> DataFrame:
    """rows, failing at run time where a label is outside [0, n_classes)."""
    for c in columns:
        rows = rows.withColumn(c, F.when(F.col(c).between(0, n_classes - 1), F.col(c)).otherwise(F.raise_error(F.lit(f"{c} is out of bounds")).cast("int")))
    return rows


def confusion(rows: DataFrame, n_classes: int | None = None) -> DataFrame:
    """(actual, pred, n) over the whole grid of classes."""
    counts = rows.groupBy(F.col("y_true").cast("long").alias("actual"), F.col("y_pred").cast("long").alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    if n_classes is None:
        top = rows.agg(F.max(F.greatest("y_true", "y_pred"))).first()[0]
        n_classes = 0 if top is None else int(top) + 1
    cells = rows.sparkSession.range(n_classes * n_classes).select((F.col("id") / max(n_classes, 1)).cast("long").alias("actual"), (F.col("id") % max(n_classes, 1)).alias("pred"))
    return cells.join(counts, ["actual", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def per_class(cm: DataFrame, eps: float = EPS) -> DataFrame:
    """(cls, precision, recall, f1, support) from (actual, pred, n)."""
    sides = cm.select(F.explode(F.array(F.struct(F.col("actual").alias("cls"), F.when(F.col("actual") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")), F.struct(F.col("pred").alias("cls"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")))).alias("x")).select("x.*")
    sums = sides.groupBy("cls").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])
    p, r = F.col("tp") / (F.col("predicted") + eps), F.col("tp") / (F.col("support") + eps)
    return sums.select("cls", p.alias("precision"), r.alias("recall"), (2 * p * r / (p + r + eps)).alias("f1"), "support")


def macro(classes: DataFrame, weighted: bool = False, eps: float = EPS) -> DataFrame:
    """Mean over classes, uniform or by support; uniform if there is no support."""
    w = F.sum("support")
    mean = lambda c: F.when(w > eps, F.sum(F.col(c) * F.col("support")) / w).otherwise(F.avg(c)) if weighted else F.avg(c)
    return classes.agg(*[mean(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])


def micro(cm: DataFrame, eps: float = EPS) -> DataFrame:
    hit, n = F.sum(F.when(F.col("actual") == F.col("pred"), F.col("n")).otherwise(0)), F.sum("n")
    p = hit / (n + eps)
    return cm.agg(p.alias("micro_precision"), p.alias("micro_recall"), (2 * p * p / (p + p + eps)).alias("micro_f1"))


def accuracy(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"))


def argmax(scores: Column) -> Column:
    """The first largest score's class."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def top_k(rows: DataFrame, ks: list[int], scores: str = "scores") -> DataFrame:
    """Share of rows with fewer than k scores above the true class's; ties go to the smaller class."""
    own = F.get(F.col(scores), F.col("y_true"))
    place = F.size(F.filter(F.transform(scores, lambda s, i: (s > own) | ((s == own) & (i < F.col("y_true")))), lambda x: x))
    return rows.withColumn("place", place).agg(*[F.avg((F.col("place") < k).cast("double")).alias(f"top_{k}") for k in ks])


def aggregate_runs(values: DataFrame) -> DataFrame:
    """(metric, mean, std, n) of values (metric, value); std is 0 for one run."""
    return values.groupBy("metric").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.count(F.lit(1)).alias("n"))
