"""Stratified K-fold training and validation sets of the labelled documents, without leaks through copies.

    python -m jobs.dataset_splits DOCUMENTS LABELS OUT [--config FILE] [--checkpoint-dir DIR]

Documents of at least ``min_words`` words that have a label take part.  Equal
texts are one unit, so a copy never validates what its twin has trained; a
unit's stratum comes from its document of the smallest id.  Units are dealt to
folds in turn within each stratum, in a seeded order of hashes, so every fold
has each stratum's share to within one unit.

Writes below OUT, each time over what stood there:

* ``units/fold=/``: (doc_id, stratum, words), every document once;
* ``sets/fold=/side=/``: (doc_id, stratum), with side train or val: every fold's
  val set is its own documents, and its train set all others;
* ``balance/``: units, documents and words of each stratum and fold, as CSV.

The result depends on the tables and the settings alone, so a run that was cut
off is simply run again.  Texts are read once and never shuffled; what is
shuffled are ids and digests.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators import stats

from . import common

DEFAULTS = {"folds": 5, "seed": 42, "strata": ["lang", "quality"], "min_words": 5}
#: a label's name in a stratum where a document has none
MISSING = "-"


def units_of(documents: DataFrame, labels: DataFrame, strata: list[str], min_words: int) -> DataFrame:
    """(doc_id, stratum, words, unit) of the labelled documents; unit is the digest of the text."""
    words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    marked = documents.where("doc_id is not null and text is not null").withColumn("words", words.cast("long")).where(F.col("words") >= min_words)
    # of a label given twice, the smaller
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.min(c).alias(c) for c in labels.columns if c != "doc_id"])
    own = [c for c in marked.columns if c in strata]
    joined = marked.select("doc_id", "words", F.sha2("text", 256).alias("unit"), *own).join(known, "doc_id")
    return joined.select("doc_id", F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in strata]).alias("stratum"), "words", "unit")


def folded(rows: DataFrame, k: int, seed: int) -> DataFrame:
    """rows with the fold and the stratum of their unit."""
    first = rows.groupBy("unit").agg(F.min_by("stratum", F.struct("doc_id", "stratum")).alias("label"))
    dealt = stats.stratified_folds(first.withColumnRenamed("unit", "id"), k, seed)
    return rows.drop("stratum").join(dealt.select(F.col("id").alias("unit"), F.col("label").alias("stratum"), "fold"), "unit")


def run(spark: SparkSession, documents: str, labels: str, out: str, config: str | None = None) -> dict[str, int]:
    """Write the sets; returns counts of what was read and written."""
    cfg, out = common.settings(spark, DEFAULTS, config), out.rstrip("/")
    if cfg["folds"] < 2:
        raise ValueError("there are at least 2 folds")
    docs, marks = spark.read.parquet(documents), spark.read.parquet(labels)
    common.LOG.info("dataset_splits: reading %s and %s, settings %s", documents, labels, cfg)
    rows = folded(units_of(docs, marks, cfg["strata"], cfg["min_words"]), cfg["folds"], cfg["seed"])
    rows.hint("rebalance", "fold").write.mode("overwrite").partitionBy("fold").parquet(f"{out}/units")
    units = spark.read.schema("doc_id bigint, words bigint, unit string, stratum string, fold int").parquet(f"{out}/units")
    every = F.explode(F.sequence(F.lit(0), F.lit(cfg["folds"] - 1))).alias("of")
    sets = units.select("doc_id", "stratum", "fold", every).select("doc_id", "stratum", F.col("of").alias("fold"), F.when(F.col("of") == F.col("fold"), "val").otherwise("train").alias("side"))
    sets.write.mode("overwrite").partitionBy("fold", "side").parquet(f"{out}/sets")
    balance = units.groupBy("stratum", "fold").agg(F.count_distinct("unit").alias("units"), F.count(F.lit(1)).alias("documents"), F.sum("words").alias("words"))
    balance.orderBy("stratum", "fold").write.mode("overwrite").option("header", True).csv(f"{out}/balance")
    wrote = read_sets(spark, out).groupBy("fold", "side").count().orderBy("fold", "side").collect()
    for r in wrote:
        common.LOG.info("dataset_splits: wrote %s/sets/fold=%d/side=%s: %d documents", out, r["fold"], r["side"], r["count"])
    return {"documents": sum(r["count"] for r in wrote if r["side"] == "val"), "folds": cfg["folds"], "rows": sum(r["count"] for r in wrote)}


def read_sets(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema("doc_id bigint, stratum string, fold int, side string").parquet(f"{out.rstrip('/')}/sets")


def job1_dataset_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = common.own_folder(spark, "job1")
    for _ in range(2):
        run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", out, common.beside(__file__))
    return read_sets(spark, out).select("fold", "side", "doc_id", "stratum")


SQL = r"""
WITH d AS (SELECT doc_id, lang, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, sha256(text) AS unit FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
l AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
r AS (SELECT doc_id, coalesce(lang, '-') || '/' || coalesce(quality::VARCHAR, '-') AS stratum, unit FROM d JOIN l USING (doc_id) WHERE words >= 5),
u AS (SELECT unit, arg_min(stratum, (doc_id, stratum)) AS stratum FROM r GROUP BY unit),
f AS (SELECT unit, stratum, (row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || unit), unit) - 1) % 5 AS fold FROM u)
SELECT o.fold::INTEGER AS fold, CASE WHEN o.fold = f.fold THEN 'val' ELSE 'train' END AS side, doc_id, f.stratum FROM r JOIN f USING (unit), (SELECT unnest(range(5)) AS fold) o
"""


def main(argv: list[str] | None = None) -> None:
    args = argparse.ArgumentParser(prog="jobs.dataset_splits", description=__doc__.splitlines()[0])
    for name in ("documents", "labels", "out"):
        args.add_argument(name)
    args.add_argument("--config")
    args.add_argument("--checkpoint-dir")
    given = args.parse_args(argv)
    spark = common.session("dataset_splits", given.checkpoint_dir)
    try:
        print(run(spark, given.documents, given.labels, given.out, given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
