"""Cutting lineage in loops, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; one of our own only where none is set and all runs on one machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="chronoweave-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read again; a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/chronoweave-{uuid.uuid4().hex}"
    # nothing reads the shuffle files of a table once it is written
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, *by: str) -> tuple[DataFrame, str]:
    """df as cut() leaves it but dealt by columns, so that joins on them don't shuffle it again; and the table's name, to be dropped once nothing is planned on it."""
    spark = df.sparkSession
    name = f"chronoweave_{uuid.uuid4().hex}"
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        df.repartition(n, *by).write.bucketBy(n, *by).option("compression", "zstd").option("path", f"{shared_dir(spark).rstrip('/')}/{name.replace('_', '-')}").saveAsTable(name)
    finally:
        spark.conf.set(setting, before)
    return spark.table(name), name


def drop(kept: DataFrame, *spent: DataFrame) -> DataFrame:
    """kept, after deleting tables that cut() wrote and that nothing reads any more; kept must not be built on them."""
    for table in spent:
        for name in table.inputFiles()[:1]:
            path = kept.sparkSession._jvm.org.apache.hadoop.fs.Path(name).getParent()
            if path.getName().startswith("chronoweave-"):
                path.getFileSystem(kept.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    return kept
