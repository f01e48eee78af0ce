"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: While a table is written: its shuffle files go when it is whole, as nothing reads them again.
WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def shared_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; one of our own only where none is set and all runs on one machine, as in tests."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="chronoweave-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


@contextlib.contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def cut(df: DataFrame) -> DataFrame:
    """df as written to the shared folder: computed once, and read again after the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/chronoweave-{uuid.uuid4().hex}"
    with _set(spark, WHILE_WRITING):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(kept: DataFrame, *spent: DataFrame) -> DataFrame:
    """kept, after deleting tables that cut() wrote and that nothing reads any more; kept must not be built on them."""
    for table in spent:
        for name in table.inputFiles()[:1]:
            path = kept.sparkSession._jvm.org.apache.hadoop.fs.Path(name).getParent()
            if path.getName().startswith("chronoweave-"):
                path.getFileSystem(kept.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    return kept


def free_prefix(df: DataFrame, prefix: str = "__") -> str:
    """A prefix with which no column of df begins, in any case."""
    names = [c.lower() for c in df.columns]
    while any(c.startswith(prefix) for c in names):
        prefix += "_"
    return prefix
