"""What the jobs share: configs read through Spark, and folders of their own for registered queries."""

from __future__ import annotations

import json
import logging
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

from chronoweave.functions.lineage import shared_dir

LOG = logging.getLogger("jobs")


def settings(spark: SparkSession, defaults: dict, config: str | None) -> dict:
    """defaults, overridden by a JSON file at a path that Spark can read; names that the defaults lack are errors."""
    if config is None:
        return dict(defaults)
    given = json.loads(spark.read.text(config, wholetext=True).first()[0])
    if unknown := set(given) - set(defaults):
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return defaults | given


def beside(file: str) -> str:
    """The config file that ships beside a job, as a path for Spark."""
    return Path(file).with_suffix(".json").resolve().as_uri()


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def session(name: str, checkpoint_dir: str | None) -> SparkSession:
    """For command lines only; the master and all else come from spark-submit or the defaults."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC")
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    return builder.getOrCreate()
