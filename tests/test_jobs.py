"""The jobs: growing input in two runs, reruns, odd rows, and the command line."""

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import common, dataset_splits, grow_edges

ROOT = str(Path(__file__).resolve().parents[1])
TABLES = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(map(str, r)) for r in df.collect()))


def edges(spark, out):
    return rows(grow_edges.read_edges(spark, out).select("day", "id", "provenance"))


@pytest.mark.parametrize("cut", ["event_id % 3 = 0", "ts > '2024-01-12'", "ts < '2024-01-12'"])
def test_growing_input_ends_as_one_run_does(spark, tmp_path, cut):
    """New files with later events, with earlier ones and with events between."""
    events = spark.read.parquet(f"{TABLES}/events.parquet")
    source, once, twice = (str(tmp_path / x) for x in ("events", "once", "twice"))
    grow_edges.run(spark, f"{TABLES}/events.parquet", once)
    events.where(f"NOT ({cut})").repartition(2).write.parquet(source)
    first = grow_edges.run(spark, source, twice)
    assert edges(spark, twice) != edges(spark, once)
    events.where(cut).write.mode("append").parquet(source)
    second = grow_edges.run(spark, source, twice)
    assert sum(b["vertices"] for b in first + second) == events.select("user_id", "ts").distinct().count() and len(second) == 1
    assert edges(spark, twice) == edges(spark, once)
    assert grow_edges.run(spark, source, twice) == []  # nothing is new
    assert edges(spark, twice) == edges(spark, once)


def test_only_touched_days_are_written_anew(spark, tmp_path):
    events = spark.read.parquet(f"{TABLES}/events.parquet")
    source, out = str(tmp_path / "events"), str(tmp_path / "out")
    events.where("event_id % 5 > 0").write.parquet(source)
    grow_edges.run(spark, source, out)
    before = {r[0]: r[1] for r in files(spark, out)}
    day = events.select(grow_edges.day_of(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0]
    events.where(grow_edges.day_of(F.unix_micros(F.col("ts").cast("timestamp"))) == day).where("event_id % 5 = 0").write.mode("append").parquet(source)
    (done,) = grow_edges.run(spark, source, out)
    assert done["days"] <= 2
    assert {d for d, name in files(spark, out) if before.get(d) != name} <= {day, day + 1}


def files(spark, out):
    return [tuple(r) for r in spark.read.schema(grow_edges.EDGES).parquet(f"{out}/edges").groupBy("day").agg(F.min(F.col("_metadata.file_path"))).collect()]


def test_smaller_batches_and_a_lost_checkpoint_change_nothing(spark, tmp_path):
    source, config = str(tmp_path / "events"), tmp_path / "c.json"
    spark.read.parquet(f"{TABLES}/events.parquet").repartition(3).write.parquet(source)
    config.write_text(json.dumps({"files_per_batch": 1}))
    out = str(tmp_path / "out")
    assert len(grow_edges.run(spark, source, out, config.as_uri())) == 3
    want = edges(spark, out)
    Path(out, "checkpoint").rename(tmp_path / "lost")
    assert len(grow_edges.run(spark, source, out)) == 1
    assert edges(spark, out) == want


def test_null_and_repeated_events(spark, tmp_path):
    schema = spark.read.parquet(f"{TABLES}/events.parquet").select("user_id", "ts").schema
    made = spark.read.parquet(f"{TABLES}/events.parquet").select("user_id", "ts")
    odd = spark.createDataFrame([(None, None), (1, None)], schema).unionByName(made.limit(5)).unionByName(made)
    odd.write.parquet(str(tmp_path / "events"))
    for name, path in (("a", str(tmp_path / "events")), ("b", f"{TABLES}/events.parquet")):
        grow_edges.run(spark, path, str(tmp_path / name))
    assert edges(spark, str(tmp_path / "a")) == edges(spark, str(tmp_path / "b"))
    spark.createDataFrame([(None, None)], schema).write.parquet(str(tmp_path / "none"))
    assert grow_edges.run(spark, str(tmp_path / "none"), str(tmp_path / "c"))[0]["edges"] == 0


def test_splits_are_whole_balanced_and_without_leaks(spark, tmp_path):
    out = str(tmp_path / "out")
    got = dataset_splits.run(spark, f"{TABLES}/documents.parquet", f"{TABLES}/labels.parquet", out, common.beside(dataset_splits.__file__))
    sets = dataset_splits.read_sets(spark, out)
    assert got["rows"] == got["documents"] * got["folds"] == sets.distinct().count()
    texts = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text")
    sides = sets.join(texts, "doc_id").groupBy("fold", "text").agg(F.count_distinct("side").alias("sides"))
    assert sides.where("sides > 1").isEmpty()
    units = spark.read.parquet(f"{out}/units").groupBy("stratum", "fold").agg(F.count_distinct("unit").alias("n")).groupBy("stratum").pivot("fold").agg(F.first("n")).na.fill(0).collect()
    for row in units:
        assert max(row[1:]) - min(row[1:]) <= 1
    assert spark.read.option("header", True).csv(f"{out}/balance").count() > 0


def test_splits_rerun_over_grown_tables_replace_what_stood(spark, tmp_path):
    docs, labels, out = spark.read.parquet(f"{TABLES}/documents.parquet"), f"{TABLES}/labels.parquet", str(tmp_path / "out")
    path = str(tmp_path / "documents")
    docs.where("doc_id % 2 = 0").write.parquet(path)
    dataset_splits.run(spark, path, labels, out)
    docs.where("doc_id % 2 = 1").write.mode("append").parquet(path)
    for _ in range(2):
        dataset_splits.run(spark, path, labels, out)
        again = rows(dataset_splits.read_sets(spark, out))
        dataset_splits.run(spark, f"{TABLES}/documents.parquet", labels, str(tmp_path / "once"))
        assert again == rows(dataset_splits.read_sets(spark, str(tmp_path / "once")))


def test_odd_documents_and_settings(spark, tmp_path):
    docs = [(1, "a b c d e f", "en"), (2, "a b c d e f", None), (3, None, "en"), (None, "a b c d e g", "en"), (4, " \t\n", "en"), (5, "one two three four five", None), (6, "x" * 100_000 + " b c d e", "en")]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "d"))
    spark.createDataFrame([(1, 1), (2, 0), (5, None), (5, 1), (6, 0), (None, 1), (9, 1)], "doc_id bigint, quality int").write.parquet(str(tmp_path / "l"))
    config = tmp_path / "c.json"
    config.write_text('{"folds": 2, "seed": 7}')
    dataset_splits.run(spark, str(tmp_path / "d"), str(tmp_path / "l"), str(tmp_path / "out"), config.as_uri())
    got = {(r.doc_id, r.stratum) for r in dataset_splits.read_sets(spark, str(tmp_path / "out")).collect()}
    assert got == {(1, "en/1"), (2, "en/1"), (5, "-/1"), (6, "en/0")}
    for bad in ('{"fold": 2}', '{"folds": 1}'):
        config.write_text(bad)
        with pytest.raises(ValueError):
            dataset_splits.run(spark, str(tmp_path / "d"), str(tmp_path / "l"), str(tmp_path / "out"), config.as_uri())


def test_command_line(tmp_path):
    """In a process of its own, as only the command line makes and stops a session."""
    run = subprocess.run([sys.executable, "-m", "jobs.grow_edges", f"{TABLES}/events.parquet", str(tmp_path / "out"), "--checkpoint-dir", str(tmp_path / "c")], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0 and "'batch': 0" in run.stdout and "edges" in run.stderr
