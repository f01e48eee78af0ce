"""Evaluation, runs and their files, by hand-computed values."""

import json
import math

import pytest
from pyspark.sql import functions as F

from chronoweave import config
from chronoweave.config import BufferConfig, EngineConfig
from chronoweave.functions import ids
from chronoweave.operators import evaluate, grow, metrics
from chronoweave.plans import experiments
from chronoweave.sources import logs, tables
from chronoweave.streaming import buffer

PAIRS = "y_true bigint, y_pred bigint"


def scalars(frame):
    return {r.metric: r.value for r in frame.where("k is null").collect()}


def test_bundle_of_predictions_and_scores(spark):
    rows = spark.createDataFrame([(0, 1), (1, 1), (1, 2), (1, 2)], PAIRS)
    got = evaluate.evaluate(rows, pred="y_pred")
    each = {(r.metric, r.k): r.value for r in got.where("k is not null").collect()}
    assert each["precision_per_class", 1] == pytest.approx(0.5) and each["recall_per_class", 1] == pytest.approx(1 / 3) and each["f1_per_class", 1] == pytest.approx(0.4)
    assert scalars(got)["micro_f1"] == pytest.approx(0.25) and scalars(got)["accuracy"] == pytest.approx(0.25)
    scored = spark.createDataFrame([(0, [0.9, 0.05, 0.05]), (1, [0.2, 0.6, 0.2]), (2, [0.1, 0.3, 0.6]), (2, [0.5, 0.4, 0.1])], "y_true bigint, s array<double>")
    assert scalars(evaluate.evaluate(scored, scores="s", ks=(1, 2)))["top1"] == pytest.approx(0.75)
    for bad in ({}, {"pred": "y_pred", "scores": "s"}, {"pred": "y_pred", "ks": (1,)}):
        with pytest.raises(ValueError):
            evaluate.evaluate(rows, **bad)
    with pytest.raises(ValueError):
        evaluate.evaluate(scored, scores="s", ks=(4,))


def test_labels_are_integers_within_bounds(spark):
    good = spark.createDataFrame([(1.0,), (2.0 + 1e-13,)], "y double")
    assert [r.y for r in evaluate.integer_labels(good, "y", n_classes=3).collect()] == [1, 2]
    for value in (0.5, float("nan"), float("inf"), None, -1.0, 3.0):
        with pytest.raises(Exception, match="no label"):
            evaluate.integer_labels(spark.createDataFrame([(value,)], "y double"), "y", n_classes=3).collect()
    with pytest.raises(ValueError):
        evaluate.integer_labels(spark.createDataFrame([(True,)], "y boolean"), "y")


def test_running_batches_equal_one_shot(spark):
    one, two = [(0, 0), (1, 2)], [(2, 2), (1, 1), (0, 1)]
    running = evaluate.Running()
    with pytest.raises(ValueError):
        running.finish(spark)
    running.add(spark.createDataFrame(one, PAIRS))
    running.add(spark.createDataFrame(two, PAIRS))
    whole = evaluate.evaluate(spark.createDataFrame(one + two, PAIRS), pred="y_pred")
    assert sorted(map(str, running.finish(spark).collect())) == sorted(map(str, whole.collect()))


def test_aggregates_over_runs_and_groups(spark):
    runs = spark.createDataFrame([(1, "accuracy", None, 0.5), (2, "accuracy", None, 0.7), (1, "top1", None, 0.9), (1, "f1_per_class", 0, 0.2), (2, "f1_per_class", 0, 0.4)], "run int, metric string, k bigint, value double")
    got = {(r.metric, r.k): (r.mean, r.std, r.n) for r in evaluate.aggregate(runs).collect()}
    assert got["accuracy", None] == (pytest.approx(0.6), pytest.approx(math.sqrt(0.02)), 2) and got["top1", None] == (0.9, 0.0, 1)
    assert got["f1_per_class", 0][0] == pytest.approx(0.3)
    cms = spark.createDataFrame([(1, 0, 0, 2), (2, 0, 0, 3)], "run int, actual bigint, pred bigint, n bigint")
    assert evaluate.sum_confusions(cms).first().n == 5
    records = spark.createDataFrame([("g", 1, "b", 0.5, 0.4, 0.6), ("g", 0, "a", 0.7, 0.6, 0.8)], "grp string, seq bigint, label string, mean double, lo double, hi double")
    one = evaluate.aggregate_groups(records).first()
    assert one.n == 2 and one.group_mean == pytest.approx(0.6) and [x.label for x in one.series] == ["a", "b"]


def test_alignment_and_effect_sizes(spark):
    ddl = "seq bigint, label string, mean double, lo double, hi double"
    a = spark.createDataFrame([(0, "x", 0.6, 0.5, 0.7), (5, "y", 0.5, 0.5, 0.5)], ddl)
    b = spark.createDataFrame([(3, "y", 0.5, 0.4, 0.6), (4, "x", 0.4, 0.3, 0.5), (9, "z", 0.1, 0.1, 0.1)], ddl)
    by_place = {(r.name_a, r.name_b): r for r in evaluate.effect_sizes(a, b).collect()}
    assert set(by_place) == {("x", "y"), ("y", "x")}
    sd = 0.2 / (2 * 1.959963984540054)
    by_name = {r.name_a: r for r in evaluate.effect_sizes(a, b, "name").collect()}
    assert by_name["x"].cohen_d == pytest.approx(0.2 / sd)
    dof = 0.24 / sd**2 * 2 - 2
    assert by_name["x"].hedges_g == pytest.approx(0.2 / sd * (1 - 3 / (4 * dof - 1)))
    labels = spark.createDataFrame([("f", None, "n", 0), ("", "i", "n", 1), (None, "", "n", 2), (None, None, None, 3)], "f string, i string, n string, k int")
    assert [r[0] for r in labels.select(evaluate.record_label(F.col("f"), F.col("i"), F.col("n"), F.col("k"))).collect()] == ["f", "i", "n", "t3"]
    edges = spark.createDataFrame([("r", 0, 0.5, 0.2, 0.6), ("r", 0, 0.7, None, None), ("s", 0, 0.4, None, None)], "run string, seq bigint, mean double, lo double, hi double")
    got = {r.run: (r.mean, r.lo, r.hi) for r in evaluate.mean_interval(edges).collect()}
    assert got == {"r": (pytest.approx(0.6), 0.2, 0.6), "s": (0.4, 0.4, 0.4)}


def test_splits_and_limits(spark, tmp_path):
    folds = spark.createDataFrame([("a", 0), ("b", 1), ("c", 0)], "id string, fold int")
    train, val = evaluate.split(folds, 0)
    assert [r.id for r in train.collect()] == ["b"] and val.count() == 2
    logs.write_splits(folds, str(tmp_path))
    assert logs.load_json(f"{tmp_path}/fold_0_train.json") == ["b"] and logs.load_json(f"{tmp_path}/fold_0_val.json") == ["a", "c"]
    assert [evaluate.step_limit(n) for n in (0, 7, 1000)] == [1, 7, 100]


def test_logs(tmp_path):
    path = str(tmp_path / "x" / "m.csv")
    with logs.CsvLog(path) as log:
        log.row({"b": 1, "a": 2})
        with pytest.raises(ValueError):
            log.row({"c": 1})
    with logs.CsvLog(path, ["a", "b"], extra=True) as log:
        log.row({"b": 3, "c": 4})
    assert open(path, newline="").read() == "a,b\r\n2,1\r\n,3\r\n"
    seen = []

    class Board(logs.NoBoard):
        def scalar(self, tag, value, step):
            seen.append((tag, value, step))

    run = logs.RunLog(logs.CsvLog(f"{tmp_path}/r.csv"), logs.JsonLog(f"{tmp_path}/r.jsonl", stamped=True), Board())
    run.metrics(3, {"loss": 0.5}, "train/")
    run.close()
    assert seen == [("train/loss", 0.5, 3)] and "ts" in json.loads(open(f"{tmp_path}/r.jsonl").read())
    folders = {logs.run_folder(str(tmp_path / "runs"), "n") for _ in range(3)}
    assert len(folders) == 3


def test_first_records(spark, tmp_path):
    (tmp_path / "a").mkdir()
    path = tmp_path / "a" / "metrics.jsonl"
    for text in ("", "[1]\n", "{oops\n"):
        path.write_text(text)
        with pytest.raises(ValueError):
            logs.first_record(str(path))
        if text.strip():
            with pytest.raises(Exception, match="JSON object"):
                tables.read_first_jsonl(spark, str(path)).collect()
    path.write_text('\n{"x": 1}\n{"x": 2}\n')
    assert logs.first_record(str(path)) == {"x": 1}
    assert tuple(tables.read_first_jsonl(spark, str(path), "x int").select("__name", "record.x").first()) == ("a", 1)
    with pytest.raises(FileNotFoundError):
        logs.first_record(str(tmp_path / "none"))


def test_quick_run_ablation_report_and_bundle(spark, tmp_path):
    spec = {"connectivity": {"2": [1], "x": [3]}, "engine": {"learn": {"impl": "beta"}}}
    record = experiments.quick(spark, spec, f"{tmp_path}/one")
    assert record["reliability_summary"]["mean_reliability"] == pytest.approx(2 / 3)
    (edge,) = record["reliability_summary"]["edges"]
    assert edge["id"] == "2@10000&1@9700#10000" and 0.1 < edge["ci"][0] < 0.2 and 0.97 < edge["ci"][1] < 1
    done = experiments.ablation(spark, f"{tmp_path}/ab", replicates=1)
    assert {k: v["n"] for k, v in done["conditions"].items()} == {"p=beta|abs=0": 1, "p=ema|abs=0": 1}
    assert done["aggregate"]["groups"]["p=beta|abs=0"]["group_mean"] == pytest.approx(2 / 3) and len(done["comparisons"][0]["effect_sizes"]["pairs"]) == 1
    paths = [f"{tmp_path}/ab/p=beta|abs=0/rep0", f"{tmp_path}/ab/p=ema|abs=0/rep0"]
    made = experiments.report(spark, paths[:1], paths[1:], out=f"{tmp_path}/r/report.json")
    assert len(made["reliability_ts"]["mean"]) == 1 and json.loads(open(made["artifact"]).read())["effect_sizes"]["align_by"] == "index"
    experiments.quick(spark, {"connectivity": {"3": [1]}}, f"{tmp_path}/other")
    packed = experiments.bundle([f"{tmp_path}/one", paths[0], f"{tmp_path}/other"], f"{tmp_path}/bundle", tol=1e-9)
    assert [c["equal"] for c in packed["comparisons"]] == [True, False] and len(open(packed["concat"]).readlines()) == 3
    assert logs.load_json(packed["manifest"])["count"] == 3


def test_dataset_run_and_baseline(spark):
    events = tables.events_of(spark, [(1, 9700), (2, 10000), (3, 50000)])
    got = experiments.dataset(spark, events, tables.connectivity_of(spark, {2: [1]}), EngineConfig(), limit=2)
    assert got["metrics"]["n_events"] == 2 and got["reliability_summary"]["mean_reliability"] == pytest.approx(2 / 3)
    out = experiments.baseline(spark, 60)
    assert 0.3 < out["separation"] < 0.7 and out == experiments.baseline(spark, 60)


def test_commands_gates_and_configs(tmp_path, capsys):
    assert experiments.off_by_default() == {"mine_default_off": True, "rewrite_default_off": True, "gate_default_off": True}
    doc = tmp_path / "d.md"
    doc.write_text("How to Run it")
    assert experiments.gates([str(doc)], {str(doc): ["how to run"]})["ok"] and not experiments.gates([str(tmp_path / "no")])["ok"]
    assert experiments.main(["gates", str(tmp_path / "no")]) == 1 and json.loads(capsys.readouterr().out)["ok"] is False
    yaml = pytest.importorskip("yaml")
    path = tmp_path / "c.yaml"
    path.write_text(yaml.safe_dump({"dch": {"k": 5}, "plasticity": {"reliability_min": 0.1, "impl": "beta"}, "snn": {"enabled": True}}))
    cfg = config.from_experiment(config.load_yaml(str(path)))
    assert cfg.grow.k == 5 and cfg.learn.clamp_min == 0.1 and cfg.learn.impl == "ema"
    path.write_text("- 1")
    with pytest.raises(ValueError):
        config.load_yaml(str(path))
    assert experiments.set_seeds(3, 4) == {"python": 3, "numpy": 4} and "pyspark" in experiments.environment()["packages"]


def test_buffers(spark, tmp_path):
    cfg = BufferConfig(horizon=100, prune_batch=3)
    assert buffer.kept([], [500, 300, 200], 0, cfg) == ([500], 0)
    assert buffer.kept([500], [450, 100], 0, cfg) == ([100, 450, 500], 2)
    rows = spark.createDataFrame([(1, 500), (1, 300), (1, 450), (2, 5)], "n bigint, t bigint")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = buffer.buffers(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), cfg)
    query = stream.writeStream.outputMode("update").format("memory").queryName("buffers").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("buffers").collect())) == [(1, 2, 450, 500), (2, 1, 5, 5)]
    assert buffer.retained(rows, cfg).count() == 3 and buffer.prune_before(rows, 450).count() == 2
    mark = buffer.Watermark()
    assert (mark.update(None), mark.batch(rows), mark.update(7)) == (0, 500, 500)


def test_small_expressions(spark):
    row = spark.createDataFrame([(11000, 9300, 31000, 1000)], "a bigint, b bigint, c bigint, d bigint")
    assert tuple(row.select(*[ids.delay_bucket(F.col(c)) for c in "abcd"]).first()) == (15, 10, 30, 1)
    assert row.select(ids.as_json("a")).first()[0] == '{"a":11000}'
    part = spark.range(1).select(ids.structural_label(F.expr("named_struct('n', 4L, 't', 300L)"), F.expr("array(named_struct('head', named_struct('n', 4L, 't', 300L), 'tail', array(named_struct('n', 3L, 't', 200L)), 'reliability', 0.6D))"), reliability=True))
    assert part.first()[0] == "HEAD:4|EDGES:[('4', (('3', 100),), '0.600')]"
    edges = tables.fan_edges(spark, 3)
    assert edges.count() == 3 and edges.select("head").distinct().count() == 1
    made = tables.random_edges(spark, 50, 10, 100, seed=1)
    assert made.where("exists(tail, x -> x.t >= head.t)").count() == 0 and made.collect() == tables.random_edges(spark, 50, 10, 100, seed=1).collect()
    known = edges.select(F.concat(F.lit("e"), F.get("tail", F.lit(0))["n"].cast("string")).alias("id"), "head", "tail")
    assert grow.remove(known, known.where("id = 'e1'")).count() == 2 and grow.get_edge(known, "e2").count() == 1
    assert grow.get_vertex(tables.events_of(spark, [(1, 2), (1, 3)]), 1, 3).count() == 1
    assert metrics.accuracy(spark.createDataFrame([(1, 1), (1, 0)], PAIRS)).first()[0] == 0.5
