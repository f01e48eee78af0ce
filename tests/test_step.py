"""The step, its parts and its streams, by hand-computed values and by equality of batch and stream."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.config import AuditConfig, CardConfig, EmbedConfig, EngineConfig, GateConfig, LearnConfig, MineConfig, RewriteConfig
from chronoweave.functions import ids
from chronoweave.operators import artifacts, cards, embed, mine
from chronoweave.plans import engine
from chronoweave.sources import audit, tables
from chronoweave.streaming import mining


def edge(head, tails, reliability, lo=0, hi=500):
    n, t = head
    name = f"{n}@{t}&{','.join(sorted(f'{a}@{b}' for a, b in tails))}#{t}"
    return (name, head, tails, lo, hi, 0, reliability, 0, 0, None, "unary", False)


def test_smoke_step(spark):
    conn = tables.connectivity_of(spark, {10: [1, 2]})
    events = tables.events_of(spark, [(1, 500), (2, 600), (10, 1000)])
    out = engine.Engine(conn).step(engine.empty(spark), events, tables.events_of(spark, [(10, 1000)]))
    m = out.metrics
    assert (m["n_candidates"], m["n_admitted"], m["n_hyperpaths"], m["n_edges_updated"], m["n_pruned"]) == (3, 3, 3, 3, 0)
    assert [r.reliability for r in out.state.edges.collect()] == pytest.approx([0.1 + 0.1 / 3] * 3)


def test_quick_step_of_five_events(spark):
    got = engine.run_quick(spark, None, ((0, 1000), (1, 1400), (2, 2000), (2, 2600), (1, 3100)))
    assert (got["n_candidates"], got["n_admitted"], got["n_hyperpaths"], got["n_edges_updated"], got["n_pruned"]) == (1, 1, 1, 0, 0)


def test_gates(spark):
    conn = tables.connectivity_of(spark, {2: [1]})
    events, target = tables.events_of(spark, [(1, 9700), (2, 10000)]), tables.events_of(spark, [(2, 10000)])
    never = lambda tail, head: F.lit(False)
    hard = engine.Engine(conn, EngineConfig(gate=GateConfig(True, "hard", ("grow",))), never).step(engine.empty(spark), events, target)
    assert hard.metrics["n_grow_infeasible"] == 1 and hard.state.edges.count() == 0
    soft = engine.Engine(conn, EngineConfig(gate=GateConfig(True, "soft", ("backward",))), never).step(engine.empty(spark), events, target)
    assert soft.metrics["n_backward_infeasible"] == 1 and soft.metrics["n_hyperpaths"] == 1


def test_promotion_comes_before_learning(spark):
    rows = [edge((3, 200), [(1, 100), (2, 120)], 0.8), edge((4, 300), [(3, 200)], 0.6)]
    start = engine.State(tables.events_of(spark, [(1, 100), (2, 120), (3, 200), (4, 300)]), spark.createDataFrame(rows, ids.EDGE), spark.createDataFrame([], mine.STATE))
    cfg = EngineConfig(mine=MineConfig(enabled=True, theta=0.2, hold_k=2))
    run, none, target = engine.Engine(tables.connectivity_of(spark, {9: [8]}), cfg), tables.events_of(spark, []), tables.events_of(spark, [(4, 300)])
    one = run.step(start, none, target, now_t=1)
    assert one.metrics["n_promoted"] == 0
    two = run.step(one.state, none, target, now_t=2)
    got = {r.id: r.reliability for r in two.state.edges.collect()}
    assert got == pytest.approx({"3@200&1@100,2@120#200": 0.98, "4@300&3@200#300": 0.8, "4@300&1@100,2@120#300": 0.7})


def test_resumed_fold_is_the_fold(spark):
    rows = [("a", t, t, 3.0) for t in range(6)] + [("b", 1, 1, 9.0)]
    every, ddl = spark.createDataFrame(rows, "label string, t bigint, seq bigint, weight double"), MineConfig(theta=5.0, lambda_decay=0.1)
    half = mine.resume(spark.createDataFrame([], mine.STATE), every.where("t < 3"), ddl)
    assert sorted(mine.resume(half, every.where("t >= 3"), ddl).collect()) == sorted(mine.fold(every, ddl).collect())


def test_stream_of_labels_is_the_fold(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(x, t, t, 3.0) for t in range(6) for x in "ab"]
    every = spark.createDataFrame(rows, "label string, t bigint, seq bigint, weight double")
    for k in range(3):
        every.where(f"t div 2 = {k}").coalesce(1).write.mode("append").parquet(src)
    cfg = MineConfig(theta=5.0)
    stream = mining.promotions(spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(src), cfg)
    seen = str(tmp_path / "out")
    query = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, i: df.write.mode("append").parquet(seen)).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.parquet(seen).groupBy("label").agg(F.sum("promotions")).collect()
    assert sorted(map(tuple, got)) == sorted((r.label, r.promotions) for r in mine.fold(every, cfg).collect())


def test_stepper_passes_over_saved_batches(spark, tmp_path):
    store = engine.Store(spark, f"file://{tmp_path}/state")
    run = engine.stepper(engine.Engine(tables.connectivity_of(spark, {2: [1]}), EngineConfig(learn=LearnConfig(impl="beta"))), store, lambda rows: rows.where("n = 2"))
    events = tables.events_of(spark, [(1, 9700), (2, 10000)])
    run(events, 0)
    run(events, 0)
    state = store.load()
    assert store.version() == 0 and state.vertices.count() == 2
    assert [(r.id, r.reliability) for r in state.edges.collect()] == [("2@10000&1@9700#10000", pytest.approx(2 / 3))]


def test_embedding(spark):
    part = lambda h, tails: {"head": {"n": h[0], "t": h[1]}, "tail": [{"n": a, "t": b} for a, b in tails], "reliability": 0.5}
    cfg = EmbedConfig(dim=64)
    a = embed.vector([part((3, 200), [(1, 100), (2, 120)]), part((4, 300), [(3, 200)])], cfg)
    shifted = embed.vector([part((4, 1300), [(3, 1200)]), part((3, 1200), [(2, 1120), (1, 1100)])], cfg)
    other = embed.vector([part((4, 300), [(3, 150)])], cfg)
    assert np.allclose(a, shifted) and not np.allclose(a, other) and np.linalg.norm(a) == pytest.approx(1.0)
    assert not embed.vector(None, cfg).any()
    edges = spark.createDataFrame([edge((2, 300), [(1, 100)], 0.5)], ids.EDGE)
    paths = edges.select(F.col("head").alias("target"), F.array("id").alias("edges"), F.col("id").alias("label"))
    assert len(embed.embed_paths(paths, edges, cfg).first().embedding) == 64


def test_cards(spark):
    edges = spark.createDataFrame([edge((2, 300), [(1, 100)], 0.5)], ids.EDGE).withColumn("counts_success", F.lit(8).cast("long"))
    paths = edges.select(F.col("head").alias("target"), F.array("id").alias("edges"), F.col("id").alias("label"))
    got = cards.cards(paths, edges, CardConfig(samples=4000)).first()
    assert got.mean == pytest.approx(0.9) and got.kind == "Frozen" and got.lo < 0.9 < got.hi
    assert cards.cards(paths, edges, CardConfig(samples=4000)).first() == got
    one = cards.beta_interval(edges, CardConfig(samples=4000)).first()
    assert one.mean == pytest.approx(0.9) and one.lo < one.mean < one.hi


def test_cards_of_equal_counts_share_their_interval(spark):
    """An interval is sampled for each set of counts, not for each path."""
    rows = [edge((2, 300 + i), [(1, 100)], 0.5) for i in range(6)]
    edges = spark.createDataFrame(rows, ids.EDGE).withColumn("counts_success", F.when(F.col("head.t") % 2 == 0, 8).otherwise(3).cast("long"))
    a, b = edges.alias("a"), edges.alias("b")
    pair = F.array("a.id", "b.id")
    paths = a.join(b, F.col("a.id") != F.col("b.id")).select(F.col("a.head").alias("target"), pair.alias("edges"), pair.cast("string").alias("label"))
    got = cards.cards(paths, edges, CardConfig(samples=500)).collect()
    assert len(got) == 30 and len({(round(r.mean, 9), r.lo, r.hi) for r in got}) == 3 and all(r.lo < r.mean < r.hi for r in got)


def test_audit_chain(spark, tmp_path):
    path = str(tmp_path / "log.jsonl")
    one = audit.AuditLog(path).append("GROW", {"count": 2, "admitted": ["e1", "e2"]}, "2025-01-01T00:00:00Z")
    two = audit.AuditLog(path).append("UPDATE", {"count": 1, "edges": [{"id": "e1", "reliability": 0.5}]}, "2025-01-01T00:00:01Z")
    assert (one, two) == ("675274798b5ad344374ea96a7a22f39f8357f17186a0dcb034346389d35d7af4", "fd1f234eeca99c807bcce6affb63f3b44b8b96f5478aa28f36f18a9f91984053")
    audit.AuditLog(path).append("UPDATE", {"id": "é"})
    assert tuple(audit.verify(audit.read(spark, path)).first()) == (True, 3, None)
    lines = open(path, encoding="utf-8").read().splitlines()
    open(path, "w", encoding="utf-8").write("\n".join([lines[0], lines[1].replace("e1", "e9"), lines[2]]) + "\n")
    assert tuple(audit.verify(audit.read(spark, path)).first()) == (False, 3, 1)
    open(path, "w", encoding="utf-8").write("\n".join([lines[0], lines[2]]) + "\n")
    assert tuple(audit.verify(audit.read(spark, path)).first()) == (False, 2, 1)
    open(path, "w", encoding="utf-8").write("\n".join([lines[0], "no record", lines[2]]) + "\n")
    assert tuple(audit.verify(audit.read(spark, path)).first()) == (False, 3, 1)
    rows = spark.createDataFrame([(i, "ROW", json.dumps(f"row {i}"), "t") for i in range(50)], "k int, kind string, payload string, ts string").repartition(4)
    chain = audit.chained(rows, ["k"])
    assert tuple(audit.verify(chain.select("idx", "line")).first()) == (True, 50, None)
    small = audit.AuditLog(str(tmp_path / "small.jsonl"), max_bytes=10)
    small.append("A", {})
    small.append("B", {})
    assert len(list(tmp_path.glob("small.jsonl*"))) == 2 and tuple(audit.verify(audit.read(spark, str(tmp_path / "small.jsonl"))).first()) == (True, 1, None)


def test_step_writes_the_audit_and_cards(spark, tmp_path):
    log, made = str(tmp_path / "a" / "log.jsonl"), str(tmp_path / "cards")
    cfg = EngineConfig(mine=MineConfig(enabled=True, theta=0.01, hold_k=1), audit=AuditConfig(log, made))
    conn, events = tables.connectivity_of(spark, {10: [1, 2]}), tables.events_of(spark, [(1, 500), (2, 600), (10, 1000)])
    engine.Engine(conn, cfg).step(engine.empty(spark), events, tables.events_of(spark, [(10, 1000)]))
    assert audit.verify(audit.read(spark, log)).first().ok
    records = [json.loads(x) for x in open(log, encoding="utf-8")]
    assert [r["kind"] for r in records] == ["GROW", "EAT", "EAT", "EAT", "UPDATE"]
    assert records[0]["payload"]["count"] == 3 and records[1]["payload"]["head"] == "10@1000" and records[4]["payload"]["count"] >= 3
    card = spark.read.json(made).first()
    assert card.type == "Plastic" and card.support == 1 and len(card.reliability_ci) == 2


def test_rules_in_the_step(spark):
    conn, events = tables.connectivity_of(spark, {10: [1, 2]}), tables.events_of(spark, [(1, 500), (2, 600), (10, 1000)])
    target = tables.events_of(spark, [(10, 1000)])
    on = engine.Engine(conn, EngineConfig(rewrite=RewriteConfig(enabled=True, prune_threshold=0.1, freeze_threshold=0.6))).step(engine.empty(spark), events, target)
    rows = on.state.edges.collect()
    assert {r.provenance for r in rows} == {"dpo:grow"} and all(r.frozen for r in rows) and {r.delta_max for r in rows} == {400, 500}
    some = engine.Engine(conn, EngineConfig(rewrite=RewriteConfig(enabled=True, prune_threshold=0.9, apply_ops=("prune",)))).step(engine.empty(spark), events, target)
    assert some.metrics["n_pruned"] == 3 and some.state.edges.count() == 0


def test_artifacts(spark):
    one = spark.createDataFrame([("a", 0.5), ("b", 0.25)], "id string, reliability double")
    two = spark.createDataFrame([("a", 0.5), ("c", 0.25)], "id string, reliability double")
    assert tuple(artifacts.equal(artifacts.compare_edges(one, one)).first()) == (True, 2, 0)
    assert tuple(artifacts.equal(artifacts.compare_edges(one, two)).first()) == (False, 3, 2)
    times = spark.createDataFrame([("x", float(i)) for i in range(1, 21)], "name string, value double")
    got = artifacts.latency(times).first()
    assert (got["median"], got["p50"], got["p95"]) == (10.5, 10.0, 19.0)


def test_streamed_bins_and_confusion(spark, tmp_path):
    rows = [(n, t, n % 2, t % 2) for n in range(3) for t in range(0, 7200, 600)]
    every = spark.createDataFrame(rows, "n bigint, s bigint, y_true int, y_pred int").withColumn("ts", F.timestamp_seconds("s"))
    every.write.parquet(str(tmp_path / "in"))
    for name, make in (("bins", lambda df: mining.bin_counts(df, "1 hour")), ("confusion", mining.confusion)):
        stream = make(spark.readStream.schema(every.schema).parquet(str(tmp_path / "in")))
        query = stream.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted((r.n, r["count"]) for r in spark.table("bins").collect()) == [(n, 6) for n in range(3) for _ in range(2)]
    want = every.groupBy("y_true", "y_pred").count().collect()
    assert sorted(map(tuple, spark.table("confusion").collect())) == sorted(map(tuple, want))


def test_store_keeps_changes_and_whole_states(spark, tmp_path):
    """Steps through a store of changes end in the same state as steps in memory, whenever whole states are written."""
    conn = tables.connectivity_of(spark, {10: [1, 2], 11: [10]})
    batches = [[(1, 500), (2, 600), (10, 1000)], [(11, 1300)], [(1, 1500), (10, 1800)], [(2, 5000)], [(11, 2100), (10, 5400)]]
    cfg = EngineConfig(learn=LearnConfig(impl="beta", prune_threshold=0.34), mine=MineConfig(enabled=True, theta=0.02, hold_k=1))
    run, state = engine.Engine(conn, cfg), engine.empty(spark)
    store = engine.Store(spark, f"file://{tmp_path}/state", whole_every=3)
    for k, pairs in enumerate(batches):
        events = tables.events_of(spark, pairs)
        targets, sign = events.where("n >= 10"), 1 if k % 2 else -1
        state = run.step(state, events, targets, sign).state
        state = engine.State(*(spark.createDataFrame(x.collect(), x.schema) for x in (state.vertices, state.edges, state.labels)))
        store.save(run.step(store.load(), events, targets, sign), k)
        kept = store.load()
        for a, b in ((state.vertices, kept.vertices), (state.edges, kept.edges), (state.labels, kept.labels)):
            assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect())), k
    assert store.version() == 4 and [whole for _, whole in store._log()] == [True, False, False, True, False]


def test_running_stream_of_steps(spark, tmp_path):
    """A stream of files through the step, one micro-batch each, ends as the steps one by one."""
    batches = [[(1, 500), (2, 600), (10, 1000)], [(1, 1500), (10, 1800)]]
    for k, pairs in enumerate(batches):
        tables.events_of(spark, pairs).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = engine.Engine(tables.connectivity_of(spark, {10: [1, 2]}))
    store = engine.Store(spark, f"file://{tmp_path}/state")
    source = spark.readStream.schema("n bigint, t bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = source.writeStream.foreachBatch(engine.stepper(run, store, lambda rows: rows.where("n = 10"))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    state = engine.empty(spark)
    for pairs in batches:
        events = tables.events_of(spark, pairs)
        state = run.step(state, events, events.where("n = 10")).state
    assert sorted(map(str, store.load().edges.collect())) == sorted(map(str, state.edges.collect())) and store.load().vertices.count() == 5
