"""Watchers in batch and on a stream with late rows; counts and reliabilities that fade; pruning."""

import math
import random

import pytest
from pyspark.sql import functions as F

from chronoweave.config import DecayConfig
from chronoweave.functions import ids
from chronoweave.operators import decay, watch
from chronoweave.streaming import watch as stream

S = 1_000_000
PATTERN = "edge string, pre bigint, n bigint, delay_min bigint, delay_max bigint"
PATTERNS = [("1>2", 1, 2, S, 5 * S), ("1>3", 1, 3, 0, 2 * S), ("2>2", 2, 2, S, 10 * S)]


def brute(pairs, patterns, watermark):
    out = {}
    for edge, pre, n, lo, hi in patterns:
        for at in {t for m, t in pairs if m == pre}:
            hits = [t for m, t in pairs if m == n and at + lo <= t <= at + hi]
            if hits:
                out[edge, at] = (watch.CONFIRMED, min(hits))
            else:
                out[edge, at] = (watch.MISSED, at + hi) if at + hi <= watermark else (watch.PENDING, None)
    return out


def some_events(seed, n=300, span=200):
    rng = random.Random(seed)
    return [(rng.choice([1, 1, 2, 3, 4]), rng.randrange(span * S)) for _ in range(n)] + [(1, 50 * S), (2, 51 * S), (1, 50 * S)]


def as_dict(rows):
    got = {(r.edge, r.at): (r.status, r.resolved_at) for r in rows}
    assert len(got) == len(rows)  # each closes once
    return got


def test_outcomes_match_brute_force(spark):
    pairs = some_events(1)
    events = spark.createDataFrame(pairs, "n bigint, t bigint")
    made = watch.watchers(events, spark.createDataFrame(PATTERNS, PATTERN))
    for watermark in (None, 0, 100 * S):
        got = as_dict(watch.outcomes(made, events, watermark).collect())
        assert got == brute(pairs, PATTERNS, max(t for _, t in pairs) if watermark is None else watermark)


def test_windows_without_width_events_or_watchers(spark):
    patterns = spark.createDataFrame([("a", 1, 2, 0, 0), ("back", 1, 2, 5, 1)], PATTERN)
    events = spark.createDataFrame([(1, 10), (2, 10), (1, 20), (2, 30)], "n bigint, t bigint")
    assert as_dict(watch.outcomes(watch.watchers(events, patterns), events).collect()) == {("a", 10): (watch.CONFIRMED, 10), ("a", 20): (watch.MISSED, 20)}
    none = events.limit(0)
    assert watch.outcomes(watch.watchers(none, patterns), events).collect() == []
    assert {r.status for r in watch.outcomes(watch.watchers(events, patterns), none).collect()} == {watch.PENDING}


@pytest.mark.parametrize("eager", [False, True])
def test_stream_with_late_rows_ends_as_the_batch(spark, tmp_path, eager):
    """Rows within the lateness come in any order over several micro-batches; one far too late is dropped."""
    rng = random.Random(7)
    pairs = some_events(2)
    arrival = sorted(pairs, key=lambda r: r[1] + rng.randrange(20 * S))  # up to 20 s late
    path = str(tmp_path / "events")
    for i in range(6):
        part = arrival[i * len(arrival) // 6 : (i + 1) * len(arrival) // 6]
        if i == 5:
            part = part + [(2, 5 * S + 1)]  # comes when the watermark has long passed it
        spark.createDataFrame(part, "n bigint, t bigint").coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame([(9, 10_000 * S)], "n bigint, t bigint").coalesce(1).write.mode("append").parquet(path)  # moves the watermark to the end
    patterns = spark.createDataFrame(PATTERNS, PATTERN)
    # both sides read the files in order of time, one a micro-batch
    read = lambda: spark.readStream.schema("n bigint, t bigint").option("maxFilesPerTrigger", 1).parquet(path)
    got = []
    out = stream.outcomes(stream.opened(read(), patterns), read(), 10 * S, "30 seconds", eager)
    query = out.writeStream.foreachBatch(lambda batch, _: got.extend(batch.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    spark.createDataFrame([(9, 10_001 * S)], "n bigint, t bigint").coalesce(1).write.mode("append").parquet(path)
    query = out.writeStream.foreachBatch(lambda batch, _: got.extend(batch.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    want = brute(pairs, PATTERNS, 10_000 * S)
    found = as_dict(got)
    if eager:
        assert {k: v[0] for k, v in found.items()} == {k: v[0] for k, v in want.items()}
        assert all(v[0] == watch.MISSED or v[1] >= want[k][1] for k, v in found.items())
    else:
        assert found == want


def test_a_watcher_closes_on_final_hits_only():
    row = ("e", 0, 10, 20, 1.0)
    assert stream.resolve([row], [15], 14, False) == ([], [row])
    assert stream.resolve([row], [15], 15, False) == ([(*row, watch.CONFIRMED, 15)], [])
    assert stream.resolve([row], [15], 0, True) == ([(*row, watch.CONFIRMED, 15)], [])
    assert stream.resolve([row], [9, 21], 19, False) == ([], [row])
    assert stream.resolve([row], [9, 21], 20, False) == ([(*row, watch.MISSED, 20)], [])


def edges_of(spark, rows):
    full = [(i, (n, t), [(n + 1, t - 1)], 0, 9, 0, r, s, m, last, kind, frozen) for i, n, t, r, s, m, last, kind, frozen in rows]
    return spark.createDataFrame(full, ids.EDGE)


def test_counts_merge_and_learning(spark):
    cfg = DecayConfig()
    done = spark.createDataFrame([("a", watch.CONFIRMED, 0, 1.0), ("a", watch.MISSED, 4 * S, 1.0), ("a", watch.PENDING, None, 1.0), ("b", watch.CONFIRMED, 10 * S, 2.0)], "edge string, status string, resolved_at bigint, weight double")
    got = {r.edge: (r.pos, r.neg, r.uses) for r in decay.counts(done, 10 * S, cfg).collect()}
    assert got["a"] == pytest.approx((0.98**10, 0.98**6, 2)) and got["b"] == pytest.approx((2.0, 0.0, 1))
    early, late = decay.counts(done.where("resolved_at < 1"), 0, cfg), decay.counts(done.where("resolved_at > 1"), 10 * S, cfg)
    merged = {r.edge: (r.pos, r.neg, r.uses, r.as_of) for r in decay.merged(early, late, cfg).collect()}
    assert merged["a"] == pytest.approx((0.98**10, 0.98**6, 2, 10 * S))
    edges = edges_of(spark, [("a", 1, 0, 0.9, 0, 0, None, "unary", False), ("b", 1, 0, 0.9, 0, 0, None, "unary", True), ("c", 1, 0, 0.9, 0, 0, None, "unary", False), ("d", 1, 0, 0.9, 0, 0, 5 * S, "unary", False)])
    shares = spark.createDataFrame([("a", 0.5), ("d", 1.0)], "id string, share double")
    learnt = {r.id: (r.reliability, r.last_update_t) for r in decay.learn(edges, decay.merged(early, late, cfg), 10 * S, cfg, shares).collect()}
    own = 0.98**10 / (0.98**10 + 0.98**6 + 1)
    relaxed = lambda dt: 0.5 + 0.4 * 0.99**dt
    assert learnt["a"] == pytest.approx((0.9 * relaxed(10) + 0.1 * (0.25 + 0.5 * own), 10 * S))
    assert learnt["b"] == (0.9, None) and learnt["c"] == (0.9, None)
    assert learnt["d"] == pytest.approx((0.9 * relaxed(5) + 0.1, 10 * S))


def test_relaxation_is_the_same_in_one_step_or_many(spark):
    cfg, rows = DecayConfig(), [("a", 1, 0, 0.9, 0, 0, 0, "unary", False), ("f", 1, 0, 0.9, 0, 0, 0, "unary", True), ("soon", 1, 99 * S, 0.2, 0, 0, None, "unary", False)]
    at = lambda edges, t: decay.as_of(edges, t, cfg)
    once = {r.id: r.reliability for r in at(edges_of(spark, rows), 60 * S).collect()}
    half = at(edges_of(spark, rows), 25 * S).withColumn("last_update_t", F.greatest(F.coalesce("last_update_t", "head.t"), F.lit(25 * S)))
    twice = {r.id: r.reliability for r in at(half, 60 * S).collect()}
    assert once == pytest.approx(twice) and once["f"] == 0.9 and once["soon"] == 0.2
    assert once["a"] == pytest.approx(0.5 + 0.4 * math.pow(0.99, 60))


def test_pruning_by_reason(spark):
    cfg = DecayConfig(prune_threshold=0.3, budget_per_head=2, relax=0.0, reliability_min=0.0)
    now = 100 * S
    rows = [
        ("weak", 1, 90 * S, 0.1, 3, 0, now, "unary", False),
        ("fresh", 2, 99 * S, 0.1, 3, 0, now, "unary", False),
        ("unused", 3, 0, 0.1, 1, 1, now, "unary", False),
        ("frozen", 4, 0, 0.1, 9, 9, 0, "unary", True),
        ("still", 5, 0, 0.9, 9, 9, now - 31 * S, "unary", False),
        ("abstract", 6, 0, 0.9, 9, 9, now - 31 * S, "abstraction", False),
        *((f"h{i:03d}", 7, 90 * S, 0.5, 9, 9, now, "unary", False) for i in range(200)),
        ("best", 7, 90 * S, 0.9, 9, 9, now, "unary", False),
    ]
    got = {r.id: r.reason for r in decay.pruned(edges_of(spark, rows), now, cfg).collect()}
    assert got == {"weak": "threshold", "still": "idle"} | {f"h{i:03d}": "budget" for i in range(1, 200)}
    assert decay.pruned(edges_of(spark, rows).limit(0), now, cfg).collect() == []
