"""Summaries of panes: bounds under every cut and merge, exact counts of what is frequent, promotion and demotion."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import sketch

OBS = "label string, t bigint"


def zipf(seed, n, labels=400):
    rng = random.Random(seed)
    return [(f"l{min(labels - 1, int(rng.paretovariate(0.8)) - 1)}" if rng.random() < 0.7 else "hot", rng.randrange(100)) for _ in range(n)]


def bounds_hold(summary, counts, capacity):
    rows = summary.collect()
    totals = {r.pane: (r.lost, r.n) for r in rows if r.label is None}
    lows = {(r.pane, r.label): r.low for r in rows if r.label is not None}
    per_pane = Counter(p for p, _ in lows)
    assert all(c <= capacity for c in per_pane.values())
    for (pane, label), c in counts.items():
        low, (lost, n) = lows.get((pane, label), 0), totals[pane]
        assert low <= c <= low + lost and lost * (capacity + 1) <= n
    assert {p: n for p, (_, n) in totals.items()} == {p: sum(c for (q, _), c in counts.items() if q == p) for p in totals}


@pytest.mark.parametrize("capacity,parts", [(1, 3), (8, 1), (8, 7), (50, 16), (1000, 4)])
def test_bounds_hold_for_any_number_of_tasks(spark, capacity, parts):
    rows = zipf(capacity, 3000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)  # many cuts a task
    try:
        summary = sketch.summaries(spark.createDataFrame(rows, OBS).repartition(parts), 25, capacity)
        bounds_hold(summary, Counter((t // 25, x) for x, t in rows), capacity)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_late_rows_merge_into_what_is_there(spark):
    early, late = zipf(1, 2000), zipf(2, 500)
    parts = [sketch.summaries(spark.createDataFrame(x, OBS), 25, 10) for x in (early, late)]
    bounds_hold(sketch.merged(parts[0].unionByName(parts[1]), 10), Counter((t // 25, x) for x, t in early + late), 10)


@pytest.mark.parametrize("pairs", [1_000_000, 1])
def test_frequent_labels_are_exact(spark, monkeypatch, pairs):
    monkeypatch.setattr(sketch, "BROADCAST_PAIRS", pairs)
    rows = zipf(3, 4000)
    df = spark.createDataFrame(rows + [(None, 1), ("x", None)], OBS)
    got = {(r.win, r.label): (r.support, r.n) for r in sketch.frequent(df, sketch.summaries(df, 10, 30), 10, 3, 30, 0.04).collect()}
    want = {}
    for win in range(10):
        inside = Counter(x for x, t in rows if win - 2 <= t // 10 <= win)
        n = sum(inside.values())
        want |= {(win, x): (c, n) for x, c in inside.items() if c >= 0.04 * n}
    assert got == want and ("hot" in {x for _, x in got})


def test_a_share_below_what_may_be_lost_is_refused(spark):
    df = spark.createDataFrame([("a", 1)], OBS)
    with pytest.raises(ValueError):
        sketch.frequent(df, sketch.summaries(df, 10, 9), 10, 1, 9, 0.1)
    none = df.limit(0)
    assert sketch.frequent(none, sketch.summaries(none, 10, 9), 10, 1, 9, 0.2).collect() == []


def test_promotion_and_demotion(spark):
    # share of "a" by window: 0.3 (weak), 0.6, 0.3, none, 0.7; "b" is never strong
    shares = {0: 3, 1: 6, 2: 3, 4: 7}
    rows = [(w, "a", c, 10) for w, c in shares.items()] + [(w, "b", 3, 10) for w in range(5)]
    got = sketch.with_states(spark.createDataFrame(rows, "win bigint, label string, support bigint, n bigint"), 0.5)
    assert sorted((r.win, r.label, r.support, r.state) for r in got.collect()) == [(1, "a", 6, "promoted"), (2, "a", 3, "active"), (3, "a", None, "demoted"), (4, "a", 7, "promoted")]
    assert got.where(F.col("label") == "b").isEmpty()
