"""Freezes before, in and after their intervals; decisions, what is protected, and regions with leaks."""

import math
import random

import pytest

from chronoweave.config import IsolationConfig
from chronoweave.functions import ids
from chronoweave.operators import isolation

FREEZES = "id string, task_id string, start bigint, stop bigint"


def test_states_match_brute_force(spark):
    rng = random.Random(2)
    frozen = []
    for _ in range(200):
        start = rng.randrange(300)
        frozen.append((f"e{rng.randrange(8)}", "t", start, start + rng.choice([0, 1, 5, 20, -3])))
    asked = [(f"e{rng.randrange(9)}", t, i) for i, t in enumerate(rng.randrange(-5, 360) for _ in range(400))]
    cfg = IsolationConfig(ttl=10, review=6)
    got = isolation.states(spark.createDataFrame(asked, "id string, t bigint, stop bigint"), spark.createDataFrame(frozen, FREEZES), cfg)
    assert got.columns == ["id", "t", "stop", "state"]
    found = {r.stop: (r.id, r.t, r.state) for r in got.collect()}
    assert len(found) == len(asked)
    for name, t, i in asked:
        own = [(a, b) for e, _, a, b in frozen if e == name and a < b]
        if any(a <= t < b for a, b in own):
            want = isolation.FROZEN
        else:
            want = isolation.REVIEW if any(b <= t < b + 6 for _, b in own) else isolation.OPEN
        assert found[i] == (name, t, want)


def test_merged_intervals_cover_the_same_times(spark):
    rows = [("a", "t", 0, 5), ("a", "u", 5, 8), ("a", "t", 1, 3), ("a", "t", 10, 12), ("a", "t", 10, 12), ("b", "t", 4, 4)]
    got = sorted(map(tuple, isolation.merged(spark.createDataFrame(rows, FREEZES)).collect()))
    assert got == [("a", 0, 8), ("a", 10, 12)]


def test_modes_and_step_sizes(spark):
    cfg = IsolationConfig()
    rows = spark.createDataFrame([(1, 0.6), (2, 0.59), (3, 0.3), (4, 0.31), (5, None)], "i int, s double")
    assert {r.i: r.m for r in rows.select("i", isolation.mode(rows["s"], cfg).alias("m")).collect()} == {1: "REUSE", 2: "HYBRID", 3: "ISOLATE", 4: "HYBRID", 5: "ISOLATE"}
    states = spark.createDataFrame([(isolation.FROZEN,), (isolation.REVIEW,), (isolation.OPEN,)], "s string")
    assert [r.a for r in states.select(isolation.alpha(states["s"], 0.1, cfg).alias("a")).collect()] == [0.0, 0.02, 0.1]
    with pytest.raises(ValueError):
        IsolationConfig(reuse=0.1, isolate=0.5)


def test_what_decisions_freeze(spark):
    rng = random.Random(4)
    edges = [(task, f"{task}{i:02d}", round(rng.random(), 3), rng.randrange(10)) for task in "abc" for i in range(41)] + [("d", "d0", 0.5, 0)]
    frame = spark.createDataFrame(edges, "task_id string, id string, reliability double, uses bigint")
    modes = spark.createDataFrame([("a", "ISOLATE"), ("b", "HYBRID"), ("c", "REUSE"), ("d", "ISOLATE"), ("gone", "ISOLATE")], "task_id string, mode string")
    for most in (50_000, 3):
        cfg = IsolationConfig(protect_share=0.2, hybrid_share=0.5, protect_most=most, ttl=7)
        got = sorted((r.task_id, r.id, r.start, r.stop) for r in isolation.freezes(modes, frame, 100, cfg).collect())
        want = []
        for task, share in (("a", 0.2), ("b", 0.1), ("d", 0.2)):
            own = [e for e in edges if e[0] == task]
            top = max(e[3] for e in own)
            score = lambda e, top=top: e[2] * (e[3] / top if top else 0.0)
            quota = min(most, math.ceil(round(len(own) * share, 6)))
            want += [(task, e[1], 100, 107) for e in sorted(own, key=lambda e: (-score(e), e[1]))[:quota]]
        assert got == sorted(want)


def test_regions_let_a_share_through(spark):
    regions = spark.createDataFrame([(n, n % 2) for n in range(20)], "n bigint, region bigint")
    rows = []
    for i in range(100):  # a busy head, mostly across
        tails = [(i % 7 + 1, i), (i % 5 + 1, i)] if i % 3 else [(2, i)]
        rows.append((f"e{i:03d}", (0, 1000), tails, 0, 9, 0, (i * 37 % 100) / 100, 0, 0, None, "unary", False))
    rows += [("stray", (50, 5), [(60, 1)], 0, 9, 0, 0.1, 0, 0, None, "unary", False)]
    edges = spark.createDataFrame(rows, ids.EDGE)
    got = {r.id: (r.region, r.span) for r in isolation.within_leak(edges, regions, IsolationConfig(leak=0.1)).collect()}
    span = {r[0]: len({v[0] % 2 for v in [r[1], *r[2]] if v[0] < 20}) for r in rows}
    inner = {i for i, s in span.items() if s <= 1}
    across = sorted((r for r in rows if span[r[0]] > 1), key=lambda r: (-(r[6] - 0.5), r[0]))
    assert set(got) == inner | {r[0] for r in across[: len([r for r in rows if r[1][0] == 0]) // 10]}
    assert got["stray"] == (None, 0) and all(got[i] == (0, span[i]) for i in got if i != "stray")
