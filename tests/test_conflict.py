"""Conflicts between heads against going through them by score, also where rounds are many and times lie on bucket ends."""

import random

import pytest
from pyspark.sql import functions as F

from chronoweave.functions import ids
from chronoweave.operators import conflict


def by_score(heads, rho):
    best = {}
    for n, t, s in heads:
        best[n, t] = max(s, best.get((n, t), s))
    kept = set()
    for (n, t), _ in sorted(best.items(), key=lambda x: (-x[1], x[0][1])):
        if not any(m == n and abs(u - t) <= rho for m, u in kept):
            kept.add((n, t))
    return kept


@pytest.mark.parametrize("rho,bucket", [(3, 64), (7, 1), (40, 2), (0, 64)])
def test_resolve(spark, monkeypatch, rho, bucket):
    monkeypatch.setattr(conflict, "BUCKET", bucket)
    rng = random.Random(rho)
    heads = [(rng.randrange(3), rng.randrange(-50, 400), rng.choice([0.1, 0.2, 0.5, 0.9])) for _ in range(300)]
    heads += [(9, 2 * i, i / 100) for i in range(40)]  # each is beaten by the next
    got = conflict.resolve(spark.createDataFrame(heads, "n bigint, t bigint, score double"), rho)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == by_score(heads, rho)


def test_priority_coherence_and_admission(spark):
    rows = [("a", (1, 100), [(2, 70), (3, 74)], 0.5), ("b", (1, 102), [(2, 40)], 0.5), ("c", (1, 200), [(2, 150)], 0.5), ("d", (4, 101), [(2, 1), (3, 99)], 0.5)]
    edges = spark.createDataFrame([(i, h, v, 0, 9, 0, r, 0, 0, None, "unary", False) for i, h, v, r in rows], ids.EDGE)
    score = conflict.priority(F.col("head.t"), F.col("tail"), 10, 90, 2)
    got = {r.id: (r.s, r.c) for r in edges.select("id", score.alias("s"), conflict.coherent(F.col("tail"), 5).alias("c")).collect()}
    assert got["c"] == (pytest.approx(0.7 + 0.15), True)
    assert got["a"] == (pytest.approx(0.7 * (1 - (20 + 24) / 2 / 80)), True) and got["d"][1] is False
    assert got["b"][0] > got["a"][0]
    assert {r.id for r in conflict.admitted(edges, score, 5).collect()} == {"b", "c", "d"}
    assert conflict.admitted(edges.limit(0), score, 5).collect() == []
