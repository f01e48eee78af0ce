"""The distributed bootstrap against closed forms, and critical pairs and termination against the analysis by dictionaries."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.functions import ids
from chronoweave.operators import resample, rewrite


def test_weights_are_poisson_and_independent():
    w = resample.weights(np.arange(20_000), 50, 3)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    for k, chance in enumerate(np.diff([0, *resample.CHANCES])[:5]):
        assert abs((w == k).mean() - chance) < 0.003
    rows = np.corrcoef(w[:, :20].T)
    assert np.abs(rows - np.eye(20)).max() < 0.04  # replicates
    assert np.abs(np.corrcoef(w[:40].astype(float)) - np.eye(40)).max() < 0.75 and abs(np.corrcoef(w[:-1].ravel(), w[1:].ravel())[0, 1]) < 0.01  # neighbouring keys
    assert (resample.weights(np.arange(10), 5, 3) != resample.weights(np.arange(10), 5, 4)).any()


def test_intervals_near_closed_form_over_all_rows(spark):
    lines = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    got = resample.bootstrap(lines, F.col("l_quantity"), F.col("l_orderkey") * 8 + F.col("l_linenumber"), "l_returnflag", 400).collect()
    want = {r.l_returnflag: r for r in lines.groupBy("l_returnflag").agg(F.avg("l_quantity").alias("m"), F.stddev_samp("l_quantity").alias("s"), F.count("l_quantity").alias("n")).collect()}
    assert {r.group for r in got} == set(want)
    for r in got:
        w = want[r.group]
        se = w.s / math.sqrt(w.n)
        # a spread of 400 replicates is within 4 / sqrt(800) of the true one in nearly all draws
        assert r.se == pytest.approx(se, rel=0.15)
        assert r.lo == pytest.approx(w.m - 1.96 * se, abs=0.5 * se) and r.hi == pytest.approx(w.m + 1.96 * se, abs=0.5 * se)


def test_bootstrap_is_the_same_on_any_number_of_tasks(spark, monkeypatch):
    rows = spark.createDataFrame([(i, float(i % 17), None if i % 5 == 0 else f"g{i % 3}") for i in range(500)] + [(None, 1.0, "g0"), (900, None, "g0")], "k bigint, x double, g string")
    run = lambda df: {r.group: (r.se, r.lo, r.hi) for r in resample.bootstrap(df, F.col("x"), F.col("k"), "g", 50).collect()}
    one, many = run(rows.coalesce(1)), run(rows.repartition(9))
    assert set(one) == {None, "g0", "g1", "g2"}
    for name in one:
        assert one[name] == pytest.approx(many[name])
    assert run(rows.limit(0)) == {}
    whole = resample.bootstrap(rows.where("x is not null and k is not null"), F.col("x"), F.col("k"), None, 50).collect()
    assert len(whole) == 1 and whole[0].group is None


def edge(head, tail, s, m, frozen=False):
    (n, t), (pn, pt) = head, tail
    return (f"{n}@{t}&{pn}@{pt}#{t}", head, [tail], 0, 9, 0, 0.5, s, m, None, "unary", frozen)


def test_overlaps_agree_with_the_analysis_of_single_matches(spark):
    edges = [edge((1, i), (2, 0), s, m, frozen) for i, (s, m, frozen) in enumerate([(0, 10, False), (4, 6, False), (9, 1, False), (9, 1, True), (5, 5, False)], 1)]
    extra = [edge((1, 50), (2, 0), 0, 0)]
    rules = [rewrite.Rule("grow", "GROW"), rewrite.Rule("prune", "PRUNE", 0.5), rewrite.Rule("freeze", "FREEZE", 0.4)]
    graph, made = spark.createDataFrame(edges, ids.EDGE), spark.createDataFrame(edges[:3] + extra, ids.EDGE)
    got = {(r.a, r.b, r.key_head.t): r.joinable for r in rewrite.overlaps(rules, graph, made).collect()}
    want = {}
    for _, head, tails, *_, s, m, _, _, frozen in edges:
        state = {(head, tuple(tails)): (s, m, frozen)}
        fits = {"grow": head[1] <= 3, "prune": (s + 1) / (s + m + 2) <= 0.5, "freeze": (s + 1) / (s + m + 2) >= 0.4 and not frozen}
        for a in rules:
            for b in rules:
                if a.name < b.name and fits[a.name] and fits[b.name]:
                    match = (head, tails, s, m)
                    one, two = rewrite._apply(b, match, rewrite._apply(a, match, state)), rewrite._apply(a, match, rewrite._apply(b, match, state))
                    want[a.name, b.name, head[1]] = {(k, v[2]) for k, v in one.items()} == {(k, v[2]) for k, v in two.items()}
    assert got == want and not all(got.values())
    with pytest.raises(ValueError):
        rewrite.overlaps([rules[0], rules[0]], graph, made)


def test_termination_of_many_systems(spark):
    rows = [("a", "PRUNE", None), ("b", "GROW", None), ("b", "PRUNE", None), ("c", "GROW", 3), ("d", "GROW", -1), ("e", None, None)]
    got = {r.system: (r.ends, r.bounded) for r in rewrite.termination(spark.createDataFrame(rows, "system string, kind string, max_grow bigint")).collect()}
    assert got == {"a": ("true", False), "b": ("unknown", False), "c": ("true", True), "d": ("unknown", False), "e": ("true", False)}
    for rules, bound in (([], None), ([rewrite.Rule("g", "GROW")], None), ([rewrite.Rule("g", "GROW")], 3), ([rewrite.Rule("g", "GROW")], -1)):
        system = spark.createDataFrame([("x", r.kind, bound) for r in rules] or [("x", "PRUNE", bound)], "system string, kind string, max_grow bigint")
        row, (ends, bounded) = rewrite.termination(system).first(), rewrite.terminates(rules, bound)
        assert (row.ends, row.bounded) == (str(ends).lower(), bounded)
