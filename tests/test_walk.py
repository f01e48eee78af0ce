"""The sampled search: reruns agree, draws follow the softmax, caps and depths hold."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chronoweave.config import WalkConfig
from chronoweave.functions import ids, ranking
from chronoweave.operators import walk


def edge(head, tails, r):
    n, t = head
    return (f"{n}@{t}&{','.join(f'{a}@{b}' for a, b in tails)}#{t}", head, tails, 0, 9, 0, r, 0, 0, None, "unary", False)


def test_draws_follow_the_softmax_and_reruns_agree(spark):
    """3000 heads with the same three candidates, one drawn each."""
    rates, heads = (0.2, 0.5, 0.9), 3000
    rows = [edge((1, 1000 + i), [(10 + k, 500)], r) for i in range(heads) for k, r in enumerate(rates)]
    edges = spark.createDataFrame(rows, ids.EDGE)
    targets = edges.select("head.n", "head.t").distinct()
    cfg = WalkConfig(horizon=0, depth=3, branch=1, beam_size=8, temperature=0.7, w_recent=0.0, seed=5)
    draw = lambda df, c: {(r.target.t): r.edges for r in walk.walk(df, targets, targets, c, checked=True).collect()}
    one, again, other = draw(edges, cfg), draw(edges.repartition(7), cfg), draw(edges, WalkConfig(**{**cfg.__dict__, "seed": 6}))
    assert one == again and one != other and len(one) == heads
    share = Counter(x[0].split("&")[1].split("@")[0] for x in one.values())
    chances = [r ** (1 / 0.7) for r in rates]
    for k, c in enumerate(chances):
        p = c / sum(chances)
        assert share[str(10 + k)] / heads == pytest.approx(p, abs=4 * math.sqrt(p * (1 - p) / heads))


def test_horizon_depth_and_ends(spark):
    rows = [edge((1, 100), [(2, 90), (3, 80)], 0.5), edge((1, 100), [(4, 70)], 0.25), edge((3, 80), [(5, 60)], 0.5), edge((2, 90), [(6, 10)], 1.0), edge((9, 100), [(8, 90)], 0.0)]
    edges, target = spark.createDataFrame(rows, ids.EDGE), spark.createDataFrame([(1, 100), (9, 100)], "n bigint, t bigint")
    vertices = spark.createDataFrame([(2, 90), (3, 80), (4, 70), (5, 60), (6, 10), (8, 90)], "n bigint, t bigint")
    cfg = WalkConfig(horizon=50, length_penalty_base=1.0)
    got = {(r.target.n, r.length): r.score for r in walk.walk(edges, vertices, target, cfg).collect()}
    # within 50 of the target 6@10 is out of reach, so the state whose turn 2@90 is ends there; the edge of no reliability isn't drawn
    assert set(got) == {(1, 1), (9, 0)} and got[9, 0] == 1.0
    short = {r.length for r in walk.walk(edges, vertices, target, WalkConfig(horizon=0, depth=1)).collect()}
    assert 2 not in short
    # the latest-added vertex is expanded, and 6@10 has no edge, so 3@80 never has its turn
    assert {r.length for r in walk.walk(edges, vertices, target, WalkConfig(horizon=0, depth=4)).where("target.n = 1").collect()} == {1, 2}


def test_the_cap_keeps_the_most_reliable(spark):
    rows = [edge((1, 100), [(2, i)], 0.01 * (i + 1)) for i in range(80)]
    kept = walk.usable(spark.createDataFrame(rows, ids.EDGE), WalkConfig(incoming_cap=3)).collect()
    assert sorted(round(r.reliability, 2) for r in kept) == [0.78, 0.79, 0.8]


def test_rules_and_similarity_raise_chances(spark):
    rows = [edge((1, 1000 + i), [(10 + k, 500)], 0.5) for i in range(800) for k in range(2)]
    edges = spark.createDataFrame(rows, ids.EDGE).withColumn("rule", F.when(F.col("tail")[0]["n"] == 11, 1.0))
    targets = edges.select("head.n", "head.t").distinct()
    got = walk.walk(edges, targets, targets, WalkConfig(horizon=0, depth=2, branch=1, w_recent=0.0, w_rule=0.7, temperature=0.7), checked=True).collect()
    p = math.e / (math.e + 1)
    assert sum("&11@" in r.edges[0] for r in got) / 800 == pytest.approx(p, abs=4 * math.sqrt(p * (1 - p) / 800))


def test_best_of_each_group(spark):
    rows = spark.createDataFrame([("a", i, i % 7) for i in range(300)] + [("b", 1, 1), (None, 2, 2), (None, 3, 3)], "g string, i bigint, v bigint")
    got = ranking.best(rows, ["g"], [F.desc("v"), F.col("i")], 2, "i")
    assert got.columns == ["g", "i", "v"]
    assert sorted((r.g or "", r.i) for r in got.collect()) == [("", 2), ("", 3), ("a", 6), ("a", 13), ("b", 1)]


def test_scores_round_as_sql_rounds_them(spark):
    """Products whose tenth decimal is a 5: what SQL sees is the double, which may lie below."""
    import duckdb

    values = [r * 0.98**k for r in (0.2734375, 0.328125, 0.109375, 0.065625, 0.046875, 0.2343750) for k in range(6)] + [-0.2573571875, 0.0, 0.9999999995]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r.v: r.x for r in rows.select("v", ids.rounded(F.col("v"), 9).alias("x")).collect()}
    assert all(got[v] == duckdb.execute("SELECT round(?::DOUBLE, 9)", [v]).fetchone()[0] for v in values)
    assert any(got[r.v] != r.x for r in rows.select("v", F.round("v", 9).alias("x")).collect())


def test_length_penalty_is_the_nearest_double(spark):
    edges = spark.createDataFrame([((f"e{i}"), (1, 10 - i), [(1, 9 - i)], 1.0) for i in range(4)], "id string, head struct<n:bigint,t:bigint>, tail array<struct<n:bigint,t:bigint>>, reliability double")
    vertices = spark.createDataFrame([(1, t) for t in range(1, 11)], "n bigint, t bigint")
    got = walk.walk(edges, vertices, spark.createDataFrame([(1, 10)], "n bigint, t bigint"), WalkConfig(horizon=100, depth=6, length_penalty_base=0.98)).collect()
    assert [(r.length, r.score) for r in got] == [(4, 0.98**4)]


def test_states_of_the_last_level_that_end_are_paths(spark):
    """The last level grows paths of depth + 1 edges: the one that ends there counts, the one that could go on doesn't."""
    shape = "id string, head struct<n:bigint,t:bigint>, tail array<struct<n:bigint,t:bigint>>, reliability double"
    rows = [(f"e{n}.{i}", (n, 10 - i), [(n, 9 - i)], 1.0) for n, length in ((1, 3), (2, 4)) for i in range(length)]
    edges, targets = spark.createDataFrame(rows, shape), spark.createDataFrame([(1, 10), (2, 10)], "n bigint, t bigint")
    found = lambda **more: [(r.target.n, r.length) for r in walk.walk(edges, targets, targets, WalkConfig(horizon=100, depth=2), checked=True, **more).collect()]
    assert found(closing=True) == [(1, 3)] and found() == []


def test_search_shuffles_its_edges_once(spark, monkeypatch):
    """Edges are dealt by their heads before the levels, which only shuffle states; of paths of one label the best stays."""
    from pyspark.sql import functions as F

    from chronoweave.config import TraverseConfig
    from chronoweave.operators import traverse
    from chronoweave.sources import tables

    plans, cut = [], traverse.cut

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(traverse, "cut", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = tables.layered_edges(spark, 3, 3).withColumn("id", F.concat_ws(">", F.col("tail")[0]["n"], F.col("head.n")))
        targets = spark.createDataFrame([(9, 300)], "n bigint, t bigint")
        found = traverse.traverse(edges, targets, targets, TraverseConfig(horizon=1000, beam_size=27), checked=True).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(found) == 27 and {r.length for r in found} == {3}
    assert len({r.label for r in found}) == 27 and all(abs(r.score - (0.9 * 0.98) ** 3) < 1e-12 for r in found)
    levels = plans[1:]
    assert levels and all(p.count("Exchange hashpartitioning(") == 2 for p in levels)  # states by vertex and by target
    assert not spark.catalog.listTables()


def test_promoted_edges_are_not_shuffled_again(spark):
    """Parts of paths are dealt by target, as the heads' rho is, so what is made of them meets it where it lies."""
    from chronoweave.functions import ids
    from chronoweave.operators import abstraction

    edges = spark.createDataFrame([("a", (2, 20), [(1, 10)], 0.5, 7), ("b", (1, 10), [(0, 5)], 0.8, 3)], "id string, head struct<n:bigint,t:bigint>, tail array<struct<n:bigint,t:bigint>>, reliability double, rho bigint")
    paths = spark.createDataFrame([((2, 20), ["a", "b"], 1.0, 2, "a|b")], f"target {ids.EDGE.split('head ')[1].split(', tail')[0]}, edges array<string>, score double, length int, label string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = abstraction.higher_order(paths, edges)
        plan = made._jdf.queryExecution().executedPlan().toString()
        rows = made.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning(") == 4
    assert [(r.head.n, [(v.n, v.t) for v in r.tail], r.rho, r.reliability) for r in rows] == [(2, [(0, 5)], 7, 0.5)]
