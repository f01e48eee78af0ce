"""Paths that carry their edges give what a join with the edges gives, without one."""

import pytest
from pyspark.sql import functions as F

from chronoweave.config import AbstractionConfig, CardConfig, EmbedConfig
from chronoweave.functions import ids
from chronoweave.operators import abstraction, cards, embed


def edge(head, tails, r, rho):
    n, t = head
    return (f"{n}@{t}&{','.join(f'{a}@{b}' for a, b in tails)}#{t}", head, tails, 0, 9, rho, r, 0, 0, None, "unary", False)


@pytest.fixture()
def two(spark):
    rows = [edge((1, 100), [(2, 90), (3, 80)], 0.5, 7), edge((2, 90), [(4, 70)], 0.3, 5), edge((1, 200), [(1, 100)], 0.0, 3), edge((1, 100), [(5, 60)], 0.9, 8)]
    edges = spark.createDataFrame(rows, ids.EDGE)
    listed = [((1, 100), [rows[0][0], rows[1][0]], "a"), ((1, 200), [rows[2][0], rows[3][0]], "b"), ((1, 100), [rows[3][0]], "c"), ((2, 90), [], "d")]
    paths = spark.createDataFrame([(t, e, 1.0, len(e), x) for t, e, x in listed], "target struct<n:bigint,t:bigint>, edges array<string>, score double, length int, label string")
    by_id = {r[0]: r for r in rows}
    held = spark.createDataFrame([(x, [by_id[i] for i in e], {(1, 100): 7, (1, 200): 3, (2, 90): 5}[t]) for t, e, x in listed], f"label string, parts array<struct<{ids.EDGE.replace(', ', ',').replace(' ', ':')}>>, rho bigint")
    return edges, paths, paths.join(held, "label")


@pytest.mark.parametrize("kind", ["min", "mean", "geo"])
def test_higher_order_by_parts(two, kind):
    edges, paths, held = two
    cfg = AbstractionConfig(reliability=kind)
    shown = lambda df: sorted((r.id, r.hoe_label, r.tail, r.delta_min, r.delta_max, r.rho, round(r.reliability, 12), r.hoe_from_edges) for r in df.collect())
    want = shown(abstraction.higher_order(paths, edges, cfg))
    made = abstraction.higher_order(held, None, cfg)  # nothing is left to join
    assert shown(made) == want and len(want) == 3
    # rho is joined where only the parts are carried
    assert shown(abstraction.higher_order(held.drop("rho"), edges, cfg)) == want


def test_embeddings_by_parts(two):
    edges, paths, held = two
    cfg = EmbedConfig(dim=32, use_reliability=True)
    shown = lambda df: {r.label: r.embedding for r in df.collect()}
    assert shown(embed.embed_paths(held, None, cfg)) == shown(embed.embed_paths(paths, edges, cfg))
    assert held.where(F.size("parts") == 0).count() == 1


def test_a_path_keeps_its_label_without_its_first_edge(two):
    """The label travels with the first edge; that edge may be gone from the edges."""
    edges, paths, _ = two
    left = edges.where("id not like '1@200%' and not (head.n = 1 and size(tail) = 2)")
    got = {r.hoe_label: r for r in abstraction.higher_order(paths, left).collect()}
    assert {k: [tuple(v) for v in r.tail] for k, r in got.items()} == {"a": [(4, 70)], "b": [(5, 60)], "c": [(5, 60)]}
    assert all(len(r.hoe_from_edges) == 1 for r in got.values()) and got["a"].reliability == pytest.approx(0.3)


def test_cards_by_parts(two):
    edges, paths, held = two
    cfg = CardConfig(samples=200)
    want = sorted(map(tuple, cards.cards(paths, edges, cfg).collect()))
    made = cards.cards(held, None, cfg)  # nothing is left to join
    assert sorted(map(tuple, made.collect())) == want and len(want) == 3


def test_labelled_paths_are_gathered_once(spark, two):
    """A path's own columns come back with its structure from the one shuffle that gathers its edges."""
    edges, paths, _ = two
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = abstraction.label_paths(paths, edges)
        plan = made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning(") == 3  # parts by id, edges by id, paths
    assert made.columns == [*paths.columns, "structure"]
    got = {r.label: r for r in made.collect()}
    assert {x: tuple(r)[:-1] for x, r in got.items()} == {r.label: tuple(r) for r in paths.collect()}
    assert got["d"].structure == "HEAD:2|EDGES:[]" and got["c"].structure == "HEAD:1|EDGES:[('1', (('5', 40),))]"
    assert got["a"].structure == "HEAD:1|EDGES:[('1', (('2', 10), ('3', 20))),('2', (('4', 20),))]"
