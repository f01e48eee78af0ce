"""Hand-computed cases of the engine."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from chronoweave.config import GrowConfig
from chronoweave.functions.special import t_quantile, t_two_sided
from chronoweave.operators import grow
from chronoweave.plans import catalog
from chronoweave.sources import tables

from .conftest import TEST_DIR


def test_candidates(spark):
    conn = tables.connectivity_of(spark, {10: [1, 2]})
    v = tables.vertices(tables.events_of(spark, [(1, 600), (2, 700), (1, 800), (10, 1000)]))
    rows = grow.candidates(v, conn, GrowConfig(causal_coincidence_delta=120, budget_per_head=10)).collect()
    assert sorted(r.provenance for r in rows) == ["pair"] * 3 + ["unary"] * 3
    few = grow.candidates(v, conn, GrowConfig(causal_coincidence_delta=120, budget_per_head=2)).collect()
    assert sorted(r.tail[0].t for r in few) == [700, 800]


def test_student_t():
    assert t_quantile(0.975, 10) == pytest.approx(2.2281388519649385)
    assert t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05)


def test_entry_and_sql(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_path_embeddings_cover_every_head(spark):
    edges = catalog._unary(spark, TEST_DIR).selectExpr("id", "head", "tail[0] AS tail").cache()
    want = edges.alias("a").join(edges.alias("b"), F.expr("b.head = a.tail"))
    got = catalog.QUERIES["path_embeddings"](spark, TEST_DIR).cache()
    assert got.count() == want.count() and got.select("t").distinct().count() == want.selectExpr("a.head.t").distinct().count()


def test_edges_around_a_vertex_are_those_of_the_whole_graph(spark):
    """The heads that may hold a vertex give its edges, and one pass finds both sides."""
    from chronoweave.operators import grow
    from chronoweave.plans import catalog

    d = "/root/testdata/sf0.001"
    every = catalog._unary(spark, d).cache()
    for n, t in every.orderBy("id").select("head.n", "head.t").limit(2).collect() + every.orderBy("id").selectExpr("tail[0].n", "tail[0].t").limit(2).collect():
        got = sorted(map(tuple, grow.incident(catalog._unary(spark, d, t), n, t).select("side", "id").collect()))
        assert got == sorted([("out", r.id) for r in grow.outgoing(every, n, t).collect()] + [("in", r.id) for r in grow.incoming(every, n, t).collect()]) and got
