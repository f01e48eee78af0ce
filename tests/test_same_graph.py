"""Graphs are compared in one pass, by what edge_set() keeps."""

from chronoweave.operators import rewrite

EDGES = "head struct<n: bigint, t: bigint>, tail array<struct<n: bigint, t: bigint>>, frozen boolean"


def test_same_graph_in_one_pass(spark, monkeypatch):
    monkeypatch.setattr(type(spark.range(0)), "exceptAll", None)  # the two passes of before
    one, two = ((1, 9), [(2, 3), (4, 5)], False), ((1, 9), [(2, 3)], None)
    made = lambda *rows: spark.createDataFrame(rows, EDGES)
    a = made(one, two)
    assert rewrite.same_graph(a, made(two, one, one))
    assert not rewrite.same_graph(a, made(one)) and not rewrite.same_graph(made(one), a)
    assert not rewrite.same_graph(a, made(one, (*two[:2], True)))
