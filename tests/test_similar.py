"""Groups of close directions: recall against brute force, hot buckets in tiles, and odd vectors."""

import numpy as np
import pytest

from chronoweave.operators import similar

VEC = "id bigint, vector array<double>"


def by_force(rows, threshold):
    x = np.array([v for _, v in rows])
    x = x / np.linalg.norm(x, axis=1)[:, None]
    close = x @ x.T >= threshold
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(close[i]):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    least = {}
    for i, (name, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), name), name)
    return {name: least[find(i)] for i, (name, _) in enumerate(rows)}, close


def some_vectors(seed, groups, each, dim=32, spread=0.05):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        base = rng.standard_normal(dim)
        for k in range(each if g else each * 10):  # one large group
            rows.append((len(rows), (base + spread * (k % 7 + 1) * rng.standard_normal(dim)).tolist()))
    return rows


@pytest.mark.parametrize("run", [1024, 16])
def test_groups_are_those_of_brute_force(spark, monkeypatch, run):
    monkeypatch.setattr(similar, "RUN", run)
    rows = some_vectors(1, 30, 8)
    want, _ = by_force(rows, 0.9)
    got = {r.id: r.group_id for r in similar.groups(spark.createDataFrame(rows, VEC).repartition(5), 0.9, 0.999).collect()}
    assert got == want and len(set(want.values())) > 30


def test_recall_of_single_pairs_is_what_was_asked(spark):
    """Pairs at the very threshold, of which nothing else leads from one to the other."""
    rng = np.random.default_rng(4)
    rows, angle = [], np.arccos(0.9) - 1e-9
    for _ in range(300):
        a, b = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
        rows += [(len(rows), a.tolist()), (len(rows) + 1, (np.cos(angle) * a + np.sin(angle) * b).tolist())]
    got = {r.id: r.group_id for r in similar.groups(spark.createDataFrame(rows, VEC), 0.9, 0.95).collect()}
    found = sum(got[i] == got[i + 1] for i in range(0, 600, 2)) / 300
    assert found >= 0.9
    assert all(got[i] in (i, i - 1) for i in range(600))


def test_plans_follow_the_number_of_vectors():
    for n in (1, 1000, 10**6, 10**12):
        bits, bands = similar.plan(n, 0.9, 0.95)
        assert n / 2**bits <= similar.IN_BUCKET or bits == similar.MOST_BITS
        p = (1 - np.arccos(0.9) / np.pi) ** bits
        assert 1 - (1 - p) ** bands >= 0.95 > 1 - (1 - p) ** (bands - 1)
    assert similar.plan(100, 1.0, 0.95)[1] == 1
    for bad in ((0.0, 0.5), (1.1, 0.5), (0.5, 1.0)):
        with pytest.raises(ValueError):
            similar.plan(10, *bad)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [5e300, 0.0]), (3, [1e-300, 0.0]), (4, [-1.0, 0.0]), (5, [0.0, 0.0]), (6, None), (7, []), (8, [1.0, None]), (9, [float("nan"), 1.0]), (10, [1.0, 0.0, 0.0]), (11, [2.0, 0.0, 0.0]), (None, [1.0, 0.0]), (3, [1e-300, 0.0]), (12, [-3.0, 0.0]), (12, [7.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, VEC).selectExpr("*", "1 AS dim", "2 AS group_id")
    got = {r.id: r.group_id for r in similar.groups(df, 0.95).collect()}
    # 12 stands for two vectors, and so joins the groups of 4 and 10
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9, 10: 4, 11: 4, 12: 4, None: None}
    assert similar.groups(df.limit(0)).collect() == []


@pytest.mark.parametrize("run", [1024, 16])
def test_groups_in_bands_are_those_of_brute_force(spark, monkeypatch, run):
    monkeypatch.setattr(similar, "RUN", run)
    monkeypatch.setattr(similar, "ROW_PAIRS", 0)
    rows = some_vectors(1, 30, 8)
    want, _ = by_force(rows, 0.9)
    assert {r.id: r.group_id for r in similar.groups(spark.createDataFrame(rows, VEC).repartition(5), 0.9, 0.999).collect()} == want


def test_low_thresholds_compare_blocks_and_miss_nothing(spark, monkeypatch):
    """Bands would take thousands of rows a vector, and at half the recall miss half of the single pairs."""
    assert not similar.in_bands(600_000, similar.plan(600_000, 0.4, 0.9999)[1]) and similar.in_bands(10**6, similar.plan(10**6, 0.9, 0.95)[1])
    monkeypatch.setattr(similar, "BLOCK", 50)
    monkeypatch.setattr(similar, "ANCHORS", 40)
    monkeypatch.setattr(similar, "SLICE", 300)
    rng = np.random.default_rng(7)
    rows = [(3 * i + 1, rng.standard_normal(24).tolist()) for i in range(500)]
    want, close = by_force(rows, 0.5)
    sizes = sorted(list(want.values()).count(g) for g in set(want.values()))
    assert sizes[-1] > 100 and sizes[0] == 1 and 2 in sizes
    got = {r.id: r.group_id for r in similar.groups(spark.createDataFrame(rows, VEC).repartition(5), 0.5, 0.5).collect()}
    assert got == want
