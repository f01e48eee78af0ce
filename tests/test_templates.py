"""Templates against brute force: gaps, versions, composition, and the edges that matches make."""

import random

import pytest

from chronoweave.functions.asof import first_within
from chronoweave.operators import templates

ROWS = [
    ("A", 1, 1, 0, 0, "v", None, None), ("A", 1, 1, 0, 1, "c", 1, 20),
    ("A", 2, 1, 100, 0, "v", None, None), ("A", 2, 1, 100, 1, "c", 1, 20), ("A", 2, 1, 100, 2, "p", 0, 30),
    ("one", 1, 1, 0, 0, "p", None, None),
    ("B", 1, 2, 0, 0, "T:A", None, None), ("B", 1, 2, 0, 1, "T:one", 1, 40), ("B", 1, 2, 0, 2, "c", 0, 50),
    ("never", 1, 1, 0, 0, "v", None, None), ("never", 1, 1, 0, 1, "c", 9, 3),
]


def brute(events, rows):
    found, seen = [], set(events)
    for level in sorted({r[2] for r in rows}):
        made = set()
        for name in {r[0] for r in rows if r[2] == level}:
            versions = sorted({(r[3], r[1]) for r in rows if r[0] == name})
            for k, (valid, version) in enumerate(versions):
                ends = versions[k + 1][0] if k + 1 < len(versions) else float("inf")
                steps = sorted((r[4:] for r in rows if r[0] == name and r[1] == version), key=lambda s: s[0])
                for n, kind, t in seen:
                    if kind != steps[0][1] or not valid <= t < ends:
                        continue
                    times = [t]
                    for _, want, lo, hi in steps[1:]:
                        hits = [u for m, k2, u in seen if m == n and k2 == want and times[-1] + lo <= u <= times[-1] + hi]
                        if not hits:
                            break
                        times.append(min(hits))
                    else:
                        made.add((name, version, level, n, times[0], times[-1], tuple(times)))
        found += made
        seen |= {(m[3], "T:" + m[0], m[5]) for m in made}
    return sorted(found)


def test_matches_of_all_levels(spark):
    rng = random.Random(6)
    events = [(rng.randrange(3), rng.choice("vcp"), rng.randrange(200)) for _ in range(250)]
    frame = spark.createDataFrame(events + events[:5], "n bigint, kind string, t bigint")
    rows = spark.createDataFrame(ROWS, templates.TEMPLATE)
    got = sorted((r.template, r.version, r.level, r.n, r.start, r.stop, tuple(r.times)) for r in templates.composed(frame, rows).collect())
    assert got == brute(set(events), ROWS)
    assert {r[0] for r in got} == {"A", "B", "one"} and {r[1] for r in got if r[0] == "A"} == {1, 2}
    assert templates.composed(frame.limit(0), rows).count() == 0 and templates.composed(frame, rows.limit(0)).collect() == []


def test_edges_of_matches(spark):
    rows = [("A", 1, 1, 5, 10, 30, [10, 20, 30]), ("Z", 1, 1, 5, 10, 30, [10, 20, 30]), ("A", 2, 1, 5, 30, 30, [30, 30]), ("one", 1, 1, 6, 4, 4, [4])]
    got = templates.as_edges(spark.createDataFrame(rows, templates.MATCH)).collect()
    assert [(r.id, r.delta_min, r.delta_max, r.provenance) for r in got] == [("5@30&5@10,5@20#30", 10, 20, "template:A@1")]


@pytest.mark.parametrize("seed", [1, 2])
def test_first_within_any_intervals(spark, seed):
    rng = random.Random(seed)
    events = [(rng.choice(["a", "b"]), rng.randrange(-100, 300)) for _ in range(120)]
    asked = []
    for i in range(200):
        lo = rng.randrange(-120, 320)
        asked.append((i, rng.choice(["a", "b", "c"]), lo, lo + rng.choice([0, 0, 3, 10, 90 * (seed - 1)])))
    got = first_within(spark.createDataFrame(asked, "i int, k string, open bigint, close bigint"), spark.createDataFrame(events, "k string, t bigint"), ["k"]).collect()
    assert len(got) == len(asked)
    for r in got:
        inside = [t for k, t in events if k == r.k and r.open <= t <= r.close]
        assert r.hit == (min(inside) if inside else None)
