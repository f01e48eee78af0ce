"""Task similarity by bits against brute force, with exact bits and with shared ones."""

import random

import numpy as np
import pytest

from chronoweave.config import PolicyConfig
from chronoweave.operators import policy


def brute(asked, tasks):
    out = {}
    for name, e in asked.items():
        scored = [(-len(e & t) / len(e | t), k) for k, t in tasks.items() if e & t]
        out[name] = (min(scored)[1], -min(scored)[0]) if scored else (None, 0.0)
    return out


@pytest.mark.parametrize("bits,universe", [(8192, 60), (8192, 3000), (64, 60), (64, 3000), (128, 500)])
def test_best_matches(monkeypatch, bits, universe):
    monkeypatch.setattr(policy, "MOST_BITS", bits)
    rng = random.Random(universe + bits)
    draw = lambda: np.array(sorted(rng.sample(range(universe), rng.randrange(1, 40))))
    tasks, asked = [draw() for _ in range(60)], [draw() for _ in range(30)]
    asked += [tasks[3], tasks[3][:-1], np.array([universe + 5])]
    tasks += [tasks[3]]  # an equal one of another name
    names = np.array(rng.sample(range(1000), len(tasks)))
    found, score = policy.best_matches(asked, tasks, names)
    want = brute({i: set(x.tolist()) for i, x in enumerate(asked)}, {int(names[j]): set(x.tolist()) for j, x in enumerate(tasks)})
    for i in range(len(asked)):
        task, likeness = want[i]
        assert (None if found[i] < 0 else int(names[found[i]])) == task and score[i] == likeness


@pytest.mark.parametrize("tile", [1024, 3])
def test_decide_in_tiles(spark, monkeypatch, tile):
    monkeypatch.setattr(policy, "TILE", tile)
    rng = random.Random(9)
    tasks = {f"t{i:02d}": set(rng.sample(range(30), rng.randrange(1, 12))) for i in range(25)} | {"u": {1, 2}, "v": {1, 2}}
    asked = {i: set(rng.sample(range(35), rng.randrange(1, 12))) for i in range(14)} | {90: {1, 2}, 91: {1, 2}, 92: {777}}
    weak = [("w", e, 0.1) for e in range(35)]  # below the cutoff
    frame = spark.createDataFrame([(t, e, 0.9) for t, es in tasks.items() for e in es] + weak, "task_id string, edge_id bigint, reliability double")
    new = spark.createDataFrame([(i, e) for i, es in asked.items() for e in es], "new_id bigint, edge_id bigint")
    got = {r.new_id: (r.action, r.task_id, r.similarity) for r in policy.decide(frame, new).collect()}
    limit = PolicyConfig().similarity_threshold
    for i, (task, likeness) in brute(asked, tasks).items():
        reuse = task is not None and likeness >= limit
        assert got[i] == ("REUSE" if reuse else "ISOLATE", task if reuse else None, likeness)
    assert {r.action for r in policy.decide(frame.limit(0), new).collect()} == {"ISOLATE"}
    assert policy.decide(frame, new.limit(0)).collect() == []


@pytest.mark.parametrize("tasks_at_once,asked_at_once,block", [(1 << 16, 1 << 14, 1 << 20), (7, 3, 64)])
def test_signatures_travel_as_bits(spark, monkeypatch, tasks_at_once, asked_at_once, block):
    """Where every edge has a bit of its own, no tile holds lists of edges, and the best of equal ones has the least name."""
    monkeypatch.setattr(policy, "TASKS", tasks_at_once)
    monkeypatch.setattr(policy, "ASKED", asked_at_once)
    monkeypatch.setattr(policy, "BLOCK", block)
    monkeypatch.setattr(policy, "best_matches", lambda *_: pytest.fail("compared as lists"))
    rng = random.Random(4)
    tasks = {i: set(rng.sample(range(70), rng.randrange(1, 30))) for i in range(60)} | {90: {1, 2}, 80: {1, 2}, 85: {1, 2, 3, 4}}
    asked = {i: set(rng.sample(range(75), rng.randrange(1, 30))) for i in range(20)} | {70: {1, 2}, 71: {2, 1}, 72: {777}, 73: {1, 2, 777}}
    frame = spark.createDataFrame([(t, e, 0.9) for t, es in tasks.items() for e in es], "task_id bigint, edge_id bigint, reliability double")
    new = spark.createDataFrame([(i, e) for i, es in asked.items() for e in es], "new_id bigint, edge_id bigint")
    got = {r.new_id: (r.task_id, r.similarity) for r in policy.decide(frame, new, PolicyConfig(similarity_threshold=0.0)).collect()}
    assert got == brute(asked, tasks)
