"""Split files against plain lists, and sampled Beta intervals against the exact distribution."""

import json

import pytest

from chronoweave.config import CardConfig
from chronoweave.functions import ids
from chronoweave.functions.special import betainc
from chronoweave.operators import cards, stats
from chronoweave.sources import logs


def test_split_files_are_what_plain_lists_say(spark, tmp_path):
    rows = [(f"é{i:03d}" if i % 7 == 0 else f"s{i:03d}", "abc"[i % 3]) for i in range(100)]
    folds = stats.stratified_folds(spark.createDataFrame(rows, "id string, label string"), 4, 3)
    own = {r.id: r.fold for r in folds.collect()}
    made = logs.write_splits(folds.repartition(5), str(tmp_path / "s"))
    assert len(made) == 8
    for i in range(4):
        for side, want in (("val", [x for x in own if own[x] == i]), ("train", [x for x in own if own[x] != i])):
            logs.save_json(str(tmp_path / "plain.json"), sorted(want))
            assert (tmp_path / "s" / f"fold_{i}_{side}.json").read_text() == (tmp_path / "plain.json").read_text()
    for _ in range(2):
        logs.write_split_tables(folds, str(tmp_path / "t"))
    got = spark.read.json(str(tmp_path / "t")).collect()
    assert sorted((r.fold, r.side, r.id) for r in got) == sorted((i, "val" if own[x] == i else "train", x) for i in range(4) for x in own)


def test_one_fold_leaves_no_train_ids(spark, tmp_path):
    folds = spark.createDataFrame([(2, 0), (1, 0), (10, 0)], "id bigint, fold bigint")
    logs.write_splits(folds, str(tmp_path))
    assert json.loads((tmp_path / "fold_0_train.json").read_text()) == [] and json.loads((tmp_path / "fold_0_val.json").read_text()) == [1, 2, 10]


def test_beta_intervals_hold_their_share_of_the_exact_distribution(spark):
    counts = [(0, 0), (1, 4), (6, 0), (3, 3), (40, 2), (200, 100)]
    rows = [(f"e{i}", (1, 1), [(2, 0)], 0, 9, 0, 0.5, s, m, None, "unary", False) for i, (s, m) in enumerate(counts)]
    cfg = CardConfig(samples=20_000)
    for r in cards.beta_interval(spark.createDataFrame(rows, ids.EDGE), cfg).collect():
        s, m = counts[int(r.id[1:])]
        below, upto = betainc(s + cfg.alpha0, m + cfg.beta0, r.lo), betainc(s + cfg.alpha0, m + cfg.beta0, r.hi)
        # the sampled quantile's share has a spread of sqrt(p (1 - p) / n), about 0.0011
        assert upto - below == pytest.approx(0.95, abs=0.007)
        assert below == pytest.approx(0.025, abs=0.005) and 1 - upto == pytest.approx(0.025, abs=0.005)
        assert r.mean == pytest.approx((s + 1) / (s + m + 2))
