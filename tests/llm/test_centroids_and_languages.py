"""Centroid clustering and language ID against brute force, at every magnitude and on the edge cases."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from chronoweave.llm import centroids, language_id

VEC = "vec_id long, embedding array<double>"
DOC = "doc_id long, text string, lang string"


def brute_clusters(rows, k, rounds, dim, salt="1:"):
    kept = []
    for i, vector in rows:
        if vector is not None and len(vector) == dim and all(v is not None and math.isfinite(v) for v in vector):
            kept.append((i, [math.floor(64 * v) for v in vector]))
    first = sorted((r for r in kept if r[0] is not None), key=lambda r: hashlib.sha256(f"{salt}{r[0]}".encode()).hexdigest())[:k]
    centers = [list(v) for _, v in first]
    if not centers:
        return []

    def near(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centers]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[0], []).append(v)
        for c, members in own.items():
            centers[c] = [sum(x) // len(members) for x in zip(*members)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, c, d in found:
        inertia[c] += d
    long = lambda v: v if v < 1 << 63 else None
    return [(i, c, long(d), long(inertia[c]), long(sum(inertia.values())), hashlib.sha256(",".join(map(str, centers[c])).encode()).hexdigest()) for i, c, d in found]


def same(got, want):
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("size", [1.0, 3e5, 4e6, 1e30])
def test_clusters_at_all_magnitudes(spark, size):
    rng = random.Random(int(math.log10(size)))
    rows = [(i, [rng.uniform(-1, 1) * size * (1 if rng.random() < 0.5 else 1e-3) for _ in range(4)]) for i in range(120)]
    got = centroids.cluster(spark.createDataFrame(rows, VEC), k=5, dim=4).collect()
    same(got, brute_clusters(rows, 5, 3, 4))


def test_cluster_edge_cases(spark):
    fine = [(i, [float(i % 7), 1.0]) for i in range(40)]
    odd = [(100, None), (101, []), (102, [1.0]), (103, [1.0, None]), (104, [1.0, float("nan")]), (105, [float("inf"), 0.0]), (None, [3.0, 1.0]), (106, [-0.0, 0.0]), (106, [-0.0, 0.0])]
    rows = fine + odd + [(7, [5.0, 5.0])] * 400  # one frequent row
    df = spark.createDataFrame(rows, VEC).selectExpr("vec_id", "embedding", "'x' AS cluster", "1 AS x")
    got = [[tuple(r) for r in centroids.cluster(df.repartition(n), k=3, dim=2).collect()] for n in (1, 7)]
    same(got[0], got[1])
    assert len(got[0]) == 40 + 3 + 400 and {r[0] for r in got[0]} == {i for i, _ in fine} | {None, 106}
    assert centroids.cluster(df.limit(0), dim=2).collect() == []
    assert centroids.cluster(df.where("vec_id is null"), dim=2).collect() == []
    few = centroids.cluster(df.where("vec_id < 2"), k=16, dim=2).collect()
    assert sorted((r.vec_id, r.distance) for r in few) == [(0, 0), (1, 0)]


def test_equal_distances_go_to_the_smaller_number():
    cluster, distance = centroids.nearest(np.array([[0.0, 0.0], [3.0, 0.0]]), [[1, 0], [-1, 0], [1, 0]])
    assert cluster.tolist() == [0, 0] and distance.tolist() == [1, 4]


def test_sums_are_exact_where_floats_are_not(spark):
    big = float(1 << 40)
    rows = [(i, [big + i, -big]) for i in range(50)]
    got = centroids.cluster(spark.createDataFrame(rows, VEC), k=2, rounds=2, dim=2).collect()
    same(got, brute_clusters(rows, 2, 2, 2))


def brute_profile(texts, size=300):
    counts = Counter()
    for text in texts:
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text or "")
        for word in re.findall(r"[^\W\d_]+", low):
            padded = f"_{word}_"
            for n in (1, 2, 3):
                counts.update(g for g in (padded[i : i + n] for i in range(len(padded) - n + 1)) if g != "_")
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size]]


def brute_language(text, profiles, size=300):
    own = brute_profile([text], size)
    if not own or not profiles:
        return "und", 0.0
    found = []
    for lang, profile in sorted(profiles.items()):
        at = {g: i for i, g in enumerate(profile)}
        found.append((sum(abs(i - at[g]) if g in at else size for i, g in enumerate(own)), lang))
    d, lang = min(found)
    return lang, 1.0 - d / (len(own) * size)


TEXTS = {
    "en": ["the quick brown fox jumps over the lazy dog", "She sells sea shells; by the sea-shore!", "It was the best of times, 1984."],
    "de": ["Der schnelle braune Fuchs springt über den faulen Hund", "Straße und Größe, ÄÖÜ äöü", "Die Katze sitzt auf der Matte"],
    "el": ["Η γρήγορη καφέ αλεπού πηδάει", "ΚΑΛΗΜΕΡΑ κόσμε"],
    "zh": ["敏捷的棕色狐狸跳过了懒狗", "你好，世界"],
}


def test_predictions_match_brute_force(spark):
    rows = [(i, t, lang) for i, (lang, t) in enumerate((x, t) for x, ts in TEXTS.items() for t in ts)]
    profiles = {x: brute_profile(ts) for x, ts in TEXTS.items()}
    asked = [(0, t, None) for _, t, _ in rows] + [(1, t, None) for t in ("", None, "123 !!", "fox fox", "Über", "狐", "ij̀", "the Straße", "x" * 1000)]
    docs = spark.createDataFrame(rows, DOC)
    got = language_id.predict(spark.createDataFrame(asked, DOC), language_id.fit(docs.repartition(3)), ["doc_id", "text"]).collect()
    for r in got:
        if r.text and "̀" in r.text:  # a mark belongs to its word, which the brute force's pattern doesn't know
            continue
        assert (r.lang_pred, r.score) == brute_language(r.text, profiles), r.text
    assert {r.lang_pred for r in got if r.text in (None, "", "123 !!")} == {"und"}


def test_long_texts_are_read_whole(spark, monkeypatch):
    rng = random.Random(5)
    text = " ".join(rng.choice(["Größe", "wort", "x", "狐狸", "...", "é", "a1b", "—"]) for _ in range(4000))
    for piece in (64, 1000, 1 << 19):
        monkeypatch.setattr(language_id, "PIECE", piece)
        raw = np.frombuffer(text.encode(), np.uint8)
        o, code, count, lettered = language_id._count_block(raw, np.array([0, len(raw)]), np.array([3]), 4)
        got = {"".join(chr(c) for c in (x >> 42, x >> 21 & 0x1FFFFF, x & 0x1FFFFF) if c): n for x, n in zip(code.tolist(), count.tolist())}
        counts = Counter()
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            padded = f"_{word}_"
            counts.update(padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1))
        del counts["_"]
        assert got == dict(counts) and lettered.all() and set(o.tolist()) == {3}


def test_language_edge_cases(spark):
    rows = [(i, t, x) for i, (t, x) in enumerate([("hello there", "en"), ("hello there", "en"), ("guten tag", "de"), (None, "fr"), ("bonjour", None), ("", ""), ("ciao", "")])]
    docs = spark.createDataFrame(rows, DOC).selectExpr("*", "'z' AS __text", "'q' AS gram")
    profiles = language_id.fit(docs)
    assert profiles.langs == ["", "de", "en"]
    got = {r.doc_id: r.lang_pred for r in language_id.predict(docs, profiles, ["doc_id"]).collect()}
    assert got == {0: "en", 1: "en", 2: "de", 3: "und", 4: got[4], 5: "und", 6: ""}
    none = language_id.fit(docs.limit(0))
    assert [(r.lang_pred, r.score) for r in language_id.predict(docs.limit(1), none, ["doc_id"]).collect()] == [("und", 0.0)]
    with pytest.raises(ValueError):
        language_id.fit(docs, most_languages=2)
    # equal distances: the language that comes first
    twin = language_id.fit(spark.createDataFrame([(1, "abc", "y"), (2, "abc", "x")], DOC))
    assert language_id.predict(docs.limit(1), twin, ["doc_id"]).first().lang_pred == "x"


def test_counts_are_flushed_whole(spark, monkeypatch):
    rows = [(i, f"w{chr(97 + i % 26)}{chr(97 + i // 26)} same", "en" if i % 3 else "de") for i in range(500)]
    docs = spark.createDataFrame(rows, DOC)
    want = language_id.fit(docs)
    monkeypatch.setattr(language_id, "HELD", 8)
    got = language_id.fit(docs.repartition(5))
    assert got.langs == want.langs and (got.grams == want.grams).all() and (got.ranks == want.ranks).all()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.001"
    got = language_id.op12_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    right = got.where("lang_pred = lang").count()
    assert right >= 0.95 * got.count() > 0
