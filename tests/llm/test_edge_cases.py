"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronoweave.llm import chat_windows, license_scans, mixing, ngram_join, packing, progressive_jpeg, quality_rules, substring_dedup, token_counts, url_filters
from chronoweave.llm.tokens import encode

from .test_llm_operators import DOC, WORDS, components_by_force, samples, words_of

BLANKS = [" " * 1_000_000, "\n" * 1_000_000, "before" + " " * 1_000_000 + "after", "a\n" + "\t " * 500_000 + "b", "x" * 300_000]


@pytest.fixture(scope="module")
def slow():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with nulls everywhere, repeated rows, and columns whose names operators might use themselves."""
    passage = " ".join(words_of(900, 80))
    rows = [(1, passage, "a"), (1, passage, "a"), (2, passage + " " + " ".join(words_of(901, 60)), None), (None, None, None), (None, passage, "a"), (3, "", "b"), (4, " \n\t ", "b"), (5, "one", "b")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("lang", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("bigint"))
    clash = ("skey", "slot", "size", "key", "taken", "doc", "anchor", "__doc", "__spans", "__id", "__set", "__sid", "__place", "__words", "component", "sid", "gram")
    return frame.select("*", *[F.lit(f"={c}").alias(c) for c in clash]).repartition(2)


@pytest.mark.parametrize("text", BLANKS)
def test_long_runs_have_the_other_librarys_ids(slow, text):
    assert encode(text) == slow.encode(text, add_special_tokens=False).ids


def test_long_blank_texts_pass_every_tokenizing_operator(spark, slow):
    docs = spark.createDataFrame(list(enumerate(BLANKS)), "doc_id bigint, text string")
    want = {i: len(slow.encode(t, add_special_tokens=False).ids) for i, t in enumerate(BLANKS)}
    packed = packing.pack(docs).groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("d")).collect()
    assert {r.doc_id: (r.n, r.d) for r in packed} == {i: (n + 1, n + 1) for i, n in want.items()}
    assert {r.doc_id: r.n for r in token_counts.count_tokens(docs).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()} == want
    turns = docs.select(F.lit(1).alias("conv_id"), F.col("doc_id").alias("turn"), F.lit("assistant").alias("role"), "text")
    assert chat_windows.read_back(chat_windows.format_conversations(turns)).first().loss_chars == sum(map(len, BLANKS))


def test_each_id_lies_in_one_piece_and_nothing_is_padded(odd):
    rows = packing.pack(odd.unionByName(odd.withColumn("doc_id", F.col("doc_id") + 10))).toPandas()
    for _, g in rows.groupby("sequence_id"):
        n = int(g.length.sum())
        assert n == 2048 or n & (n - 1) == 0
        assert sorted(g.offset) == list(np.cumsum([0, *g.sort_values("offset").length[:-1]]))
    texts = {2: odd.where("doc_id = 2").first().text}
    mine = rows[rows.doc_id == 2].sort_values("start")
    assert list(mine.start) == [0, *np.cumsum(mine.length)[:-1]] and set(mine.doc_tokens) == {len(encode(texts[2])) + 1} and mine.length.sum() == len(encode(texts[2])) + 1


def test_tokens_by_line_against_the_other_library(spark, slow):
    rng = np.random.default_rng(3)
    parts = ["word", " ", "\n", "\n\n", "ß日本", "🙂", "12345", "  \n ", "it's", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts, 60)) for _ in range(40)] + ["\n", "a\n", "\n\na"]
    want = Counter()
    for i, text in enumerate(texts):
        raw, at = text.encode(), 0
        for token in (slow.id_to_token(x) for x in slow.encode(text, add_special_tokens=False).ids):
            want[i, raw[:at].count(b"\n")] += 1
            at += len(token)  # a character of the byte-level alphabet a byte
        assert at == len(raw)
    got = token_counts.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.section): r.n_tokens for r in got if r.n_tokens} == dict(want)


def test_urls_repeat_and_run_long(spark):
    urls = ["http://a.com/x"] * 3 + ["http://b.net/es/y"] * 3 + ["http://q.org/" + "z" * 50_000, "http://q.org/x", None, "", "no scheme"]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").select("*", F.lit("c").alias("host"), F.lit("c").alias("gram"), F.lit(1).alias("n"))
    one, two = (sorted(map(tuple, url_filters.judge(frame.repartition(n)).collect())) for n in (1, 3))
    assert one == two and len(one) == len(urls)
    rows = {r[0]: r for r in one}
    assert len(rows[6][2]) == 50_001 and rows[6][4] in ("allow", "block") and rows[8][1:5] == ("", "", None, rows[10][4])
    bare = url_filters.judge(spark.createDataFrame([(1, "http://q.org/x")], "page_id bigint, url string")).first()
    assert bare.verdict == "allow" and bare.threshold is None


@pytest.mark.parametrize("percent", [30, 50, 85, 100])
def test_similar_sets_of_any_sizes_link(spark, percent, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL_GROUP", 2)
    monkeypatch.setattr(ngram_join, "TILE", 8)
    base = words_of(910, 700)
    rows = [(i, " ".join(base[: 60 + 16 * i])) for i in range(38)]
    got = Counter(map(tuple, ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), percent=percent).collect()))
    assert got == components_by_force(rows, percent)


def test_similar_sets_reject_what_is_no_percent(spark):
    with pytest.raises(ValueError):
        ngram_join.similar_groups(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), percent=0)


def test_near_duplicates_of_odd_rows(odd):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_groups(odd).collect())
    assert got[1, 77, 1] == 2 and got[None, 77, 1] == 1 and got[None, 0, None] == 1 and got[3, 0, 3] == 1 and got[5, 1, 5] == 1
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns and kept.where("skey <> '=skey' or __sid <> '=__sid'").count() == 0
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, None, 3, 4, 5])


def test_passages_of_odd_rows(odd, spark):
    found = substring_dedup.find_passages(odd).collect()
    assert {(r.doc_id, r.start_word, r.end_word, r.anchor_doc) for r in found} == {(2, 0, 80, 1)}
    left = substring_dedup.without_passages(odd)
    assert left.columns == odd.columns and left.count() == 8 and left.where("__spans <> '=__spans' or doc <> '=doc'").count() == 0
    assert len(left.where("doc_id = 2").first().text.split()) == 60
    same = " ".join(["again"] * 20_000)
    periodic = [(1, same), (2, same), (3, "x y " * 300), (4, "q r x y " + "x y " * 100)]
    got = substring_dedup.find_passages(spark.createDataFrame(periodic, "doc_id bigint, text string")).collect()
    assert {r.doc_id for r in got} == {2, 4} and len(got) <= 6
    assert max(r.end_word - r.start_word for r in got if r.doc_id == 2) == 20_000


def test_passages_against_brute_force(spark):
    """Random tables with several shared passages a pair, some with changed words; every shared word of 50 or more in a row is covered, nothing else is."""
    rng = np.random.default_rng(12)
    pool = [words_of(1000 + i, int(rng.integers(50, 90))) for i in range(6)]
    rows, shared = [], {}
    for i in range(14):
        text, mine = words_of(1100 + i, 30), []
        for p in rng.choice(6, int(rng.integers(0, 4)), replace=False):
            mine.append((len(text), int(p)))
            text += pool[p] + words_of(1200 + 10 * i + int(p), int(rng.integers(5, 120)))
        rows.append((i, " ".join(text)))
        shared[i] = mine
    want, seen = {}, set()
    for i in range(14):
        want[i] = {k for at, p in shared[i] if p in seen for k in range(at, at + len(pool[p]))}
        seen |= {p for _, p in shared[i]}
    got = {i: set() for i in range(14)}
    for r in substring_dedup.find_passages(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect():
        got[r.doc_id] |= set(range(r.start_word, r.end_word))
    assert got == want


def test_alignment_of_gaps_is_the_longest_common_subsequence():
    rng = np.random.default_rng(4)
    for _ in range(60):
        one, two = (rng.integers(0, 4, int(rng.integers(0, 30))) for _ in range(2))
        table = np.zeros((len(one) + 1, len(two) + 1), int)
        for i, x in enumerate(one):
            for j, y in enumerate(two):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert substring_dedup._between(one, two) == table[-1, -1]


def test_mix_keeps_clashing_columns_and_cuts_equal_rows_exactly(odd, spark):
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixed.where("skey <> '=skey' or size <> '=size' or __place <> '=__place'").count() == 0
    rows = [(7, "a b c d e", "s")] * 9 + [(8, "f g h", "s"), (9, "i j", "t"), (10, " ".join(words_of(920, 40)), "t")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    sizes = docs.select("doc_id", "source", mixing.n_words(docs["text"]).alias("size"))
    aims = {r.skey: int(r.target) for r in mixing.mix_sizes(sizes).select("skey", "target").distinct().collect()}
    took = Counter()
    for r in mixing.mix(docs).collect():
        took["=" + r.source] += len(r.text.split())
    assert dict(took) == aims
    assert sorted(map(tuple, mixing.mix(docs).collect())) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()))


def test_media_of_odd_rows(odd, spark):
    rows = progressive_jpeg.read_back(progressive_jpeg.store_texts(odd)).collect()
    assert len(rows) == 8 and Counter(r.n_bytes for r in rows)[0] == 2 and {r.payload_bytes for r in rows if r.n_bytes == 0} == {64}
    none = spark.createDataFrame([(1, None)], "doc_id bigint, media binary")
    assert tuple(progressive_jpeg.read_back(none).first()) == (1, *[None] * 7) and tuple(progressive_jpeg.to_tensors(none).first()) == (1, None, None, None)
    tensors = {r.doc_id: r for r in progressive_jpeg.to_tensors(progressive_jpeg.store_texts(odd)).collect()}
    assert all(len(r.rgb) == r.height * r.width * 3 for r in tensors.values())
    long = spark.createDataFrame([(1, "ab" * 400_000)], "doc_id bigint, text string")
    got = progressive_jpeg.read_back(progressive_jpeg.store_texts(long)).first()
    assert got.n_bytes == 800_000 and got.payload_bytes == 800_000


def test_conversations_with_ties_repeats_and_long_turns(spark):
    ddl = "conv_id bigint, turn bigint, role string, text string, window_id string"
    assert chat_windows.read_back(chat_windows.format_conversations(spark.createDataFrame([], ddl))).count() == 0
    long = " ".join(words_of(930, 5000))
    rows = [(1, 0, "system", "s"), (1, 1, "user", long), (1, 1, "assistant", "tie"), (1, 2, "assistant", "again"), (1, 2, "assistant", "again"), (1, None, "user", "first"), (None, 0, "assistant", "x"), (None, 0, "assistant", "x")]
    frame = spark.createDataFrame([(*r, "c") for r in rows], ddl).repartition(3)
    got = {r.conv_id: r for r in chat_windows.read_back(chat_windows.format_conversations(frame, budget=200)).collect()}
    import hashlib

    ordered = [("user", "first"), ("system", "s"), ("assistant", "tie"), ("user", long), ("assistant", "again"), ("assistant", "again")]
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in ordered).encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(b"tieagainagain").hexdigest() and got[1].loss_chars == 13 and got[None].n_turns == 2
    windows = chat_windows.format_conversations(frame, budget=200).where("conv_id = 1").orderBy("window_id").collect()
    assert max(w.n_turns - w.n_repeated for w in windows if w.n_tokens > 200) == 1


def test_quality_without_trusted_rows_and_with_null_ids(odd, spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    ratio, threshold = quality_rules.fit_rule(odd, labels)
    assert not ratio.any() and threshold == 0.0
    rows = quality_rules.judge(odd, ratio, threshold).collect()
    assert len(rows) == 8 and Counter((r.doc_id, r.kept) for r in rows)[1, True] == 2 and {r.kept for r in rows if r.n_words == 80} == {True}
    nulls = spark.createDataFrame([(None, 1), (1, 1), (2, 0), (None, None)], "doc_id bigint, quality int")
    kept = quality_rules.keep_good(odd, *quality_rules.fit_rule(odd, nulls))
    assert kept.columns == odd.columns and kept.where("text is null").count() == 0
    same = {r.score for r in quality_rules.judge(odd, *quality_rules.fit_rule(odd, nulls)).collect() if r.n_words == 80}
    assert len(same) == 1


def by_rule(text, rules):
    """Places that no place of greater priority holds, pair by pair."""
    places = []
    for label, keyword, pattern, priority, weight in rules:
        if keyword in text.lower():
            for m in re.finditer(pattern, text):
                size = len(m[1] or "") + len(m[2] or "")
                places.append((m.end() - size, m.end(), priority, label, weight))
    return [p for p in places if not any(q[2] > p[2] and q[0] <= p[0] and q[1] >= p[1] for q in places)]


def test_every_license_rule_against_brute_force(spark):
    rules = license_scans.rules()
    texts, wanted = [], []
    for label, _, _, name in license_scans.NAMES:
        shown = max(samples(name), key=len)
        texts += [f"This is licensed under the {shown}.", f"{shown}"]
        wanted += [label, label]
    texts += ["licensed under the gnu general public license, version 2 or later and the MIT License; " * 40, "SPDX-License-Identifier: MIT " * 50, "nothing here", ""]
    rows = {r.doc_id: r for r in license_scans.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    fired = set()
    for i, text in enumerate(texts):
        want = by_rule(text, rules)
        assert sorted((d.lo, d.hi, d.priority) for d in rows[i].detections) == sorted(p[:3] for p in want), text
        fired |= {p[3] for p in want}
    assert fired == {n[0] for n in license_scans.NAMES}
    long = spark.createDataFrame([(1, "word " * 200_000 + "mit license")], "doc_id bigint, text string")
    got = license_scans.scan(long).first()
    assert (got.first_word, got.n_base, got.base_labels) == (200_000, 1, "mit")


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_rows_and_empty_tables(odd, spark, tmp_path, k):
    spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    name, stage = corpus_pipeline.STAGES[k]
    made = stage(spark, odd, str(tmp_path))
    if k < 4:
        assert made.columns == odd.columns and made.schema == odd.schema, name
    rows = made.collect()
    assert len(rows) >= 1
    assert stage(spark, spark.createDataFrame([], odd.schema), str(tmp_path)).count() == 0
    assert stage(spark, spark.createDataFrame([], DOC), str(tmp_path)).count() == 0


def test_words_of_the_fixture_are_words():
    assert all(WORDS.fullmatch(w) for w in words_of(1, 5))
