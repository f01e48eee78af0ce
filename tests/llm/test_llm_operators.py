"""Brute-force checks and edge cases of the corpus operators."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import chat_windows, license_scans, mixing, ngram_join, packing, progressive_jpeg, quality_rules, substring_dedup, token_counts, url_filters
from chronoweave.llm import textscan as ts
from chronoweave.llm.tokens import encode

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, slot string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(seed, n):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    base, other, passage = words_of(1, 120), words_of(2, 300), words_of(3, 70)
    near = base[:60] + ["changed"] + base[61:]
    rows = [
        (1, " ".join(base), "s1"), (2, " ".join(base), "s1"), (3, " ".join(near), None), (4, None, "s2"), (5, "", "s2"), (6, "two words", "s1"), (7, "Two WORDS", None),
        (8, " ".join(other[:150] + passage + other[150:]), "s3"), (9, " ".join(words_of(4, 90) + passage + words_of(5, 90)), "s3"), (10, " ".join(words_of(6, 20_000)), "s1"),
        (11, "ß 日本 \n\n \t x", "s2"), (11, "ß 日本 \n\n \t x", "s2"), (12, "Released under the MIT License. mit-license; Apache   license", "s1"), (None, "no id here", "s1"),
    ]
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x") for i, t, s in rows], DOC).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def test_packing_covers_each_id_once(docs, empty):
    rows = packing.pack(docs, block_tokens=4096).toPandas()
    texts = Counter((r.doc_id, tuple([*encode(r.text or ""), 1])) for r in docs.collect())
    want = Counter()
    for (name, ids), n in texts.items():
        want[name] += len(ids) * n
    got = Counter()
    for r in rows.itertuples():
        got[None if np.isnan(r.doc_id) else int(r.doc_id)] += r.length
    assert got == want
    ids = {name: np.array(x, "<u4") for name, x in texts}
    for r in rows.dropna(subset=["doc_id"]).itertuples():
        assert zlib.crc32(ids[int(r.doc_id)][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048
    assert packing.pack(empty).count() == 0


def test_tokens_match_the_other_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("", "a b  c\n\n d", "Größe 日本語 🙂🙃 it's 1234567", "x<|endoftext|>y", " \t\r\n", "\x00​́é"):
        assert encode(text) == slow.encode(text, add_special_tokens=False).ids


def test_url_filters(spark):
    urls = ["https://a.COM/x?y", "http://www.example.com/en/1", "http://b.example.com/en/2#z", "ftp://x.net/es/1", "x.net/es/1", None, "http://com", "http://n.net/fr/", "http://good.org/en/3", "://", "http://com/"]
    rows = {r.page_id: r for r in url_filters.judge(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")).collect()}
    assert [rows[i].rule for i in range(11)] == ["com/", "www.example.com/en/", "example.com/en/", "net/es/", None, None, None, "net/fr/", None, None, "com/"]
    assert rows[0].host == "a.com" and rows[0].path == "/x" and rows[5].host == "" and rows[9].path == ""
    assert {r.verdict for r in rows.values()} <= {"allow", "block"}
    assert url_filters.judge(spark.createDataFrame([], "page_id bigint, url string")).count() == 0


def shingles(text, n=4):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def components_by_force(rows, percent):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in range(len(sets)):
        for b in range(a):
            one, two = sets[a][1], sets[b][1]
            if one and two and 100 * len(one & two) >= percent * len(one | two):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return Counter((i, len(s), least.get(find(k))) for k, (i, s) in enumerate(sets))


def test_ngram_join_matches_brute_force(spark, docs, empty, monkeypatch):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for k in range(60):  # a family of near copies, some further apart
        w = words_of(9, 150)
        for j in range(k % 7):
            w[(k * 13 + j * 29) % 150] = f"edit{k}x{j}"
        rows.append((100 + k, " ".join(w)))
    frame = spark.createDataFrame([(i, t) for i, t in rows], "doc_id bigint, text string").repartition(3)
    want = components_by_force(rows, 85)
    for small, tile, hot, run_bytes in ((32, 1024, 4096, 1 << 22), (2, 8, 4096, 1 << 22), (2, 8, 3, 4000), (0, 1, 1, 1)):
        monkeypatch.setattr(ngram_join, "SMALL_GROUP", small)
        monkeypatch.setattr(ngram_join, "TILE", tile)
        monkeypatch.setattr(ngram_join, "HOT", hot)
        monkeypatch.setattr(ngram_join, "RUN_BYTES", run_bytes)
        assert Counter(map(tuple, ngram_join.similar_groups(frame).collect())) == want
    assert ngram_join.similar_groups(empty).count() == 0
    kept = sorted(r.doc_id for r in ngram_join.keep_one(docs).collect() if r.doc_id is not None)
    assert 1 in kept and 2 not in kept and 4 in kept and 5 in kept and 10 in kept


def test_families_with_one_line_in_common(spark, monkeypatch):
    """Groups of a frequent line that hold several components, bridged ones and single sets."""
    monkeypatch.setattr(ngram_join, "SMALL_GROUP", 2)
    monkeypatch.setattr(ngram_join, "TILE", 6)
    monkeypatch.setattr(ngram_join, "HOT", 20)
    line, rows = " ".join(words_of(70, 12)), []
    for f in range(5):
        base = words_of(71 + f, 120)
        for k in range(4 + 8 * (f == 0)):
            w = list(base)
            for j in range(k * 2):  # a chain: each is near the next, the ends aren't near each other
                w[(j * 7) % 120] = f"x{f}y{j}"
            rows.append((len(rows), " ".join([line, *w])))
    rows += [(len(rows) + i, " ".join([line, *words_of(90 + i, 100 + 5 * i)])) for i in range(12)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert Counter(map(tuple, ngram_join.similar_groups(frame).collect())) == components_by_force(rows, 85)


def test_a_tile_gives_a_forest_of_all_its_links():
    rng = np.random.default_rng(3)
    for percent in (50, 85):
        sets = []
        for _ in range(6):
            base = np.unique(rng.integers(0, 1 << 60, 200, dtype=np.uint64))
            for _ in range(8):
                keep = base[rng.random(len(base)) < rng.uniform(0.7, 1.0)]
                sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 60, int(rng.integers(0, 30)), dtype=np.uint64)])))
        first = np.arange(len(sets)) % 3 > 0
        for side in (first, np.ones(len(sets), bool)):
            ids, comp = np.arange(len(sets)), np.arange(len(sets)) // 2 * 2  # some are in one component already
            got = ngram_join.tile_links(side, ids, comp, np.array([len(x) for x in sets]), [ngram_join.signature(x).tobytes() for x in sets], [x.tobytes() for x in sets], percent)
            pairs = [(i, j) for i in ids for j in ids if i < j and (side[i] != side[j] or side.all())]
            true = {(i, j) for i, j in pairs if 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))}
            assert {(min(x), max(x)) for x in got} <= true and len(got) < len(sets)
            assert roots(len(sets), [*got, *enumerate(comp.tolist())]) == roots(len(sets), [*true, *enumerate(comp.tolist())])


def roots(n, links):
    root = list(range(n))
    for _ in range(n):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_keep_one_decides_by_row(spark, empty):
    one, two, three, four = (" ".join(words_of(90 + i, 80)) for i in range(4))
    rows = [(1, one), (1, one), (2, one), (None, one), (None, two), (None, two), (3, three), (4, three), (4, four), (5, ""), (5, ""), (None, None)]
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert Counter(map(tuple, kept)) == Counter([(1, one), (None, two), (3, three), (4, four), (5, ""), (5, ""), (None, None)])
    assert ngram_join.keep_one(empty).count() == 0


def crowded():
    """Documents 100 and 200 share 60 words with every sixth changed; each of 20 others holds a run of five of them."""
    passage = words_of(300, 60)
    other = [f"z{i}" if i % 6 == 5 else w for i, w in enumerate(passage)]
    rows = [(100, " ".join([*words_of(301, 40), *passage, *words_of(302, 40)])), (200, " ".join([*words_of(303, 40), *other, *words_of(304, 40)]))]
    for i in range(20):
        run = i % 10 * 6
        rows.append((i * 7 + 1, " ".join([*words_of(310 + i, 60), *passage[run : run + 5], *words_of(340 + i, 60)])))
    return rows


def test_passages_are_found_in_a_crowd_and_however_rows_are_dealt(spark):
    rows = crowded()
    shared = words_of(400, 70)
    rows += [(1000 + i, " ".join([*words_of(500 + i, 30), *shared[i % 9 :], *words_of(900 + i, 30)])) for i in range(300)]  # hot seeds
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = [sorted(map(tuple, substring_dedup.find_passages(frame.repartition(n)).collect())) for n in (1, 4, 16, 100)]
    assert all(x == found[0] for x in found)
    assert [(r[2], r[3]) for r in found[0] if (r[0], r[4]) == (200, 100)] == [(40, 99)]
    assert {r[0] for r in found[0]} == {200} | {1000 + i for i in range(1, 300)}


def test_substring_dedup(docs, empty):
    found = substring_dedup.find_passages(docs).collect()
    spans = {(r.doc_id, r.anchor_doc): (r.start_word, r.end_word, r.anchor_start) for r in found}
    assert spans[9, 8] == (90, 160, 150)
    assert spans[2, 1] == (0, 120, 0) and spans[3, 1][:2] == (0, 120)
    assert {r.doc_id for r in found} == {2, 3, 9}
    left = {r.doc_id: r for r in substring_dedup.without_passages(docs).collect()}
    assert 2 not in left and 4 in left and 5 in left and len(left[9].text.split()) == 180 and left[9].n_chars == len(left[9].text)
    assert substring_dedup.find_passages(empty).count() == 0


def test_chains_against_quadratic_search():
    rng = np.random.default_rng(5)
    for _ in range(20):
        runs = np.array([[a, a + l, b, b + l, l + 5] for a, b, l in zip(rng.integers(0, 80, 12), rng.integers(0, 80, 12), rng.integers(0, 6, 12), strict=True)])
        runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
        best = []
        for i, (d0, _, a0, _, gain) in enumerate(runs):
            before = [best[j] - 0.1 * (d0 - runs[j][1] + a0 - runs[j][3]) for j in range(i) if runs[j][1] < d0 and runs[j][3] < a0]
            best.append(gain + max([0.0, *before]))
        first = substring_dedup.chain(runs)[0]
        total = sum(runs[i][4] for i in first) - sum(0.1 * (runs[j][0] - runs[i][1] + runs[j][2] - runs[i][3]) for i, j in zip(first, first[1:], strict=False))
        assert total == pytest.approx(max(best))


@pytest.mark.parametrize(("size", "between"), [(60, 40), (60, 100), (60, 200), (200, 200), (200, 400)])
def test_two_passages_with_other_words_between(spark, size, between):
    one, two = words_of(21, size), words_of(22, size)
    texts = [words_of(30, 20) + one + words_of(31, between) + two + words_of(32, 20), words_of(33, 30) + one + words_of(34, between) + two + words_of(35, 30)]
    found = substring_dedup.find_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")).collect()
    covered = {w for r in found for w in range(r.start_word, r.end_word)}
    assert covered == {*range(30, 30 + size), *range(30 + size + between, 30 + 2 * size + between)}


def test_parts_of_a_chain():
    doc, anchor = np.arange(1000), np.arange(5000, 6000)
    runs = np.array([[100, 125, 100], [142, 167, 142], [300, 305, 300], [400, 405, 400], [600, 655, 600]])
    for d0, d1, a0 in runs:
        anchor[a0 : a0 + d1 + 5 - d0] = doc[d0 : d1 + 5]
    # 30 + 12 + 30 words pass together, though their gap is not the widest; the two short runs belong to nothing
    assert substring_dedup.passages(doc, anchor, runs, 5, 50, 80) == [(100, 172, 100, 172, 60), (600, 660, 600, 660, 60)]


def test_passage_whose_seeds_are_anchored_apart(spark):
    passage = words_of(40, 60)
    cuts = [0, 10, 22, 33, 45, 52, 60]
    texts = [words_of(50 + i, 60) + passage[max(0, a - 3) : b + 3] + words_of(60 + i, 60) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    texts += [words_of(70, 80) + passage + words_of(71, 80), words_of(72, 50) + passage + words_of(73, 90)]
    found = substring_dedup.find_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)).collect()
    assert {(r.doc_id, r.start_word, r.end_word, r.anchor_doc, r.anchor_start) for r in found} == {(7, 50, 110, 6, 80)}


def test_passages_with_changed_words(spark):
    """Every pair of 60-word passages with one changed word in every 5 to 10 is found, wherever the changes start."""
    rows, n = [], 0
    for every in (5, 6, 7, 8, 10):
        for start in range(every):
            passage = words_of(100 + n, 60)
            changed = [f"new{n}x{i}" if i % every == start else w for i, w in enumerate(passage)]
            rows += [(2 * n, " ".join(words_of(300 + n, 20) + passage + words_of(400 + n, 20))), (2 * n + 1, " ".join(words_of(500 + n, 30) + changed + words_of(600 + n, 30)))]
            n += 1
    found = {r.doc_id: r for r in substring_dedup.find_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert set(found) == set(range(1, 2 * n, 2))
    assert all(r.anchor_doc == i - 1 and r.end_word - r.start_word >= 50 for i, r in found.items())


def test_token_counts(docs, empty):
    rows = token_counts.count_tokens(docs).collect()
    total = Counter()
    for r in rows:
        total[r.doc_id] += r.n_tokens
    assert total[10] == len(encode(docs.where("doc_id = 10").first().text)) and total[4] == 0
    split = token_counts.attribute(np.array([3, 4, 2]), np.array([0, 5]), 9, "split")
    assert list(split) == [1.5, 1.5] and list(token_counts.attribute(np.array([3, 4, 2]), np.array([0, 5]), 9, "start")) == [2, 1]
    assert list(token_counts.attribute(np.array([3, 4, 2]), np.array([0, 5]), 9, "majority")) == [2, 1]
    assert token_counts.count_tokens(empty).count() == 0


def test_mixing(docs, empty):
    sizes = docs.select("doc_id", "source", mixing.n_words(docs["text"]).alias("size"))
    rows = mixing.mix_sizes(sizes, rows_a_bucket=2).collect()
    assert len(rows) == 14
    for key in {r.skey for r in rows}:
        own = [r for r in rows if r.skey == key]
        assert sum(r.taken for r in own) == int(own[0].target) and all(r.taken <= 2 * r.size for r in own)
        assert own[0].target <= 2 * own[0].source_size
    mixed = mixing.mix(docs).collect()
    assert abs(sum(len(WORDS.findall(r.text)) for r in mixed) - sum(r.taken for r in rows)) <= 12
    assert mixing.mix(empty).count() == 0


def test_progressive_jpeg_round_trip(docs, empty):
    rng = np.random.default_rng(0)
    for n in (0, 1, 64, 65, 700):
        raw = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        data = progressive_jpeg.store(progressive_jpeg.padded(raw), n)
        picture = progressive_jpeg.decode(data)
        assert progressive_jpeg.load(picture) == (progressive_jpeg.padded(raw), n)
        slow = progressive_jpeg.decode(data, arrays=False)
        assert all((a.coef == b.coef).all() for a, b in zip(picture.components, slow.components, strict=True))
        assert progressive_jpeg.rgb(picture).shape == (picture.height, picture.width, 3)
    rows = progressive_jpeg.read_back(progressive_jpeg.store_texts(docs)).collect()
    assert len(rows) == 14 and {r.payload_bytes % 64 for r in rows} == {0} and len({(r.media_sha256, r.feature) for r in rows if r.doc_id in (1, 2)}) == 1
    assert progressive_jpeg.read_back(progressive_jpeg.store_texts(empty)).count() == 0


def test_chat_windows(spark):
    turns = [(1, 0, "system", "be ### kind"), *[(1, k, ("user", "assistant")[k % 2 == 0], f"turn {k} </turn> \\### x" * 5) for k in range(1, 12)], (2, 0, None, None), (3, 5, "assistant", ""), (None, 0, "user:x", "a\\"), (-7, 0, "user", chat_windows.PROBE), (-7, 1, "assistant", chat_windows.PROBE)]
    frame = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    windows = chat_windows.format_conversations(frame, budget=300)
    import hashlib

    rows = {r.conv_id: r for r in chat_windows.read_back(windows).collect()}
    for conv in {t[0] for t in turns}:
        own = [(r or "", x or "") for c, _, r, x in turns if c == conv]
        loss = "".join(x for r, x in own if r == "assistant")
        assert rows[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in own).encode()).hexdigest()
        assert rows[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and rows[conv].loss_chars == len(loss)
    assert rows[1].n_windows > 1


def test_quality_rules(docs, empty):
    rows = {r.doc_id: r for r in quality_rules.judge(docs, quality_rules.fit(docs, np.array([1, 8])), -9.0).collect()}
    for r in docs.collect():
        w = WORDS.findall(r.text or "")
        lines = [x for x in (r.text or "").split("\n") if WORDS.search(x)]
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        got = rows[r.doc_id]
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text or "")), len(lines) - len(set(lines)), len(hit))
    assert quality_rules.judge(empty, np.zeros(16), 0.0).count() == 0


def test_quality_threshold_and_counts_over_all_labelled_rows(spark):
    """More good rows than were sampled before, and the threshold of scores that never come to the driver."""
    n = 20_500
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"))
    counts = quality_rules.summed(quality_rules.labelled(rows, rows.select("doc_id", F.lit(1).alias("quality"))).where("good"), 1 << 12)
    assert counts.sum() == n
    twice = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (None, 1)], "doc_id bigint, quality int")
    assert sorted(map(tuple, quality_rules.labelled(rows, twice).collect())) == [(False, "w2"), (True, "w1")]
    rng = np.random.default_rng(3)
    for good, bad in ((rng.normal(0.3, 0.3, 400), rng.normal(-0.3, 0.3, 300)), (np.round(rng.normal(0, 1, 50), 1), np.round(rng.normal(0, 1, 50), 1)), (np.array([0.2, 0.1]), np.zeros(0)), (np.zeros(0), np.array([0.1]))):
        frame = spark.createDataFrame([*((True, float(x)) for x in good), *((False, float(x)) for x in bad)], "good boolean, score double").repartition(3)
        assert quality_rules.threshold_of(frame) == quality_rules.best_threshold(good, bad)


def test_quality_threshold_leaves_own_ngrams_out(spark):
    rng = np.random.default_rng(8)
    clean, junk = words_of(80, 3000), words_of(81, 400)
    text = lambda words: " ".join(rng.choice(words, 120))
    rows = [(i, text(clean)) for i in range(80)] + [(100 + i, text(clean[:300] + junk)) for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([*((i, 1) for i in range(40)), *((100 + i, 0) for i in range(10))], "doc_id bigint, quality int")
    kept = {r.doc_id: r.kept for r in quality_rules.judge(frame, *quality_rules.fit_rule(frame, labels)).collect()}
    assert sum(kept[i] for i in range(40, 80)) >= 38 and sum(kept[100 + i] for i in range(10, 20)) <= 1
    good, counts = np.arange(40), quality_rules.fit_counts(frame, np.arange(40), 1 << 14)
    left, bad = quality_rules.left_out_scores(frame, good, np.arange(100, 110), counts, 1.0)
    one = quality_rules.fit(frame, good[1:], 1 << 14)
    own = quality_rules.judge(frame.where("doc_id = 0"), one, 0.0).first().score
    assert len(left) == 40 and len(bad) == 10 and np.abs(left - own).min() < 1e-6


def test_quality_scores_by_brute_force(spark):
    """Counts, ratios, left-out scores, threshold and verdicts by dictionaries; only an n-gram's bucket is taken from the library."""
    sf, buckets = "/root/testdata/sf0.001", {}

    def bucket(gram):
        if gram not in buckets:
            words = []
            for w in gram:
                raw = np.frombuffer(w.encode(), np.uint8)
                words.append(ts.span_hashes(raw, np.array([0]), np.array([len(raw)]))[0])
            hashed = words[0] if len(gram) == 1 else ts.grams(np.array(words), 2)[0]
            buckets[gram] = int(hashed) % quality_rules.N_BUCKETS
        return buckets[gram]

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    grams = {}
    for i, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams[i] = Counter(bucket(g) for g in [*((w,) for w in words), *zip(words, words[1:])])
    raw, target = Counter(), Counter()
    for i, own in grams.items():
        raw.update(own)
        if quality.get(i) == 1:
            target.update(own)
    n, all_raw, all_target = quality_rules.N_BUCKETS, sum(raw.values()), sum(target.values())

    def score(own, without=Counter()):
        total, left = 0.0, all_target - sum(without.values())
        for b, times in own.items():
            share = (raw[b] + 1.0) / (all_raw + n)
            total += times * (math.log((target[b] - without[b] + n * share) / (left + n)) - math.log(share))
        return total / max(1, sum(own.values()))

    rows = {r.doc_id: r for r in quality_rules.op9_quality_rules(spark, sf).collect()}
    passing = [i for i in quality if i in rows and not rows[i].base_failed]
    good = [score(grams[i], grams[i]) for i in passing if quality[i] == 1]
    bad = [score(grams[i]) for i in passing if quality[i] == 0]
    marks = sorted({round(x, 9) for x in good + bad})
    tries = [marks[0], *((a + b) / 2 for a, b in zip(marks, marks[1:])), marks[-1] + 1e-9]
    gain = lambda at: round(sum(x >= at for x in good) / len(good) + sum(x < at for x in bad) / len(bad), 12)
    threshold = max(tries, key=lambda at: (gain(at), -at))
    assert set(rows) == set(texts)
    for i, r in rows.items():
        assert r.score == pytest.approx(score(grams[i]), abs=1e-8)
        assert r.kept == (not r.base_failed and r.score >= threshold)


def test_quality_threshold():
    assert quality_rules.best_threshold(np.array([0.1, 0.2, 0.3]), np.array([-0.3, -0.1, 0.0])) == pytest.approx(0.05)
    assert quality_rules.best_threshold(np.array([0.1, 0.2]), np.zeros(0)) == 0.1 and quality_rules.best_threshold(np.zeros(0), np.zeros(0)) == 0.0


def test_license_scans(docs, empty):
    rows = {r.doc_id: r for r in license_scans.scan(docs).collect()}
    r = rows[12]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (9, 3, 3, 7, "apache,mit") and r.labels == "apache,mit"
    assert rows[4].n_words == 0 and rows[4].labels == "" and rows[1].first_word is None and rows[11].n_words == 3
    assert license_scans.scan(empty).count() == 0
    assert len(license_scans.rules()) > 300 and len({x[3] for x in license_scans.rules()}) == len(license_scans.rules())


def samples(pattern):
    """Texts that a pattern matches: every alternative, with what may be left out left out."""
    from itertools import product
    from re import _parser as parser

    def of(tokens):
        parts = []
        for op, arg in tokens:
            name = str(op)
            if name == "LITERAL":
                parts.append([chr(arg)])
            elif name == "BRANCH":
                parts.append([x for branch in arg[1] for x in of(branch)])
            elif name == "SUBPATTERN":
                parts.append(of(arg[3]))
            elif name == "MAX_REPEAT":
                parts.append(["".join(x) for x in product(of(arg[2]), repeat=arg[0])])
            elif name == "IN":
                parts.append([chr(arg[0][1]) if str(arg[0][0]) == "LITERAL" else "x"])
            else:
                raise ValueError(name)
        return ["".join(x) for x in product(*parts)]

    return of(parser.parse(pattern))


def test_license_keywords_stand_in_every_sample(spark):
    for _, _, keyword, name in license_scans.NAMES:
        assert all(keyword.split()[0] in x for x in samples(name)), name
    texts = ["Berkeley Software Distribution license", "under a simplified licence", "SPDX-License-Identifier: (MIT OR Apache-2.0)", "SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 AND (BSD-3-Clause OR ISC)", "SPDX-License-Identifier: MIT\nthen Apache-2.0"]
    rows = {r.doc_id: r.labels for r in license_scans.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert rows == {0: "bsd", 1: "bsd-2-clause", 2: "apache-2.0,mit", 3: "bsd-3-clause,gpl-2.0-or-later,isc", 4: "mit"}
