"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Unigrams and bigrams of every whole text are hashed into ``N_BUCKETS`` buckets,
the same number for every corpus unless the caller names another.  They are counted over all documents (the raw
multinomial) and over all trusted ones (the target multinomial, which backs off
to the raw one).  A document's score is the mean over its n-grams of
``log p_target - log p_raw``, and it is kept when the score reaches a threshold
and the base rules pass, so equal texts always get equal verdicts.

The threshold is the one that parts labelled good documents from labelled bad
ones best, both classes weighed alike.  A good document's score is taken there
with its own n-grams left out of the target counts, as those of an unlabelled
document are, so the threshold follows the scale of the scores of each corpus.

Cases: a null or blank text has no words, fails the base rules and scores 0;
repeated rows are counted and judged as often as they stand; without trusted
documents every score is 0 and the base rules decide alone; an empty table
gives an empty result.  Columns besides the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import textscan as ts
from .idfilter import bitmap, passes
from .memory import tidy
from .stage import cut, drop

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True

RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def _buckets(words: np.ndarray, first_word: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all unigrams and bigrams, and the text that each stands in."""
    counts = np.diff(first_word)
    text = np.repeat(np.arange(len(counts)), counts)
    at, two = ts.gram_rows(first_word, 2)
    pairs = ts.grams(words, 2)[at] if len(at) else np.zeros(0, np.uint64)
    hashes = np.concatenate([words, pairs])
    return (hashes % np.uint64(n_buckets)).astype(np.int64), np.concatenate([text, two])


def _base(raw: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, first_word: np.ndarray, words: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    letters = ts.WORD_BYTE[raw] & ((raw & 0xC0) != 0x80)
    # lines: a text's last line ends where the text does
    breaks = np.flatnonzero(raw == 0x0A)
    line_from = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    line_to = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    with_word = np.searchsorted(starts, line_to) > np.searchsorted(starts, line_from)
    line_from, line_to = line_from[with_word], line_to[with_word]
    line_text = np.searchsorted(offsets, line_from, side="right") - 1
    same = ts.mix64(ts.span_hashes(raw, line_from, line_to) + ts.mix64(line_text.astype(np.uint64)))
    order = np.argsort(same, kind="stable")
    later = np.zeros(len(same), dtype=bool)
    later[order[1:]] = same[order][1:] == same[order][:-1]
    dup_lines = np.bincount(line_text[later], minlength=n)
    # words in 3-word windows that stand twice or more in their text
    at, text = ts.gram_rows(first_word, 3)
    hit = np.zeros(len(words) + 3, dtype=bool)
    if len(at):
        key = ts.mix64(ts.grams(words, 3)[at] + ts.mix64(text.astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        equal = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), dtype=bool)
        twice[order[1:][equal]] = True
        twice[order[:-1][equal]] = True
        for i in range(3):
            hit[at[twice] + i] = True
    return {
        "n_words": np.diff(first_word),
        "word_chars": ts.per_text(letters, offsets),
        "n_symbols": ts.per_text(SYMBOL[raw], offsets),
        "n_dup_lines": dup_lines,
        "n_repeat_words": ts.per_text(hit[: len(words)], first_word),
    }


SLICE = 4096  # buckets whose counts travel as one compressed array


def count_buckets(texts: DataFrame, n_buckets: int) -> DataFrame:
    """(slice, counts): n-gram counts over all rows of texts (text), SLICE buckets a row.

    A task sends an array for each slice that it has n-grams of, not a row for
    each bucket, and one that adds them up holds its own slices' sums only.
    """

    def rows(arrays: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        if arrays:
            yield pa.RecordBatch.from_pydict({"slice": pa.array(list(arrays), pa.int32()), "counts": pa.array([press.compress(x.tobytes()) for x in arrays.values()], pa.binary())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, dtype=np.int64)
        for batch in batches:
            for _, _, raw, offsets in ts.blocks(*ts.utf8_block(batch.column(0))):
                starts, ends, first = ts.spans(raw, offsets)
                bucket, _ = _buckets(ts.span_hashes(raw, starts, ends), first, n_buckets)
                total += np.bincount(bucket, minlength=n_buckets)
        yield from rows({i // SLICE: total[i : i + SLICE] for i in range(0, n_buckets, SLICE) if total[i : i + SLICE].any()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = unpacked(part)
                sums[i] = sums[i] + own if i in sums else own
        yield from rows(sums)

    parts = texts.select("text").mapInArrow(tidy(count), "slice int, counts binary")
    return parts.repartition("slice").mapInArrow(tidy(add), "slice int, counts binary")


def unpacked(part: bytes) -> np.ndarray:
    """Counts of a slice's buckets."""
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(part), np.int64)


N_BUCKETS = 1 << 16


def summed(texts: DataFrame, n_buckets: int) -> np.ndarray:
    """Count of each bucket over texts (text).  What comes to the driver is a number a bucket."""
    rows = count_buckets(texts, n_buckets).toArrow()
    counts = np.zeros(n_buckets)
    for i, part in zip(rows.column("slice").to_pylist(), rows.column("counts").to_pylist(), strict=True):
        counts[i * SLICE : (i + 1) * SLICE] = unpacked(part)
    return counts


def listed(docs: DataFrame, good: np.ndarray, bad: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(good, text) of the documents of two short lists of ids."""
    both = np.union1d(good, bad)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            own = np.isin(ids, both) & np.asarray(batch.column(0).is_valid())
            yield pa.RecordBatch.from_arrays([pa.array(np.isin(ids[own], good)), batch.column(1).filter(pa.array(own))], ["good", "text"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "good boolean, text string")


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(good, text) of all documents that are labelled good or bad; one that is both is good.

    A bitmap leaves out most other documents where they are read, so only
    labelled texts are shuffled; labels of any number are never broadcast.
    """
    marks = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("i")).agg((F.max("quality") == 1).alias("good"))
    wanted = bitmap(marks, "i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(wanted, batch.column(0).to_numpy())))

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("text")).where("i is not null")
    return rows.mapInArrow(tidy(run), "i long, text string").join(marks.hint("merge"), "i").select("good", "text")


def fit_counts(docs: DataFrame, trusted_ids: np.ndarray, n_buckets: int = N_BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Raw and target counts of each bucket, for a short list of trusted ids."""
    return np.stack([summed(docs.select(F.col(text_col).alias("text")), n_buckets), summed(listed(docs, trusted_ids, trusted_ids, id_col, text_col), n_buckets)])


def log_ratio(counts: np.ndarray, smoothing: float) -> np.ndarray:
    """log p_target - log p_raw of each bucket."""
    raw, target = counts
    n = len(raw)
    if not target.sum():
        return np.zeros(n)
    share = (raw + smoothing) / (raw.sum() + smoothing * n)
    return np.log((target + smoothing * n * share) / (target.sum() + smoothing * n)) - np.log(share)


def fit(docs: DataFrame, trusted_ids: np.ndarray, n_buckets: int = N_BUCKETS, smoothing: float = 1.0, **columns: str) -> np.ndarray:
    return log_ratio(fit_counts(docs, trusted_ids, n_buckets, **columns), smoothing)


def left_out(rows: DataFrame, counts: np.ndarray, smoothing: float) -> DataFrame:
    """(good, score) of rows (good, text) that pass the base rules: good ones each without its own n-grams in the target."""
    (raw, target), n_buckets = counts, counts.shape[1]
    prior = smoothing * n_buckets * (raw + smoothing) / (raw.sum() + smoothing * n_buckets)
    whole, total = log_ratio(counts, smoothing), target.sum() + smoothing * n_buckets

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw_bytes, offsets in ts.blocks(*ts.utf8_block(batch.column(1))):
                own = batch.column(0).slice(a, b - a).to_numpy(zero_copy_only=False)
                judged = _judged(raw_bytes, offsets, whole, 0.0)
                starts, ends, first = ts.spans(raw_bytes, offsets)
                bucket, text = _buckets(ts.span_hashes(raw_bytes, starts, ends), first, n_buckets)
                key, times = np.unique((text * n_buckets + bucket)[own[text]], return_counts=True)
                text, bucket = key // n_buckets, key % n_buckets
                n = np.bincount(text, weights=times, minlength=b - a)
                left = np.maximum(target[bucket] - times, 0) + prior[bucket]
                change = np.bincount(text, weights=times * (np.log(left) - np.log(target[bucket] + prior[bucket])), minlength=b - a)
                score = judged["score"] + np.where(own, change / np.maximum(n, 1) + np.log(total) - np.log(np.maximum(total - n, smoothing * n_buckets)), 0.0)
                keep = ~judged["base_failed"]
                yield pa.RecordBatch.from_pydict({"good": own[keep], "score": np.round(score, 9)[keep]})

    return rows.select("good", "text").mapInArrow(tidy(scan), "good boolean, score double")


def left_out_scores(docs: DataFrame, good: np.ndarray, bad: np.ndarray, counts: np.ndarray, smoothing: float, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """left_out() of two short lists of ids, as arrays of good and bad scores."""
    rows = left_out(listed(docs, good, bad, id_col, text_col), counts, smoothing).toArrow()
    own, score = rows.column("good").to_numpy(), rows.column("score").to_numpy()
    return score[own], score[~own]


BIN = 1e-3  # width of the bins of scores that are summed before what is within them


def threshold_of(scores: DataFrame) -> float:
    """best_threshold() of any number of scores (good, score); the driver gets one row.

    Equal scores are counted, bins of them summed, and within each bin what lies
    below a score is what lies below the bin and what comes before it there.
    Gains are compared as whole numbers.
    """
    each = scores.groupBy("score").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b")).withColumn("bin", F.floor(F.col("score") / BIN))
    each = cut(each)
    before = W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    bins = each.groupBy("bin").agg(F.sum("g").alias("g"), F.sum("b").alias("b")).select("bin", *(F.coalesce(F.sum(c).over(before), none).alias(f"{c}_bin") for c in "gb"))
    whole = each.agg(F.sum("g").alias("all_g"), F.sum("b").alias("all_b"), F.min(F.when(F.col("g") > 0, F.col("score"))).alias("least")).first()
    if not whole.all_g:
        drop(scores, each)
        return 0.0
    if not whole.all_b:
        drop(scores, each)
        return float(whole.least)
    within = W.partitionBy("bin").orderBy("score").rowsBetween(W.unboundedPreceding, -1)
    below = {c: F.coalesce(F.sum(c).over(within), none) + F.col(f"{c}_bin") for c in "gb"}
    gains = each.join(F.broadcast(bins), "bin").select("score", (below["b"].cast("decimal(38,0)") * whole.all_g - below["g"].cast("decimal(38,0)") * whole.all_b).alias("gain"))
    mark = gains.agg(F.max_by("score", F.struct("gain", -F.col("score")))).first()[0]
    last = each.where(F.col("score") < mark).agg(F.max("score")).first()[0]
    drop(scores, each)
    return float(mark if last is None else (mark + last) / 2)


def best_threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """The threshold with the greatest share of good scores at or above it plus share of bad ones below it; the least of equals."""
    if not len(good):
        return 0.0
    good, bad = np.sort(good), np.sort(bad)
    if not len(bad):
        return float(good[0])
    marks = np.unique(np.concatenate([good, bad]))
    at = np.append(marks[0], np.append((marks[1:] + marks[:-1]) / 2, marks[-1] + 1e-9))
    gain = 1 - np.searchsorted(good, at) / len(good) + np.searchsorted(bad, at) / len(bad)
    return float(at[np.argmax(np.round(gain, 12))])


def fit_rule(docs: DataFrame, labels: DataFrame, smoothing: float = 1.0, n_buckets: int = N_BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, float]:
    """Log ratios and threshold from all labelled rows; without good ones, ratios of 0 and a threshold of 0."""
    rows = cut(labelled(docs, labels, id_col, text_col))
    counts = np.stack([summed(docs.select(F.col(text_col).alias("text")), n_buckets), summed(rows.where("good"), n_buckets)])
    threshold = threshold_of(left_out(rows, counts, smoothing)) if counts[1].sum() else 0.0
    drop(docs, rows)
    return log_ratio(counts, smoothing), threshold


def judge(docs: DataFrame, ratio: np.ndarray, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base figures, score and verdict of each row of docs."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offsets in ts.blocks(*ts.utf8_block(batch.column(1))):
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(a, b - a), **_judged(raw, offsets, ratio, threshold)})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(scan), RESULT)


def _judged(raw: np.ndarray, offsets: np.ndarray, ratio: np.ndarray, threshold: float) -> dict[str, np.ndarray]:
    starts, ends, first = ts.spans(raw, offsets)
    words = ts.span_hashes(raw, starts, ends)
    out = _base(raw, offsets, starts, ends, first, words)
    bucket, text = _buckets(words, first, len(ratio))
    n = np.bincount(text, minlength=len(offsets) - 1)
    score = np.round(np.bincount(text, weights=ratio[bucket], minlength=len(offsets) - 1) / np.maximum(n, 1), 9)
    failed = (out["n_words"] < 50) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
    return out | {"base_failed": failed, "score": score, "kept": ~failed & (score >= threshold)}


def keep_good(docs: DataFrame, ratio: np.ndarray, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that the rules reject, in docs' own columns; judged where they are read, without a shuffle."""
    names = docs.columns
    at = names.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [_judged(raw, offsets, ratio, threshold)["kept"] for _, _, raw, offsets in ts.blocks(*ts.utf8_block(batch.column(at)))]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(tidy(scan), docs.schema)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs, *fit_rule(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
