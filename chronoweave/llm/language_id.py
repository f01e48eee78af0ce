"""Language ID: rank-order profiles of character n-grams, compared by out-of-place distance.

A word is a run of letters and marks, lower-cased and bounded by ``_`` on both
sides; its n-grams are the runs of one to three characters, other than ``_``
alone.  A language's profile is its ``PROFILE`` most frequent n-grams over all of
its training documents, in descending order of count (of equal counts the lesser
in code points first); a document's is the same over its own text.  The distance
sums, over the document's n-grams, how far apart the two ranks stand, and
``PROFILE`` for an n-gram that the language's profile lacks.  The nearest
language is predicted; the score is 1 - distance / (n-grams * PROFILE).

Three code points pack into 63 bits, so n-grams are compared exactly, not by
hash.  Tasks count whole texts by language and n-gram and send sums, so a
language with most of the rows reaches the shuffle as many keys, each with a row
a task or so.  The driver holds ``PROFILE`` rows a language: ``most_languages``
bounds how many there may be, and fit() stops with an error beyond.

Cases: a null text, or one without a letter, is ``und`` with score 0 (marks that
stand alone still count in profiles); so is every text where nothing can be
learned.  A very long
text is read in pieces whose counts are merged.  Null languages aren't learned;
an empty one is a language.  A row with a null id is neither learned nor held
out.  Repeated rows count as often as they stand; equal distances go to the
language that comes first by code points; an empty table gives an empty result;
other columns aren't read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import textscan as ts
from .memory import tidy
from .stage import free_prefix

PROFILE = 300
MOST_LANGUAGES = 10_000
UNKNOWN = "und"
EDGE = ord("_")
PIECE = 1 << 19  # bytes of text that are counted at once
HELD = 1 << 20  # distinct (language, n-gram) pairs of a task that are held before they are sent
SALTS = 16  # parts in which a language's n-grams are ranked first
ALPHABET = 0x40000  # code points from here on are no letters but for private use


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: its lower case where it belongs to words, else EDGE; and whether it is a letter."""
    low, letter = np.full(0x110000, EDGE, np.int32), np.zeros(0x110000, bool)
    for i in range(ALPHABET):
        c = chr(i)
        if c.isalpha():
            letter[i] = True
            low[i] = ord(c.lower()) if len(c.lower()) == 1 else i
        elif unicodedata.category(c)[0] == "M":
            low[i] = i
    return low, letter


def _code_points(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts and where each text starts (one more than texts); bytes that are no UTF-8 become U+FFFD."""
    data = raw.tobytes()
    try:
        points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        before = np.zeros(len(raw) + 1, np.int64)
        np.cumsum((raw & 0xC0) != 0x80, out=before[1:])
        return points, before[offsets]
    except UnicodeDecodeError:
        parts = [np.frombuffer(data[a:b].decode(errors="replace").encode("utf-32-le"), np.uint32) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def _symbols(points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' words, each text with an edge at both ends and one between words; the text of each symbol, and which texts have a letter."""
    low, letter = _tables()
    texts = len(bounds) - 1
    symbols = np.full(len(points) + 2 * texts, EDGE, np.int32)
    owner = np.repeat(np.arange(texts), np.diff(bounds) + 2)
    at = np.arange(len(points)) + 2 * np.repeat(np.arange(texts), np.diff(bounds)) + 1
    symbols[at] = low[points]
    lettered = ts.per_text(letter[points], bounds) > 0
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] != EDGE) | (symbols[:-1] != EDGE) | (owner[1:] != owner[:-1])
    return symbols[keep], owner[keep], lettered


def _counted(owner: np.ndarray, grams: list[tuple[np.ndarray, np.ndarray]], n_owners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, n-gram, count), sorted, from (positions, n-gram of columns of symbols)."""
    alphabet = np.unique(np.concatenate([x.ravel() for _, x in grams])) if grams else np.zeros(1, np.int32)
    if alphabet[0] != 0:
        alphabet = np.concatenate([[0], alphabet])
    bits = int(len(alphabet) - 1).bit_length()
    if 3 * bits + int(max(n_owners - 1, 0)).bit_length() > 63:
        raise OverflowError
    lut = np.zeros(int(alphabet[-1]) + 1, np.int64)
    lut[alphabet] = np.arange(len(alphabet))
    keys = []
    for at, columns in grams:
        key = owner[at].astype(np.int64)
        for column in columns:
            key = (key << bits) | lut[column]
        keys.append(key << (bits * (3 - len(columns))))
    keys = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    count = np.diff(np.append(edge, len(keys)))
    keys, mask = keys[edge], (1 << bits) - 1
    code = np.zeros(len(keys), np.int64)
    for i in (2, 1, 0):
        code = (code << 21) | alphabet[(keys >> (bits * i)) & mask]
    return keys >> (3 * bits), code, count


def _grams(symbols: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Positions and columns of symbols of all n-grams; edges keep those of different words and texts apart."""
    word = symbols != EDGE
    one = np.flatnonzero(word)
    two = np.flatnonzero(word[1:] | word[:-1])
    three = np.flatnonzero(word[1:-1]) if len(symbols) > 2 else np.zeros(0, np.int64)
    return [(one, symbols[one][None]), (two, np.stack([symbols[two], symbols[two + 1]])), (three, np.stack([symbols[three + i] for i in range(3)]))]


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts' counts, summed by owner and n-gram, and sorted by these."""
    owner, code, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((code, owner))
    owner, code, count = owner[order], code[order], count[order]
    edge = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])])) if len(owner) else np.zeros(0, np.int64)
    return owner[edge], code[edge], np.add.reduceat(count, edge) if len(edge) else count


def _count_block(raw: np.ndarray, offsets: np.ndarray, owners: np.ndarray, n_owners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, n-gram, count) of a block of whole texts, and which texts have a letter."""
    if len(offsets) == 2 and len(raw) > PIECE:
        return _count_long(raw, int(owners[0]))
    symbols, text, lettered = _symbols(*_code_points(raw, offsets))
    try:
        return *_counted(owners[text], _grams(symbols), n_owners), lettered
    except OverflowError:  # more different letters and owners than fit a key: by halves; a single text always fits
        if len(owners) == 1:
            o, code, count = _counted(np.zeros(len(text), np.int64), _grams(symbols), 1)
            return o + owners[0], code, count, lettered
        half = len(owners) // 2
        parts = [_count_block(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], owners[a:b], n_owners) for a, b in ((0, half), (half, len(owners)))]
        return *_merged([p[:3] for p in parts]), np.concatenate([p[3] for p in parts])


def _count_long(raw: np.ndarray, owner: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """_count_block() of one text in pieces: each begins at a character and carries the two symbols before it."""
    parts, lettered, at, before = [], False, 0, np.array([EDGE], np.int32)
    while at < len(raw):
        to = min(len(raw), at + PIECE)
        while to < len(raw) and (raw[to] & 0xC0) == 0x80:
            to += 1
        points, bounds = _code_points(raw[at:to], np.array([0, to - at]))
        inner, _, some = _symbols(points, bounds)
        # the piece's own edges stand only where the text has one
        inner = inner[0 if _tables()[0][points[0]] == EDGE else 1 :]
        inner = inner[: len(inner) if to == len(raw) or _tables()[0][points[-1]] == EDGE else -1]
        if before[-1] == EDGE and len(inner) and inner[0] == EDGE:
            inner = inner[1:]
        symbols = np.concatenate([before, inner])
        new = len(before)
        grams = [(p[p + n >= new], c[:, p + n >= new]) for n, (p, c) in enumerate(_grams(symbols))]
        parts.append(_counted(np.zeros(len(symbols), np.int64), grams, 1))
        if len(parts) > 16:
            parts = [_merged(parts)]
        lettered, at, before = lettered or bool(some[0]), to, symbols[-2:]
    o, code, count = _merged(parts)
    return o + owner, code, count, np.array([lettered])


def training_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over the whole texts of docs (lang, text); several rows of one language and n-gram may come from a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def rows() -> pa.RecordBatch:
            owner, code, count = held.pop()
            return pa.RecordBatch.from_arrays([pa.array(list(langs), pa.string()).take(pa.array(owner)), pa.array(code), pa.array(count)], ["lang", "gram", "n"])

        for batch in batches:
            owner = np.array([langs.setdefault(x, len(langs)) for x in batch.column(0).to_pylist()], np.int64)
            for a, b, raw, offsets in ts.blocks(*ts.utf8_block(batch.column(1)), most=PIECE):
                held.append(_count_block(raw, offsets, owner[a:b], len(langs))[:3])
                if sum(len(x[0]) for x in held) > HELD:
                    held = [_merged(held)]
                    if len(held[0][0]) > HELD // 2:
                        yield rows()
        if held:
            held = [_merged(held)]
            yield rows()

    return docs.mapInArrow(tidy(run), "lang string, gram long, n long")


@dataclass(frozen=True)
class Profiles:
    """Languages in order of code points, the n-grams of all their profiles, sorted, and each one's rank in each language (PROFILE: not in it)."""

    langs: list[str]
    grams: np.ndarray
    ranks: np.ndarray


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", most_languages: int = MOST_LANGUAGES) -> Profiles:
    """Profiles of all languages of docs' rows."""
    known = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    totals = training_counts(known).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # ranked first within parts of a language, so that no task orders all n-grams of a frequent one
    for part in (["lang", F.pmod("gram", F.lit(SALTS))], ["lang"]):
        totals = totals.withColumn("rank", F.row_number().over(W.partitionBy(*part).orderBy(F.desc("n"), "gram")) - 1).where(F.col("rank") < PROFILE)
    rows = totals.select("lang", "gram", "rank").limit(most_languages * PROFILE + 1).toArrow()
    if rows.num_rows > most_languages * PROFILE or len(set(rows.column("lang").to_pylist())) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    names, gram, rank = rows.column("lang").to_pylist(), rows.column("gram").to_numpy(), rows.column("rank").to_numpy()
    langs, grams = sorted(set(names)), np.unique(gram)
    ranks = np.full((len(langs), len(grams)), PROFILE, np.int64)
    at = {x: i for i, x in enumerate(langs)}
    ranks[[at[x] for x in names], np.searchsorted(grams, gram)] = rank
    return Profiles(langs, grams, ranks)


def predict(docs: DataFrame, profiles: Profiles, names: list[str], text_col: str = "text") -> DataFrame:
    """The named columns of docs, which come first, with lang_pred and score of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offsets in ts.blocks(*ts.utf8_block(batch.column(len(names))), most=PIECE):
                found, score = _judged(raw, offsets, profiles)
                lang = pa.array([*profiles.langs, UNKNOWN], pa.string()).take(pa.array(found))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[: len(names)]), lang, pa.array(score)], [*names, "lang_pred", "score"])

    own = docs.select(*names, F.col(text_col).alias(free_prefix(docs) + "text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])
    return own.mapInArrow(tidy(run), f"{fields}, lang_pred string, score double")


def _judged(raw: np.ndarray, offsets: np.ndarray, profiles: Profiles) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest language of each text (one beyond the last: none) and its score."""
    n = len(offsets) - 1
    text, code, count, lettered = _count_block(raw, offsets, np.arange(n), n)
    if not profiles.langs:
        return np.zeros(n, np.int64), np.zeros(n)
    order = np.lexsort((-count, text))  # stable: equal counts stay in order of n-grams
    text, code = text[order], code[order]
    each = np.bincount(text, minlength=n)
    rank = np.arange(len(text)) - (np.cumsum(each) - each)[text]
    top = rank < PROFILE
    text, code, rank = text[top], code[top], rank[top]
    at = np.minimum(np.searchsorted(profiles.grams, code), len(profiles.grams) - 1)
    known = profiles.grams[at] == code
    size = np.bincount(text, minlength=n)
    best, found = np.full(n, np.inf), np.zeros(n, np.int64)
    for i, ranks in enumerate(profiles.ranks):
        theirs = np.where(known, ranks[at], PROFILE)
        apart = np.where(theirs == PROFILE, PROFILE, np.abs(theirs - rank))
        distance = np.bincount(text, weights=apart, minlength=n)
        nearer = distance < best
        best[nearer], found[nearer] = distance[nearer], i
    found = np.where(lettered, found, len(profiles.langs))
    return found, np.where(lettered, 1.0 - best / (np.maximum(size, 1) * PROFILE), 0.0)


def remainder(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; documents with 1 are held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    profiles = fit(docs.where(remainder() != 1))
    rows = docs.select("doc_id", F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"), "text")
    return predict(rows, profiles, ["doc_id", "held_out"])


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}]+') AS words, coalesce(regexp_matches(text, '\p{L}'), false) AS lettered,
  list_reduce([4294967295] || list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc FROM documents),
m AS MATERIALIZED (SELECT k, doc_id, lang, words, lettered, xor(crc, 4294967295) % 3 AS part FROM d),
w AS (SELECT k, '_' || word || '_' AS word, count(*) AS n FROM (SELECT k, unnest(words) AS word FROM m) GROUP BY 1, 2),
g AS MATERIALIZED (SELECT k, gram, sum(n)::BIGINT AS n FROM (SELECT k, n, unnest(list_transform(range(1, length(word) - z + 2), lambda i: substr(word, i, z))) AS gram FROM w, (SELECT unnest([1, 2, 3]) AS z)) WHERE gram <> '_' GROUP BY 1, 2),
own AS MATERIALIZED (SELECT * FROM (SELECT k, gram, row_number() OVER (PARTITION BY k ORDER BY n DESC, gram) - 1 AS rank FROM g) WHERE rank < 300),
prof AS MATERIALIZED (SELECT * FROM (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, gram) - 1 AS rank FROM g JOIN m USING (k) WHERE part <> 1 AND lang IS NOT NULL GROUP BY lang, gram) WHERE rank < 300),
size AS (SELECT k, count(*) AS n FROM own GROUP BY k),
near AS (SELECT k, lang, sum(300 - abs(own.rank - prof.rank))::BIGINT AS gain FROM own JOIN prof USING (gram) GROUP BY k, lang),
dist AS (SELECT k, lang, size.n, 300 * size.n - coalesce(gain, 0) AS d FROM size CROSS JOIN (SELECT DISTINCT lang FROM prof) LEFT JOIN near USING (k, lang)),
best AS (SELECT k, arg_min(lang, (d, lang)) AS lang, min(d) AS d, any_value(n) AS n FROM dist GROUP BY k)
SELECT doc_id, coalesce(part = 1, false) AS held_out, CASE WHEN lettered THEN coalesce(best.lang, 'und') ELSE 'und' END AS lang_pred,
  CASE WHEN lettered AND best.lang IS NOT NULL THEN 1.0::DOUBLE - best.d::DOUBLE / (best.n * 300) ELSE 0.0::DOUBLE END AS score FROM m LEFT JOIN best USING (k)
"""
