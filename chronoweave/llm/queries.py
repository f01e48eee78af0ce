"""The registered queries of the subpackage and their SQL.

Where an operator's result has columns that SQL can't express, such as those
that depend on token ids, on a template or on a file's form, the query without
them is registered a second time under a name of its own, with SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .centroids import OP11_SQL, op11_centroid_clustering
from .chat_windows import PROBE, op8_chat_windows
from .language_id import OP12_SQL, op12_language_id
from .license_scans import op10_license_scans
from .mixing import OP6_SQL, op6_mixing
from .ngram_join import op4_ngram_join
from .packing import op1_packing
from .progressive_jpeg import op7_media_columns, tensor_columns
from .quality_rules import op9_quality_rules
from .substring_dedup import op3_substring_dedup
from .token_counts import op5_token_counts
from .url_filters import OP2_SQL, op2_url_filters


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op7 read back from the files, without their form."""
    return op7_media_columns(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def chat_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op8 read back from the windows, without the template's own characters."""
    return op8_chat_windows(spark, sf_dir).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9 without the method's verdict."""
    return op9_quality_rules(spark, sf_dir).drop("score", "kept")


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10 without the method's labels."""
    return op10_license_scans(spark, sf_dir).drop("labels", "score")


QUERIES = {
    "op1_packing": op1_packing,
    "op2_url_filters": op2_url_filters,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_ngram_join": op4_ngram_join,
    "op5_token_counts": op5_token_counts,
    "op6_mixing": op6_mixing,
    "op7_media_columns": op7_media_columns,
    "op8_chat_windows": op8_chat_windows,
    "op9_quality_rules": op9_quality_rules,
    "op10_license_scans": op10_license_scans,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_language_id": op12_language_id,
    "media_payloads": media_payloads,
    "media_tensors": tensor_columns,
    "chat_digests": chat_digests,
    "quality_base": quality_base,
    "license_base": license_base,
}

MEDIA_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
p AS (SELECT doc_id, octet_length(raw) AS n, greatest(64, 64 * ((octet_length(raw) + 63) // 64)) AS padded, raw FROM d)
SELECT doc_id, n::BIGINT AS n_bytes, padded::BIGINT AS payload_bytes, sha256(raw || unhex(repeat('00', (padded - n)::BIGINT))) AS payload_sha256 FROM p
"""

CHAT_SQL = f"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS said, coalesce(role, '') AS who FROM conversations
  UNION ALL SELECT -7, turn, role, '{PROBE}', role FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(who || chr(10) || said || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, said)) AS turns_sha256,
  coalesce(sum(length(said)) FILTER (who = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(said, '' ORDER BY turn NULLS FIRST, said) FILTER (who = 'assistant'), '')) AS loss_sha256 FROM t GROUP BY conv_id
"""

QUALITY_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
g AS (SELECT k, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM (SELECT k, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2)),
twice AS (SELECT k, i FROM (SELECT *, count(*) OVER (PARTITION BY k, gram) AS n FROM g) WHERE n > 1),
hits AS (SELECT k, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS o) GROUP BY k),
lines AS (SELECT k, count(*) - count(DISTINCT line) AS dup FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(words) < 50 OR 100 * coalesce(n, 0) > 50 * len(words) AS base_failed
FROM w LEFT JOIN hits USING (k) LEFT JOIN lines USING (k)
"""

LICENSE_SQL = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
p AS (SELECT k, i - 1 AS spot, CASE WHEN words[i] = 'mit' AND words[i + 1] = 'license' THEN 'mit' WHEN words[i] = 'apache' AND words[i + 1] = 'license' THEN 'apache' WHEN words[i] = 'general' AND words[i + 1] = 'public' AND words[i + 2] = 'license' THEN 'gpl' END AS label
  FROM (SELECT k, words, unnest(range(1, len(words) + 1)) AS i FROM w)),
b AS (SELECT k, count(*) AS n, min(spot) AS lo, max(spot) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p WHERE label IS NOT NULL GROUP BY k)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word, coalesce(labels, '') AS base_labels FROM w LEFT JOIN b USING (k)
"""

ORACLE_SQL = {"op2_url_filters": OP2_SQL, "op6_mixing": OP6_SQL, "op11_centroid_clustering": OP11_SQL, "op12_language_id": OP12_SQL, "media_payloads": MEDIA_SQL, "chat_digests": CHAT_SQL, "quality_base": QUALITY_SQL, "license_base": LICENSE_SQL}
