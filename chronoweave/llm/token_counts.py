"""Token counts by section: whole documents are encoded once and tokens attributed by their offsets.

The tokens of a text cover its UTF-8 bytes without gaps, so the running sum of
their byte sizes gives each token's span.  Sections are spans over the same
bytes.  Both lists are sorted, so the join of the two is a binary search inside
the row, without a shuffle.  A token that crosses a boundary is allocated by an
explicit rule:

* ``start``: to the section that holds its first byte;
* ``majority``: to the section that holds most of its bytes, the earlier on a tie;
* ``split``: to every section it touches, in proportion to the bytes there.

Cases: a null or empty text has no tokens and one section, 0, with none; equal
rows give equal rows; sections with no token of their own stand with 0; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan as ts
from .memory import tidy
from .tokens import byte_sizes, encode

RULES = ("start", "majority", "split")


def line_sections(raw: np.ndarray) -> np.ndarray:
    """Byte starts of the lines of a text; the break belongs to the line it ends."""
    at = np.flatnonzero(raw == 0x0A) + 1
    return np.concatenate([[0], at[at < len(raw)]])


def title_and_body(raw: np.ndarray) -> np.ndarray:
    """Two fields: the first line, with its break, and the rest."""
    return line_sections(raw)[:2]


def attribute(sizes: np.ndarray, starts: np.ndarray, total: int, rule: str) -> np.ndarray:
    """Tokens of each section, from the tokens' byte sizes and the sections' starts."""
    ends = np.cumsum(sizes)
    begins = ends - sizes
    bounds = np.append(starts, total)
    first = np.searchsorted(starts, begins, side="right") - 1
    if rule == "start":
        return np.bincount(first, minlength=len(starts)).astype(np.float64)
    last = np.searchsorted(starts, ends - 1, side="right") - 1
    inside = first == last
    out = np.bincount(first[inside], minlength=len(starts)).astype(np.float64)
    for t in np.flatnonzero(~inside):
        s = np.arange(first[t], last[t] + 1)
        part = np.minimum(bounds[s + 1], ends[t]) - np.maximum(bounds[s], begins[t])
        if rule == "majority":
            out[s[np.argmax(part)]] += 1
        else:
            out[s] += part / sizes[t]
    return out


def count_tokens(docs: DataFrame, sections: Callable[[np.ndarray], np.ndarray] = line_sections, rule: str = "start", id_col: str = "doc_id", text_col: str = "text", json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """One row a document and section: (doc_id, section, n_bytes, n_tokens, doc_tokens).

    ``sections`` maps the bytes of a text to the sorted starts of its sections,
    the first of which is 0.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size_of = byte_sizes(json_path, ranks_path)
        for batch in batches:
            for a, b, raw, offsets in ts.blocks(*ts.utf8_block(batch.column(1))):
                cols: dict[str, list] = {x: [] for x in ("row", "section", "n_bytes", "n_tokens", "doc_tokens")}
                for i in range(b - a):
                    one = raw[offsets[i] : offsets[i + 1]]
                    ids = encode(one.tobytes().decode("utf-8", "replace"), json_path, ranks_path)
                    starts = sections(one)
                    cols["n_tokens"].append(attribute(size_of[ids], starts, len(one), rule))
                    cols["n_bytes"].append(np.diff(np.append(starts, len(one))))
                    cols["section"].append(np.arange(len(starts)))
                    cols["row"].append(np.full(len(starts), a + i))
                    cols["doc_tokens"].append(np.full(len(starts), len(ids)))
                got = {k: np.concatenate(v) for k, v in cols.items()}
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).take(pa.array(got.pop("row")))} | got)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), "doc_id long, section long, n_bytes long, n_tokens double, doc_tokens long")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document; a token belongs to the line of its first byte."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "section", "n_bytes", F.col("n_tokens").cast("long").alias("n_tokens"), "doc_tokens")
