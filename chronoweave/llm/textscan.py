"""Vectorised scanning of UTF-8 text columns with numpy.

The word definition used throughout the subpackage, ``[^\\x20\\x09-\\x0D]+``,
only looks at ASCII bytes, so words of a UTF-8 text can be found on its bytes.
All functions work on a *block*: the concatenated bytes of some whole texts and
the offsets at which each text starts.  Nulls are empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORD_BYTE = np.ones(256, dtype=bool)
WORD_BYTE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_BASE = 0x9E3779B97F4A7C55  # odd, so that it has an inverse modulo 2**64
_MUL = _U(0xD6E8FEB86659FD93)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) > n:
            return
        size = max(n + 1, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            run = np.full(size, _U(base), dtype=np.uint64)
            run[0] = 1
            setattr(self, name, np.multiply.accumulate(run))


_powers = _Powers()


def utf8_block(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than texts) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(raw: np.ndarray, offsets: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut into runs of whole texts of about ``most`` bytes: (first, last + 1, bytes, offsets)."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the index of the first word of each text (one more than texts)."""
    inside = WORD_BYTE[raw]
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    edge = np.empty(len(raw), dtype=bool)
    edge[0] = True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:])
    cut = offsets[:-1]
    edge[cut[cut < len(raw)]] = True
    at = np.flatnonzero(edge)
    ends = np.append(at[1:], len(raw))
    word = inside[at]
    starts, ends = at[word], ends[word]
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; equal bytes, equal hash."""
    _powers.reach(len(raw))
    code = BYTE_CODE[LOWER[raw] if lower else raw]
    code *= _powers.up[: len(raw)]
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(code, out=total[1:])
    return mix64((total[ends] - total[starts]) * _powers.down[starts] + (ends - starts).astype(np.uint64))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; element i is the run that starts at word i."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    out = words[: len(words) - n + 1].copy()
    for i in range(1, n):
        out *= _MUL
        out += words[i : len(words) - n + 1 + i]
    return mix64(out)


def gram_rows(first_word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For grams() over a whole block: the positions that stay within a text, and the text of each."""
    counts = np.diff(first_word)
    text = np.repeat(np.arange(len(counts)), counts)
    whole = len(text) - n + 1
    if whole <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(text[:whole] == text[n - 1 :])
    return at, text[at]


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values between consecutive bounds."""
    total = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
