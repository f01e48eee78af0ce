"""Hierarchical multi-length packing of token streams.

Documents are routed to context-size tiers (2048, 1024, 512 and 256 ids): a
document goes to the smallest window that holds it, and one beyond the largest
window gives off whole windows first and is routed by what remains.  Each tier
is packed from the longest: a window opens with its longest waiting document,
its gap takes the longest waiting documents that fit, from its own tier or a
shorter one, and what is still free is filled by cutting one document of the
shortest tier that has any.  So every window is full but the last few of a
partition, and those are cut at powers of two, so none is padded.
Windows of one tier with similar attention cost (sum of squared piece lengths)
then form step groups of equal token counts, so no rank of a step waits long.

Packing runs where the documents are read, in blocks of a bounded number of
tokens, and needs no shuffle; what does not fill a window waits for the next
block.  A lost task packs the same rows into the same windows when it is rerun.

Cases: a null or empty text is one piece, the end mark; a text of any length is
cut into whole windows and a rest; a null id is packed as such; repeated rows are
packed as often as they stand, told apart by ``sequence_id`` and ``offset``; an
empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .memory import tidy
from .tokens import encode

TIERS = (2048, 1024, 512, 256)
END_ID = 1

PIECES = pa.schema(
    [(x, pa.int64()) for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_id")]
)
PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long, step_id long"


class _Packer:
    """Packs the documents of one partition.  A waiting entry is (length, order, document, start)."""

    def __init__(self, tiers: tuple[int, ...], step_tokens: int, base: int) -> None:
        self.tiers, self.step_tokens = tuple(sorted(tiers, reverse=True)), step_tokens
        self.waiting: list[tuple[int, int, int, int]] = []  # sorted by length; a tier is a range of it
        self.ids: dict[int, np.ndarray] = {}
        self.names: dict[int, int | None] = {}
        self.left: dict[int, int] = {}
        self.tokens = self.order = 0
        self.next_sequence = self.next_step = base
        self.full: list[tuple[int, list[tuple[int, int, int]]]] = []

    def add(self, name: int | None, ids: np.ndarray) -> None:
        key = self.order
        self.ids[key], self.names[key], self.left[key] = ids, name, len(ids)
        self.tokens += len(ids)
        top, start = self.tiers[0], 0
        while len(ids) - start > top:
            self._close(top, [(key, start, top)])
            start += top
        self._wait(len(ids) - start, key, start)

    def _wait(self, length: int, key: int, start: int) -> None:
        insort(self.waiting, (length, self.order, key, start))
        self.order += 1

    def _close(self, window: int, pieces: list[tuple[int, int, int]]) -> None:
        self.full.append((window, pieces))
        self.tokens -= sum(x[2] for x in pieces)

    def _longest(self, most: int) -> tuple[int, int, int, int] | None:
        """Take the longest waiting document of at most so many ids."""
        at = bisect_left(self.waiting, (most + 1,)) - 1
        return self.waiting.pop(at) if at >= 0 else None

    def _fill(self, window: int, first: tuple[int, int, int, int]) -> None:
        pieces, free = [(first[2], first[3], first[0])], window - first[0]
        while free and (x := self._longest(free)):
            pieces.append((x[2], x[3], x[0]))
            free -= x[0]
        if free and self.waiting:  # all that wait are longer than the gap: cut the shortest
            length, _, key, start = self.waiting.pop(0)
            pieces.append((key, start, free))
            self._wait(length - free, key, start + free)
        self._close(window, pieces)

    def pack(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        """Pack what waits; unless it is the last block, keep less than the largest window for the next one."""
        for window, shorter in zip(self.tiers, (*self.tiers[1:], 0), strict=True):
            while self.waiting and self.waiting[-1][0] > shorter and self.tokens >= self.tiers[0]:
                self._fill(window, self.waiting.pop())
        if last:
            while self.tokens:
                # what is less than the shortest tier goes to windows of its binary digits, so none is padded
                window = next((t for t in self.tiers if t <= self.tokens), 1 << self.tokens.bit_length() - 1)
                if first := self._longest(window):
                    self._fill(window, first)
                else:
                    length, _, key, start = self.waiting.pop(0)
                    self._wait(length - window, key, start + window)
                    self._close(window, [(key, start, window)])
        yield from self._emit()

    def _emit(self) -> Iterator[pa.RecordBatch]:
        if not self.full:
            return
        rows: list[tuple] = []
        room, window_before = 0, 0
        for window, pieces in sorted(self.full, key=lambda x: (-x[0], -sum(p[2] ** 2 for p in x[1]))):
            if window != window_before or room < window:
                self.next_step += 1
                room, window_before = self.step_tokens, window
            room -= window
            offset = 0
            for key, start, length in pieces:
                ids = self.ids[key]
                rows.append((self.names[key], start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids), self.next_sequence, offset, window, self.next_step))
                offset += length
                self.left[key] -= length
            self.next_sequence += 1
        for key in [k for k, n in self.left.items() if not n]:
            del self.ids[key], self.names[key], self.left[key]
        self.full = []
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], schema=PIECES)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, step_tokens: int = 1 << 17, block_tokens: int = 1 << 20, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """One row a piece: the document's ids [start, start + length) stand at ``offset`` of ``sequence_id``.

    ``window`` is the tier of the sequence and ``step_id`` its step group.  The
    largest tier is the pad length; ``block_tokens`` bounds what a task holds
    besides its longest document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = _Packer(tiers, step_tokens, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encode(text.as_py() or "", json_path, ranks_path)
                ids.append(END_ID)
                packer.add(name.as_py(), np.array(ids, dtype="<u4"))
                if packer.tokens >= block_tokens or len(packer.full) * tiers[0] >= block_tokens:
                    yield from packer.pack()
        yield from packer.pack(last=True)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), PIECES_DDL)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
