"""Media columns: progressive JPEG files, read scan by scan into coefficient arrays.

``decode`` reads any 8-bit progressive file with one or three components
(Huffman coding, sequential scan order free, 1x1 or 2x2 luma sampling): spectral
selection and successive approximation accumulate in one coefficient array a
component, the inverse transform runs in numpy, chroma is upsampled by
repetition, and the result is a full-resolution RGB tensor.

``store`` writes bytes losslessly as coefficients of such a file, one byte a
coefficient, the format's unit.  A byte b becomes the AC value b (b >= 128) or
b - 255, whose magnitude always has eight bits, and the DC value b plus 768 on
every other block, whose differences always have ten; so each scan's codes have
one length and both directions are plain array operations.  Six scans carry the
first seven bits and the last bit apart (successive approximation), and the low
and high frequencies apart (spectral selection).  ``load`` reads the bytes back
from the stored file alone.

Cases: a null or empty text is the 64 zero bytes of an empty payload; equal
texts give equal values; a text of any length is stored whole, in rows of MCUs;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .memory import tidy

#: The zigzag order of the format, as raster positions.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])
_K, _N = np.arange(8)[:, None], np.arange(8)[None, :]
_BASIS = (np.where(_K == 0, np.sqrt(0.125), 0.5) * np.cos((2 * _N + 1) * _K * np.pi / 16)).astype(np.float32)

MCUS_A_ROW = 4080
#: (components, first and last coefficient, high bit before, low bit now) of each scan that store() writes.
SCRIPT = ((0, 0, 0, 1), (1, 5, 0, 1), (6, 63, 0, 1), (0, 0, 1, 0), (1, 63, 1, 0))


@dataclass
class Component:
    ident: int
    h: int
    v: int
    q: int
    blocks_wide: int = 0  # of the component itself: scans of one component
    blocks_high: int = 0
    coef: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 64), np.int16))  # with MCU padding, zigzag order


@dataclass
class Picture:
    width: int
    height: int
    components: list[Component]
    tables: dict[int, np.ndarray]
    comment: bytes = b""

    @property
    def mcus(self) -> tuple[int, int]:
        h, v = max(c.h for c in self.components), max(c.v for c in self.components)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


# ---------------------------------------------------------------- bits

def _stuffed(bits: np.ndarray) -> bytes:
    """Whole bytes of a 0/1 array, padded with ones and with 0 after each FF."""
    if pad := -len(bits) % 8:
        bits = np.concatenate([bits, np.ones(pad, np.uint8)])
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def _bits(values: np.ndarray, n: int) -> np.ndarray:
    """The low n bits of each value, highest first, as one row each."""
    return ((values[..., None] >> np.arange(n - 1, -1, -1)) & 1).astype(np.uint8)


def _extend(bits: np.ndarray, size: int) -> np.ndarray:
    """Signed values of size-bit codes."""
    return np.where(bits >= 1 << (size - 1), bits, bits - (1 << size) + 1)


# ---------------------------------------------------------------- store

def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _one_code(kind: int, symbol: int) -> bytes:
    """A Huffman table with the single code 0."""
    return _segment(0xC4, bytes([kind << 4, 1, *[0] * 15, symbol]))


def _dc_order(mcu_wide: int, mcu_high: int) -> np.ndarray:
    """Raster positions of luma blocks in the order of interleaved scans."""
    rows, cols = np.divmod(np.arange(mcu_wide * mcu_high), mcu_wide)
    y, x = 2 * rows[:, None] + [0, 0, 1, 1], 2 * cols[:, None] + [0, 1, 0, 1]
    return (y * 2 * mcu_wide + x).ravel()


def store(payload: bytes, n_bytes: int) -> bytes:
    """A progressive JPEG file with the payload, a positive multiple of 64 bytes; n_bytes and its length stand in a comment."""
    n_blocks = len(payload) // 64
    mcus = -(-n_blocks // 6)
    wide = min(mcus, MCUS_A_ROW)
    high = -(-mcus // wide)
    data = np.zeros((wide * high, 6, 64), np.uint8)
    data.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    order = _dc_order(wide, high)
    luma = np.empty((4 * wide * high, 64), np.uint8)
    luma[order] = data[:, :4].reshape(-1, 64)
    planes = [luma, data[:, 4], data[:, 5]]

    out = [b"\xff\xd8", _segment(0xFE, struct.pack(">QQ", len(payload), n_bytes)), _segment(0xDB, b"\x00" + b"\x01" * 64)]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, 16 * high, 16 * wide, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    dc = data[:, :, 0].astype(np.int32)
    dc[:, :4] += 768 * (np.arange(4 * wide * high).reshape(-1, 4) % 2 == 0)
    dc[:, 4:] += 768 * (np.arange(wide * high)[:, None] % 2 == 0)
    for low, top, before, now in SCRIPT:
        spectral = bytes([low, top, before << 4 | now])
        if low == 0:
            head = _segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0]) + spectral)
            if before == 0:
                first = dc >> now
                steps = np.empty_like(first)
                steps[:, :4] = np.diff(first[:, :4].ravel(), prepend=0).reshape(-1, 4)
                steps[:, 4:] = np.diff(first[:, 4:], axis=0, prepend=0)
                size = 10 - now
                code = np.where(steps < 0, steps + (1 << size) - 1, steps)
                out += [_one_code(0, size), head, _stuffed(_bits(code, size + 1).ravel())]
            else:
                out += [head, _stuffed((dc & 1).astype(np.uint8).ravel())]
            continue
        out.append(_one_code(1, 7 if before == 0 else 0))
        for k, plane in enumerate(planes, 1):
            head = _segment(0xDA, bytes([1, k, 0]) + spectral)
            part = plane[:, low : top + 1]
            if before == 0:  # the code 0 and seven bits are one byte below 128
                out += [head, (part >> 1).tobytes()]
            else:
                bits = np.zeros((len(part), 64), np.uint8)  # the end-of-block code, then a bit for each coefficient
                bits[:, 1:] = part & 1 ^ (part < 128)
                out += [head, _stuffed(bits.ravel())]
    return b"".join([*out, b"\xff\xd9"])


def load(picture: Picture) -> tuple[bytes, int]:
    """The payload and the n_bytes that store() was given, from the coefficients of a decoded file."""
    size, n_bytes = struct.unpack(">QQ", picture.comment)
    wide, high = picture.mcus
    order = _dc_order(wide, high)
    y, cb, cr = (c.coef.reshape(-1, 64) for c in picture.components)
    data = np.empty((wide * high, 6, 64), np.int16)
    data[:, :4], data[:, 4], data[:, 5] = y[order].reshape(-1, 4, 64), cb, cr
    data[:, :, 0] &= 0xFF
    ac = data[:, :, 1:]
    ac += (ac < 0) * np.int16(255)
    return data.astype(np.uint8).tobytes()[:size], n_bytes


# ---------------------------------------------------------------- decode

class _Huffman:
    def __init__(self, counts: bytes, symbols: bytes) -> None:
        self.single = symbols[0] if len(symbols) == 1 and counts[0] == 1 else None
        self.codes: dict[tuple[int, int], int] = {}
        code, at = 0, 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                self.codes[length, code] = symbols[at]
                code, at = code + 1, at + 1
            code <<= 1


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8)).tolist()
        self.at = 0

    def take(self, n: int) -> int:
        value = 0
        for bit in self.bits[self.at : self.at + n]:
            value = value << 1 | bit
        self.at += n
        return value

    def symbol(self, table: _Huffman) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.bits[self.at]
            self.at += 1
            if (found := table.codes.get((length, code))) is not None:
                return found
        raise ValueError("no such code")

    def signed(self, size: int) -> int:
        value = self.take(size)
        return value if not size or value >= 1 << (size - 1) else value - (1 << size) + 1


_MARK = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.DOTALL)


def decode(data: bytes, arrays: bool = True) -> Picture:
    """Accumulate all scans of a progressive file into coefficients.

    With ``arrays``, scans whose only code has one bit are read as arrays; any
    other is read code by code.
    """
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, huffman, quant, picture, restart, comment = 2, {}, {}, None, 0, b""
    while True:
        marker, (size,) = data[at + 1], struct.unpack_from(">H", data, at + 2) if data[at + 1] != 0xD9 else (0,)
        if marker == 0xD9:
            break
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huffman[body[0]] = _Huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif marker == 0xC2:
            picture = _frame(body)
        elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise ValueError("only progressive Huffman files are read")
        elif marker == 0xDA:
            end = _MARK.search(data, at).start()
            _scan(picture, body, data[at:end], huffman, restart, arrays)
            at = end
    picture.tables, picture.comment = quant, comment
    return picture


def _frame(body: bytes) -> Picture:
    bits, height, width, n = struct.unpack_from(">BHHB", body)
    if bits != 8 or n not in (1, 3):
        raise ValueError("8 bits and one or three components are read")
    parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
    picture = Picture(width, height, parts, {})
    wide, high = picture.mcus
    h, v = max(c.h for c in parts), max(c.v for c in parts)
    for c in parts:
        c.blocks_wide, c.blocks_high = -(-width * c.h // (8 * h)), -(-height * c.v // (8 * v))
        c.coef = np.zeros((high * c.v, wide * c.h, 64), np.int16)
    return picture


def _scan(picture: Picture, head: bytes, data: bytes, huffman: dict, restart: int, arrays: bool) -> None:
    n = head[0]
    parts = [(next(c for c in picture.components if c.ident == head[1 + 2 * i]), head[2 + 2 * i]) for i in range(n)]
    low, top, approx = head[1 + 2 * n : 4 + 2 * n]
    before, now = approx >> 4, approx & 15
    if n == 1:
        c = parts[0][0]
        where = [np.stack(np.divmod(np.arange(c.blocks_wide * c.blocks_high), c.blocks_wide), 1)]
    else:
        rows, cols = (x[:, None] for x in np.divmod(np.arange(np.prod(picture.mcus)), picture.mcus[0]))
        where = []
        for c, _ in parts:
            dy, dx = np.divmod(np.arange(c.h * c.v), c.h)
            where.append(np.stack([(rows * c.v + dy).ravel(), (cols * c.h + dx).ravel()], 1))
    tables = [huffman.get(t >> 4) if low == 0 else huffman.get(16 + (t & 15)) for _, t in parts]
    single = low == 0 and before or all(t is not None and t.single is not None for t in tables) and len({t.single for t in tables}) == 1
    if arrays and not restart and single and _scan_arrays(parts, where, tables, data.replace(b"\xff\x00", b"\xff"), low, top, before, now):
        return
    pieces = re.split(rb"\xff[\xd0-\xd7]", data) if restart else [data]
    per = [len(w) // (len(where[0]) if n == 1 else np.prod(picture.mcus)) for w in where]
    units = len(where[0]) if n == 1 else int(np.prod(picture.mcus))
    for k, piece in enumerate(pieces):
        reader, last, state = _Reader(piece.replace(b"\xff\x00", b"\xff")), [0] * n, [0]
        for unit in range(k * restart, min(units, (k + 1) * restart) if restart else units):
            for i, (c, _) in enumerate(parts):
                for y, x in where[i][unit * per[i] : (unit + 1) * per[i]]:
                    _block(reader, c.coef[y, x], tables[i], low, top, before, now, last, i, state)


def _block(r: _Reader, block: np.ndarray, table: _Huffman, low: int, top: int, before: int, now: int, last: list[int], i: int, run: list[int]) -> None:
    """One block of one scan, code by code; run holds the blocks left of an end-of-band run."""
    if low == 0:
        if before:
            block[0] |= r.take(1) << now
        else:
            last[i] += r.signed(r.symbol(table))
            block[0] = last[i] << now
        return
    k = low
    while k <= top and not run[0]:
        zeros, size = divmod(r.symbol(table), 16)
        if not size and zeros < 15:
            run[0] = (1 << zeros) + r.take(zeros)
            break
        value = (r.signed(size) if not before else (1 if r.take(1) else -1)) if size else 0
        while k <= top:  # pass over zeros, correcting what is there already
            if before and block[k]:
                if r.take(1):
                    block[k] += (1 << now) if block[k] > 0 else -(1 << now)
            elif zeros:
                zeros -= 1
            else:
                block[k] = value << now if value >= 0 else -(-value << now)
                k += 1
                break
            k += 1
    if run[0]:
        if before:
            for j in range(k, top + 1):
                if block[j] and r.take(1):
                    block[j] += (1 << now) if block[j] > 0 else -(1 << now)
        run[0] -= 1


def _scan_arrays(parts: list, where: list[np.ndarray], tables: list, data: bytes, low: int, top: int, before: int, now: int) -> bool:
    """A scan whose codes all have one length, as arrays; false if this one hasn't."""
    raw = np.frombuffer(data, np.uint8)
    units = len(where[0]) if len(parts) == 1 else np.gcd.reduce([len(w) for w in where])
    if low == 0:
        size = 0 if before else tables[0].single + 1
        per = [len(w) // units for w in where]
        width = 1 if before else size
        bits = np.unpackbits(raw)[: units * sum(per) * width].reshape(units, sum(per), width)
        if before:
            values = bits[:, :, 0].astype(np.int32)
        else:
            codes = (bits[:, :, 1:].astype(np.int32) << np.arange(size - 2, -1, -1)).sum(2, dtype=np.int32)
            values = _extend(codes, size - 1)
        at = 0
        for (c, _), w, n in zip(parts, where, per, strict=True):
            own = values[:, at : at + n].ravel()
            at += n
            if before:
                c.coef[w[:, 0], w[:, 1], 0] |= (own << now).astype(np.int16)
            else:
                c.coef[w[:, 0], w[:, 1], 0] = np.cumsum(own) << now
        return True
    c, w, n, symbol = parts[0][0], where[0], top - low + 1, tables[0].single
    if c.coef.shape[:2] != (c.blocks_high, c.blocks_wide):
        return False
    flat = c.coef.reshape(-1, 64)
    if not before and 0 < symbol < 11:
        if symbol == 7:
            codes = raw[: len(w) * n].astype(np.int16)
        else:
            bits = np.unpackbits(raw)[: len(w) * n * (symbol + 1)].reshape(-1, symbol + 1)[:, 1:]
            codes = (bits.astype(np.int16) << np.arange(symbol - 1, -1, -1, dtype=np.int16)).sum(1, dtype=np.int16)
        values = _extend(codes.reshape(len(w), n), symbol).astype(np.int16)
        flat[:, low : top + 1] = np.where(values < 0, -(-values << now), values << now)
        return True
    if before and symbol == 0 and (own := flat[:, low : top + 1]).all():
        bits = np.unpackbits(raw)[: len(w) * (n + 1)].reshape(len(w), n + 1)[:, 1:].astype(np.int16) << now
        own += np.where(own > 0, bits, -bits)
        return True
    return False


# ---------------------------------------------------------------- pixels

def samples(picture: Picture, c: Component) -> np.ndarray:
    """Samples of one component: dequantise and inverse-transform."""
    high, wide, _ = c.coef.shape
    raster = np.empty((high * wide, 64), np.float32)
    raster[:, ZIGZAG] = c.coef.reshape(-1, 64) * picture.tables[c.q]
    half = np.matmul(raster.reshape(-1, 8, 8), _BASIS).reshape(-1, 8, 8)
    out = np.matmul(_BASIS.T, half) + np.float32(128)
    return out.reshape(high, wide, 8, 8).transpose(0, 2, 1, 3).reshape(high * 8, wide * 8)


def rgb(picture: Picture) -> np.ndarray:
    """The full-resolution tensor, height x width x 3, of 8-bit values."""
    h, v = max(c.h for c in picture.components), max(c.v for c in picture.components)
    planes = []
    for c in picture.components:
        plane = np.clip(samples(picture, c), 0, 255)
        if (h // c.h, v // c.v) != (1, 1):
            plane = plane.repeat(v // c.v, 0).repeat(h // c.h, 1)
        planes.append(plane[: picture.height, : picture.width])
    if len(planes) == 1:
        planes = [planes[0], np.full_like(planes[0], 128), np.full_like(planes[0], 128)]
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    out = np.empty((picture.height, picture.width, 3), np.uint8)
    for i, x in enumerate((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)):
        out[:, :, i] = np.clip(np.rint(x), 0, 255)
    return out


def features(tensor: np.ndarray) -> str:
    """Size, channel means and channel deviations in thousandths, from exact sums."""
    flat = tensor.reshape(-1, 3)
    n = len(flat)
    total = flat.sum(0, dtype=np.int64)
    square = np.einsum("ij,ij->j", flat, flat, dtype=np.int64)
    mean = [int(t) * 1000 // n for t in total]
    spread = [int(np.floor(np.sqrt(max(0, int(s) * n - int(t) ** 2)) * 1000 / n)) for s, t in zip(square, total, strict=True)]
    return f"{tensor.shape[1]}x{tensor.shape[0]};mean={','.join(map(str, mean))};std={','.join(map(str, spread))}"


# ---------------------------------------------------------------- columns

def padded(text: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of 64."""
    return text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media): each whole text as a progressive JPEG file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, media, held = [], [], 0
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode()
                ids.append(name.as_py())
                media.append(store(padded(raw), len(raw)))
                held += len(media[-1])
                if held > 8 << 20:  # small batches, whatever the texts' lengths
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "media"])
                    ids, media, held = [], [], 0
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), "doc_id long, media binary")


def to_tensors(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(doc_id, height, width, rgb): each file's full-resolution tensor, rows first; null media gives nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                data = batch.column(1)[i].as_py()
                tensor = None if data is None else rgb(decode(data))
                h, w = (None, None) if tensor is None else tensor.shape[:2]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([h], pa.int32()), pa.array([w], pa.int32()), pa.array([None if tensor is None else tensor.tobytes()], pa.binary())], ["doc_id", "height", "width", "rgb"])

    return media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(tidy(run), "doc_id long, height int, width int, rgb binary")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_back(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Digests of what each stored file holds, and features of its tensor; null media gives nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, item in zip(batch.column(0), batch.column(1), strict=True):
                if (data := item.as_py()) is None:
                    rows.append((name.as_py(), *[None] * 7))
                    continue
                picture = decode(data)
                payload, n_bytes = load(picture)
                rows.append((name.as_py(), n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), features(rgb(picture))))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in DIGEST.split(", ")])

    return media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(tidy(run), DIGEST)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def tensor_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's file as its full-resolution RGB tensor, with the tensor's digest."""
    tensors = to_tensors(store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return tensors.select("doc_id", "height", "width", F.length("rgb").alias("rgb_bytes"), F.sha2("rgb", 256).alias("rgb_sha256"))
