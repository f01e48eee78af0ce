"""Recordings of event cameras in their published file formats, as rows of events.

Files are read by Spark's binary source, a row a file, from any store that it
reaches; a task turns each into rows by numpy, BATCH events at a time.  What is
damaged is an error that names the file, unless ``skip_damaged`` leaves it out.

N-MNIST: ``Train`` and ``Test`` hold a folder for each digit with a file a
sample.  An event is five bytes: column, row, and 24 bits of which the highest
is the polarity and the others the time in microseconds.

DVS Gesture: AEDAT 3.1 files, each with a table ``<name>_labels.csv`` of what is
seen from when to when.  After header lines that begin with ``#`` come packets:
seven little-endian numbers, among them the kind and the number of events, then
events of two words each, of which the first has the validity, the polarity, the
row and the column, and the second the time.  Only polarity packets count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "item string, x int, y int, p int, t bigint"
BATCH = 1 << 16

#: The sensors' sides, and the names of the splits' folders.
NMNIST_SIDE, GESTURE_SIDE = 34, 128
SPLITS = {"train": "Train", "test": "Test"}

#: Fixed values of AEDAT 3.1: bytes of a packet's header, its kind of packets with polarities, and bits of an event's first word.
HEADER_BYTES, POLARITY_KIND, EVENT_BYTES = 28, 1, 8
VALID, POLARITY, ROW, COLUMN = (0, 1), (1, 1), (2, 15), (17, 15)


def nmnist_events(raw: bytes) -> dict[str, np.ndarray]:
    """Events (x, y, p, t) of a sample."""
    if len(raw) % 5:
        raise ValueError(f"{len(raw)} bytes are no whole number of events")
    b = np.frombuffer(raw, np.uint8).reshape(-1, 5).astype(np.int64)
    return {"x": b[:, 0], "y": b[:, 1], "p": b[:, 2] >> 7, "t": (b[:, 2] & 0x7F) << 16 | b[:, 3] << 8 | b[:, 4]}


def _bits(word: np.ndarray, field: tuple[int, int]) -> np.ndarray:
    return (word >> field[0]) & ((1 << field[1]) - 1)


def gesture_events(raw: bytes) -> dict[str, np.ndarray]:
    """Valid events (x, y, p, t) of the polarity packets of an AEDAT 3.1 file."""
    at = 0
    while raw[at : at + 1] == b"#":
        end = raw.find(b"\n", at)
        if end < 0:
            raise ValueError("a header line has no end")
        last, at = raw[at:end].rstrip(b"\r"), end + 1
        if last == b"#!END-HEADER":
            break
    words = []
    while at < len(raw):
        if at + HEADER_BYTES > len(raw):
            raise ValueError("a packet's header is cut off")
        kind, _ = np.frombuffer(raw, "<i2", 2, at).tolist()
        size, _, overflow, _, number, _ = np.frombuffer(raw, "<i4", 6, at + 4).tolist()
        at += HEADER_BYTES
        if size < 0 or number < 0 or at + size * number > len(raw):
            raise ValueError("a packet is cut off")
        if kind == POLARITY_KIND and number:
            if size != EVENT_BYTES:
                raise ValueError(f"events of {size} bytes")
            pair = np.frombuffer(raw, "<u4", 2 * number, at).reshape(-1, 2).astype(np.int64)
            words.append(np.stack([pair[:, 0], pair[:, 1] + (overflow << 31)], 1))
        at += size * number
    both = np.concatenate(words) if words else np.zeros((0, 2), np.int64)
    both = both[_bits(both[:, 0], VALID) == 1]
    return {"x": _bits(both[:, 0], COLUMN), "y": _bits(both[:, 0], ROW), "p": _bits(both[:, 0], POLARITY), "t": both[:, 1]}


def _decoded(files: DataFrame, decode, skip_damaged: bool) -> DataFrame:
    """EVENTS of files (item, content), in the order of each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    events = decode(content.as_py())
                except ValueError as error:
                    if skip_damaged:
                        continue
                    raise ValueError(f"{item}: {error}") from error
                for lo in range(0, len(events["t"]), BATCH):
                    part = {k: v[lo : lo + BATCH] for k, v in events.items()}
                    n = len(part["t"])
                    columns = [pa.array([item] * n, pa.string()), *(pa.array(part[k].astype(np.int32)) for k in "xyp"), pa.array(part["t"])]
                    yield pa.RecordBatch.from_arrays(columns, ["item", "x", "y", "p", "t"])

    return files.mapInArrow(run, EVENTS)


def neuron(x: Column, y: Column, p: Column, side: int) -> Column:
    """A number for each pixel and polarity of a sensor."""
    return (((y * side) + x) * 2 + p).cast("bigint")


def _with_neuron(events: DataFrame, side: int) -> DataFrame:
    return events.withColumn("n", neuron(F.col("x"), F.col("y"), F.col("p"), side))


def read_nmnist(spark: SparkSession, root: str, split: str, item: str | None = None, skip_damaged: bool = False) -> DataFrame:
    """(item, label, n, t, x, y, p) of a split's samples, or of one; item is ``digit/file`` without its ending."""
    if split not in SPLITS:
        raise ValueError("split is train or test")
    folder = f"{root.rstrip('/')}/{SPLITS[split]}"
    path = f"{folder}/{item}.bin" if item else f"{folder}/[0-9]/*.bin"
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([0-9]/[^/]+)\.bin$", 1).alias("item"), "content")
    rows = _with_neuron(_decoded(files, nmnist_events, skip_damaged), NMNIST_SIDE)
    return rows.select("item", F.substring("item", 1, 1).cast("int").alias("label"), "n", "t", "x", "y", "p")


def read_gestures(spark: SparkSession, root: str, split: str, item: str | None = None, skip_damaged: bool = False) -> DataFrame:
    """(item, label, n, t, x, y, p) of labelled gestures; item is ``file/number`` of a row of the file's table, in its order of time.

    The split is a list of file names, ``trials_to_train.txt`` or
    ``trials_to_test.txt``.  Events outside all gestures are left out, and t
    counts from a gesture's start.
    """
    if split not in SPLITS:
        raise ValueError("split is train or test")
    root = root.rstrip("/")
    listed = spark.read.text(f"{root}/trials_to_{split}.txt").select(F.regexp_replace(F.trim("value"), r"\.aedat$", "").alias("file")).where("file <> ''").distinct()
    name = lambda end: F.regexp_extract("path", rf"([^/]+){end}$", 1).alias("file")
    files = spark.read.format("binaryFile").load(f"{root}/*.aedat").select(name(r"\.aedat"), "content").join(listed, "file", "left_semi")
    tables = spark.read.option("header", True).schema("class int, startTime_usec bigint, endTime_usec bigint").csv(f"{root}/*_labels.csv")
    tables = tables.select("*", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)_labels\.csv$", 1).alias("file")).join(listed, "file", "left_semi")
    # a person's recording has a dozen gestures
    spans = tables.groupBy("file").agg(F.array_sort(F.collect_list(F.struct(F.col("startTime_usec").alias("lo"), F.col("endTime_usec").alias("hi"), F.col("class").alias("label")))).alias("spans"))
    if item:
        files = files.where(F.col("file") == item.rsplit("/", 1)[0])
    rows = _with_neuron(_decoded(files.select(F.col("file").alias("item"), "content"), gesture_events, skip_damaged), GESTURE_SIDE)
    seen = rows.join(spans, rows["item"] == spans["file"]).select("file", "n", "t", "x", "y", "p", F.posexplode("spans").alias("number", "span")).where("t >= span.lo AND t < span.hi")
    out = seen.select(F.concat("file", F.lit("/"), F.col("number").cast("string")).alias("item"), "span.label", "n", (F.col("t") - F.col("span.lo")).alias("t"), "x", "y", "p")
    return out.where(F.col("item") == item) if item else out


def to_table(recordings: DataFrame, path: str, split: str) -> None:
    """Write recordings in the form that tables.read_dataset reads, below path/split; a split is replaced whole."""
    if split not in SPLITS:
        raise ValueError("split is train or test")
    recordings.select("item", "label", "n", "t").write.mode("overwrite").parquet(f"{path.rstrip('/')}/{split}")
