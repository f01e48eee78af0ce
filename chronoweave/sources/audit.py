"""A hash-chained audit log in JSON lines, and its parallel check.

A record is one line of JSON with sorted keys: kind, payload, prev_hash, ts and
hash, the SHA-256 of the line without the hash followed by the 32 bytes of the
record's before, so a change anywhere shows.  Appending is one ordered writer by
nature; records reach it in bounded runs.  Checking is parallel: every record is
hashed where it is read, and a join on the line numbers compares the links.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .logs import utc_now

RECORD = "idx bigint, prev_hash string, hash string, line string"
EDGES_A_RECORD = 1000
HASH_CHARS = len('{"hash":"",') + 64  # of a line, up to the rest of its record


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


def chained_line(kind: str, payload: str, ts: str, prev: str | None) -> tuple[str, str]:
    """(hash, line) of a record whose payload is canonical JSON already."""
    body = f'"kind":{canonical(kind)},"payload":{payload},"prev_hash":{canonical(prev)},"ts":{canonical(ts)}}}'
    own = hashlib.sha256(("{" + body).encode() + bytes.fromhex(prev or "")).hexdigest()
    return own, f'{{"hash":"{own}",{body}'


class AuditLog:
    """Appends to one file; resumes from its last whole line; starts a new file beyond max_bytes, if set."""

    def __init__(self, path: str, max_bytes: int | None = None) -> None:
        self.path, self.max_bytes = path, max_bytes
        self.prev: str | None = None
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        if os.path.exists(path):
            with open(path, encoding="utf-8") as lines:
                for line in lines:
                    if line.endswith("\n") and line.strip():
                        self.prev = json.loads(line)["hash"]

    def append(self, kind: str, payload: dict, ts: str | None = None) -> str:
        return self.extend([(kind, canonical(payload), ts)])

    def extend(self, records: Iterable[tuple[str, str, str | None]]) -> str:
        """Append (kind, payload as canonical JSON, time or none)."""
        self.rotate()
        with open(self.path, "a", encoding="utf-8") as out:
            for kind, payload, ts in records:
                self.prev, line = chained_line(kind, payload, ts or utc_now(), self.prev)
                out.write(line + "\n")
        return self.prev or ""

    def rows(self, records: DataFrame) -> str:
        """Append the rows (kind, payload, ts) of a table in its order, a partition at a time on the driver."""
        return self.extend((r["kind"], r["payload"], r["ts"]) for r in records.select("kind", "payload", "ts").toLocalIterator())

    def rotate(self) -> str | None:
        """Move a file beyond max_bytes aside, named by its time, and start the chain anew."""
        if self.max_bytes is None or not os.path.exists(self.path) or os.path.getsize(self.path) <= self.max_bytes:
            return None
        stem = f"{self.path}.{time.strftime('%Y%m%dT%H%M%SZ', time.gmtime())}"
        moved, k = stem, 0
        while os.path.exists(moved):
            k += 1
            moved = f"{stem}.{k}"
        os.rename(self.path, moved)
        self.prev = None
        return moved


def chained(records: DataFrame, order: list[str]) -> DataFrame:
    """(idx, prev_hash, hash, line) of a table's rows (kind, payload, ts) in order.

    The chain is sequential, so one task makes it, a batch at a time; the
    records are made in parallel before they meet there.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idx, prev = 0, None
        for batch in batches:
            out = []
            for kind, payload, ts in zip(batch["kind"], batch["payload"], batch["ts"], strict=True):
                own, line = chained_line(kind, payload, ts, prev)
                out.append((idx, prev, own, line))
                idx, prev = idx + 1, own
            yield pd.DataFrame(out, columns=["idx", "prev_hash", "hash", "line"])

    rows = records.select(*order, "kind", "payload", "ts").repartition(1).sortWithinPartitions(*order)
    return rows.select("kind", "payload", "ts").mapInPandas(run, RECORD)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(idx, line) of a log's lines in their order; lines are numbered by splits of the file, so none is read by one task alone."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    inside = lines.withColumn("r", F.row_number().over(W.partitionBy("f", "b").orderBy("i")) - 1)
    before, total = {}, 0
    for r in lines.groupBy("f", "b").agg(F.count(F.lit(1)).alias("n")).orderBy("f", "b").collect():  # one row a split
        before[r["f"], r["b"]] = total
        total += r["n"]
    if not before:
        return inside.select(F.col("r").cast("bigint").alias("idx"), "line")
    starts = spark.createDataFrame([(*k, v) for k, v in before.items()], "f string, b bigint, s bigint")
    return inside.join(F.broadcast(starts), ["f", "b"]).select((F.col("r") + F.col("s")).cast("bigint").alias("idx"), "line")


def _parts() -> tuple[Column, Column, Column]:
    """(stored hash, stored hash before, computed hash) of a line; nulls where it is no record."""
    stored = F.nullif(F.regexp_extract("line", r'^\{"hash":"([0-9a-f]{64})",', 1), F.lit(""))
    body = F.concat(F.lit("{"), F.substring(F.col("line"), F.lit(HASH_CHARS + 1), F.length("line")))
    prev = F.get_json_object("line", "$.prev_hash")
    whole = F.concat(F.encode(body, "utf-8"), F.coalesce(F.unhex(prev), F.lit(b"")))
    return stored, prev, F.when(stored.isNotNull(), F.sha2(whole, 256))


def verify(log: DataFrame) -> DataFrame:
    """One row (ok, count, bad_index) of lines (idx, line): whether hashes and links hold, and the first index where they don't."""
    stored, prev, own = _parts()
    seen = log.select("idx", stored.alias("hash"), prev.alias("prev"), own.alias("own"))
    before = seen.groupBy((F.col("idx") + 1).alias("idx")).agg(F.min("hash").alias("link"))
    linked = seen.join(before, "idx", "left")
    good = (F.col("hash") == F.col("own")) & F.when(F.col("idx") == 0, F.col("prev").isNull()).otherwise(F.col("link") == F.col("prev"))
    bad = ~F.coalesce(good, F.lit(False))
    out = linked.agg(F.count(F.lit(1)).alias("count"), F.min(F.when(bad, F.coalesce("idx", F.lit(-1)))).alias("bad_index"), (F.count(F.lit(1)) - F.count_distinct("idx")).alias("twice"))
    return out.select((F.col("bad_index").isNull() & (F.col("twice") == 0)).alias("ok"), "count", "bad_index")


def with_previous(log: DataFrame) -> DataFrame:
    """Records (idx, prev_hash, hash, line) with the hash of the one before as stored, for reading a break."""
    return log.join(log.select((F.col("idx") + 1).alias("idx"), F.col("hash").alias("stored_before")), "idx", "left")


def step_records(admitted: DataFrame, paths: DataFrame | None, updated: DataFrame | None, ts: str) -> DataFrame:
    """What a step tells: (phase, at, name, kind, payload, ts) of the edges admitted, a record a head, the paths found, one each, and the edges learnt.

    Learnt edges go by runs of ids, so a record is bounded whatever the step.
    """
    json_of = lambda *cols: F.to_json(F.struct(*cols))
    heads = admitted.groupBy("head").agg(F.array_sort(F.collect_list("id")).alias("admitted"))
    out = heads.select(F.lit(0).alias("phase"), F.col("head.t").alias("at"), F.col("head.n").cast("string").alias("name"), F.lit("GROW").alias("kind"), json_of("admitted", F.size("admitted").alias("count")).alias("payload"))
    if paths is not None:
        head = F.concat_ws("@", "target.n", "target.t").alias("head")
        out = out.unionByName(paths.select(F.lit(1).alias("phase"), F.col("target.t").alias("at"), F.concat_ws("|", F.col("target.n").cast("string"), "label").alias("name"), F.lit("EAT").alias("kind"), json_of("edges", head, "label", "length", "score").alias("payload")))
    if updated is not None:
        many = updated.count()
        runs = max(1, -(-many // EDGES_A_RECORD))
        each = updated.groupBy(F.pmod(F.xxhash64("id"), F.lit(runs)).alias("run")).agg(F.array_sort(F.collect_list(F.struct("id", "reliability"))).alias("edges"))
        out = out.unionByName(each.select(F.lit(2).alias("phase"), F.col("run").cast("bigint").alias("at"), F.lit("").alias("name"), F.lit("UPDATE").alias("kind"), json_of(F.size("edges").alias("count"), "edges").alias("payload")))
    return out.withColumn("ts", F.lit(ts))
