"""Frequent labels with decay and hysteresis.

A label's count decays by exp(-lambda dt) and grows by each observation's
weight, in order of (t, seq); every observation adds to hold, and one with the
count at theta or more and hold at hold_k or more promotes the label and sets
hold, but not the count, back.  The rule is a recursion over a label's
observations, so these are sorted by label and streamed: a task holds the state
of one label, four numbers, however many observations it has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MineConfig

STATE = "label string, count double, last_t bigint, hold int, promotions int"
_SCHEMA = pa.schema([("label", pa.string()), ("count", pa.float64()), ("last_t", pa.int64()), ("hold", pa.int32()), ("promotions", pa.int32())])


def _streamed(rows: DataFrame, cfg: MineConfig) -> DataFrame:
    """States after rows (label, kind, t, seq, weight, hold, promotions): kind 0 is a state to go on from, kind 1 an observation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        open_, name, count, last, hold, made = False, None, 0.0, None, 0, 0
        for batch in batches:
            for label, kind, t, weight, h, p in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if not open_ or label != name:
                    if open_:
                        done.append((name, count, last, hold, made))
                    open_, name, count, last, hold, made = True, label, 0.0, None, 0, 0
                if not kind:
                    count, last, hold, made = weight, t, h, p
                    continue
                count = count * math.exp(-cfg.lambda_decay * max(0, t - (t if last is None else last))) + weight
                last, hold = t, hold + 1
                if count >= cfg.theta and hold >= cfg.hold_k:
                    hold, made = 0, made + 1
            if len(done) > 10_000:
                yield batch_of(done)
                done = []
        if open_:
            yield batch_of([*done, (name, count, last, hold, made)])

    def batch_of(states: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*states, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    sorted_ = rows.repartition("label").sortWithinPartitions("label", "kind", "t", "seq", "weight")
    return sorted_.select("label", "kind", "t", "weight", "hold", "promotions").mapInArrow(run, STATE)


def _observed(observations: DataFrame, cfg: MineConfig) -> DataFrame:
    none = F.lit(None).cast("int")
    return observations.where(F.col("weight") >= cfg.min_weight).select("label", F.lit(1).alias("kind"), "t", "seq", F.col("weight").cast("double").alias("weight"), none.alias("hold"), none.alias("promotions"))


def fold(observations: DataFrame, cfg: MineConfig | None = None) -> DataFrame:
    """(label, count, last_t, hold, promotions) from observations (label, t, seq, weight)."""
    cfg = cfg or MineConfig()
    return _streamed(_observed(observations, cfg), cfg)


def resume(states: DataFrame, observations: DataFrame, cfg: MineConfig | None = None) -> DataFrame:
    """fold() going on from the states of the labels so far; its rows, in the form of STATE."""
    cfg = cfg or MineConfig()
    before = states.select("label", F.lit(0).alias("kind"), F.col("last_t").alias("t"), F.lit(0).cast("bigint").alias("seq"), F.col("count").alias("weight"), "hold", "promotions")
    return _streamed(before.unionByName(_observed(observations, cfg).withColumn("seq", F.col("seq").cast("bigint"))), cfg)


def promoted(observations: DataFrame, cfg: MineConfig | None = None) -> DataFrame:
    return fold(observations, cfg).where("promotions > 0").select("label", "promotions")
