"""Bootstrap of means by Poisson weights, distributed and reproducible.

A row counts in a replicate as often as a Poisson(1) number says that is drawn
from a hash of the row's key, the replicate and the seed.  So no sample is ever
gathered: a task adds up its rows' weights and weighted values for all
replicates at once, and what is shuffled are two numbers a group and replicate.
Reruns draw the same on any number of tasks, as long as keys name the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: the chance that a Poisson(1) number is at most 0, 1, 2, ...; beyond the last, one more
CHANCES = [math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) for k in range(10)]
ROWS = 4096  # rows weighted at once
GROUPS = 4096  # groups whose sums a task holds

_U = np.uint64
_LOW = _U(0xFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """32-bit numbers, each bit of which depends on all of x's, as in the finalizer of MurmurHash3; in 64 bits without overflow."""
    x = x & _LOW
    x ^= x >> _U(16)
    x = (x * _U(0x85EBCA6B)) & _LOW
    x ^= x >> _U(13)
    x = (x * _U(0xC2B2AE35)) & _LOW
    return x ^ (x >> _U(16))


def weights(keys: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """Poisson(1) numbers of each key (rows) in each replicate (columns)."""
    own = mixed(keys.astype(np.int64).view(np.uint64))
    salt = mixed(np.arange(1, replicates + 1, dtype=np.uint64) * _U(0x9E3779B9) + _U(seed & 0xFFFFFFFF))
    u = mixed(own[:, None] ^ salt[None, :]) / float(1 << 32)
    return np.searchsorted(np.array(CHANCES), u, side="right")


def replicates(rows: DataFrame, value: Column, key: Column, by: str | None = None, n: int = 200, seed: int = 0) -> DataFrame:
    """(group, replicate, weight, total) of the rows whose value is not null; group is null without ``by``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, np.ndarray] = {}

        def sums() -> Iterator[pa.RecordBatch]:
            for name, both in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array(both[0].astype(np.int64)), pa.array(both[1])], ["group", "replicate", "weight", "total"])
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x, keys = part.column(1).to_numpy(), part.column(2).to_numpy()
                coded = part.column(0).dictionary_encode(null_encoding="encode")
                names, owner = coded.dictionary.to_pylist(), coded.indices.to_numpy()
                w = weights(keys, n, seed)
                for i, name in enumerate(names):
                    mine = w if len(names) == 1 else w[owner == i]
                    values = x if len(names) == 1 else x[owner == i]
                    both = held.setdefault(name, np.zeros((2, n)))
                    both[0] += mine.sum(0)
                    both[1] += values @ mine
                if len(held) > GROUPS:
                    yield from sums()
        yield from sums()

    group = F.col(by).cast("string") if by else F.lit(None).cast("string")
    own = rows.select(group.alias("group"), value.cast("double").alias("value"), key.cast("bigint").alias("key")).where("value is not null and key is not null")
    parts = own.mapInArrow(run, "group string, replicate int, weight bigint, total double")
    return parts.groupBy("group", "replicate").agg(F.sum("weight").alias("weight"), F.sum("total").alias("total"))


def bootstrap(rows: DataFrame, value: Column, key: Column, by: str | None = None, n: int = 200, level: float = 0.95, seed: int = 0) -> DataFrame:
    """(group, se, lo, hi): the spread of the replicates' means and their percentile interval, one row a group.

    A replicate in which none of a group's rows is drawn doesn't count.
    """
    means = replicates(rows, value, key, by, n, seed).where("weight > 0").withColumn("mean", F.col("total") / F.col("weight"))
    lo = (1 - level) / 2
    return means.groupBy("group").agg(F.stddev_samp("mean").alias("se"), F.percentile("mean", F.lit(lo)).alias("lo"), F.percentile("mean", F.lit(1 - lo)).alias("hi"))
