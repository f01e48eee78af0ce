"""Per-neuron event buffers on a stream: order, retention and the watermark.

Events may come late and out of order; they are put in their place and none is
dropped on arrival.  A buffer looks at its age every ``prune_batch`` events and
then forgets what is older than ``horizon`` before its last event, so state is
bounded by rate and horizon and not by the stream's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import BufferConfig

BUFFERS = "n bigint, size bigint, first_t bigint, last_t bigint"
_STATE = "t array<bigint>, appended bigint"


def kept(times: list[int], new: list[int], appended: int, cfg: BufferConfig) -> tuple[list[int], int]:
    """A buffer's sorted times, and its count of appends since it was last pruned, after new ones in order of arrival."""
    times = sorted(times)
    while new:
        some, new = new[: cfg.prune_batch - appended], new[cfg.prune_batch - appended :]
        times, appended = sorted(times + some), appended + len(some)
        if appended >= cfg.prune_batch:
            times, appended = [t for t in times if t >= times[-1] - cfg.horizon], 0
    return times, appended


def buffers(events: DataFrame, cfg: BufferConfig | None = None) -> DataFrame:
    """(n, size, first_t, last_t) of each neuron's buffer after each micro-batch of a stream (n, t)."""
    cfg = cfg or BufferConfig()

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, appended = state.get if state.exists else ([], 0)
        times, appended = list(times), int(appended)
        for batch in batches:
            times, appended = kept(times, batch["t"].tolist(), appended, cfg)
        if times:
            state.update((times, appended))
            yield pd.DataFrame({"n": [key[0]], "size": [len(times)], "first_t": [times[0]], "last_t": [times[-1]]})

    return events.select("n", "t").groupBy("n").applyInPandasWithState(run, BUFFERS, _STATE, "update", GroupStateTimeout.NoTimeout)


def retained(events: DataFrame, cfg: BufferConfig | None = None) -> DataFrame:
    """Of a table (n, t), what buffers hold that are pruned to the last: each neuron's events within the horizon of its latest."""
    cfg = cfg or BufferConfig()
    last = events.groupBy("n").agg(F.max("t").alias("__last"))
    return events.join(last, "n").where(F.col("t") >= F.col("__last") - cfg.horizon).drop("__last")


def prune_before(events: DataFrame, t: int) -> DataFrame:
    """Events not before t."""
    return events.where(F.col("t") >= t)


class Watermark:
    """The latest event time so far, 0 before any; late events leave it where it is."""

    def __init__(self) -> None:
        self.t = 0

    def update(self, t: int | None) -> int:
        self.t = max(self.t, t or 0)
        return self.t

    def batch(self, events: DataFrame) -> int:
        """Of a micro-batch (n, t), one number a batch comes to the driver."""
        return self.update(events.agg(F.max("t")).first()[0])
