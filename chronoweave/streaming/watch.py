"""Watchers on a stream: keyed state with timers that closes each prediction once.

State is keyed by head neuron and time bucket, as in operators/watch.py, so a
busy neuron is many short-lived keys, and a key is gone once the watermark has
passed all its windows.  A row that comes after the watermark has passed it is
dropped; within the lateness, rows may come in any order.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import watch

OUTCOMES = "edge string, n bigint, at bigint, open bigint, close bigint, weight double, status string, resolved_at bigint"
_STATE = "edge array<string>, at array<bigint>, open array<bigint>, close array<bigint>, weight array<double>, t array<bigint>"


def opened(events: DataFrame, patterns: DataFrame) -> DataFrame:
    """watch.watchers() of a stream: repeated ones come out as well, and the state of outcomes() takes each once."""
    made = events.select(F.col("n").alias("pre"), F.col("t").alias("at")).join(patterns.where("delay_min >= 0 AND delay_max >= delay_min"), "pre")
    return made.select("edge", "n", "at", (F.col("at") + F.col("delay_min")).alias("open"), (F.col("at") + F.col("delay_max")).alias("close"), F.lit(1.0).alias("weight"))


def resolve(pending: list[tuple], times: list[int], watermark: int, eager: bool) -> tuple[list[tuple], list[tuple]]:
    """Outcomes of pending watchers (edge, at, open, close, weight) over sorted head times, and those still pending.

    A hit is final when the watermark has reached it, as no earlier one can come;
    eager takes the first that has come.
    """
    done, left = [], []
    for row in pending:
        i = bisect_left(times, row[2])
        hit = times[i] if i < len(times) and times[i] <= row[3] else None
        if hit is not None and (eager or hit <= watermark):
            done.append((*row, watch.CONFIRMED, hit))
        elif hit is None and row[3] <= watermark:
            done.append((*row, watch.MISSED, row[3]))
        else:
            left.append(row)
    return done, left


def outcomes(watching: DataFrame, events: DataFrame, width: int, lateness: str = "1 hour", eager: bool = False) -> DataFrame:
    """OUTCOMES rows, one a watcher, of streams watching (WATCHER) and events (n, t); times are microseconds.

    ``width`` is at least the widest window, close - open; a window opens no
    earlier than its watcher's own time.  Without eager, what
    comes out is what operators/watch.outcomes gives for the rows that came in
    time, at the price of waiting for the watermark; with eager, a confirmation
    comes with the first event that arrives, and only its time may differ.
    """
    bucket = lambda x: F.floor(x / (width + 1)).cast("long")
    none = F.lit(None)
    opened = watching.select("n", bucket(F.col("open")).alias("bucket"), F.timestamp_micros("at").alias("ts"), "edge", "at", "open", "close", "weight", none.cast("bigint").alias("t"))
    heads = events.select("n", F.explode(F.array(bucket(F.col("t")), bucket(F.col("t")) - 1)).alias("bucket"), F.timestamp_micros("t").alias("ts"), none.cast("string").alias("edge"), *(none.cast("bigint").alias(c) for c in ("at", "open", "close")), none.cast("double").alias("weight"), "t")
    rows = opened.unionByName(heads).withWatermark("ts", lateness)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        edge, at, start, stop, weight, times = state.get if state.exists else ([],) * 6
        pending, known = list(zip(edge, at, start, stop, weight, strict=True)), set(times)
        if not state.hasTimedOut:
            named = {(row[0], row[1]) for row in pending}
            for frame in frames:
                is_event = frame["t"].notna()
                known.update(int(t) for t in frame.loc[is_event, "t"])
                for row in frame.loc[~is_event, ["edge", "at", "open", "close", "weight"]].itertuples(index=False):
                    if (row[0], int(row[1])) not in named:
                        named.add((row[0], int(row[1])))
                        pending.append((row[0], int(row[1]), int(row[2]), int(row[3]), float(row[4])))
        watermark = state.getCurrentWatermarkMs() * 1000
        done, pending = resolve(pending, sorted(known), watermark, eager)
        # a watcher that comes yet opens after the watermark, so only later events may still confirm one, and those that pending ones wait for
        oldest = min((row[2] for row in pending), default=watermark)
        times = sorted(t for t in known if t > min(watermark, oldest - 1))
        if pending or times:
            state.update(tuple(list(x) for x in zip(*pending, strict=True)) + (times,) if pending else ([], [], [], [], [], times))
            due = min([row[3] for row in pending] + times)
            state.setTimeoutTimestamp(max(due // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if done:
            columns = list(zip(*done, strict=True))
            yield pd.DataFrame({"edge": columns[0], "n": [key[0]] * len(done), "at": columns[1], "open": columns[2], "close": columns[3], "weight": columns[4], "status": columns[5], "resolved_at": columns[6]})

    return rows.groupBy("n", "bucket").applyInPandasWithState(run, OUTCOMES, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
