"""Keyed streaming state: frequent labels with decay and hold, and events in order."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import MineConfig

PROMOTIONS = "label string, t bigint, count double, promotions bigint"
_STATE = "count double, last_t bigint, hold bigint"


def promotions(observations: DataFrame, cfg: MineConfig | None = None) -> DataFrame:
    """(label, t, count, promotions) from a stream of (label, t, seq, weight): one row for each label of a micro-batch.

    t and count are the label's state after the batch, promotions those of the
    batch.  The rule is mine.fold's, and so are the results on input in order of
    time; within a batch, rows are put in order (t, seq).  A row older than the
    state counts without decay.  State is three numbers a label.
    """
    cfg = cfg or MineConfig()

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, last, hold = state.get if state.exists else (0.0, None, 0)
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["t", "seq"], kind="stable")
        made = 0
        for t, weight in zip(rows["t"].tolist(), rows["weight"].tolist(), strict=True):
            if weight < cfg.min_weight:
                continue
            age = max(0, t - (t if last is None else last))
            count = count * math.exp(-cfg.lambda_decay * age) + weight
            last, hold = int(t), hold + 1
            if count >= cfg.theta and hold >= cfg.hold_k:
                made, hold = made + 1, 0
        if last is not None:
            state.update((float(count), last, int(hold)))
            yield pd.DataFrame({"label": [key[0]], "t": [last], "count": [float(count)], "promotions": [made]})

    return observations.select("label", "t", "seq", "weight").groupBy("label").applyInPandasWithState(run, PROMOTIONS, _STATE, "update", GroupStateTimeout.NoTimeout)


def bin_counts(events: DataFrame, width: str, lateness: str = "1 hour") -> DataFrame:
    """(start, n, count) of tumbling bins of a stream with event time ts and neuron n."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", width).alias("w"), "n").agg(F.count(F.lit(1)).alias("count")).select(F.col("w.start").alias("start"), "n", "count")


def confusion(predictions: DataFrame) -> DataFrame:
    """(y_true, y_pred, n) over a stream of predictions, in complete or update mode."""
    return predictions.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
