"""Frequent labels of sliding windows from mergeable summaries of panes.

A summary of a pane keeps at most ``capacity`` labels, each with a lower bound
of its count, and what may have been lost: when more labels are held, the count
of the one after the last that fits is taken from all, and added to ``lost``.
A label's true count lies from ``low`` to ``low + lost``, and since each such cut
takes as much from more than ``capacity`` labels, lost is at most n / (capacity + 1)
of n observations, however summaries are cut and merged: tasks make them over
their own rows, panes merge those of tasks, and windows add those of panes.

So of any number of labels, ``capacity`` a pane and task are shuffled, and no
task sees all rows of a label.  frequent() then counts exactly those labels that
the bounds leave in question.

A summary is a table (pane, label, low, lost, n): a row for each label held, and
one without a label for lost and n.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SUMMARY = "pane bigint, label string, low bigint, lost bigint, n bigint"
#: (pane, label) pairs that are sent to all tasks for counting; more are joined
BROADCAST_PAIRS = 1_000_000
PROMOTED, ACTIVE, DEMOTED = "promoted", "active", "demoted"


def _trim(pane: np.ndarray, low: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    """Indexes of the labels that stay, their lowered counts, and the cut of each pane that had one."""
    order = np.lexsort((-low, pane))
    p, x = pane[order], low[order]
    first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(p)))
    over = size > capacity
    cut = np.zeros(len(first), np.int64)
    cut[over] = x[first[over] + capacity]
    x = x - np.repeat(cut, size)
    kept = x > 0
    return order[kept], x[kept], {int(a): int(b) for a, b in zip(p[first[over]], cut[over], strict=True)}


def summaries(observations: DataFrame, pane: int, capacity: int) -> DataFrame:
    """The summaries of observations (label, t) by panes of that width; rows without a label or time don't count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        lost: dict[int, int] = {}
        seen: dict[int, int] = {}

        def cut(table: pa.Table) -> pa.Table:
            keep, low, cuts = _trim(table["pane"].to_numpy(), table["low"].to_numpy(), capacity)
            for p, c in cuts.items():
                lost[p] = lost.get(p, 0) + c
            return pa.table({"pane": table["pane"].take(keep), "label": table["label"].take(keep), "low": low})

        for batch in batches:
            rows = pa.Table.from_batches([batch]).group_by(["pane", "label"]).aggregate([([], "count_all")]).rename_columns(["pane", "label", "low"])
            for p, c in zip(*(x.tolist() for x in np.unique(batch.column("pane").to_numpy(), return_counts=True)), strict=True):
                seen[p] = seen.get(p, 0) + c
            if held is not None:
                rows = pa.concat_tables([held, rows]).group_by(["pane", "label"]).aggregate([("low", "sum")]).rename_columns(["pane", "label", "low"])
            held = cut(rows)
        if held is not None:
            panes = list(seen)
            yield batch_of(held["pane"].to_numpy(), held["label"].combine_chunks(), held["low"].to_numpy(), None, None)
            yield batch_of(np.array(panes), pa.nulls(len(panes), pa.string()), np.zeros(len(panes), np.int64), [lost.get(p, 0) for p in panes], [seen[p] for p in panes])

    def batch_of(panes, labels, low, lost, n) -> pa.RecordBatch:
        none = pa.nulls(len(panes), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(panes, pa.int64()), labels, pa.array(low, pa.int64()), none if lost is None else pa.array(lost, pa.int64()), none if n is None else pa.array(n, pa.int64())], ["pane", "label", "low", "lost", "n"])

    own = observations.where("label is not null and t is not null").select(F.floor(F.col("t") / pane).cast("long").alias("pane"), "label")
    return merged(own.mapInArrow(run, SUMMARY), capacity)


def merged(parts: DataFrame, capacity: int) -> DataFrame:
    """Summaries of the same panes as one each; also for adding those of rows that came later."""
    lows = parts.where("label is not null").groupBy("pane", "label").agg(F.sum("low").alias("low"))
    totals = parts.where("label is null").groupBy("pane").agg(F.sum("lost").alias("lost"), F.sum("n").alias("n"))
    ranked = lows.withColumn("rank", F.row_number().over(W.partitionBy("pane").orderBy(F.desc("low"), "label")))
    ranked = ranked.where(F.col("rank") <= capacity + 1).withColumn("cut", F.max(F.when(F.col("rank") > capacity, F.col("low")).otherwise(0)).over(W.partitionBy("pane")))
    cuts = ranked.groupBy("pane").agg(F.max("cut").alias("cut"))
    kept = ranked.where((F.col("rank") <= capacity) & (F.col("low") > F.col("cut")))
    none = F.lit(None).cast("bigint")
    heads = totals.join(cuts, "pane", "left").select("pane", F.lit(None).cast("string").alias("label"), F.lit(0).cast("bigint").alias("low"), (F.col("lost") + F.coalesce("cut", F.lit(0))).alias("lost"), "n")
    return kept.select("pane", "label", (F.col("low") - F.col("cut")).alias("low"), none.alias("lost"), none.alias("n")).unionByName(heads)


def windows(summary: DataFrame, panes: int) -> DataFrame:
    """(win, label, low, lost, n) of the windows of that many panes, each named by its last one, up to the last pane."""
    last = summary.agg(F.max("pane").alias("last"))
    spread = summary.join(F.broadcast(last), F.lit(True)).select("*", F.explode(F.sequence("pane", F.least(F.col("pane") + panes - 1, "last"))).alias("win"))
    lows = spread.where("label is not null").groupBy("win", "label").agg(F.sum("low").alias("low"))
    totals = spread.where("label is null").groupBy("win").agg(F.sum("lost").alias("lost"), F.sum("n").alias("n"))
    return lows.join(totals, "win").select("win", "label", "low", "lost", "n")


def frequent(observations: DataFrame, summary: DataFrame, pane: int, panes: int, capacity: int, share: float) -> DataFrame:
    """(win, label, support, n) of the labels with at least ``share`` of a window's observations, counted exactly.

    A share must exceed what a summary may lose, 1 / (capacity + 1), so that no
    frequent label can be missing from it.
    """
    if share * (capacity + 1) <= 1:
        raise ValueError(f"a share of {share} needs a capacity of at least {int(1 / share)}")
    open_ = windows(summary, panes).where(F.col("low") + F.col("lost") >= share * F.col("n"))
    pairs = open_.select("label", F.explode(F.sequence(F.col("win") - panes + 1, "win")).alias("pane")).distinct()
    own = observations.where("label is not null and t is not null").select(F.floor(F.col("t") / pane).cast("long").alias("pane"), "label")
    if pairs.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS:
        counted = own.join(F.broadcast(pairs), ["pane", "label"], "left_semi").groupBy("pane", "label").agg(F.count(F.lit(1)).alias("c"))
    else:
        counted = own.groupBy("pane", "label").agg(F.count(F.lit(1)).alias("c")).join(pairs, ["pane", "label"], "left_semi")
    asked = open_.select("win", "label", "n", F.explode(F.sequence(F.col("win") - panes + 1, "win")).alias("pane"))
    total = asked.join(counted, ["pane", "label"]).groupBy("win", "label", "n").agg(F.sum("c").alias("support"))
    return total.where(F.col("support") >= share * F.col("n")).select("win", "label", "support", "n")


def with_states(found: DataFrame, share: float) -> DataFrame:
    """found, frequent() at the share of demotion, as (win, label, support, n, state) of the labels in force.

    A label is promoted by a window with ``share`` and stays active for as long
    as the windows after it still have it; the window in which it is gone says
    demoted, without support.  A label has a row a window, however often it stands.
    """
    by = W.partitionBy("label").orderBy("win")
    island = found.withColumn("island", F.col("win") - F.row_number().over(by))
    within = W.partitionBy("label", "island").orderBy("win")
    strong = (F.col("support") >= share * F.col("n")).cast("int")
    marked = island.withColumn("since", F.sum(strong).over(within.rowsBetween(W.unboundedPreceding, W.currentRow))).where("since > 0")
    first = F.row_number().over(within) == 1
    rows = marked.select("win", "label", "support", "n", F.when(first, PROMOTED).otherwise(ACTIVE).alias("state"), "island")
    last = found.agg(F.max("win").alias("last"))
    ends = rows.groupBy("label", "island").agg((F.max("win") + 1).alias("win")).join(F.broadcast(last), F.lit(True)).where("win <= last")
    none = F.lit(None).cast("bigint")
    return rows.drop("island").unionByName(ends.select("win", "label", none.alias("support"), none.alias("n"), F.lit(DEMOTED).alias("state")))
