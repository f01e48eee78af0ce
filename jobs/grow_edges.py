"""Candidate hyperedges of an events table that grows by files, kept by day; takes only files that are new.

    python -m jobs.grow_edges EVENTS OUT [--config FILE] [--checkpoint-dir DIR]

A file stream with its checkpoint in OUT hands over the files that no run has
seen.  Their vertices are stored by day, and the edges of every day whose heads
can see one of them, from a vertex's own day to the day of its time plus
``delay_max``, are grown anew from the stored vertices and replace that day's
partition.  So what stands in OUT is what one run over all files would write,
whatever the order in which events come, late ones included, and however they
are cut into runs and batches.

Writes below OUT: ``vertices/batch=/day=/`` (n, t), ``edges/day=/`` and
``checkpoint``.  A batch that was cut off is replayed by the stream and
overwrites what it wrote; without its checkpoint, everything is replayed to the
same end.  A neuron listens to the next ``fan_in`` neurons.  Times are
microseconds, days those of UTC.  The driver holds the list of a batch's days.
"""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.config import GrowConfig
from chronoweave.functions import ids
from chronoweave.operators import grow

from . import common

DAY = 86_400_000_000
DEFAULTS = {"k": 3, "combination_order_max": 2, "causal_coincidence_delta": 1_800_000_000, "delay_min": 60_000_000, "delay_max": 21_600_000_000, "budget_per_head": 8, "fan_in": 4, "files_per_batch": 64}
VERTICES = "n bigint, t bigint, batch bigint, day int"
EDGES = ids.EDGE + ", day int"


def day_of(t: Column) -> Column:
    return F.floor(t / DAY).cast("int")


def any_path(path: str) -> str:
    """path as a pattern that fits it alone: a stream takes a single file only by a pattern."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def grown(vertices: DataFrame, heads: DataFrame, cfg: dict) -> DataFrame:
    """Edges of heads (n, t), with their day."""
    listens = heads.select("n").distinct().select(F.col("n").alias("post"), F.explode(F.sequence(F.col("n") + 1, F.col("n") + cfg["fan_in"])).alias("pre"))
    own = GrowConfig(**{k: v for k, v in cfg.items() if k not in ("fan_in", "files_per_batch")})
    return grow.candidates(vertices, listens, own, heads).withColumn("day", day_of(F.col("head.t")))


def step(batch: DataFrame, number: int, out: str, cfg: dict) -> dict[str, int]:
    """Take a batch of (n, t) in: store its vertices and grow the days that they touch."""
    spark = batch.sparkSession
    new = batch.where("n is not null and t is not null").distinct().withColumn("day", day_of(F.col("t")))
    new.write.mode("overwrite").partitionBy("day").parquet(f"{out}/vertices/batch={number}")
    came = spark.read.schema("n bigint, t bigint, day int").parquet(f"{out}/vertices/batch={number}")
    reach = F.explode(F.sequence(day_of(F.col("t") + cfg["delay_min"]), day_of(F.col("t") + cfg["delay_max"])))
    touched = sorted({r[0] for r in came.select("day").unionByName(came.select(reach.alias("day"))).distinct().collect()})
    if not touched:
        return {"batch": number, "vertices": 0, "days": 0, "edges": 0}
    back = -(-cfg["delay_max"] // DAY)
    needed = sorted({d - i for d in touched for i in range(back + 1)})
    known = spark.read.schema(VERTICES).parquet(f"{out}/vertices").where(F.col("day").isin(needed)).select("n", "t", "day").distinct()
    edges = grown(known.select("n", "t"), known.where(F.col("day").isin(touched)).select("n", "t"), cfg)
    edges.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{out}/edges")
    done = {"batch": number, "vertices": came.count(), "days": len(touched), "edges": read_edges(spark, out).where(F.col("day").isin(touched)).count()}
    common.LOG.info("grow_edges: batch %(batch)d: %(vertices)d vertices read, %(edges)d edges of %(days)d days written", done)
    return done


def run(spark: SparkSession, events: str, out: str, config: str | None = None) -> list[dict[str, int]]:
    """Take in all files that are new, and return when they are; one record a batch."""
    cfg, out, done = common.settings(spark, DEFAULTS, config), out.rstrip("/"), []
    common.LOG.info("grow_edges: reading %s into %s, settings %s", events, out, cfg)
    stream = spark.readStream.schema(spark.read.parquet(events).schema).option("maxFilesPerTrigger", cfg["files_per_batch"]).parquet(any_path(events))
    rows = stream.select(F.col("user_id").cast("bigint").alias("n"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    writer = rows.writeStream.foreachBatch(lambda batch, number: done.append(step(batch, number, out, cfg)))
    query = writer.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    common.LOG.info("grow_edges: %d batches, %d edges written", len(done), sum(d["edges"] for d in done))
    return done


def read_edges(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(EDGES).parquet(f"{out.rstrip('/')}/edges")


def job2_grow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = common.own_folder(spark, "job2")
    for _ in range(2):
        run(spark, f"{sf_dir}/events.parquet", out, common.beside(__file__))
    return read_edges(spark, out).select("day", "id", F.size("tail").alias("n_tails"), "provenance", "reliability")


SQL = f"""
WITH vx AS (SELECT DISTINCT user_id AS n, epoch_us(ts) AS t FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
near AS (SELECT h.n, h.t, v.n AS pre, v.t AS pt, row_number() OVER (PARTITION BY h.n, h.t, v.n ORDER BY v.t DESC) AS rk
  FROM vx h JOIN vx v ON v.n BETWEEN h.n + 1 AND h.n + 4 AND v.t BETWEEN h.t - 21600000000 AND h.t - 60000000),
gaps AS (SELECT *, CASE WHEN pt - lag(pt) OVER w > 1800000000 THEN 1 ELSE 0 END AS gap, row_number() OVER w AS idx FROM near WHERE rk <= 3 WINDOW w AS (PARTITION BY n, t ORDER BY pt, pre)),
num AS (SELECT *, sum(gap) OVER (PARTITION BY n, t ORDER BY pt, pre) AS cluster FROM gaps),
made AS (SELECT n, t, [pre || '@' || pt] AS tail, pt AS latest, [idx] AS idx FROM num
  UNION ALL SELECT a.n, a.t, [a.pre || '@' || a.pt, b.pre || '@' || b.pt], greatest(a.pt, b.pt), [a.idx, b.idx] FROM num a JOIN num b ON a.n = b.n AND a.t = b.t AND a.cluster = b.cluster AND a.idx < b.idx),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n, t ORDER BY len(tail), latest DESC, idx) AS rk FROM made)
SELECT (t // {DAY})::INTEGER AS day, n || '@' || t || '&' || array_to_string(list_sort(tail), ',') || '#' || t AS id, len(tail)::INTEGER AS n_tails,
  CASE len(tail) WHEN 1 THEN 'unary' ELSE 'pair' END AS provenance, 0.1::DOUBLE AS reliability FROM ranked WHERE rk <= 8
"""


def main(argv: list[str] | None = None) -> None:
    args = argparse.ArgumentParser(prog="jobs.grow_edges", description=__doc__.splitlines()[0])
    for name in ("events", "out"):
        args.add_argument(name)
    args.add_argument("--config")
    args.add_argument("--checkpoint-dir")
    given = args.parse_args(argv)
    spark = common.session("grow_edges", given.checkpoint_dir)
    try:
        for record in run(spark, given.events, given.out, given.config):
            print(record)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
