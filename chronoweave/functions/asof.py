"""The first event of a key within an interval, for many intervals at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def first_within(asked: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """asked (keys, open, close, ...) with ``hit``, the time of the first of events (keys, t) from open to close; null where there is none.

    Time is cut into buckets as wide as the widest interval, and an event stands
    in its own bucket and the one before, so an interval's bucket has all that it
    may hold.  There all are sorted once, latest first, and an interval takes the
    last event that came by: a busy key costs a sort, not its intervals times its
    events, and is spread over its buckets.
    """
    names, row = asked.columns, F.struct(*asked.columns)
    widest = asked.agg(F.max(F.col("close") - F.col("open"))).first()[0]
    width = max(1, (widest or 0) + 1)
    bucket = lambda x: F.floor(x / width).cast("long")
    own = asked.select(*keys, bucket(F.col("open")).alias("__bucket"), F.col("open").alias("__t"), F.lit(1).alias("__kind"), F.lit(None).cast("bigint").alias("__hit"), row.alias("__row"))
    given = events.select(*keys, "t").distinct().select(*keys, F.explode(F.array(bucket(F.col("t")), bucket(F.col("t")) - 1)).alias("__bucket"), F.col("t").alias("__t"), F.lit(0).alias("__kind"), F.col("t").alias("__hit"))
    rows = own.unionByName(given.withColumn("__row", F.lit(None).cast(own.schema["__row"].dataType)))
    by = W.partitionBy(*keys, "__bucket").orderBy(F.desc("__t"), "__kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = rows.withColumn("__hit", F.last("__hit", ignorenulls=True).over(by)).where("__kind = 1")
    return found.select(*(F.col("__row")[c].alias(c) for c in names), F.when(F.col("__hit") <= F.col("__row")["close"], F.col("__hit")).alias("hit"))
