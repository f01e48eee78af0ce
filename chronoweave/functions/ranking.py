"""The best rows of each group, without a task for a large group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: parts in which a group is ranked before its best are ranked together
SALTS = 32


def best(rows: DataFrame, keys: list[str], order: list[Column], k: int, spread: str) -> DataFrame:
    """The first k rows of each group of keys in a total order.

    A group is ranked in SALTS parts by the hash of column ``spread``, and what
    is among the first k of its part is ranked again, so a group of any size
    costs its last task SALTS * k rows.
    """
    part, rank = "__part", "__rank"
    out = rows.withColumn(part, F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    for by in ([*keys, part], keys):
        out = out.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)
    return out.drop(part, rank)
