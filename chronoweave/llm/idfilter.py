"""A bitmap of ids of bounded size, for leaving out most rows where texts are read.

It lets every listed id pass and some others; an exact join follows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 24


def bitmap(ids: DataFrame, column: str) -> np.ndarray:
    """64-bit words of the bitmap: at most BITS / 64 rows come to the driver, whatever the number of ids."""
    spot = ids.select(F.pmod(F.col(column), F.lit(BITS)).alias("spot"))
    rows = spot.selectExpr("spot div 64 AS w", "shiftleft(1L, cast(spot % 64 AS int)) AS b").groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    words = np.zeros(BITS // 64, np.int64)
    words[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64)
    return words


def passes(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    spot = np.mod(ids, BITS)
    return (words[spot // 64] >> (spot % 64) & 1).astype(bool)
