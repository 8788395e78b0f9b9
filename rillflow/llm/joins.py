"""Joins whose left side may hold a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many keys can be hot: one must have a larger share of all rows than 1 / MOST_HOT.
MOST_HOT = 20_000
#: Rows of one key that any task can take.
LEAST_ROWS = 4096
SALTS = 32


def hot_keys(rows: DataFrame, key: str) -> DataFrame | None:
    """The keys of more than ``LEAST_ROWS`` rows and more than one in ``MOST_HOT`` of all; their number is under ``MOST_HOT`` by that.

    None if there are too few rows for a hot key.
    """
    n = rows.count()
    if n <= LEAST_ROWS:
        return None
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > max(LEAST_ROWS, n // MOST_HOT)).select(key)


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None, *, spread: str, how: str = "inner") -> DataFrame:
    """Join (inner or left) on ``key``, unique in ``right``; rows of hot keys are dealt out by a hash of ``spread`` to ``SALTS`` copies of the right row.

    ``hot``: ``hot_keys(left, key)``, or those of any table that has the left rows' keys
    as often.  The list (fewer than ``MOST_HOT`` keys) is broadcast.
    """
    if hot is None:
        return left.join(right, key, how)
    hot = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = left.join(hot, key, "left").withColumn("_salt", salt).drop("_hot")
    copies = right.join(hot, key, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return dealt.join(copies, [key, "_salt"], how).drop("_salt")
