"""Labelled training rows: which are held out, and a bounded sample of the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is divisible by 5 (null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(documents: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """At most ``limit`` labelled rows that aren't held out, with their texts: (text, label).

    Rows are taken in the order of a hash of the id, so the choice depends on neither
    partitions nor the size of the table.  Only hashes below a bound that some twice
    ``limit`` rows pass are sorted, so that no task sends a full ``limit`` of its own to
    the driver.  The id list has at most ``limit`` rows of 16 bytes, which bounds the
    broadcast.  Null ids and labels are left out.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("double").alias("label"))
    known = known.where(F.col("_id").isNotNull() & F.col("label").isin(0.0, 1.0) & ~is_held_out(F.col("_id")))
    share = min(1.0, (2 * limit + 100) / max(1, known.count()))
    below = F.xxhash64("_id") <= F.lit(min(2**63 - 1, -(2**63) + int(share * 2**64)))
    chosen = known.where(below).dropDuplicates(["_id"]).orderBy(F.xxhash64("_id"), "_id").limit(limit)
    return documents.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "label")
