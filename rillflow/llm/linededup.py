"""Line dedup by distinct-site spread, DataFrame functions only.

A line that occurs on at least ``min_sites`` distinct sites is cross-site
boilerplate.  HyperLogLog sketches of the sites, one per line hash, merge by
aggregation; lines whose estimate is near the threshold get exact distinct counts.
Of each boilerplate line the first occurrence (smallest doc_id, then position) stays,
so that no content leaves the corpus; all others go.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import store

MIN_SITES = 10
LG_K = 12
#: Half-width of the band around the threshold that is counted exactly, as a share of it: over ten standard errors of the sketch.
BAND = 0.2


def _lines(documents: DataFrame, *more: str) -> DataFrame:
    """A row per line with a visible character: (doc, pos, line), the line as two 64-bit hashes of different seeds."""
    return (
        documents.select("doc_id", F.xxhash64("text").alias("text_hash"), *more, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .withColumn("line", _key(F.col("line")))
        .where(F.col("line") != "")
        .withColumn("line", F.struct(F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b")))
    )


def _key(line: Column) -> Column:
    """A line without spaces, tabs and carriage returns at its ends."""
    return F.btrim(line, F.lit(" \t\r"))


def boilerplate(documents: DataFrame, *, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(line, first_doc, first_pos): hashes of lines on at least ``min_sites`` distinct non-null sites."""
    low, high = math.floor(min_sites * (1 - BAND)), math.ceil(min_sites * (1 + BAND))
    lines = _lines(documents, site)
    spread = store(
        lines.groupBy("line")
        .agg(F.hll_sketch_agg(F.col(site).cast("string"), F.lit(LG_K)).alias("sites"), F.min(F.struct("doc_id", "pos")).alias("first"))
        .select("line", F.hll_sketch_estimate("sites").alias("sites"), F.col("first.doc_id").alias("first_doc"), F.col("first.pos").alias("first_pos"))
        .where(F.col("sites") >= low),
        "line-spread",
    )
    near = spread.where(F.col("sites") <= high)
    exact = lines.select("line", site).join(near.select("line"), "line", "left_semi").groupBy("line", site).agg(F.lit(1).alias("one")).groupBy("line").agg(F.count(site).alias("sites")).where(F.col("sites") >= min_sites)
    sure = spread.where(F.col("sites") > high)
    return sure.drop("sites").unionByName(near.drop("sites").join(exact.select("line"), "line", "left_semi"))


def remove_boilerplate(documents: DataFrame, *, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``documents`` with cross-site boilerplate lines removed from ``text``, and ``n_lines`` and ``n_removed``.

    Lines are compared without spaces, tabs and carriage returns at their ends; blank
    lines are never boilerplate and are not counted.  A null site counts for no site.
    A null text stays null with 0 lines; repeated rows (same id and text) are one
    document; an empty table gives an empty result.  Whole texts and lines count at any
    length.  Columns named n_lines or n_removed are replaced, others pass through.
    """
    found = store(boilerplate(documents, site=site, min_sites=min_sites), "boilerplate")
    bad = (
        _lines(documents)
        .join(found, "line")
        .where(~(F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("pos") == F.col("first_pos"))))
        .groupBy(F.col("doc_id").alias("bad_doc"), F.col("text_hash").alias("bad_text"))
        .agg(F.collect_set("pos").alias("bad"))
    )
    d = documents.drop("n_lines", "n_removed")
    joined = d.join(bad, d.doc_id.eqNullSafe(bad.bad_doc) & (F.xxhash64(d.text) == bad.bad_text), "left")
    all_lines = F.split("text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("bad"))
    text = F.when(F.col("bad").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at(all_lines, i + 1)), "\n"))
    n_lines = F.coalesce(F.size(F.filter(all_lines, lambda x: _key(x) != "")), F.lit(0))
    return joined.select(
        *(text.alias("text") if c == "text" else F.col(f"`{c}`") for c in d.columns),
        F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("bigint").alias("n_lines"),
        F.when(F.col("bad").isNull(), 0).otherwise(F.size("bad")).cast("bigint").alias("n_removed"),
    )


def line_report(documents: DataFrame, *, min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, n_lines, n_removed and the digest of the text that is left (null: of the empty text)."""
    out = remove_boilerplate(documents.select("doc_id", "text", "source"), min_sites=min_sites)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = f"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS key FROM l
), b AS (
  SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT source) >= {MIN_SITES}
), m AS (
  SELECT k.*, b.key IS NOT NULL AND row_number() OVER (PARTITION BY k.key ORDER BY doc_id, pos) > 1 AS gone
  FROM k LEFT JOIN b ON k.key = b.key
), r AS (
  SELECT doc_id, count(*) FILTER (key <> '') AS n_lines, count(*) FILTER (gone) AS n_removed,
         string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS kept
  FROM m GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id
"""
