"""A training corpus from raw documents, in five stages over whole tables.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again
as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm import bpe, decontam, linededup, neardup, quality
from rillflow.llm.queries import VOCABULARY, table
from rillflow.llm.scratch import store


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects.

    A null text is scored as an empty one, any text whole; repeated rows have one verdict.
    Without labels the score is constant and all documents stay.  An empty table stays
    empty.  Columns named score or predicted can't be among those of ``docs``.
    """
    scored = quality.classify(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.where(F.col("predicted") == 1).select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes cross-site boilerplate lines; a document that had nothing else goes, as its lines stay elsewhere.

    ``n_chars`` follows the text.  A null text has no lines and stays, as does an empty
    one; a null source is no site; ties go to the smallest id, so the first document with
    a line keeps it; repeated rows are cut alike; an empty table stays empty.
    """
    out = linededup.remove_boilerplate(docs).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group (five-word shingles, similarity 0.8), that with the smallest id.

    Texts without words and rows without an id are in no group and stay.  Of repeated rows
    (same id and text) one stays; only rows whose id repeats are compared by text.  An
    empty table stays empty.
    """
    found = neardup.near_duplicates(docs).where("kept")
    kept = store(found.groupBy(F.col("doc_id").alias("kept_id")).agg(F.count(F.lit(1)).alias("_rows")), "kept-documents")
    rows = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")))
    once = F.col("doc_id").isNull() | (F.col("_rows") == 1)
    return rows.where(once).select(*docs.columns).unionByName(rows.where(~once).select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, verbatim or paraphrased.

    A null or empty text holds none; without items all documents stay; repeated rows have
    one verdict; an empty table stays empty.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and the digest of the text decoded from them; a null or empty text has no ids."""
    vocabulary = bpe.read_vocabulary(VOCABULARY)
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), vocabulary, digest=True)
    return encoded.select("doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256")


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_boilerplate),
    ("near dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: Trained models and the tokenizer are beyond SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = store(docs, f"pipeline-{i}")
    return docs
