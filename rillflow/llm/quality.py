"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gbt import Forest, train
from .labelled import is_held_out, sample
from .stats import FEATURES, text_stats
from .textarrays import slabs

#: Bound of the labelled rows that training sees: 40,000 x 20 doubles are 6.4 MB on the driver.
SAMPLE_ROWS = 40_000


def features(column: pa.Array) -> np.ndarray:
    """The FEATURES matrix of a batch of texts."""
    return np.concatenate([text_stats(s)[1] for s in slabs(column)] or [np.zeros((0, len(FEATURES)))])


def labelled_features(documents: DataFrame, labels: DataFrame, label: str, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the bounded sample, in id order; only these numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column("text"))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(FEATURES)), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), flat], ["doc_id", "label", "x"])

    rows = sample(documents, labels, label, limit).select(F.col("doc_id").cast("string").alias("doc_id"), "text", "label").mapInArrow(run, "doc_id string, label double, x array<double>").toArrow().sort_by("doc_id")
    x = rows.column("x").combine_chunks()
    x = (pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x).flatten().to_numpy()
    return x.reshape(-1, len(FEATURES)), rows.column("label").to_numpy()


def fit(documents: DataFrame, labels: DataFrame, *, label: str = "quality", limit: int = SAMPLE_ROWS) -> Forest:
    """Trains on at most ``limit`` labelled rows outside the held-out fold."""
    x, y = labelled_features(documents, labels, label, limit)
    return train(x, y)


def classify(documents: DataFrame, forest: Forest, *, threshold: float = 0.3) -> DataFrame:
    """``documents`` with ``score`` (0 to 1, higher: better) and ``predicted`` (1 if score >= threshold).

    One map over whole texts, no shuffle.  A null text is scored as an empty one;
    repeated rows are scored alike; an empty table gives an empty result.  Other
    columns pass through, except that columns named score or predicted are replaced.
    """
    kept = documents.drop("score", "predicted")
    schema = kept.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema
    for f in schema:
        f.nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = forest.score(features(b.column("text")))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*b.schema.names, "score", "predicted"]
            )

    return kept.mapInArrow(run, schema)


def quality_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = classify(documents.select("doc_id", "text"), fit(documents, labels))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
