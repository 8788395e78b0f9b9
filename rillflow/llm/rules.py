"""Quality rules: fixed base rules, then gradient-boosted trees with monotonic constraints.

The verdict may only fall with more symbols, more repeated words or more repeated
lines, and the trees may not reverse that: a document that fails cannot pass by
adding noise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .gbt import Forest, train
from .quality import SAMPLE_ROWS, labelled_features
from .stats import BASE, FEATURES, text_stats
from .textarrays import slabs

LEAST_WORDS = 50
MOST_REPEATED = 0.5

#: Features whose rise may only lower the verdict.
FALLING = ("symbols_per_word", "dup_lines_per_line", "repeat_words_per_word", "bangs_per_word", "pipes_per_word", "upper_per_letter")

SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, score double"


def fit(documents: DataFrame, labels: DataFrame, *, limit: int = SAMPLE_ROWS) -> Forest:
    """Trains the constrained trees on at most ``limit`` labelled rows outside the held-out fold."""
    x, y = labelled_features(documents, labels, "quality", limit)
    return train(x, y, monotone={FEATURES.index(name): -1 for name in FALLING})


def judge(documents: DataFrame, forest: Forest, *, threshold: float = 0.3) -> DataFrame:
    """Counts, base rules and verdict of every document in one map over whole texts.

    ``base_failed``: under 50 words, or more than half of the words in repeated 3-word
    windows.  ``kept``: not base_failed and score >= threshold.  A null or empty text
    has no words and so fails; repeated rows are judged alike; an empty table gives an
    empty result; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slabs(b.column("text")):
                base, x = text_stats(s)
                failed = (base["n_words"] < LEAST_WORDS) | (base["n_repeat_words"] > MOST_REPEATED * base["n_words"])
                score = forest.score(x)
                columns = [base[k] for k in BASE] + [failed, ~failed & (score >= threshold), score]
                ids = b.column("doc_id").slice(s.first, s.n)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(np.ascontiguousarray(c)) for c in columns)], ["doc_id", *BASE, "base_failed", "kept", "score"])

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)


def quality_rules(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``judge`` with trees trained on ``labels``."""
    return judge(documents, fit(documents, labels))
