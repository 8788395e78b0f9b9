"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the embeddings of its subwords: the word itself and its
character n-grams of 3 to 5, each marked if it touches the word's begin or end.  A
document's vector is the mean of its words' vectors.  Unseen misspellings and unseen
words of a known family share n-grams with known ones, and a subword never seen in
training has the zero vector.  Embeddings and softmax are fitted together under a
penalty on the length of each embedding.  The softmax is linear, so scoring needs one
number per subword bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import is_held_out, sample
from .textarrays import IS_SPACE_OR_MARK, Rolling, Slab, Words, as_array, find_words, hash_words, mix64, slabs

BUCKETS = 1 << 17
DIMENSIONS = 8
SIZES = (3, 4, 5)
#: Bound of the labelled rows of each class that training sees.
SAMPLE_ROWS = 1500
#: Training documents that a subword must occur in to have an embedding.
LEAST_DOCUMENTS = 2
#: How far subwords are put on one scale: 0 leaves shares as they are, 1 gives all the same mean square.
EVEN = 0.75

_BEGIN, _END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Model:
    """``weight`` of each subword bucket: its embedding times the difference of both softmax rows."""

    weight: np.ndarray
    bias: float


def subwords(slab: Slab, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every subword of the given words, in word order."""
    roll = Rolling(slab.data)
    heads = np.flatnonzero((slab.data & 0xC0) != 0x80)  # begins of characters
    first, last = np.searchsorted(heads, begin), np.searchsorted(heads, end)
    heads = np.r_[heads, len(slab.data)]
    word, value = [np.arange(len(begin))], [mix64(roll.ranges(begin, end) + _BEGIN + _END)]
    for size in SIZES:
        count = np.maximum(last - first - size + 1, 0)
        owner = np.repeat(np.arange(len(begin)), count)
        at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + first[owner]
        h = roll.ranges(heads[at], heads[at + size]) + np.uint64(size)
        h = h + np.where(at == first[owner], _BEGIN, np.uint64(0)) + np.where(at + size == last[owner], _END, np.uint64(0))
        word.append(owner)
        value.append(mix64(h))
    word, value = np.concatenate(word), np.concatenate(value)
    order = np.argsort(word, kind="stable")
    return word[order], (value[order] % np.uint64(BUCKETS)).astype(np.int64)


def distinct_words(slab: Slab) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of a slab, an occurrence of each distinct one, and the distinct word of each."""
    words = find_words(slab, IS_SPACE_OR_MARK)
    _, one, kind = np.unique(hash_words(slab.data, words.begin, words.end), return_index=True, return_inverse=True)
    return words, one, kind


def bags(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, buckets, shares) of each text: how much each subword counts in the text's mean."""
    for s in slabs(pc.utf8_lower(as_array(column))):
        words, one, kind = distinct_words(s)
        owner, bucket = subwords(s, words.begin[one], words.end[one])
        per_word = np.bincount(owner, minlength=len(one))
        start = np.r_[0, np.cumsum(per_word)]
        for i in range(s.n):
            mine, times = np.unique(kind[words.first[i] : words.first[i + 1]], return_counts=True)
            share = times / max(1, times.sum()) / per_word[mine]
            at = np.repeat(start[mine] - np.r_[0, np.cumsum(per_word[mine])[:-1]], per_word[mine]) + np.arange(int(per_word[mine].sum()))
            keys, back = np.unique(bucket[at], return_inverse=True)
            yield s.first + i, keys.astype(np.int32), np.bincount(back, np.repeat(share, per_word[mine]), len(keys)).astype(np.float32)


def _fit_active(at: np.ndarray, share: np.ndarray, doc: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: np.ndarray, state: tuple, steps: int) -> tuple:
    """Accelerated proximal steps on the embeddings, the softmax and the bias together.

    With two classes the softmax needs one direction, the difference of its rows; of it
    and the embeddings only the product counts, so it is kept at length one.  After each
    step a subword's whole embedding shrinks by its penalty and vanishes if it is shorter.
    """
    embedding, direction, bias = state
    move, bias_move = np.zeros_like(embedding), 0.0
    n, rate = len(y), 2.0  # 1 / rate: bound of the curvature, as shares are scaled
    for step in range(steps):
        ahead, bias_ahead = embedding + step / (step + 3) * move, bias + step / (step + 3) * bias_move
        z = np.bincount(doc, (ahead @ direction)[at] * share, n) + bias_ahead
        error = weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / n
        pull = np.bincount(at, error[doc] * share, len(embedding))
        fresh = ahead - rate * pull[:, None] * direction
        length = np.sqrt((fresh * fresh).sum(1))
        fresh *= np.maximum(1 - rate * penalty / np.maximum(length, 1e-300), 0)[:, None]
        turned = direction - rate * (pull @ fresh)
        direction = turned / max(1e-12, float(np.sqrt((turned * turned).sum())))
        fresh_bias = bias_ahead - rate * float(error.sum())
        move, bias_move, embedding, bias = fresh - embedding, fresh_bias - bias, fresh, fresh_bias
    return embedding, direction, bias


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, *, shrink: float = 0.15, least: int = LEAST_DOCUMENTS, seed: int = 7) -> Model:
    """Fits the embeddings of all subwords of at least ``least`` documents and the softmax together; both classes weigh alike.

    Few subwords tell anything about the class, so embeddings are shrunk: by ``shrink``
    times the pull that would keep all of them at zero, at any number of rows.  In later
    rounds strong subwords are shrunk less, so that they aren't underrated.  Shares are
    divided by a power of their root mean square, so that rare subwords learn nearly as
    fast as common ones.  With one class only (or no rows) the score is constant.
    """
    seen = np.bincount(np.concatenate([r[0] for r in rows]), minlength=BUCKETS) if len(rows) else np.zeros(BUCKETS)
    used = np.flatnonzero(seen >= min(least, len(y)))
    if not len(y) or not len(used) or y.min() == y.max():
        p = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if len(y) else 0.5
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(p / (1 - p))))
    number = np.full(BUCKETS, -1)
    number[used] = np.arange(len(used))
    at, share = number[np.concatenate([r[0] for r in rows])], np.concatenate([r[1] for r in rows]).astype(np.float64)
    doc = np.repeat(np.arange(len(y)), [len(r[0]) for r in rows])
    at, share, doc = at[at >= 0], share[at >= 0], doc[at >= 0]
    scale = (len(y) / np.bincount(at, share**2, len(used))) ** (EVEN / 2)
    scale /= np.sqrt(((share * scale[at]) ** 2).sum() / len(y))
    share = share * scale[at]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))

    direction = np.random.default_rng(seed).normal(size=DIMENSIONS)
    direction /= np.sqrt((direction * direction).sum())
    embedding, bias = np.zeros((len(used), DIMENSIONS)), 0.0
    full = shrink * np.abs(np.bincount(at, (weight * (0.5 - y) / len(y))[doc] * share, len(used))).max()
    penalty = np.full(len(used), full)
    for steps in (60, 200, 200, 200):
        if steps > 60:  # a subword at zero stays there, which leaves a few hundred
            length = np.sqrt((embedding * embedding).sum(1))
            live = np.flatnonzero(length)
            if not len(live):
                break
            keep = length[at] > 0
            number[used] = -1
            number[used[live]] = np.arange(len(live))
            at, share, doc = number[used[at[keep]]], share[keep], doc[keep]
            used, scale, embedding, length = used[live], scale[live], embedding[live], length[live]
            penalty = full / (1 + length / np.median(length)) ** 2
        embedding, direction, bias = _fit_active(at, share, doc, y, weight, penalty, (embedding, direction, bias), steps)
    out = np.zeros(BUCKETS, np.float32)
    out[used] = (embedding @ direction) * scale
    return Model(out, float(bias))


def scores(column: pa.Array, model: Model) -> np.ndarray:
    """Probability of label 1 of each text."""
    out = [np.empty(0)]
    for s in slabs(pc.utf8_lower(as_array(column))):
        words, one, kind = distinct_words(s)
        owner, bucket = subwords(s, words.begin[one], words.end[one])
        value = np.bincount(owner, model.weight[bucket], len(one)) / np.maximum(np.bincount(owner, minlength=len(one)), 1)
        total = np.r_[0, np.cumsum(value[kind])]
        mean = (total[words.first[1:]] - total[words.first[:-1]]) / np.maximum(np.diff(words.first), 1)
        out.append(1 / (1 + np.exp(-np.clip(mean + model.bias, -30, 30))))
    return np.concatenate(out)


def fit(documents: DataFrame, labels: DataFrame, *, label: str = "toxic", limit: int = SAMPLE_ROWS) -> Model:
    """Trains on at most ``limit`` labelled rows of each class outside the held-out fold.

    Their subword bags reach the driver: eight bytes for each distinct subword of a text,
    of which there are at most ``BUCKETS``, so 1 MB a text at the very most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, keys, share in bags(b.column("text")):
                one = lambda x: pa.array([x])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, 1), b.column("label").slice(i, 1), one(keys), one(share)], ["doc_id", "label", "keys", "share"])

    parts = [sample(documents, labels.where(F.col(label) == k), label, limit) for k in (0, 1)]
    chosen = parts[0].unionByName(parts[1]).select(F.col("doc_id").cast("string").alias("doc_id"), "text", "label")
    table = chosen.mapInArrow(run, "doc_id string, label double, keys array<int>, share array<float>").toArrow().sort_by("doc_id")
    rows = [(k.values.to_numpy(), w.values.to_numpy()) for k, w in zip(table.column("keys"), table.column("share"), strict=True)]
    return train(rows, table.column("label").to_numpy())


def classify(documents: DataFrame, model: Model, *, threshold: float = 0.5) -> DataFrame:
    """``documents`` with ``score`` (0 to 1, higher: more toxic) and ``predicted`` (1 if score >= threshold).

    One map over whole texts, no shuffle; the model's half megabyte is broadcast.  A null
    text, or one without words, has the score of the bias alone; repeated rows score
    alike; an empty table gives an empty result.  Columns named score or predicted are
    replaced, others pass through.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kept = documents.drop("score", "predicted")
    schema = kept.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema
    for f in schema:
        f.nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = scores(b.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*b.schema.names, "score", "predicted"])

    return kept.mapInArrow(run, schema)


def toxicity_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = classify(documents.select("doc_id", "text"), fit(documents, labels))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
