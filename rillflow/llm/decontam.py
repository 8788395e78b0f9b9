"""Benchmark decontamination by latent semantic retrieval.

1. One pass over all texts counts in how many passages (``PASSAGE`` words) each hashed
   word occurs.
2. A randomised SVD of the TF-IDF matrix of all passages and at most ``BASIS_ITEMS`` items
   gives a latent basis for these, so that the share of an item that the basis holds
   doesn't fall with the number of items: a second pass over all texts multiplies the passages
   with the range finder, blocks of the product are summed by Spark, and only a features x rank
   matrix of fixed size reaches the driver, where each block of items is added to it.
3. A third pass projects every window of every text into each basis, windows being sized
   to the items, and takes the items whose cosine passes ``COSINE`` of the item's norm in the basis as candidates.  A candidate is confirmed on the words themselves:
   by a longest common subsequence that covers most of the item, or, for paraphrases, by
   a shorter one together with the item's answer words (its rarest ones).

No pass shuffles texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import IS_SPACE_OR_MARK, Slab, as_array, find_words, hash_words, mix64, slabs

FEATURES = 1 << 14
RANK = 128
PASSAGE = 16
#: All passages together weigh in the basis as so many, if there are more.
CORPUS_WEIGHT = 8192
#: Weight of an item's row in the basis against that of one of ``CORPUS_WEIGHT`` passages.
ITEM_WEIGHT = 3.0
#: Least cosine of a window that holds an item, as a share of the item's norm inside the basis.
COSINE = 0.3
#: Items of fewer words need less: a window of the smallest size holds much else.
SHORT_ITEM = 5
#: Items that share a basis.
BASIS_ITEMS = 200
#: Items searched for in one pass over the texts.
ITEM_BLOCK = 2000
#: Bytes of items that one pass searches for, and so a bound of what is broadcast besides the bases.
ITEM_BYTES = 8 << 20
SLAB = 256 << 10

COPY_SHARE = 0.75
PARAPHRASE_SHARE = 0.5
ANSWER_WORDS = 6
ANSWER_SHARE = 0.8


@dataclass(frozen=True)
class Items:
    """Benchmark items: ids, word hashes, and, once there is a basis, their unit latent vectors."""

    ids: list[int]
    words: list[np.ndarray]


def _lower_slabs(column: pa.Array) -> Iterator[Slab]:
    return slabs(pc.utf8_lower(as_array(column)), SLAB)


def _word_hashes(slab: Slab) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word without ASCII punctuation, and the bounds of each text's words."""
    words = find_words(slab, IS_SPACE_OR_MARK)
    return hash_words(slab.data, words.begin, words.end), words.first


def _feature(word: np.ndarray) -> np.ndarray:
    return (word % np.uint64(FEATURES)).astype(np.int32)


def _passages(first: np.ndarray, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """(begin, text) of the passages of ``size`` words, the last of a text maybe shorter."""
    count = -(-np.diff(first) // size)
    text = np.repeat(np.arange(len(count)), count)
    return first[text] + size * (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)), text


def _owned(feature: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """feature * passages + passage of each word: numbers that sort by feature, then passage."""
    n = len(begin)
    owner = np.repeat(np.arange(n), np.diff(begin, append=len(feature)))
    return (feature.astype(np.int64) * n + owner).astype(np.int32 if n * FEATURES < 1 << 31 else np.int64)


def read_items(benchmark: DataFrame) -> Iterator[Items]:
    """The stated query set, in blocks by a hash of the item: some ``ITEM_BLOCK`` items and ``ITEM_BYTES`` of text each.

    Items without words are left out; of items with one id each counts.  Only one block
    at a time is on the driver.
    """
    known = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    n, size = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // ITEM_BLOCK), -(-size // ITEM_BYTES))
    for k in range(blocks):
        part = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else known
        table = part.orderBy("item_id", "text").toArrow()
        ids, words = [], []
        for s in _lower_slabs(table.column("text")):
            h, first = _word_hashes(s)
            for i in range(s.n):
                if first[i + 1] > first[i]:
                    ids.append(table.column("item_id")[s.first + i].as_py())
                    words.append(h[first[i] : first[i + 1]])
        if ids:
            yield Items(ids, words)


def corpus_statistics(documents: DataFrame) -> tuple[np.ndarray, int]:
    """Weight of each feature (a smoothed log of passages by passages with it), and the number of passages.

    Passages that end with their text may be shorter and count alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total = np.zeros(FEATURES, np.int64), 0
        for b in batches:
            for s in _lower_slabs(b.column("text")):
                h, first = _word_hashes(s)
                begin, _ = _passages(first)
                if not len(begin):
                    continue
                word = np.sort(_owned(_feature(h), begin))
                df += np.bincount(word[np.flatnonzero(np.diff(word, prepend=-1))] // len(begin), minlength=FEATURES)
                total += len(begin)
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[found, FEATURES]), pa.array(np.r_[df[found], total])], ["key", "n"])

    counts = documents.select("text").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(FEATURES + 1)
    df[counts["key"].to_numpy(np.int64)] = counts["n"]
    return np.log((1 + df[-1]) / (1 + df[:-1])).astype(np.float32), int(df[-1])


def range_finder() -> np.ndarray:
    return np.random.default_rng(3).normal(size=(FEATURES, RANK)).astype(np.float32)


def corpus_product(documents: DataFrame, weight: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A^T A start, where A has a unit row of weighted features for every passage of all texts.

    At most 256 tasks send blocks of their sums, so that what is summed for a block is bounded.
    """
    block, piece = 512, 16
    shared = documents.sparkSession.sparkContext.broadcast((weight, start * weight[:, None]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, table = shared.value
        total = np.zeros(table.shape)
        for b in batches:
            for s in _lower_slabs(b.column("text")):
                h, first = _word_hashes(s)
                begin, _ = _passages(first)
                if not len(begin):
                    continue
                n, feature = len(begin), _feature(h)
                # words by feature, then passage
                word = np.sort(_owned(feature, begin))
                f, p = np.divmod(word, n)
                pair = np.flatnonzero(np.diff(word, prepend=-1))
                energy = np.bincount(p[pair], (np.diff(pair, append=len(word)) * weight[f[pair]]) ** 2.0, minlength=n)
                row = _sums(table, feature, begin) / np.maximum(energy, 1e-9).astype(np.float32)[:, None]
                # sums of the rows of a feature's words, which are cut into pieces as some words are very frequent
                at = np.flatnonzero(np.diff(f, prepend=-1))
                place = np.arange(len(f)) - np.repeat(at, np.diff(at, append=len(f)))
                cut = np.flatnonzero(place % piece == 0)
                part, to, turn = _sums(row, p, cut), f[cut], place[cut] // piece
                order = np.argsort(turn, kind="stable")
                for some in np.split(order, np.cumsum(np.bincount(turn))[:-1]):
                    total[to[some]] += part[some]
        total *= weight[:, None]
        used = [i for i in range(0, FEATURES, block) if total[i : i + block].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([total[i : i + block].astype(np.float32).tobytes() for i in used], pa.binary())], ["block", "part"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        parts = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in group["part"])
        return pd.DataFrame({"block": group["block"][:1], "part": [parts.astype(np.float32).tobytes()]})

    out = np.zeros(start.shape)
    for r in documents.select("text").coalesce(256).mapInArrow(run, "block int, part binary").groupBy("block").applyInPandas(add, "block int, part binary").collect():
        out[r["block"] : r["block"] + block] = np.frombuffer(r["part"], np.float32).reshape(-1, start.shape[1])
    return out


def latent_basis(items: list[np.ndarray], weight: np.ndarray, start: np.ndarray, product: np.ndarray, passages: int) -> np.ndarray:
    """Orthonormal columns (FEATURES x rank) that span what the range finder finds of the corpus's ``product`` and the items' rows."""
    total = product * min(1.0, CORPUS_WEIGHT / max(1, passages))
    for words in items:
        f, times = np.unique(_feature(words), return_counts=True)
        value = times * weight[f].astype(np.float64)
        value *= ITEM_WEIGHT / max(1e-9, float(np.linalg.norm(value)))
        total[f] += value[:, None] * (value @ start[f])
    basis, values, _ = np.linalg.svd(total, full_matrices=False)
    # rows are taken from it, which is slow on columns laid out one after another
    return np.ascontiguousarray(basis[:, values > 1e-5 * max(values.max(), 1e-12)], np.float32)


def common_subsequence(masks: dict[int, int], m: int, text: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows; ``masks``: positions of each word in the item."""
    full = (1 << m) - 1
    row = full
    for word in text:
        hit = masks.get(word)
        if hit is not None:
            u = row & hit
            row = ((row + u) | (row - u)) & full
    return m - row.bit_count()


def masks_and_answers(words: np.ndarray, weight: np.ndarray) -> tuple[dict[int, int], frozenset[int]]:
    """Positions of each word of an item as bits, and its rarest words."""
    mask: dict[int, int] = {}
    for i, x in enumerate(words.tolist()):
        mask[x] = mask.get(x, 0) | 1 << i
    rare = sorted(mask, key=lambda x: (-weight[int(x % FEATURES)], x))
    return mask, frozenset(rare[:ANSWER_WORDS])


def is_held(masks: dict[int, int], answers: frozenset[int], m: int, text: list[int]) -> bool:
    """Whether a stretch of words holds an item of ``m`` words, verbatim or paraphrased."""
    common = common_subsequence(masks, m, text)
    return common >= COPY_SHARE * m or common >= PARAPHRASE_SHARE * m and len(answers.intersection(text)) >= ANSWER_SHARE * len(answers)


def _held_bits(words: list[np.ndarray]) -> np.ndarray:
    """A bitmap of the words of each item by ``_held_at``: some 64 places a word, so that few others seem to be there."""
    size = 1 << 20
    while size < 64 * sum(map(len, words)):
        size *= 2
    bits = np.zeros(size, bool)
    for k, w in enumerate(words):
        bits[_held_at(w, np.full(len(w), k), size)] = True
    return bits


def _held_at(word: np.ndarray, item: np.ndarray, size: int) -> np.ndarray:
    return ((word ^ mix64(item.astype(np.uint64) + np.uint64(1))) & np.uint64(size - 1)).astype(np.int64)


def _words_held(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, item: np.ndarray, bits: np.ndarray, step: int = 4096) -> np.ndarray:
    """At least how many of the words h[lo:hi] are words of ``item``: no common subsequence is longer.

    A few other words may be counted, too.
    """
    out = np.zeros(len(lo), np.int64)
    low, salt = (h & np.uint64(len(bits) - 1)).astype(np.int64), _held_at(np.zeros(len(item), np.uint64), item, len(bits))
    for i in range(0, len(lo), step):
        n = hi[i : i + step] - lo[i : i + step]
        end = np.cumsum(n)
        at = np.arange(int(n.sum())) + np.repeat(lo[i : i + step] - end + n, n)
        hits = np.r_[0, np.cumsum(bits[low[at] ^ np.repeat(salt[i : i + step], n)])]
        out[i : i + step] = hits[end] - hits[end - n]
    return out


def _answer_bits(answers: Sequence[frozenset[int]]) -> np.ndarray:
    """By ``_held_at`` the answer words of each item, each with a bit of its own; other words may have some of these bits, too."""
    size = 1 << 16
    while size < 64 * sum(map(len, answers)):
        size *= 2
    bits = np.zeros(size, np.uint8)
    for k, some in enumerate(answers):
        at = _held_at(np.fromiter(some, np.uint64, len(some)), np.full(len(some), k), size)
        np.bitwise_or.at(bits, at, np.uint8(1) << np.arange(len(some), dtype=np.uint8))
    return bits


def _answers_seen(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, item: np.ndarray, bits: np.ndarray, step: int = 4096) -> np.ndarray:
    """At least how many answer words of ``item`` are among the words h[lo:hi], which are one or more."""
    out = np.zeros(len(lo), np.int64)
    for i in range(0, len(lo), step):
        n = hi[i : i + step] - lo[i : i + step]
        begin = np.cumsum(n) - n
        at = np.arange(int(n.sum())) + np.repeat(lo[i : i + step] - begin, n)
        out[i : i + step] = np.bitwise_count(np.bitwise_or.reduceat(bits[_held_at(h[at], np.repeat(item[i : i + step], n), len(bits))], begin))
    return out


def _masks_of_words(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of the words of each item of at most 64 words, and the bits of their positions in it."""
    short = [k for k, w in enumerate(words) if len(w) <= 64]
    word = np.concatenate([np.empty(0, np.uint64), *(words[k] for k in short)])
    item = np.repeat(short, [len(words[k]) for k in short]).astype(np.uint64)
    place = np.concatenate([np.empty(0, np.uint64), *(np.arange(len(words[k]), dtype=np.uint64) for k in short)])
    keys, at = np.unique(word ^ mix64(item + np.uint64(1)), return_inverse=True)
    masks = np.zeros(len(keys), np.uint64)
    np.bitwise_or.at(masks, at, np.uint64(1) << place)
    return keys, masks


def _common_lengths(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, item: np.ndarray, size: np.ndarray, bits: np.ndarray, words: tuple[np.ndarray, np.ndarray], step: int = 1024) -> np.ndarray:
    """``common_subsequence`` of each h[lo:hi] and an item of at most 64 words, ``size`` of them; the candidates go on side by side.

    Never less; more only where two items' words have one 64-bit key.
    """
    keys, masks = words
    out = np.zeros(len(lo), np.int64)
    salt = mix64(item.astype(np.uint64) + np.uint64(1))
    for i in range(0, len(lo), step):
        n = hi[i : i + step] - lo[i : i + step]
        at = np.arange(int(n.sum())) + np.repeat(lo[i : i + step] - np.cumsum(n) + n, n)
        owner = np.repeat(np.arange(len(n)), n)
        key = h[at] ^ salt[i : i + step][owner]
        some = np.flatnonzero(bits[(key & np.uint64(len(bits) - 1)).astype(np.int64)])
        key, owner = key[some], owner[some]
        found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        true = np.flatnonzero(keys[found] == key)
        found, owner = found[true], owner[true]
        count = np.bincount(owner, minlength=len(n))
        hits = np.zeros((int(count.max()), len(n)), np.uint64)
        hits[np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count), owner] = masks[found]
        row = full = ~np.uint64(0) >> (np.uint64(64) - size[i : i + step].astype(np.uint64))
        for hit in hits:
            u = row & hit
            row = ((row + u) | (row ^ u)) & full
        out[i : i + step] = size[i : i + step] - np.bitwise_count(row)
    return out


def _sums(table: np.ndarray, row: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of the table's rows ``row[begin[i] : begin[i + 1]]`` for each i, by pieces that fit the CPU's cache."""
    count = np.diff(begin, append=len(row))
    order = np.argsort(-count, kind="stable")
    at, count, step = begin[order], count[order], 256
    total, rows = np.zeros((len(begin), table.shape[1]), table.dtype), np.empty((step, table.shape[1]), table.dtype)
    for i in range(0, len(begin), step):
        for k in range(int(count[i])):
            n = int((count[i : i + step] > k).sum())
            total[i : i + n] += np.take(table, row[at[i : i + n] + k], axis=0, out=rows[:n], mode="clip")
    out = np.empty_like(total)
    out[order] = total
    return out


def _passage_size(m: int) -> int:
    """Words of half a window in which an item of ``m`` words is searched: 4 (up to 12 words), 16 (up to 80), 64 (up to 320) and so on."""
    size = 4 if m <= 12 else PASSAGE
    while m > 5 * size and size > 4:
        size *= 4
    return size


def _queries(words: list[np.ndarray], basis: np.ndarray, weight: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Unit latent vectors of items as columns, and the least cosine of each: ``cosine`` of its norm inside the basis.

    An item that the basis doesn't hold at all has the bound 0, which every window passes.
    """
    latent, least = np.empty((basis.shape[1], len(words)), np.float32), np.empty(len(words), np.float32)
    for k, w in enumerate(words):
        f, times = np.unique(_feature(w), return_counts=True)
        value = times * weight[f]
        inside = value @ basis[f]
        size = np.linalg.norm(inside)
        latent[:, k] = inside / max(1e-9, size)
        least[k] = cosine * min(1.0, len(w) / SHORT_ITEM) ** 2 * size / max(1e-9, np.linalg.norm(value))
    return latent, least


def _search(documents: DataFrame, items: Items, bases: list[tuple[int, np.ndarray]], weight: np.ndarray, cosine: float) -> DataFrame:
    """``bases``: number of the first item of each block, and the block's basis."""
    blocks: dict[int, list] = {}
    for (i, basis), end in zip(bases, [*(b[0] for b in bases[1:]), len(items.ids)], strict=True):
        table, sizes = basis * weight[:, None], np.array([_passage_size(len(w)) for w in items.words[i:end]])
        for size in np.unique(sizes).tolist():
            number = i + np.flatnonzero(sizes == size)
            blocks.setdefault(size, []).append((number, table, *_queries([items.words[k] for k in number], basis, weight, cosine)))
    masks, answers = zip(*(masks_and_answers(w, weight) for w in items.words), strict=True)
    held = _held_bits(items.words), _answer_bits(answers), _masks_of_words(items.words)
    least_answers = np.array([ANSWER_SHARE * len(a) for a in answers])
    shared = documents.sparkSession.sparkContext.broadcast((blocks, weight * weight, masks, answers, np.array([len(w) for w in items.words]), items.ids, held, least_answers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, square, masks, answers, sizes, ids, (held, answer_bits, word_masks), least_answers = shared.value
        for b in batches:
            for s in _lower_slabs(b.column("text")):
                h, first = _word_hashes(s)
                found: dict[int, set[int]] = {}
                feature = _feature(h)
                for size, probes in blocks.items() if len(h) else ():
                    begin, text = _passages(first, size)
                    energy = np.add.reduceat(square[feature], begin)
                    joined = np.flatnonzero(text[1:] == text[:-1])
                    single = np.flatnonzero(np.bincount(text, minlength=s.n)[text] == 1)
                    at = np.concatenate([joined, single])
                    norm = np.sqrt(np.maximum(np.concatenate([energy[joined] + energy[joined + 1], energy[single]]), 1e-9))[:, None]
                    for number, table, latent, cosines in probes:
                        part = _sums(table, feature, begin)
                        w, item = np.nonzero(np.concatenate([part[joined] + part[joined + 1], part[single]]) / norm @ latent >= cosines)
                        item, t = number[item], text[at[w]]
                        lo = np.maximum(first[t], begin[at[w]] - sizes[item])
                        hi = np.minimum(first[t + 1], begin[at[w]] + 2 * size + sizes[item])
                        # is_held implies what is asked for first, by many candidates at once
                        known = _words_held(h, lo, hi, item, held)
                        some = np.flatnonzero(known >= PARAPHRASE_SHARE * sizes[item])
                        seen = np.zeros(len(item), bool)
                        seen[some] = _answers_seen(h, lo[some], hi[some], item[some], answer_bits) >= least_answers[item[some]]
                        least = np.where(seen, PARAPHRASE_SHARE, COPY_SHARE) * sizes[item]
                        some = some[known[some] >= least[some]]
                        short = some[sizes[item[some]] <= 64]
                        known[short] = _common_lengths(h, lo[short], hi[short], item[short], sizes[item[short]], held, word_masks)
                        some = some[known[some] >= least[some]]
                        for t, k, lo, hi in zip(t[some].tolist(), item[some].tolist(), lo[some].tolist(), hi[some].tolist(), strict=True):
                            if ids[k] not in found.get(t, ()) and is_held(masks[k], answers[k], int(sizes[k]), h[lo:hi].tolist()):
                                found.setdefault(t, set()).add(ids[k])
                lists = [sorted(found.get(i, ())) for i in range(s.n)]
                yield pa.RecordBatch.from_arrays([*(c.slice(s.first, s.n) for c in b.columns), pa.array(lists, pa.list_(pa.int64()))], [*b.schema.names, "items"])

    schema = documents.select("*", F.array(F.lit(0).cast("bigint")).alias("items")).schema
    for f in schema:
        f.nullable = True
    return documents.mapInArrow(run, schema)


def find_items(documents: DataFrame, benchmark: DataFrame, *, cosine: float = COSINE) -> DataFrame:
    """``documents`` with ``items``: sorted ids of the benchmark items that each text holds, verbatim or paraphrased.

    A null or empty text holds none, and an item without words is held by none; with an
    empty benchmark all lists are empty.  Whole texts count at any length.  Repeated rows
    are searched alike.  A column named items is replaced, others pass through.
    """
    documents = documents.drop("items")
    out, fitted, parts = documents, None, []
    for block in read_items(benchmark):
        if fitted is None:
            (weight, passages), start = corpus_statistics(documents), range_finder()
            fitted = weight, start, corpus_product(documents, weight, start), passages
        # blocks of even size
        cuts = np.linspace(0, len(block.ids), -(-len(block.ids) // BASIS_ITEMS) + 1).astype(int).tolist()
        bases = [(a, latent_basis(block.words[a:b], *fitted)) for a, b in pairwise(cuts)]
        parts.append(f"_items_{len(parts)}")
        out = _search(out, block, bases, weight, cosine).withColumnRenamed("items", parts[-1])
    if not parts:
        return documents.withColumn("items", F.array().cast("array<bigint>"))
    return out.withColumn("items", F.array_sort(F.array_distinct(F.concat(*parts)))).drop(*parts)


def contamination_report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items and items of every document."""
    found = find_items(documents.select("doc_id", "text"), benchmark)
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("bigint").alias("n_items"), "items")


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` without those that hold a benchmark item."""
    return find_items(documents, benchmark).where(F.size("items") == 0).select(*documents.columns)
