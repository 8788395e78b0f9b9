"""Suffix-array dedup: removes bytes covered by strings of ``length`` bytes that start more than once.

1. Anchors.  In every window of ``length`` bytes the half-length string of smallest hash
   (leftmost if tied) is the window's anchor.  Equal windows have equal anchors at equal
   offsets, so only windows around an anchor that occurs twice can repeat.  Neighbouring
   windows share an anchor; one row stands for such a stretch, with a hash of the anchor
   and one of the whole stretch.
2. Stretches that occur twice as a whole repeat in every window.  Of the others, those
   whose anchor occurs twice are open.
3. Only the windows of open stretches, and of one copy of each stretch with the same
   anchor, become suffixes: two 64-bit tokens (first and second half) and a position.
   Sampled splitters range-partition them by leading tokens, positions breaking ties, so
   that equal suffixes can fill many buckets.  Each bucket sorts by multikey quicksort and
   marks equal neighbours; the first and last run of each bucket are compared across
   boundaries by a small aggregation.

Nothing is capped: anchors and counts cover all bytes of all texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import remove, store
from .textarrays import Rolling, Slab, mix64, sliding_min, slabs

LENGTH = 400
#: Suffixes that a bucket holds on average.
BUCKET_ROWS = 400_000

#: Bits of a window's number in its stretch, which has length - length // 2 + 1 windows at most.
_WINDOW_BITS = 10

_HIGH = np.uint64(0xFFFFFFFF00000000)
_LOW = np.uint64(0x00000000FFFFFFFF)
_SALT = np.uint64(0xC2B2AE3D27D4EB4F)


def stretches(slab: Slab, length: int) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, anchor hash, stretch hash) of each stretch of windows with one anchor."""
    half = length // 2
    roll = Rolling(slab.data)
    hashes = mix64(roll.windows(half))
    key = (hashes & _HIGH) | np.arange(len(hashes), dtype=np.uint64)
    least = sliding_min(key, length - half + 1)
    at = np.arange(len(least))
    text = np.repeat(np.arange(slab.n), np.diff(np.minimum(slab.start, len(least))))
    inside = at + length <= slab.start[text + 1]
    at, text, least = at[inside], text[inside], least[inside]
    if not len(at):
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    cut = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (text[1:] != text[:-1])])
    first, last = at[cut], at[np.r_[cut[1:] - 1, len(at) - 1]]
    anchor = (least[cut] & _LOW).astype(np.int64)
    whole = mix64(roll.ranges(first, last + length) + (anchor - first).astype(np.uint64) * _SALT)
    return text[cut], first - slab.start[text[cut]], last - first + 1, hashes[anchor], whole


def multikey_sort(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes by their tokens, and a flag for each in that order: equal to the one before.

    Multikey quicksort for arrays: sort by one token, then go on to the next token only
    inside runs of equal ones.
    """
    n = len(tokens[0])
    order = np.argsort(tokens[0])
    same = np.r_[False, tokens[0][order][1:] == tokens[0][order][:-1]] if n else np.empty(0, bool)
    for token in tokens[1:]:
        run = np.cumsum(~same)
        tied = np.flatnonzero(same | np.r_[same[1:], False]) if n else order
        if not len(tied):
            break
        inner = np.lexsort((token[order[tied]], run[tied]))
        order[tied] = order[tied][inner]
        value = token[order[tied]]
        same[tied[1:]] &= value[1:] == value[:-1]
    return order, same


def _anchor_rows(documents: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slabs(b.column("text")):
                text, first, n, anchor, whole = stretches(s, length)
                row = pa.array(text + s.first)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(row), b.column("text_hash").take(row), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64))],
                    ["doc_id", "text_hash", "first", "n", "anchor", "whole"],
                )

    return documents.mapInArrow(run, "doc_id bigint, text_hash bigint, first int, n int, anchor bigint, whole bigint")


def _suffix_rows(texts: DataFrame, length: int) -> DataFrame:
    """A row per window of the stretches listed in ``stretches`` (struct stretch, first, n, open): two tokens, and ``ref``.

    ``ref`` is (stretch number, window in the stretch, open) in one integer.
    """
    half = length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("stretches")
            for s in slabs(b.column("text")):
                part = lists.slice(s.first, s.n)
                items = part.flatten()
                text = np.repeat(np.arange(s.n), part.value_lengths().to_numpy(zero_copy_only=False))
                stretch, first, n, is_open = (items.field(k).to_numpy(zero_copy_only=False) for k in range(4))
                within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                at = within + np.repeat(first + s.start[text], n)
                roll = Rolling(s.data)
                t1, t2 = mix64(roll.ranges(at, at + half)), mix64(roll.ranges(at + half, at + length))
                ref = (np.repeat(stretch * 2 + is_open.astype(np.int64), n) << _WINDOW_BITS) | within
                yield pa.RecordBatch.from_arrays([pa.array(t1.view(np.int64)), pa.array(t2.view(np.int64)), pa.array(ref)], ["t1", "t2", "ref"])

    return texts.select("text", "stretches").mapInArrow(run, "t1 bigint, t2 bigint, ref bigint")


def _bucket_marks(suffixes: DataFrame) -> DataFrame:
    """Sorts each partition; rows: state 0 a repeated open window (no tokens), 1 an open window alone in its bucket's first or last run, 2 another such run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t1, t2, ref = (np.concatenate([b.column(c).to_numpy() for b in parts]) for c in ("t1", "t2", "ref"))
        del parts
        is_open = (ref >> _WINDOW_BITS) & 1 == 1
        order, same = multikey_sort([t1, t2])
        repeated = same | np.r_[same[1:], False]
        marked = ref[order[repeated & is_open[order]]]
        edges = [0] if same[1:].all() else [0, len(order) - 1]
        border = order[edges]
        state = np.where(~repeated[edges] & is_open[border], 1, 2).astype(np.int8)
        none = pa.nulls(len(marked), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(marked), pa.array(np.zeros(len(marked), np.int8))], ["t1", "t2", "ref", "state"])
        yield pa.RecordBatch.from_arrays([pa.array(t1[border]), pa.array(t2[border]), pa.array(ref[border]), pa.array(state)], ["t1", "t2", "ref", "state"])

    return suffixes.mapInArrow(run, "t1 bigint, t2 bigint, ref bigint, state tinyint")


def repeated_spans(documents: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """(doc_id, text_hash, first, last): runs of window starts whose strings occur elsewhere; runs may touch or overlap."""
    if length - length // 2 + 1 >= 1 << _WINDOW_BITS:
        raise ValueError("length is too large")
    keyed = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").where(F.octet_length("text") >= length)
    rows = store(_anchor_rows(keyed, length), "anchors")

    kinds = rows.groupBy("anchor", "whole").agg(F.count(F.lit(1)).alias("c"))
    shared = kinds.groupBy("anchor").agg(F.sum("c").alias("total"), F.min("c").alias("least")).where("total >= 2").select("anchor", (F.col("least") == 1).alias("any_open"))
    groups = store(kinds.join(shared, "anchor"), "stretch-groups")
    matched = store(rows.join(groups, ["anchor", "whole"]), "stretches")
    remove(rows, groups)
    whole = matched.where("c >= 2").select("doc_id", "text_hash", "first", (F.col("first") + F.col("n") - 1).alias("last"))

    place = F.struct("doc_id", "text_hash", "first", "n").alias("place")
    copies = matched.where("any_open and c >= 2").groupBy("anchor", "whole").agg(F.min(place).alias("place")).select("place", F.lit(False).alias("open"))
    fine = matched.where("any_open and c = 1").select(place, F.lit(True).alias("open")).unionByName(copies)
    fine = store(fine.select("place.*", "open").withColumn("stretch", F.monotonically_increasing_id()), "open-stretches")
    total = fine.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not total:
        return whole
    lists = fine.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(F.collect_list(F.struct("stretch", "first", "n", "open")).alias("stretches"))
    texts = keyed.join(lists, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")))
    suffixes = _suffix_rows(texts, length).repartitionByRange(max(1, -(-int(total) // BUCKET_ROWS)), "t1", "t2", "ref")
    marks = store(_bucket_marks(suffixes), "suffix-marks")
    across = marks.where("state > 0").groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("buckets")).where("buckets >= 2")
    waiting = marks.where("state = 1").join(across, ["t1", "t2"], "left_semi")
    single = marks.where("state = 0").select("ref").unionByName(waiting.select("ref"))
    single = single.select(F.expr(f"shiftright(ref, {_WINDOW_BITS + 1})").alias("stretch"), F.col("ref").bitwiseAND(F.lit((1 << _WINDOW_BITS) - 1)).cast("int").alias("window"))
    found = single.join(fine, "stretch").select("doc_id", "text_hash", (F.col("first") + F.col("window")).alias("first"))
    return whole.unionByName(found.withColumn("last", F.col("first")))


def remove_repeats(documents: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and ``kept`` (the remaining bytes) of each row.

    Strings are judged on the input, in the same text and in all others; overlapping
    ones count.  A null text counts as empty.  A repeated row (same id and text)
    repeats all of its strings, so nothing of it stays if it has ``length`` bytes.
    Whole texts count at any length.  An empty table gives an empty result; other
    columns are left out.
    """
    spans = store(repeated_spans(documents.select("doc_id", "text"), length=length).groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(F.collect_set(F.struct("first", "last")).alias("spans")), "spans")
    keyed = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("text_hash"))
    joined = keyed.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("spans")
            for s in slabs(b.column("text")):
                part = lists.slice(s.first, s.n)
                items = part.flatten()
                sizes = part.fill_null([]).value_lengths().to_numpy(zero_copy_only=False) if part.null_count < len(part) else np.zeros(s.n, np.int64)
                base = np.repeat(s.start[:-1], sizes)
                step = np.zeros(len(s.data) + 1, np.int64)
                np.add.at(step, items.field(0).to_numpy(zero_copy_only=False) + base, 1)
                np.add.at(step, items.field(1).to_numpy(zero_copy_only=False) + base + length, -1)
                gone = np.cumsum(step)[:-1] > 0
                opens = gone.copy()
                opens[1:] &= ~gone[:-1]
                heads = s.start[:-1][s.start[:-1] < len(gone)]
                opens[heads] = gone[heads]
                count = lambda x: (c := np.r_[0, np.cumsum(x)])[s.start[1:]] - c[s.start[:-1]]
                removed = count(gone)
                kept = [s.data[i:j][~gone[i:j]].tobytes() if r else s.data[i:j].tobytes() for i, j, r in zip(s.start[:-1], s.start[1:], removed, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(s.first, s.n), pa.array(np.diff(s.start)), pa.array(removed), pa.array(count(opens)), pa.array(kept, pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    return joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def repeat_report(documents: DataFrame) -> DataFrame:
    """``remove_repeats`` with the digest of the remaining bytes, and whether any were removed."""
    digest = F.sha2("kept", 256).alias("kept_sha256")
    return remove_repeats(documents).select("doc_id", "n_bytes", "n_removed", "n_spans", digest, (F.col("n_removed") > 0).alias("has_repeats"))
