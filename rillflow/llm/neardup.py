"""MinHash near-dedup: a chosen-path set similarity join, confirmed on full sets.

Documents with equal shingle sets are one class and take part once.  Each class is
embedded as ``TOKENS`` minwise tokens.  In every tree a node chooses each (position,
token) with probability 1 / (similarity * TOKENS), by a hash of the node, so two
classes at the wanted similarity go on to a common child in expectation once.

1. The first trees settle large groups: members of a node are compared with one pivot,
   and what the links connect has one colour from then on.
2. All trees branch.  Nodes of one colour are done.  Nodes of up to ``SMALL_NODE``
   members are compared exhaustively, but for members of one colour; each is one row of
   bounded size, and only pairs that agree become rows.  Larger nodes branch further.
3. Nothing is capped: what is in large nodes at the last depth is coloured by all links so
   far and goes through an exact prefix-filter join, in which documents meet only in their
   rarest shingles.

Independent trees repeat this: with 24 trees a pair at the threshold is missed with a
probability of 5e-7 where nodes of depth 2 settle it and of 2.6e-5 to 3.4e-5 where only
depth 3 does.

Comparisons use the agreement of 64 minwise bytes first (up to five standard deviations
below what a pair at the threshold has: 40 of 64 at 0.85) and the full shingle sets last.
Joins in which a third of the rows may have one key (nodes, pivots, components) are salted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .joins import hot_keys, salted_join
from .scratch import remove, store
from .textarrays import LOWER, Slab, find_words, hash_words, mix64, slabs

TOKENS = 64
TREES = 24
#: Of these, the first are used to connect large groups before anything else is compared.
SETTLING_TREES = 8
DEPTH = 3
#: Hash buckets by which the prefix join orders shingles: 8 MB of counts, broadcast.
COUNT_BUCKETS = 1 << 20
#: Shingles of a prefix that goes along whole.
SHORT_PREFIX = 64
#: Bits that tell which documents' texts may be needed: 8 MB, broadcast, whatever the number of documents.
ID_BITS = 1 << 26
#: Nodes up to this size are compared exhaustively.
SMALL_NODE = 64
#: List values of an Arrow batch that a Python worker takes at once; a batch may hold 10,000 long lists.
PIECE = 1 << 15

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)
_ODD = mix64(np.arange(1, TOKENS + 1, dtype=np.uint64) * _A) | np.uint64(1)
_ADD = mix64(np.arange(1, TOKENS + 1, dtype=np.uint64) * _B)


def shingle_sets(slab: Slab, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct word shingles of each text, sorted by (text, hash), and the bounds of each text's.

    A-Z are lower-cased.  A text with fewer than ``width`` words has its whole word
    sequence as its only shingle; one without words has none.
    """
    words = find_words(slab)
    h = hash_words(LOWER[slab.data], words.begin, words.end)
    n_words = np.diff(words.first)
    count = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    first = np.repeat(words.first[:-1], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    text = np.repeat(np.arange(slab.n), count)
    size = np.minimum(n_words, width)[text]
    value = size.astype(np.uint64)
    for k in range(width):
        word = h[np.minimum(first + k, max(len(h) - 1, 0))] if len(h) else h
        value = np.where(k < size, mix64(value * _A + word), value)
    order = np.argsort(value)
    order = order[np.argsort(text[order], kind="stable")]
    value, text = value[order], text[order]
    fresh = np.r_[True, (value[1:] != value[:-1]) | (text[1:] != text[:-1])] if len(value) else np.empty(0, bool)
    value, text = value[fresh], text[fresh]
    return value, np.searchsorted(text, np.arange(slab.n + 1))


def _sign(documents: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, s1, s2, tokens): set size, an order-free 128-bit hash of the set, and its minwise tokens (32 bits each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slabs(b.column("text")):
                value, bound = shingle_sets(s, width)
                n = np.diff(bound)
                some = np.flatnonzero(n)
                at = bound[:-1][some]
                s1, s2 = np.zeros(s.n, np.uint64), np.zeros(s.n, np.uint64)
                tokens = np.zeros((s.n, TOKENS), np.uint32)
                if len(some):
                    s1[some] = np.add.reduceat(mix64(value ^ _A), at)
                    s2[some] = np.add.reduceat(mix64(value ^ _B), at)
                    for j in range(TOKENS):
                        tokens[some, j] = np.minimum.reduceat(value * _ODD[j] + _ADD[j], at) >> np.uint64(32)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(s.first, s.n), pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array([row.tobytes() for row in tokens], pa.binary())],
                    ["doc_id", "n", "s1", "s2", "tokens"],
                )

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, s1 bigint, s2 bigint, tokens binary")


def _pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of whole rows whose lists in ``column`` have up to ``limit`` values together; a longer list is alone."""
    ends = np.cumsum(batch.column(column).value_lengths().to_numpy(zero_copy_only=False))
    i = done = 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(i, j - i)
        i, done = j, int(ends[j - 1])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, TOKENS)


def _branch(rows: DataFrame, similarity: float, *, trees: range | None = None) -> DataFrame:
    """Children of (node, doc, n, colour, tokens) rows: each chosen token leads to a node.  ``trees``: start these trees instead."""
    chosen_below = np.uint64(int((1 << 64) / (similarity * TOKENS)))
    passed = [c for c in rows.columns if c not in ("node", "tokens")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column = np.arange(TOKENS, dtype=np.uint64) << np.uint64(32)
        for whole in batches:
            for i in range(0, whole.num_rows, 2000):
                b = whole.slice(i, 2000)
                token = mix64((column | _matrix(b.column("tokens"))) + _B)
                nodes = [b.column("node").to_numpy().view(np.uint64)] if trees is None else [np.full(b.num_rows, mix64(np.array([k + 1], np.uint64) * _B)[0]) for k in trees]
                for node in nodes:
                    draw = mix64(token ^ node[:, None])
                    row, j = np.nonzero(draw < chosen_below)
                    child = mix64(draw[row, j] + token[row, j] * _A)
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), *(b.column(c).take(at) for c in passed)], ["node", *passed])

    return rows.mapInArrow(run, StructType([StructField("node", LongType()), *(rows.schema[c] for c in passed)]))


def least_agreement(percent: int) -> int:
    """Equal minwise bytes that a pair at the threshold has, less five standard deviations."""
    s = percent / 100
    return int(TOKENS * s - 5 * (TOKENS * s * (1 - s)) ** 0.5)


def _agreeing(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the (a, x, b, y) pairs with at least ``least_agreement`` equal minwise bytes in x and y."""
    least = least_agreement(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, TOKENS) for c in ("x", "y"))
            at = pa.array(np.flatnonzero((x == y).sum(1) >= least))
            yield pa.RecordBatch.from_arrays([b.column("a").take(at), b.column("b").take(at)], ["a", "b"])

    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _agreeing_in_nodes(members: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the members of one small node that differ in colour and agree; all are compared, by node size in one array.

    Only agreeing pairs become rows.  A node has at most ``SMALL_NODE`` members.
    """
    least = least_agreement(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (piece for whole in batches for piece in _pieces(whole, "members")):
            lists = b.column("members")
            items = lists.flatten()
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            begin = np.cumsum(size) - size
            doc, n = (items.field(k).to_numpy(zero_copy_only=False) for k in range(2))
            colour = items.field(2).fill_null(-1).to_numpy(zero_copy_only=False)
            plain = items.field(2).is_null().to_numpy(zero_copy_only=False)
            low = np.frombuffer(b"".join(items.field(3).to_pylist()), np.uint8).reshape(-1, TOKENS)
            for m in np.unique(size):
                i, j = np.triu_indices(m, 1)
                nodes, step = begin[size == m], max(1, (4 << 20) // (len(i) * TOKENS))
                for at in range(0, len(nodes), step):
                    x, y = (nodes[at : at + step, None] + i).ravel(), (nodes[at : at + step, None] + j).ravel()
                    fits = np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent
                    fits &= plain[x] | plain[y] | (colour[x] != colour[y])
                    x, y = x[fits], y[fits]
                    alike = (low[x] == low[y]).sum(1) >= least
                    x, y = doc[x[alike]], doc[y[alike]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    grouped = members.groupBy("node").agg(F.collect_list(F.struct("doc", "n", "colour", "bytes")).alias("members"))
    return grouped.select("members").mapInArrow(run, "a bigint, b bigint").distinct()


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _maybe_needed(documents: DataFrame, needed: DataFrame) -> DataFrame:
    """``documents`` without most of those whose ids aren't in ``needed.doc_id``; none of those is lost.

    ``ID_BITS`` bits are set by hashes of the needed ids, in blocks of 32,768.
    """
    place = F.xxhash64("doc_id").bitwiseAND(F.lit(ID_BITS - 1)) + 1
    block, bit = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    blocks = needed.groupBy(block.alias("_block")).agg(F.bitmap_construct_agg(bit).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1
    return documents.join(F.broadcast(blocks), block == F.col("_block")).where(is_set).select(*documents.columns)


def _needed_texts(documents: DataFrame, needed: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents whose ids are in ``needed.doc_id``, each there once; few other texts are shuffled.

    A merge join at every size: whether the ids would fit a broadcast changes with the
    input.  An inner one, as Spark would move a semi join below ``_maybe_needed``.
    """
    return _maybe_needed(documents.select("doc_id", "text"), needed).join(needed.select("doc_id").hint("merge"), "doc_id")


def _sets(documents: DataFrame, needed: DataFrame, width: int) -> DataFrame:
    """(doc, shingles) of the documents whose ids are in ``needed.doc_id``, each there once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slabs(b.column("text")):
                value, bound = shingle_sets(s, width)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(s.first, s.n), pa.ListArray.from_arrays(pa.array(bound.astype(np.int32)), pa.array(value.view(np.int64)))], ["doc", "shingles"])

    return store(_needed_texts(documents, needed).mapInArrow(run, "doc bigint, shingles array<bigint>"), "shingle-sets")


def _confirmed(documents: DataFrame, pairs: DataFrame, percent: int, width: int) -> DataFrame | None:
    """The (a, b) pairs whose full shingle sets are similar, or None if there are no pairs."""
    pairs = store(pairs, "candidates")
    if pairs.isEmpty():
        return None
    sets = _sets(documents, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), width)
    x, y = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("doc").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    similar = common * 100 >= (F.size("x") + F.size("y") - common) * percent
    both = salted_join(salted_join(pairs, x, "a", hot_keys(pairs, "a"), spread="b"), y, "b", hot_keys(pairs, "b"), spread="a")
    out = store(both.where(similar).select("a", "b"), "links")
    remove(pairs, sets)
    return out


def _shingle_counts(sets: DataFrame) -> np.ndarray:
    """How many documents have a shingle of each of ``COUNT_BUCKETS`` hash buckets: an array of fixed size.

    At most 256 tasks send blocks of their counts, so that what is summed for a block is bounded.
    """
    block = COUNT_BUCKETS // 256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(COUNT_BUCKETS, np.int64)
        for b in (piece for whole in batches for piece in _pieces(whole, "shingles", COUNT_BUCKETS // 4)):
            n += np.bincount(_bucket(b.column("shingles").flatten().to_numpy()), minlength=COUNT_BUCKETS)
        some = [(k, np.flatnonzero(part), part) for k, part in enumerate(n.reshape(256, block)) if part.any()]
        packed = [np.concatenate([at, part[at]]).astype(np.int64).tobytes() for _, at, part in some]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in some], pa.int32()), pa.array(packed, pa.binary())], ["block", "part"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(block, np.int64)
        for part in group["part"]:
            at, n = np.frombuffer(part, np.int64).reshape(2, -1)
            total[at] += n
        return pd.DataFrame({"block": group["block"][:1], "part": [total.tobytes()]})

    out = np.zeros((256, block), np.int64)
    for r in sets.coalesce(256).mapInArrow(run, "block int, part binary").groupBy("block").applyInPandas(add, "block int, part binary").collect():
        out[r["block"]] = np.frombuffer(r["part"], np.int64)
    return out.ravel()


def _bucket(shingle: np.ndarray) -> np.ndarray:
    return (shingle.view(np.uint64) % np.uint64(COUNT_BUCKETS)).astype(np.int64)


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(doc, n, rest, shingle, prefix): the shingles of each document by which a similar one can be met.

    Shingles are ordered from rare to frequent buckets; any one order for all documents
    would be right.  ``rest``: shingles from this one on that others may have, too.
    ``prefix``: all of the document's, if they are few; as each of them has all, some
    documents at a time are written, so that a batch stays small.
    """
    counts = sets.sparkSession.sparkContext.broadcast(_shingle_counts(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (piece for whole in batches for piece in _pieces(whole, "shingles")):
            lists = b.column("shingles")
            n = lists.value_lengths().to_numpy(zero_copy_only=False)
            value, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(n)), n)
            times = counts.value[_bucket(value)]
            value, owner, times = value[times >= 2], owner[times >= 2], times[times >= 2]
            order = np.lexsort((value, times, owner))
            value, owner = value[order], owner[order]
            k = np.bincount(owner, minlength=len(n))
            rest = np.cumsum(k)[owner] - np.arange(len(owner))
            near = rest * 100 >= n[owner] * percent
            value, owner, rest = value[near], owner[near], rest[near]
            size = np.bincount(owner, minlength=len(n))
            short = size[owner] <= SHORT_PREFIX
            ends = np.r_[0, np.cumsum(np.where(size <= SHORT_PREFIX, size, 0))].astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(value[short])).take(pa.array(owner))
            yield pa.RecordBatch.from_arrays([b.column("doc").take(pa.array(owner)), pa.array(n[owner].astype(np.int64)), pa.array(rest), pa.array(value), prefix], ["doc", "n", "rest", "shingle", "prefix"])

    return sets.mapInArrow(run, "doc bigint, n bigint, rest bigint, shingle bigint, prefix array<bigint>")


def _prefix_pairs(documents: DataFrame, docs: DataFrame, low: DataFrame, percent: int, width: int) -> DataFrame:
    """(a, b) pairs of ``docs`` (doc, colour) that agree and may be similar: an exact prefix and position filter.

    Similar sets share a shingle so early in the order from rare to frequent that what
    follows it in both suffices for the overlap they need.  Shingles of one document
    only match nothing, so that edited copies, whose own shingles fill their prefixes,
    meet hardly anybody.  A pair meets at the first shingle that short prefixes share.
    """
    sets = _sets(documents, docs.select(F.col("doc").alias("doc_id")), width)
    prefix = store(_prefixes(sets, percent).join(docs, "doc").join(low, "doc"), "prefixes")
    remove(sets)
    x, y = (prefix.select("shingle", *(F.col(c).alias(f"{c}_{k}") for c in ("doc", "colour", "n", "rest", "bytes", "prefix"))) for k in "xy")
    enough = F.least("rest_x", "rest_y") * (100 + percent) >= (F.col("n_x") + F.col("n_y")) * percent
    enough &= _sizes_fit(F.col("n_x"), F.col("n_y"), percent)
    enough &= (F.size("prefix_x") == 0) | (F.size("prefix_y") == 0) | (F.get(F.array_intersect("prefix_x", "prefix_y"), F.lit(0)) == F.col("shingle"))
    plain = x.where("colour_x is null").join(y, "shingle").where(enough & ((F.col("doc_x") < F.col("doc_y")) | F.col("colour_y").isNotNull()))
    several = prefix.where("colour is not null").groupBy("shingle").agg(F.min("colour").alias("c1"), F.max("colour").alias("c2")).where("c1 < c2").select("shingle")
    mixed = x.where("colour_x is not null").join(several, "shingle", "left_semi").join(y.where("colour_y is not null"), "shingle").where(enough & (F.col("doc_x") < F.col("doc_y")) & (F.col("colour_x") != F.col("colour_y")))
    pairs = plain.unionByName(mixed).select(F.least("doc_x", "doc_y").alias("a"), F.greatest("doc_x", "doc_y").alias("b"), F.col("bytes_x").alias("x"), F.col("bytes_y").alias("y"))
    return _agreeing(pairs, percent).distinct()


def _unsettled(rows: DataFrame) -> DataFrame:
    """(node, m) of the nodes of (node, doc, n, colour) rows whose m members aren't all of one colour."""
    nodes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("m"), F.count("colour").alias("coloured"), F.min("colour").alias("c1"), F.max("colour").alias("c2"))
    return nodes.where("m >= 2 and not (coloured = m and c1 = c2)").select("node", "m")


def settle(documents: DataFrame, signed: DataFrame, percent: int, width: int) -> DataFrame | None:
    """Links of the members of the first trees' nodes with a pivot of each: large groups of copies are connected by them."""
    rows = store(_branch(signed.select(F.col("rep").alias("doc"), "n", "bytes", "tokens"), percent / 100, trees=range(SETTLING_TREES)), "settling-nodes")
    pivot = F.min(F.struct("doc", "n", "bytes")).alias("pivot")
    nodes = store(rows.groupBy("node").agg(F.count(F.lit(1)).alias("m"), pivot).where("m >= 2").drop("m"), "pivots")
    stars = salted_join(rows, nodes, "node", hot_keys(rows, "node"), spread="doc").where((F.col("doc") != F.col("pivot.doc")) & _sizes_fit(F.col("n"), F.col("pivot.n"), percent))
    pairs = stars.select(F.col("pivot.doc").alias("a"), F.col("pivot.bytes").alias("x"), F.col("doc").alias("b"), F.col("bytes").alias("y"))
    links = _confirmed(documents, _agreeing(pairs, percent).distinct(), percent, width)
    remove(rows, nodes)
    return links


def _coloured(docs: DataFrame, known: DataFrame | None) -> DataFrame:
    """``docs`` with ``colour``, the component that is known of each ``doc`` (null: none)."""
    if known is None:
        return docs.withColumn("colour", F.lit(None).cast("bigint"))
    return docs.join(known.select(F.col("v").alias("doc"), F.col("component").alias("colour")), "doc", "left")


def similar_classes(documents: DataFrame, signed: DataFrame, percent: int, width: int) -> DataFrame | None:
    """(v, component) of all classes that are linked with others; None if there are no links."""
    similarity = percent / 100
    known = connect(None, settle(documents, signed, percent, width))
    rows = store(_branch(_coloured(signed.select(F.col("rep").alias("doc"), "n", "tokens"), known), similarity, trees=range(TREES)), "tree-nodes")
    low, tokens = (signed.select(F.col("rep").alias("doc"), c) for c in ("bytes", "tokens"))
    found = []
    for level in range(DEPTH):
        nodes = store(_unsettled(rows), "unsettled-nodes")
        left = store(salted_join(rows, nodes, "node", hot_keys(rows, "node"), spread="doc"), "unsettled")
        remove(rows, nodes)
        found.append(store(_agreeing_in_nodes(left.where(F.col("m") <= SMALL_NODE).join(low, "doc"), percent), "node-pairs"))
        large = left.where(F.col("m") > SMALL_NODE)
        if large.isEmpty():
            remove(left)
            break
        if level == DEPTH - 1:
            known = connect(known, _confirmed(documents, reduce(DataFrame.unionByName, found).distinct(), percent, width))
            remove(*found)
            docs = store(_coloured(large.select("doc").distinct(), known), "large-nodes")
            remove(left)
            found = [_prefix_pairs(documents, docs, low, percent, width)]
            break
        rows = store(_branch(large.join(tokens, "doc").select("node", "doc", "n", "colour", "tokens"), similarity), "tree-nodes")
        remove(left)
    return connect(known, _confirmed(documents, reduce(DataFrame.unionByName, found).distinct(), percent, width))


def connect(known: DataFrame | None, links: DataFrame | None) -> DataFrame | None:
    """(v, component) after further (a, b) links: these join the components that are known already, as if each were one document."""
    if links is None or known is None:
        return known if links is None else components(links)
    for end in ("a", "b"):
        name = known.select(F.col("v").alias(end), F.col("component").alias(f"_{end}"))
        plain, links = links, store(salted_join(links, name, end, hot_keys(links, end), spread="b" if end == "a" else "a", how="left"), "named-links")
        remove(plain)
    fresh = components(links.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).where("a <> b").distinct())
    root = fresh.select(F.col("v").alias("component"), F.col("component").alias("root"))
    old = salted_join(known, root, "component", hot_keys(known, "component"), spread="v", how="left").select("v", F.coalesce("root", "component").alias("component"))
    out = store(old.unionByName(fresh.join(known, "v", "left_anti")), "components")
    remove(links)
    return out


def components(links: DataFrame) -> DataFrame:
    """(v, component): smallest id reachable from each end of the (a, b) links.

    Smallest labels travel along links and are then looked up in themselves, which
    halves the way to go each round.  Labels are written to the shared folder each
    round and never leave the executors; ends with many links and large components are
    salted.
    """
    edges = store(links.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(links.select(F.col("b").alias("v"), F.col("a").alias("w"))).distinct(), "links")
    stored = label = store(edges.groupBy("v").agg(F.least(F.first("v"), F.min("w")).alias("component")), "labels")
    hubs = hot_keys(edges, "w")
    while True:
        near = salted_join(edges, label.select(F.col("v").alias("w"), F.col("component").alias("other")), "w", hubs, spread="v").groupBy("v").agg(F.min("other").alias("other"))
        spread = label.join(near, "v").select("v", F.least("component", "other").alias("component"), F.col("component").alias("old"))
        up = label.select(F.col("v").alias("component"), F.col("component").alias("root"))
        spread = salted_join(spread, up, "component", hot_keys(label, "component"), spread="v", how="left")
        fresh = store(spread.select("v", F.least("component", "root").alias("component"), "old"), "labels")
        remove(stored)
        stored, label = fresh, fresh.drop("old")
        if fresh.where("component < old").isEmpty():
            remove(edges)
            return label


def near_duplicates(documents: DataFrame, *, percent: int = 80, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Rows are linked if 100 * common shingles >= percent * distinct shingles of both.
    ``component_id`` is the smallest doc_id reachable over links, ``kept`` marks that
    document itself.  A null or empty text, or one of white space, has no shingles and
    is linked with nothing.  Whole texts count at any length.  Repeated rows are linked
    with each other; two different texts under one id are one node of the links; a row
    without an id is its own component (null) and is kept.  Other columns, also such with
    the names of the result's, are left out.  An empty table gives an empty result.
    """
    rows = store(_sign(documents, width), "signatures")
    some = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    # the low byte of each 32-bit token, as hex: every fourth pair of digits
    low = F.unhex(F.regexp_replace(F.hex("tokens"), "(..)......", "$1"))
    classes = store(rows.where(some).groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("tokens").alias("tokens")).withColumn("bytes", low), "classes")
    found = similar_classes(documents, classes, percent, width)
    component = F.col("rep") if found is None else F.coalesce("component", "rep")
    linked = classes.select("n", "s1", "s2", "rep") if found is None else classes.select("n", "s1", "s2", "rep").join(found, F.col("rep") == F.col("v"), "left")
    named = store(linked.select("n", "s1", "s2", component.alias("component")), "class-components")
    out = rows.select("doc_id", "n", "s1", "s2").join(named, ["n", "s1", "s2"], "left")
    component = F.when(some, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
