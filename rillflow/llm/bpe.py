"""BPE encoding and decoding: batched numpy merge rounds over the symbols of many words.

Distinct words of a batch lie in one flat symbol array.  Every round takes the lowest
rank of each word and merges its occurrences from the left; then only the pairs next to
a merge are looked up again, by binary search over the sorted pair keys.  Words without a
known pair leave the array.  Words of over ``LONG_WORD`` bytes would need as many rounds
as they have different ranks; their symbols are linked instead, and a round merges all
occurrences of the lowest rank left in any of them, so that the work grows with the
merges and not with rounds times length.  The vocabulary file is a parameter (a
tokenizers JSON whose words end in a suffix); it is broadcast to the executors.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import give_back

#: White space of the vocabulary's normaliser (the Unicode property White_Space).
SPACE = "\t-\r \x85\xa0  -     　"

_SHIFT = np.int64(20)
_NONE = np.int64(1) << np.int64(40)

#: Bytes beyond which a word's symbols are linked.
LONG_WORD = 256


def byte_characters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Codec:
    """Encodes and decodes like the library does with the same vocabulary file.

    Specials (added tokens, matched in the raw text) are never merged; everything
    else is put into NFC, lower-cased character by character and cut into words by
    the file's own split pattern.
    """

    def __init__(self, vocabulary: str, *, cache_words: int = 80_000, cache_length: int = 64) -> None:
        spec = json.loads(vocabulary)
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = [""] * (max([*ids.values(), *self.special.values()]) + 1)
        for text, i in [*ids.items(), *self.special.items()]:
            self.token[i] = text
        chars = byte_characters()
        self.inner = np.array([ids[c] for c in chars], np.int64)
        self.last = np.array([ids[c + suffix] for c in chars], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        key = (left << _SHIFT) | right
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made, self.pair = key[order], order.astype(np.int64), made, key
        # merging all occurrences in one round is exact only if no merge makes a pair of lower rank
        first = np.full(len(self.token), len(pairs))
        np.minimum.at(first, left, np.arange(len(pairs)))
        np.minimum.at(first, right, np.arange(len(pairs)))
        self.at_once = bool((first[made] > np.arange(len(pairs))).all())
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern.replace(r"\s", SPACE), regex.V0)
        self.letters_are_words = r"|[\p{L}]+|" in pattern  # then a run of letters needs no regex
        # the file's library knows Python's Unicode version; later letters and digits are plain symbols to it
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        later = np.array([ord(c) for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"] or [0xE000])
        jump = np.flatnonzero(np.diff(later) != 1)
        ranges = zip(later[np.r_[0, jump + 1]].tolist(), later[np.r_[jump, len(later) - 1]].tolist(), strict=True)
        self.later = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]")
        self.chunk = re.compile(f"[^{SPACE}]+")
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.cache: dict[str, bytes] = {}
        self.cache_words, self.cache_length = cache_words, cache_length

    def normalise(self, chunk: str) -> str:
        if chunk.isascii():
            return chunk.lower()
        chunk = unicodedata.normalize("NFC", chunk)
        return "".join(map(str.lower, chunk)) if "Σ" in chunk else chunk.lower()

    def words(self, chunk: str) -> list[bytes]:
        """The pieces of a normalised run without white space that are merged separately."""
        if not chunk.isascii() and self.later.search(chunk):
            return [chunk[slice(*m.span())].encode() for m in self.split.finditer(self.later.sub("\ue000", chunk))]
        return [w.encode() for w in self.split.findall(chunk)]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, ``_NONE`` if no merge makes it."""
        pair = (left << _SHIFT) | right
        at = np.minimum(np.searchsorted(self.key, pair), len(self.key) - 1)
        return np.where(self.key[at] == pair, self.rank[at], _NONE)

    def merge(self, words: Sequence[bytes]) -> list[bytes]:
        """Ids of each (non-empty) word as little-endian unsigned 32-bit integers."""
        out = [b""] * len(words)
        long = [len(w) > LONG_WORD for w in words]
        for which, merged in ((False, self._merge_rounds), (True, self._merge_linked)):
            number = [i for i, x in enumerate(long) if x == which]
            if not number:
                continue
            flat = np.frombuffer(b"".join([words[i] for i in number]), np.uint8)
            length = np.fromiter((len(words[i]) for i in number), np.int64, len(number))
            end = np.cumsum(length)
            symbol = self.inner[flat]
            symbol[end - 1] = self.last[flat[end - 1]]
            symbol, owner = merged(symbol, np.repeat(np.arange(len(number)), length))
            data = symbol.astype("<u4").tobytes()
            bound = (4 * np.r_[0, np.cumsum(np.bincount(owner, minlength=len(number)))]).tolist()
            for i, a, b in zip(number, bound, bound[1:], strict=False):
                out[i] = data[a:b]
        return out

    def _merge_rounds(self, symbol: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left and the word of each, in word order."""
        rank = np.full(len(symbol), _NONE)
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inside] = self.ranks(symbol[inside], symbol[inside + 1])
        done_symbol, done_owner = [], []
        while len(symbol):
            head = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            size = np.diff(np.r_[head, len(symbol)])
            best = np.repeat(np.minimum.reduceat(rank, head), size)
            live = best < _NONE
            done_symbol.append(symbol[~live])
            done_owner.append(owner[~live])
            hit = np.flatnonzero((rank == best) & live)
            if not len(hit):
                break
            if self.at_once:  # in a run of overlapping occurrences every second one merges
                fresh = np.r_[True, np.diff(hit) != 1]
                run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            else:
                hit = hit[np.r_[True, owner[hit[1:]] != owner[hit[:-1]]]]
            symbol[hit] = self.made[rank[hit]]
            live[hit + 1] = False
            now = (np.cumsum(live) - 1)[hit]
            symbol, owner, rank = symbol[live], owner[live], rank[live]
            rank[now] = _NONE
            near = np.concatenate([now, now[now > 0] - 1])
            near = near[near < len(owner) - 1]
            near = near[owner[near] == owner[near + 1]]
            rank[near] = self.ranks(symbol[near], symbol[near + 1])
        if not done_symbol:
            return symbol, owner
        symbol, owner = np.concatenate(done_symbol), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return symbol[order], owner[order]

    def _merge_linked(self, symbol: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for long words: each symbol knows its neighbours, and waiting pairs lie by rank."""
        n = len(symbol)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        cut = np.flatnonzero(owner[1:] != owner[:-1])
        after[cut], before[cut + 1] = n, -1
        rank, live = np.full(n, _NONE), np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def look_up(at: np.ndarray) -> None:
            rank[at] = _NONE
            at = at[after[at] < n]
            found = self.ranks(symbol[at], symbol[after[at]])
            rank[at] = found
            at, found = at[found < _NONE], found[found < _NONE]
            order = np.argsort(found, kind="stable")
            at, found = at[order], found[order]
            starts = np.flatnonzero(np.r_[True, found[1:] != found[:-1]]) if len(found) else np.empty(0, np.int64)
            for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(at)], strict=False):
                r = int(found[i])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(queue, r)
                waiting[r].append(at[i:j])

        look_up(np.arange(n))
        while queue:
            r = heapq.heappop(queue)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            if not self.at_once:
                first = np.r_[True, owner[at[1:]] != owner[at[:-1]]]
                if not first.all():
                    waiting[r] = [at[~first]]
                    heapq.heappush(queue, r)
                at = at[first]
            elif len(at) > 1 and (self.pair[r] >> _SHIFT) == (self.pair[r] & ((1 << 20) - 1)):
                fresh = np.r_[True, after[at[:-1]] != at[1:]]
                run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            gone = after[at]
            symbol[at], live[gone], rank[gone] = self.made[r], False, _NONE
            after[at] = after[gone]
            follows = after[at] < n
            before[after[at[follows]]] = at[follows]
            ahead = before[at]
            look_up(np.unique(np.concatenate([at, ahead[ahead >= 0]])))
        return symbol[live], owner[live]

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids (little-endian, 32 bits) of runs without white space."""
        order = list(chunks)
        plain = [c.lower() if c.isascii() else self.normalise(c) for c in order]
        cut = [(c.encode(),) if self.letters_are_words and c.isalpha() else self.words(c) for c in plain]
        distinct = list({w for words in cut for w in words})
        ids = dict(zip(distinct, self.merge(distinct), strict=True))
        return {c: ids[words[0]] if len(words) == 1 else b"".join([ids[w] for w in words]) for c, words in zip(order, cut, strict=True)}

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null counts as empty."""
        parts: list[list[list[str] | str]] = []
        unknown: set[str] = set()
        for text in texts:
            text, row, start = text or "", [], 0
            if "<" in text:
                for m in self.specials.finditer(text):
                    row += [self.chunk.findall(text[start : m.start()]), m[0]]
                    start = m.end()
            row.append(self.chunk.findall(text[start:] if start else text))
            parts.append(row)
            for x in row:
                if isinstance(x, list):
                    unknown.update(x)
        cache = self.cache
        unknown.difference_update(cache)
        fresh = self._learn(unknown)
        if len(cache) + len(fresh) > self.cache_words:
            kept = {c for row in parts for x in row if isinstance(x, list) for c in x} - fresh.keys()
            local = {c: cache[c] for c in kept} | fresh
            cache.clear()
            cache.update((c, v) for c, v in local.items() if len(c) <= self.cache_length)
        else:
            cache.update((c, v) for c, v in fresh.items() if len(c) <= self.cache_length)
            local = cache if all(len(c) <= self.cache_length for c in fresh) else {**cache, **fresh}
        special = {t: np.array([i], "<u4").tobytes() for t, i in self.special.items()}
        return [b"".join([special[x] if isinstance(x, str) else b"".join([local[c] for c in x]) for x in row]) for row in parts]

    def decode(self, ids: Sequence[bytes]) -> list[str]:
        """Tokens joined by spaces, specials included: the file names no decoder."""
        token = self.token.__getitem__
        return [" ".join(map(token, np.frombuffer(x, "<u4").tolist())) for x in ids]


_codecs: dict[str, Codec] = {}


def _codec(vocabulary: str) -> Codec:
    """One codec, and so one cache of words, for each worker process."""
    key = hashlib.sha256(vocabulary.encode()).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(vocabulary)
    return _codecs[key]


def _rows(column: pa.Array, size: int = 1 << 20) -> Iterator[list[str | None]]:
    """Texts of a batch, about ``size`` characters at a time."""
    block, n = [], 0
    for text in column:
        block.append(text := text.as_py())
        n += len(text or "")
        if n >= size:
            yield block
            block, n = [], 0
    yield block
    give_back()


def read_vocabulary(path: str) -> str:
    """The file's contents, read once on the driver."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(documents: DataFrame, vocabulary: str, *, digest: bool = False) -> DataFrame:
    """``documents`` with ``ids`` (array<int>) and ``n_tokens``.

    Every whole text is encoded; a null or empty text gives no ids.  Columns named
    ids or n_tokens are replaced, all others pass through; repeated rows are encoded
    alike; an empty table gives an empty result.  A map without a shuffle.

    ``digest``: with ``decoded_sha256``, the digest of the text decoded from the ids, in
    place of ``text``.  Both directions run in one map then; two would take twice the
    workers, each with a codec of its own.
    """
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)  # a file of fixed size
    read = documents.drop("ids", "n_tokens")
    kept = read.drop("text", "decoded_sha256") if digest else read
    at = [read.columns.index(c) for c in kept.columns]
    more = {"ids": F.array(F.lit(0)), "n_tokens": F.lit(0).cast("bigint")} | ({"decoded_sha256": F.lit("")} if digest else {})
    schema = kept.select("*", *(c.alias(name) for name, c in more.items())).schema
    names = schema.names
    for f in schema:
        f.nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for b in batches:
            done = 0
            for texts in _rows(b.column("text")):
                ids = codec.encode(texts)
                n = np.array([len(x) // 4 for x in ids], np.int64)
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
                flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
                digests = [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in codec.decode(ids)], pa.string())] if digest else []
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(done, len(ids)) for k in at), pa.ListArray.from_arrays(offsets, flat), pa.array(n), *digests], names)
                done += len(ids)

    return read.mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ``ids`` (null ids: empty)."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    kept = encoded.drop("decoded")
    schema = kept.select("*", F.lit("").alias("decoded")).schema
    for f in schema:
        f.nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for b in batches:
            texts = codec.decode([np.array(x.as_py() or [], "<u4").tobytes() for x in b.column("ids")])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "decoded"])

    return kept.mapInArrow(run, schema)


def round_trip(documents: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the text decoded from them.

    Both directions run in one map, so neither ids nor decoded texts travel.  Whole
    texts count at any length; a null or empty text has no tokens and the digests of
    nothing.  Repeated rows have equal results, other columns are left out, and an empty
    table gives an empty result.
    """
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            done = 0
            for texts in _rows(b.column("text")):
                ids = codec.encode(texts)
                decoded = codec.decode(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(done, len(ids)),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([sha(x) for x in ids], pa.string()),
                        pa.array([sha(x.encode()) for x in decoded], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
                done += len(ids)

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
