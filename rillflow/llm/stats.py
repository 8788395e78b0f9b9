"""Statistics of whole documents, vectorised over slabs of UTF-8 bytes.

Words are ``[^\\x20\\x09-\\x0D]+``; a null text counts as empty.  All statistics are
functions of the text alone.
"""

from __future__ import annotations

import numpy as np

from .textarrays import IS_SPACE, Slab, find_words, hash_words, mix64

SYMBOLS = b"#*$%&|<>"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

FEATURES = (
    "log_words", "chars_per_word", "symbols_per_word", "dup_lines_per_line", "repeat_words_per_word",
    "upper_per_letter", "digits_per_char", "spaces_per_char", "non_ascii_per_char", "punctuation_per_word",
    "bangs_per_word", "pipes_per_word", "stops_per_word", "commas_per_word", "distinct_words_per_word",
    "longest_word", "short_words_per_word", "words_per_line", "log_lines", "top_word_share",
)

_C = np.uint64(0x9FB21C651E98DF25)


def _flags(values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_IS = {
    "symbol": _flags(SYMBOLS),
    "upper": _flags(bytes(range(65, 91))),
    "lower": _flags(bytes(range(97, 123))),
    "digit": _flags(bytes(range(48, 58))),
    "space": IS_SPACE,
    "high": _flags(bytes(range(0xC2, 0xF5))),
    "rest": _flags(bytes(range(0x80, 0xC0))),
    "line": _flags(b"\n"),
    "bang": _flags(b"!?"),
    "pipe": _flags(b"|"),
    "stop": _flags(b"."),
    "comma": _flags(b",;:"),
    "punctuation": _flags(bytes(c for c in range(33, 127) if not chr(c).isalnum())),
}


def _keyed(text: np.ndarray, value: np.ndarray) -> np.ndarray:
    """One 64-bit key for (text number, value)."""
    return mix64(value + (text.astype(np.uint64) + np.uint64(1)) * _C)


def text_stats(slab: Slab) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """BASE counts (int64 each) and the FEATURES matrix of each text of a slab."""
    n, data = slab.n, slab.data
    lo, hi = slab.start[:-1], slab.start[1:]

    def per_text(flags: np.ndarray) -> np.ndarray:
        c = np.zeros(len(data) + 1, np.int64)
        np.cumsum(flags[data], out=c[1:])
        return c[hi] - c[lo]

    count = {k: per_text(f) for k, f in _IS.items()}
    chars = (hi - lo) - count["rest"]
    words = find_words(slab)
    n_words = np.diff(words.first)
    word_hash = hash_words(data, words.begin, words.end)

    # words inside 3-word windows that occur twice or more in their text
    m = len(words.begin)
    repeated = np.zeros(m, bool)
    if m >= 3:
        inside = words.text[2:] == words.text[:-2]
        at = np.flatnonzero(inside)
        h = word_hash[:-2] + word_hash[1:-1] * np.uint64(3) + (word_hash[2:] ^ _C) * np.uint64(0x2545F4914F6CDD1D)
        _, back, times = np.unique(_keyed(words.text[at], h[at]), return_inverse=True, return_counts=True)
        at = at[times[back] >= 2]
        for k in range(3):
            repeated[at + k] = True
    sums = lambda x: (c := np.concatenate([[0], np.cumsum(x)]))[words.first[1:]] - c[words.first[:-1]]
    n_repeat = sums(repeated)

    # lines with a word that equal an earlier line of their text
    breaks = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([lo, breaks + 1]), kind="stable")
    owner = np.sort(np.concatenate([np.arange(n), slab.owner(breaks)]), kind="stable")
    end = np.empty_like(begin)
    end[:-1] = begin[1:] - (owner[1:] == owner[:-1])
    end[-1:] = len(data)
    has_word = np.searchsorted(words.begin, end) > np.searchsorted(words.begin, begin)
    begin, end, owner = begin[has_word], end[has_word], owner[has_word]
    n_lines = np.bincount(owner, minlength=n)
    first = np.unique(_keyed(owner, hash_words(data, begin, end)), return_index=True)[1]
    n_dup_lines = n_lines - np.bincount(owner[first], minlength=n)

    base = {
        "n_words": n_words.astype(np.int64),
        "word_chars": (chars - count["space"]).astype(np.int64),
        "n_symbols": count["symbol"].astype(np.int64),
        "n_dup_lines": n_dup_lines.astype(np.int64),
        "n_repeat_words": n_repeat.astype(np.int64),
    }

    w, c = np.maximum(n_words, 1), np.maximum(chars, 1)
    letters = np.maximum(count["upper"] + count["lower"], 1)
    length = words.end - words.begin
    kinds, first, times = np.unique(_keyed(words.text, word_hash), return_index=True, return_counts=True)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, words.text[first], times)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, words.text, length)
    x = np.stack(
        [
            np.log1p(n_words), base["word_chars"] / w, count["symbol"] / w, n_dup_lines / np.maximum(n_lines, 1), n_repeat / w,
            count["upper"] / letters, count["digit"] / c, count["space"] / c, count["high"] / c, count["punctuation"] / w,
            count["bang"] / w, count["pipe"] / w, count["stop"] / w, count["comma"] / w, np.bincount(words.text[first], minlength=n) / w,
            np.log1p(longest), sums(length <= 2) / w, n_words / np.maximum(n_lines, 1), np.log1p(n_lines), most / w,
        ],
        axis=1,
    ).astype(np.float64)
    return base, x
