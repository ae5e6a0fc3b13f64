"""Exact word-window dedup by FM-indexes (operator 10).

``remove_repeated_words(docs, window)`` removes each word covered by a window
of ``window`` words whose word sequence also starts in a document with a
smaller doc_id. Words are ``[^\\x20\\x09-\\x0D]+``, compared by 64-bit hashes.

Shards are the anchor buckets of ``repeats``: a shard indexes the distinct
contexts (word sequences) of its anchors as an FM-index, i.e. the Burrows-
Wheeler transform of their concatenation in a wavelet matrix (bit planes with
sampled counts). Contexts are streamed through it from right to left: one
backward-search step prepends a word; when the match is longer than the window
the interval is widened to the suffixes that share ``window`` words (marked in
a bit vector), so the matching statistics stay at the threshold. Every interval
at the threshold reports the smallest document among its occurrences.

Defined results: null text or text without words has no words and loses
nothing; a null doc_id sorts after all others; rows with the same doc_id are one
document; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segstats.llm.repeats import repeats

K = 4  # words of an anchor


class Bits:
    """Bit vector with counts before every 64-bit word: rank1(i) = ones before i."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate(([0], np.cumsum(ones)))
        self.zeros = n - int(self.before[-1])

    def rank1(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low).astype(np.int64)


class FMIndex:
    """FM-index of a sequence of codes 0..sigma-1 whose suffix array is known."""

    def __init__(self, text: np.ndarray, sa: np.ndarray):
        bwt = text[sa - 1]  # the text before its first symbol is its last
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=int(text.max()) + 1))))
        self.planes = []
        for level in reversed(range(max(1, int(text.max()).bit_length()))):
            bit = (bwt >> level) & 1
            self.planes.append((level, Bits(bit)))
            bwt = np.concatenate((bwt[bit == 0], bwt[bit == 1]))

    def step(self, code: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals after prepending ``code`` to the matches of [lo, hi)."""
        a, b = lo, hi
        start = np.zeros_like(lo)
        for level, v in self.planes:
            one = ((code >> level) & 1).astype(bool)
            ra, rb, rs = v.rank1(a), v.rank1(b), v.rank1(start)
            a, b, start = (np.where(one, v.zeros + x, y - x) for x, y in ((ra, a), (rb, b), (rs, start)))
        return self.first[code] + a - start, self.first[code] + b - start


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array by more than ``depth`` first symbols, ties in any order: enough
    for backward search of up to ``depth`` + 1 symbols; marks: does suffix i differ from suffix i - 1 within ``depth`` symbols?)"""
    n = len(text)
    rank = text.astype(np.int64)
    have, marks, sa = 1, None, None
    while have <= depth:
        if have < depth < 2 * have:  # ranks by exactly ``depth`` symbols, for the marks
            other = np.concatenate((rank[depth - have:], np.full(depth - have, -1, np.int64)))
            exact = rank * (n + 2) + other + 1
        elif have == depth:
            exact = rank.copy()
        else:
            exact = None
        if exact is not None:
            by_depth = exact
        key = rank * (n + 2) + np.concatenate((rank[have:], np.full(min(have, n), -1, np.int64)))[:n] + 1
        sa = np.argsort(key, kind="stable")
        s = key[sa]
        rank = np.empty(n, np.int64)
        rank[sa] = np.concatenate(([0], np.cumsum(s[1:] != s[:-1])))
        have *= 2
    v = by_depth[sa]
    marks = np.concatenate(([True], v[1:] != v[:-1]))
    return sa, marks


def matching_windows(rows: np.ndarray, reach: np.ndarray, first: np.ndarray, left: int, window: int):
    """(row, before, after, doc) of every run of windows of the contexts with the
    smallest document that holds it."""
    n, width = rows.shape
    before, after = reach[:, 0].astype(np.int64), reach[:, 1].astype(np.int64)
    col = np.arange(width)
    inside = (col >= left - before[:, None]) & (col < left + after[:, None])
    _, code = np.unique(rows, return_inverse=True)
    code = np.where(inside, code.reshape(rows.shape) + 1, 0)  # 0: separator
    text = np.concatenate((code, np.zeros((n, 1), np.int64)), 1).ravel()
    sa, marks = suffix_array(text, window)
    index = FMIndex(text, sa)
    begin = np.flatnonzero(marks)
    group = np.cumsum(marks) - 1
    size = np.diff(np.concatenate((begin, [len(sa)])))
    least = np.minimum.reduceat(first[sa // (width + 1)], begin)  # smallest document of each window interval
    lo, hi = np.zeros(n, np.int64), np.full(n, len(sa), np.int64)
    matched = np.zeros(n, np.int64)
    doc = np.full((n, width), -1, np.int64)
    seen = np.zeros((n, width), bool)
    for c in reversed(range(width)):
        live = np.flatnonzero(inside[:, c])
        lo[live], hi[live] = index.step(code[live, c], lo[live], hi[live])
        matched[live] += 1
        full = live[matched[live] >= window]
        g = group[lo[full]]
        lo[full], hi[full] = begin[g], begin[g] + size[g]  # widen to what shares the window
        doc[full, c], seen[full, c] = least[g], True
    new = seen & np.concatenate((np.ones((n, 1), bool), (doc[:, 1:] != doc[:, :-1]) | ~seen[:, :-1]), 1)
    last = seen & np.concatenate(((doc[:, 1:] != doc[:, :-1]) | ~seen[:, 1:], np.ones((n, 1), bool)), 1)
    row, start = np.nonzero(new)
    stop = np.nonzero(last)[1]
    return row, left - start, stop + window - left, doc[row, start]


def remove_repeated_words(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text",
                          with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, spans (removed
    [start, end) words), kept_sha256 and, with ``with_text``, the kept words joined by spaces."""
    if window < K:
        raise ValueError(f"window must be at least {K}")
    left = window - K
    out = repeats(docs, "words", window, K, lambda *a: matching_windows(*a, left, window), id_col, text_col, with_text)
    cols = [F.col("id").alias("doc_id"), F.col("n_units").alias("n_words"), "n_removed", "spans", "kept_sha256"]
    return out.select(*cols, *(["text"] if with_text else []))
