"""Exact substring dedup by enhanced suffix arrays (operator 2).

``remove_repeated_bytes(docs, min_bytes)`` removes from every document each
byte covered by a string of ``min_bytes`` bytes that also starts in a document
with a smaller doc_id. Documents are whole UTF-8 texts; matches never cross
documents and are judged on the input.

Within a bucket of ``repeats`` the suffixes that begin at shared anchors are
sorted (a sparse suffix array), neighbours' common prefixes are computed, and
a stack scan walks the common-prefix interval tree. An interval [i, j] of depth
p whose members differ in what precedes them splits by the common-suffix
intervals of their left sides; a class with left extension q and q + p >=
min_bytes that is right-diverse (its members fall into several children of the
interval) and left-diverse (it is a maximal interval on the left) is a maximal
repeat with all of its occurrences. Each occurrence learns the group's smallest
document.

Defined results: null or empty text and texts shorter than ``min_bytes`` lose
nothing; a null doc_id sorts after all others; rows with the same doc_id are
one document (neither precedes the other) and each gives a result row; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segstats.llm.repeats import repeats

K = 16  # bytes of an anchor


def _common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row pair, at most ``most``."""
    diff = a != b
    return np.minimum(np.where(diff.any(1), diff.argmax(1), a.shape[1]), most)


def intervals(depth: list[int], least: int) -> list[tuple[int, int, int, list[int]]]:
    """Stack scan over neighbours' common-prefix lengths: (depth, first, last,
    first elements of the children after the first) of every interval of the
    tree with depth >= least and at least two elements."""
    out, stack = [], []  # stack: [depth, first, splits]
    for i, d in enumerate([*depth, -1]):
        first = i
        while stack and stack[-1][0] > d:
            p, first, splits = stack.pop()
            if p >= least:
                out.append((p, first, i, splits))
        if stack and stack[-1][0] == d:
            stack[-1][2].append(i + 1)
        elif d >= least:
            stack.append([d, first, [i + 1]])
    return out


def maximal_repeats(rows: np.ndarray, reach: np.ndarray, first: np.ndarray, left: int, length: int):
    """(row, before, after, doc) of every occurrence of every maximal repeat of
    at least ``length`` bytes through the anchors; ``first``: smallest document of each row."""
    n = len(rows)
    before, after = reach[:, 0].astype(np.int64), reach[:, 1].astype(np.int64)
    own = np.flatnonzero(before + after >= length)
    out = [(own, before[own], after[own], first[own])]
    if n < 2:
        return tuple(np.concatenate(c) for c in zip(*out))
    right_part, left_part = rows[:, left:], rows[:, :left][:, ::-1]
    as_void = lambda m: np.ascontiguousarray(m).view(np.dtype((np.void, m.shape[1]))).ravel()
    sa = np.argsort(as_void(np.concatenate((right_part, left_part), 1)), kind="stable")
    r = right_part[sa]
    lcp = _common(r[1:], r[:-1], np.minimum(after[sa[1:]], after[sa[:-1]]))
    # suffixes in the order of (anchor, left side): neighbours there share the longest left sides
    by_left = np.argsort(as_void(np.concatenate((right_part[:, :K], left_part), 1)), kind="stable")
    m = left_part[by_left]
    lcs = _common(m[1:], m[:-1], np.minimum(before[by_left[1:]], before[by_left[:-1]]))
    lcs[(right_part[by_left[1:], :K] != right_part[by_left[:-1], :K]).any(1)] = -1
    most_right, most_left = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for order, c, most in ((sa, lcp, most_right), (by_left, lcs, most_left)):
        np.maximum.at(most, order[1:], c)
        np.maximum.at(most, order[:-1], c)
    live = (most_right >= K) & (most_right + most_left >= length)  # no others can be in a group
    rank_left = np.empty(n, np.int64)
    rank_left[by_left] = np.arange(n)
    sa = sa[live[sa]]
    if len(sa) < 2:
        return tuple(np.concatenate(c) for c in zip(*out))
    r = right_part[sa]
    lcp = _common(r[1:], r[:-1], np.minimum(after[sa[1:]], after[sa[:-1]]))
    found = []
    for p, i, j, splits in intervals(lcp.tolist(), K):
        members = sa[i:j + 1]
        child = np.zeros(len(members), np.int64)
        child[np.array(splits) - i] = 1
        child = np.cumsum(child)
        order = np.argsort(rank_left[members])
        members, child = members[order], child[order]
        x = left_part[members]
        q = _common(x[1:], x[:-1], np.minimum(before[members[1:]], before[members[:-1]]))
        for e, a, b, _ in intervals(q.tolist(), max(0, length - p)):
            if (child[a:b + 1] != child[a]).any():  # right-diverse; e is where the left sides part
                group = members[a:b + 1]
                found.append((group, e, p, int(first[group].min())))
    if found:
        size = [len(g) for g, *_ in found]
        out.append((np.concatenate([g for g, *_ in found]), *(np.repeat([f[c] for f in found], size) for c in (1, 2, 3))))
    row, b, a, d = (np.concatenate(c) for c in zip(*out))
    gain = (d < first[row]) | (np.arange(len(row)) < len(own))  # a later group member's document adds nothing
    return row[gain], b[gain], a[gain], d[gain]


def remove_repeated_bytes(docs: DataFrame, min_bytes: int = 50, id_col: str = "doc_id", text_col: str = "text",
                          with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, spans
    (removed [start, end) bytes), kept_sha256 and, with ``with_text``, the kept bytes."""
    if min_bytes < K:
        raise ValueError(f"min_bytes must be at least {K}")
    left = min_bytes - K
    out = repeats(docs, "bytes", min_bytes, K, lambda *a: maximal_repeats(*a, left, min_bytes), id_col, text_col, with_text)
    cols = [F.col("id").alias("doc_id"), F.col("n_units").alias("n_bytes"), "n_removed",
            F.size("spans").cast("long").alias("n_spans"), "spans", "kept_sha256"]
    return out.select(*cols, *(["text"] if with_text else []))
