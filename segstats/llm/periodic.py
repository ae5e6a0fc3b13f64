"""Periodic runs of words by a dictionary of basic factors (operator 11).

A run is a maximal stretch of words of one text that has a smallest period q, at least
``times`` periods and at least ``min_words`` words. The dictionary of basic factors names the factors of length
1, 2, 4, ... at every position: a factor of length 2k is the pair of the names of its
halves. Per length, each position's successor is the next position with the same name.
Two occurrences within twice the length (a gap of at most the length) overlap or touch,
so they continue as an arithmetic progression, and the gap is proposed as a period. Neighbouring
positions with one gap are one proposal: the gap is the smallest period there (a
factor at least as long as a period recurs nowhere inside it), and extended to where the
gap ends the stretch is maximal. A run of three periods shows at the first length that is
no shorter than its period; longer lengths show it again, so proposals are deduplicated.
Positions whose factor occurs once in the text leave the dictionary, so ordinary prose
costs a few short rounds.

Words are compared by 64-bit hashes. The texts of a chunk (``CHUNK`` bytes, or one longer
text) share one dictionary; names never cross texts. The memory of a task is some ten
times its chunk.

Defined results: null, empty and white texts have no words and no runs; a text of one
word repeated is a run of period 1; runs of different periods may overlap; repeated rows
give equal rows; null ids are kept; an empty table gives an empty result; other columns
of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segstats.llm.blocks import utf8_parts, word_hashes, word_spans

CHUNK = 4 << 20


def _by_hash(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The positions ``at`` in order of (hash, position)."""
    bits = np.uint64(max(1, int(len(h)).bit_length()))
    top = h[at] >> bits << bits
    order = (np.sort(top | at.astype(np.uint64)) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    x = h[order]
    if ((x[1:] >> bits == x[:-1] >> bits) & (x[1:] != x[:-1])).any():  # equal in the first bits only
        return at[np.argsort(h[at], kind="stable")]
    return order


def _by_pair(a: np.ndarray, b: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of ``at`` by (a, b, position), is each place the first of a pair?)."""
    names = int(max(a.max(), b.max())) + 1
    if names * names * n < 2**63:
        x = np.sort((a.astype(np.int64) * names + b) * n + at)
        order, key = x % n, x // n
        return order, np.concatenate(([True], key[1:] != key[:-1]))
    o = np.lexsort((at, b, a))
    return at[o], np.concatenate(([True], (a[o][1:] != a[o][:-1]) | (b[o][1:] != b[o][:-1])))


def find_runs(h: np.ndarray, first: np.ndarray, min_words: int = 24, times: int = 3) -> np.ndarray:
    """(start, length, period) rows by start and period. ``h``: word hashes of texts one
    after the other; ``first``: first word of each text (length texts + 1)."""
    if times < 3:
        raise ValueError("runs of less than three periods need not show in the dictionary")
    size_of = np.diff(first)
    end = np.repeat(first[1:], size_of).astype(np.int32)
    at = np.flatnonzero(np.repeat(size_of >= min_words, size_of))
    longest, found, k = int(size_of.max(initial=0)), [], 1
    if not len(at):
        return np.zeros((0, 3), np.int64)
    order = _by_hash(h, at)
    head = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (end[order][1:] != end[order][:-1])))
    while True:
        again = np.flatnonzero(~head)  # the place before holds the same factor
        i = order[again - 1]
        gap = order[again] - i
        near = gap <= k
        found.append(_stretches(i[near], gap[near], k, min_words, times))
        if times * (k + 1) > longest:  # the next length shows periods above k
            break
        many = ~head
        many[again - 1] = True
        order, name = order[many], np.cumsum(head[many]) - 1
        names = np.full(len(h), -1, np.int32)
        names[order] = name
        inside = order + k < end[order]
        order, name = order[inside], name[inside]
        other = names[order + k]
        order, name, other = order[other >= 0], name[other >= 0], other[other >= 0]
        if not len(order):
            break
        order, head = _by_pair(name, other, order, len(h))
        k *= 2
    return np.unique(np.concatenate(found), axis=0)[:, [0, 2, 1]]


def _stretches(i: np.ndarray, gap: np.ndarray, k: int, min_words: int, times: int) -> np.ndarray:
    """(start, period, length) of neighbouring positions with one gap."""
    if not len(i):
        return np.zeros((0, 3), np.int64)
    o = np.argsort(i)
    i, gap = i[o], gap[o]
    edge = np.flatnonzero(np.concatenate(([True], (np.diff(i) != 1) | (np.diff(gap) != 0), [True])))
    start, last, q = i[edge[:-1]], i[edge[1:] - 1], gap[edge[:-1]]
    length = last - start + k + q
    ok = length >= np.maximum(min_words, times * q)
    return np.column_stack((start, q, length))[ok].astype(np.int64)


def _collapsed(data: np.ndarray, off: np.ndarray, s: np.ndarray, e: np.ndarray, first: np.ndarray, runs: np.ndarray) -> list[bytes]:
    """The words of each text that no run repeats, joined by one space."""
    depth = np.zeros(len(s) + 1, np.int32)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(depth[:-1]) == 0)
    out, mask = data.copy(), np.zeros(len(data) + 1, np.int8)
    mask[s[kept]] = 1
    np.add.at(mask, e[kept], -1)
    mask = np.cumsum(mask[:-1], dtype=np.int8).view(bool)
    edge = np.searchsorted(kept, first)  # a text's first kept word has no space before it
    behind = np.delete(kept, edge[:-1][edge[:-1] < edge[1:]])
    out[s[behind] - 1], mask[s[behind] - 1] = 0x20, True
    size = (e - s)[kept] + 1
    total = np.concatenate(([0], np.cumsum(size)))[edge]
    n = np.diff(total) - (np.diff(edge) > 0)
    text, cut = out[mask].tobytes(), np.concatenate(([0], np.cumsum(n)))
    return [text[a:b] for a, b in zip(cut[:-1], cut[1:])]


def periodic_runs(docs: DataFrame, min_words: int = 24, times: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, runs (array of start, length, period by
    start and period; words from 0), collapsed (the text without repeated periods)."""
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off, data = utf8_parts(b.column(1))
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(off, off[lo] + CHUNK, "right")) - 1)
                o, d = off[lo:hi + 1] - off[lo], data[off[lo]:off[hi]]
                s, e, first = word_spans(o, d)
                runs = find_runs(word_hashes(d, s, e), first, min_words, times)
                text = _collapsed(d, o, s, e, first, runs)
                begin = np.searchsorted(runs[:, 0], first)
                own = np.repeat(first[:-1], np.diff(begin))
                rows = pa.StructArray.from_arrays([pa.array(runs[:, 0] - own), pa.array(runs[:, 1]), pa.array(runs[:, 2])],
                                                  fields=list(run_type))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(np.diff(first).astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), rows), pa.array(text, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "runs", "collapsed"])
                lo = hi

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def best_run(runs: Column) -> Column:
    """The run of greatest length / period (compared exactly; ties: smallest start, then period), or null."""
    def better(a: Column, b: Column) -> Column:  # runs come by start and period: the first of equals stays
        return F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)
    return F.reduce(runs, F.get(runs, F.lit(0)), better)
