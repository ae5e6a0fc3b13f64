"""Shared parts of the exact repeat operators (bytes: suffix_dedup, words: fm_dedup).

A window of ``length`` units always contains the smallest of its k-gram hashes.
Positions that are smallest in some window are *anchors* (about one in nine
words, one in eighteen bytes); equal windows have equal anchors at equal offsets. So:

1. every block sends its distinct anchor hashes to hash buckets, which answer
   one bit each: does another document hold it?
2. for shared anchors, a block sends the distinct *contexts* (all units that a
   window through the anchor can reach) with the smallest doc_id that has them;
   the bucket resolves which stretches of each context also occur in which
   smallest document (this is where the operators' index structures work);
3. the block marks the stretches whose smallest document precedes its own.

Nothing is sampled: every window has an anchor, all occurrences take part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segstats.llm.blocks import (
    LAST, answer, bucket_of, by_bucket, doc_of, mix64, pack, pack_blocks, send, total_bytes, with_answers, word_hashes,
    word_spans, _BYTE,
)
from segstats.session import cut_lineage

SLICE = 1 << 17
BUCKET_BYTES = 16 << 20  # text bytes whose keys meet in one bucket


def _sliding(x: np.ndarray, n: int, op) -> np.ndarray:
    """op over every run of n neighbours (length len(x) - n + 1), by doubling."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = op(x[:-step], x[step:])
        have += step
    return x


def anchors(units: np.ndarray, end: np.ndarray, k: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors. ``units``: 64-bit hash per unit, or bytes;
    ``end``: for each unit the end of its document; k is a power of two."""
    pos, val = [], []
    w = length - k + 1
    n = len(units)
    seen = -1
    for lo in range(0, max(0, n - length + 1), SLICE):
        hi = min(n, lo + SLICE + 2 * length)  # windows that start in [lo, lo + SLICE + length]
        h = units[lo:hi] if units.dtype != np.uint8 else _BYTE[units[lo:hi]]
        step = 1
        while step < k:
            h = mix64(h[:-step] * np.uint64(0xA0761D6478BD642F) + h[step:])
            step *= 2
        starts = np.arange(lo, hi - length + 1)
        least = _sliding(h, w, np.minimum)[:len(starts)]
        least = np.where(end[starts] - starts >= length, least, np.uint64(0))
        # the largest of the minima over the windows that hold position j
        padded = np.concatenate((np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)))
        top = _sliding(padded, w, np.maximum)[:len(h)]
        j = np.flatnonzero((top == h) & (h != 0))
        # the first w positions of a later slice were judged with all their windows before
        keep = j + lo > seen
        j = j[keep]
        # positions whose last windows lie in the next slice are judged there
        limit = hi - lo - length if hi < n else len(h)
        j = j[j < limit]
        pos.append(j + lo)
        val.append(h[j])
        seen = max(seen, lo + limit - 1)
    if not pos:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(pos), np.concatenate(val)


def pack_keys(key: np.ndarray) -> bytes:
    """Keys below 2**48, six bytes each."""
    return pack(np.ascontiguousarray(key).view(np.uint8).reshape(-1, 8)[:, :6].tobytes())


def shared_bits(names, parts):
    """Answer one bit for each key of each block: does another holder exist? (lowest
    bit of a key: several holders in its own block)"""
    raw = [np.frombuffer(p, np.uint8).reshape(-1, 6) for p in parts]
    size = [len(r) for r in raw]
    wide = np.zeros((sum(size), 8), np.uint8)
    wide[:, :6] = np.concatenate(raw)
    key = wide.view(np.uint64).ravel()
    order = np.argsort(key >> np.uint64(1), kind="stable")
    s = key[order] >> np.uint64(1)
    same = s[1:] == s[:-1]
    more = (key[order] & np.uint64(1)).astype(bool)
    more[1:] |= same
    more[:-1] |= same
    shared = np.empty(len(key), bool)
    shared[order] = more
    for i, part in enumerate(np.split(shared, np.cumsum(size)[:-1])):
        yield i, pack(np.packbits(part))


class Units:
    """The units of one block. kind 'bytes' or 'words'."""

    def __init__(self, kind: str, docs: tuple):
        self.ids, self.null, byte_off, self.data, _ = docs
        if kind == "bytes":
            self.off, self.values = byte_off, self.data
        else:
            self.s, self.e, self.off = word_spans(byte_off, self.data)
            self.values = word_hashes(self.data, self.s, self.e)
        self.doc = doc_of(self.off)
        edges = self.off.astype(np.int32)
        self.end = edges[1:][self.doc] if len(self.doc) else np.empty(0, np.int32)
        self.begin = edges[:-1][self.doc] if len(self.doc) else np.empty(0, np.int32)


def contexts(u: Units, at: np.ndarray, left: int, right: int) -> tuple[np.ndarray, np.ndarray]:
    """Units [at - left, at + right) of each anchor, zero outside its document;
    and (units before, units from the anchor on) within the document."""
    idx = at[:, None] + np.arange(-left, right)
    inside = (idx >= u.begin[at][:, None]) & (idx < u.end[at][:, None])
    rows = np.where(inside, u.values[np.clip(idx, 0, len(u.values) - 1)], u.values.dtype.type(0))
    reach = np.stack((np.minimum(left, at - u.begin[at]), np.minimum(right, u.end[at] - at)), 1).astype(np.uint8)
    return rows, reach


def distinct_rows(rows: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first of each distinct row, inverse)."""
    whole = np.concatenate((np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1), reach), 1)
    v = np.ascontiguousarray(whole).view(np.dtype((np.void, whole.shape[1]))).ravel()
    _, first, inverse = np.unique(v, return_index=True, return_inverse=True)
    return first, inverse


def _key48(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(17) << np.uint64(1)


def repeats(docs: DataFrame, kind: str, length: int, k: int, resolve: Callable, id_col: str = "doc_id",
            text_col: str = "text", with_text: bool = False, min_buckets: int = 4) -> DataFrame:
    """Per document: ``n_units, n_removed, spans`` (removed [start, end) in
    units), ``kept_sha256`` and, if asked for, the kept ``text`` (bytes).

    ``resolve(rows, reach, first)`` gets the distinct contexts of a bucket with
    the smallest doc_id of each and returns (row, before, after, doc) arrays:
    the units [anchor - before, anchor + after) of context ``row`` also occur in
    document ``doc``, the smallest such.
    """
    left, right = length - k, length
    blocks = pack_blocks(docs, id_col, text_col)
    n = max(min_buckets, min(1 << 17, -(-total_bytes(blocks) // BUCKET_BYTES)))

    def block_keys(u: Units):
        """Anchor positions and hashes, and per bucket its distinct 47-bit keys
        (shifted, lowest bit: several documents of the block hold it)."""
        at, h = anchors(u.values, u.end, k, length)
        per = {}
        for b, i in by_bucket(h, n):
            key, inv = np.unique(_key48(h[i]), return_inverse=True)
            d = u.ids[u.doc[at[i]]]
            lo = np.full(len(key), LAST, np.int64)
            hi = np.full(len(key), np.iinfo(np.int64).min, np.int64)
            np.minimum.at(lo, inv, d)
            np.maximum.at(hi, inv, d)
            per[b] = (i, inv, key | (lo != hi).astype(np.uint64))
        return at, h, per

    def emit_keys(block, d):
        _, _, per = block_keys(Units(kind, d))
        for b, (_, _, key) in per.items():
            yield b, pack_keys(key)

    def shared_anchors(u: Units, bits: dict):
        at, h, per = block_keys(u)
        keep = np.zeros(len(at), bool)
        for b, (i, inv, key) in per.items():
            keep[i] = np.unpackbits(bits[b], count=len(key)).astype(bool)[inv]
        return at[keep], h[keep]

    def block_contexts(u: Units, at, h):
        for b, i in by_bucket(h, n):
            rows, reach = contexts(u, at[i], left, right)
            first, inv = distinct_rows(rows, reach)
            low = np.full(len(first), LAST, np.int64)
            np.minimum.at(low, inv, u.ids[u.doc[at[i]]])
            yield b, i, inv, rows[first], reach[first], low

    def emit_contexts(block, d, bits):
        u = Units(kind, d)
        at, h = shared_anchors(u, bits)
        out = [(b, pack((rows, reach, low), 3)) for b, _, _, rows, reach, low in block_contexts(u, at, h)]
        return pd.DataFrame({"bucket": [b for b, _ in out], "block": block, "data": [v for _, v in out]})

    def resolve_bucket(names, parts):
        rows, reach = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        low = np.concatenate([p[2] for p in parts])
        first, inv = distinct_rows(rows, reach)
        least = np.full(len(first), LAST, np.int64)
        np.minimum.at(least, inv, low)
        row, before, after, doc = resolve(rows[first], reach[first], least)
        order = np.argsort(row, kind="stable")
        row, before, after, doc = row[order], before[order], after[order], doc[order]
        start = np.searchsorted(row, np.arange(len(first) + 1))
        at = 0
        for i, p in enumerate(parts):
            mine = inv[at:at + len(p[0])]
            at += len(mine)
            count = start[mine + 1] - start[mine]
            src = np.repeat(start[mine] - np.cumsum(count) + count, count) + np.arange(count.sum())
            yield i, pack((np.repeat(np.arange(len(mine), dtype=np.int32), count), before[src].astype(np.uint8),
                           after[src].astype(np.uint8), doc[src]))

    def finish(block, d, answers):
        u = Units(kind, d)
        bits = {-1 - b: v for b, v in answers.items() if b < 0}
        delta = np.zeros(len(u.values) + 1, np.int32)
        if bits:
            at, h = shared_anchors(u, bits)
            for b, i, inv, _, _, _ in block_contexts(u, at, h):
                row, before, after, doc = answers[b]
                start = np.searchsorted(row, np.arange(inv.max() + 2))
                count = start[inv + 1] - start[inv]
                src = np.repeat(start[inv] - np.cumsum(count) + count, count) + np.arange(count.sum())
                a = np.repeat(at[i], count)
                earlier = doc[src] < u.ids[u.doc[a]]
                a, src = a[earlier], src[earlier]
                np.add.at(delta, a - before[src], 1)
                np.add.at(delta, a + after[src], -1)
        gone = np.cumsum(delta[:-1], dtype=np.int32) > 0
        raw = u.data.tobytes()
        out = []
        for j in range(len(u.ids)):
            lo, hi = int(u.off[j]), int(u.off[j + 1])
            g = gone[lo:hi]
            edge = np.flatnonzero(np.diff(np.concatenate(([0], g.view(np.int8), [0]))))
            if kind == "bytes":
                kept = (u.data[lo:hi][~g] if len(edge) else u.data[lo:hi]).tobytes()
            else:
                keep = np.flatnonzero(~g) + lo
                kept = b" ".join([raw[s:e] for s, e in zip(u.s[keep].tolist(), u.e[keep].tolist())])
            out.append((None if u.null[j] else int(u.ids[j]), hi - lo, int(g.sum()),
                        [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])],
                        hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        return pd.DataFrame(out, columns=["id", "n_units", "n_removed", "spans", "kept_sha256", "text"])

    bits = cut_lineage(answer(send(blocks, emit_keys), shared_bits))  # one bit for each key; used twice
    entries = answer(with_answers(blocks, bits, emit_contexts, "bucket long, block long, data binary"), resolve_bucket)
    answers = entries.unionByName(bits.select("block", (-1 - F.col("bucket")).alias("bucket"), "data"))
    return with_answers(blocks, answers, finish, "id long, n_units long, n_removed long, "
                        "spans array<struct<start:long,end:long>>, kept_sha256 string, text binary")
