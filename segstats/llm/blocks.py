"""Blocks of documents and keyed exchanges between them.

Several operators ask, for very many small keys of every document (windows,
words, set signatures), something that depends on all documents holding the
same key. A row per key would shuffle many times the input, so documents are
packed into *blocks* (some MB of text each, one row, compressed), a block sends
one packed array of its *distinct* keys to each key bucket, the bucket answers
with one packed array per block, and the block reads its answers beside its
own text. A key that occurs in a third of all rows is one entry per block, so
no bucket receives more than (number of blocks) entries for it.

All three steps are ordinary Spark stages (``mapInArrow``, ``groupBy`` +
``applyInPandas``, ``cogroup``); blocks live in a parquet table in
``spark.checkpoint.dir``, so lost executors only cost the retry of their tasks.
"""

from __future__ import annotations

import ctypes
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segstats.session import cut_lineage

BLOCK_BYTES = 4 << 20
PLACE_BITS = 20  # bits of a block's number in its partition, and of a document's number in its block
LAST = np.int64(2**63 - 1)  # a null doc_id sorts after every other


def release() -> None:
    """Give memory that a finished task no longer uses back to the system: Python workers live
    on and serve other stages beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def pack(obj, level: int = 1) -> bytes:
    """Pickle (numpy arrays) and compress."""
    return zstandard.ZstdCompressor(level=level).compress(pickle.dumps(obj, protocol=5))


def unpack(data: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def utf8_parts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets int64, bytes uint8) of an Arrow string / binary column; nulls are empty."""
    col = col.cast(pa.large_binary()) if col.null_count == 0 else pa.array(
        [b"" if v is None else v for v in col.cast(pa.binary()).to_pylist()], pa.large_binary())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[off[0]:off[-1]] if buf is not None and len(off) > 1 else np.empty(0, np.uint8)
    return off - off[0], data


def pack_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", flag: F.Column | None = None) -> DataFrame:
    """(block, n_bytes, data): every document once; data unpacks to
    (ids int64, null-id mask, offsets int64, UTF-8 bytes uint8, flags int64).
    Block ids are (partition << PLACE_BITS) + number; a block holds at most
    2**PLACE_BITS documents."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       (F.lit(0) if flag is None else flag).cast("long").alias("flag"))

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = TaskContext.get().partitionId() << PLACE_BITS
        end = seq + (1 << PLACE_BITS)
        for b in batches:
            if not b.num_rows:
                continue
            off, data = utf8_parts(b.column(1))
            null = np.asarray(b.column(0).is_null())
            ids = np.asarray(b.column(0).fill_null(int(LAST)))
            flags = np.asarray(b.column(2))
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(off, off[lo] + BLOCK_BYTES, "right")) - 1)
                hi = min(hi, lo + (1 << PLACE_BITS))
                if seq == end:
                    raise ValueError(f"a partition of the input has more than {1 << PLACE_BITS} blocks: split it")
                part = (ids[lo:hi], null[lo:hi], off[lo:hi + 1] - off[lo], data[off[lo]:off[hi]], flags[lo:hi])
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([seq], pa.int64()), "n_bytes": pa.array([int(off[hi] - off[lo])], pa.int64()),
                    "data": pa.array([pack(part, 6)], pa.binary())})
                seq, lo = seq + 1, hi
        release()

    return cut_lineage(slim.mapInArrow(to_blocks, "block long, n_bytes long, data binary"))


def place(block: int, doc: np.ndarray) -> np.ndarray:
    """One non-negative number for each document of a block, different from those of all other blocks."""
    if not 0 <= block < 1 << (63 - PLACE_BITS):
        raise ValueError(f"block {block}: more than {1 << (63 - 2 * PLACE_BITS)} partitions of input: merge some")
    return (np.int64(block) << PLACE_BITS) + doc


def total_bytes(blocks: DataFrame) -> int:
    return int(blocks.agg(F.sum("n_bytes")).first()[0] or 0)


def send(blocks: DataFrame, emit: Callable[[int, tuple], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """(bucket, block, data): what each block sends to each bucket."""

    def run(frames):
        for f in frames:
            for block, data in zip(f["block"], f["data"]):
                rows = list(emit(int(block), unpack(data)))
                if rows:
                    yield pd.DataFrame({"bucket": [r[0] for r in rows], "block": int(block), "data": [r[1] for r in rows]})
        release()

    return blocks.select("block", "data").mapInPandas(run, "bucket long, block long, data binary")


def answer(sent: DataFrame, reduce: Callable[[list[int], list], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """(block, bucket, data): per bucket, ``reduce(blocks, payloads)`` yields
    (position in the list, packed answer)."""

    def run(key, f):
        f = f.sort_values("block", ignore_index=True)
        names = [int(b) for b in f["block"]]
        rows = list(reduce(names, [unpack(d) for d in f["data"]]))
        release()
        return pd.DataFrame({"block": [names[i] for i, _ in rows], "bucket": key[0], "data": [d for _, d in rows]})

    return sent.groupBy("bucket").applyInPandas(run, "block long, bucket long, data binary")


def with_answers(blocks: DataFrame, answers: DataFrame, fn: Callable[[int, tuple, dict], pd.DataFrame], schema: str) -> DataFrame:
    """Per block, ``fn(block, docs, {bucket: answer})`` as rows of ``schema``."""

    def run(key, left, right):
        out = fn(int(key[0]), unpack(left["data"].iloc[0]),
                 {int(b): unpack(d) for b, d in zip(right["bucket"], right["data"])})
        release()
        return out

    return (blocks.select("block", "data").groupBy("block")
            .cogroup(answers.groupBy("block")).applyInPandas(run, schema))


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit keys (every input bit reaches every output bit)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))
_STEP = np.uint64(0xB5297A4D3F84D5B5)  # odd, so it has an inverse modulo 2**64
_STEP_INV = np.uint64(pow(0xB5297A4D3F84D5B5, -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n + 1, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


_FIXED = 1 << 15
_POW, _POW_INV = _powers(_STEP, _FIXED), _powers(_STEP_INV, _FIXED)


def word_spans(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word ``[^\\x20\\x09-\\x0D]+`` (words end with
    their document), and for every document the index of its first word
    (length n + 1)."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[off] = True  # a document begins (or all end) here
    starts = inside & np.concatenate(([True], ~inside[:-1] | first[1:-1]))
    ends = inside & np.concatenate((~inside[1:] | first[1:-1], [True]))
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, off)


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: a polynomial in random byte values modulo
    2**64 read from prefix sums, then mixed. Equal words hash alike wherever
    they stand; different words collide with probability about 2**-64."""
    out = np.empty(len(s), np.uint64)
    i = 0
    while i < len(s):  # slices keep the power tables small
        base = s[i]
        j = max(i + 1, int(np.searchsorted(e, base + _FIXED, "right")))
        if e[j - 1] - base > _FIXED:  # one very long word
            n = int(e[i] - base)
            v = np.uint64(np.sum(_BYTE[data[base:e[i]]] * _powers(_STEP, n)[:n]))
            out[i] = v + np.uint64(n)
            i += 1
            continue
        n = int(e[j - 1] - base)
        c = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data[base:e[j - 1]]] * _POW[:n])))
        a, b = s[i:j] - base, e[i:j] - base
        out[i:j] = (c[b] - c[a]) * _POW_INV[a] + (b - a).astype(np.uint64)
        i = j
    return mix64(out)


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Bucket by the low 17 bits (at most 131,072 buckets)."""
    return ((h & np.uint64(0x1FFFF)) * np.uint64(n)) >> np.uint64(17)


def by_bucket(keys: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions in ``keys``) for every bucket that has keys, positions in order."""
    b = bucket_of(keys, n).astype(np.int64)
    order = np.argsort(b, kind="stable")
    edges = np.flatnonzero(np.diff(b[order])) + 1
    for part in np.split(order, edges):
        if len(part):
            yield int(b[part[0]]), part


def doc_of(off: np.ndarray) -> np.ndarray:
    """Document index of every unit, from offsets."""
    return np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until no column of ``df`` has one of them."""
    taken = {c.lower() for c in df.columns}
    mark = "_"
    while any(f"{mark}{n}".lower() in taken for n in names):
        mark += "_"
    return [f"{mark}{n}" for n in names]
