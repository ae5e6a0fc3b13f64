"""Exact top-k search by term-at-a-time accumulation (operator 13).

Rows are sparse vectors of whole numbers: a weight per term (position), zeros left out.
Candidates are packed into blocks; a block is inverted into postings (per term the rows
that have it, and their weights). A group of queries meets a block: term by term the
postings, times the queries' weights, are scattered into a dense array of scores
(queries x rows of the block), and a partition selection keeps the ``k`` best of each
query. The partial lists are merged by a window that keeps k rows a query before its
shuffle. Every candidate is scored, so the result is exact.

Blocks and groups meet on a grid: stripes of blocks by stripes of groups, one cell a
task. The number of cells follows the cores as long as a cell stays below ``CELL`` blocks
and groups, so a task holds a bounded part of both sides, and a larger table makes more
cells, not larger ones. Neither side is broadcast.

Scores are exact: 32- or 64-bit sums where the largest possible sum fits, else Python's
integers, which travel as two longs. A score beyond the range of long ranks by its value
(up to 2**126) and is given as the end of the range.

Defined results: rows with a null id, null weights or a null weight take no part; a row
without terms scores 0; positions that the other row does not have count 0; every row
with the query's id is the query's own; each repeated row is a candidate and a query of
its own; ties go to the smaller id; fewer candidates than k give them all; an empty table
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segstats.llm.blocks import pack, unpack
from segstats.session import cut_lineage

BLOCK_ROWS = 4096
GROUP_ROWS = 256
CELL = 64
LOWEST, HIGHEST = -2**63, 2**63 - 1


def quantized(vector: F.Column, scale: int = 256) -> F.Column:
    """floor(scale * x) of every component, or null if the vector is null or holds a
    null or non-finite component. Values beyond the range of long become its ends."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(sound, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _narrow(x: np.ndarray) -> np.ndarray:
    for kind in (np.int8, np.int16, np.int32):
        if not len(x) or (x.min() >= np.iinfo(kind).min and x.max() <= np.iinfo(kind).max):
            return x.astype(kind)
    return x


def _packed(rows: DataFrame, most: int) -> DataFrame:
    """(part, data): at most ``most`` rows each; data unpacks to (ids, number of terms of
    each row, weights of all rows), rows by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for b in batches:
            for lo in range(0, b.num_rows, most):
                x = b.slice(lo, min(most, b.num_rows - lo))
                order = np.argsort(np.asarray(x.column(0)), kind="stable")
                x = x.take(pa.array(order))
                size = np.diff(np.asarray(x.column(1).offsets)).astype(np.int32)
                data = pack((np.asarray(x.column(0)), size, _narrow(np.asarray(x.column(1).flatten()))))
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([data], pa.binary())], ["part", "data"])
                part += 1

    return rows.mapInArrow(run, "part long, data binary")


class Postings:
    """Rows and weights of each term; ``terms`` ascending, ``cut`` their places in ``rows`` and ``weights``."""

    def __init__(self, size: np.ndarray, weights: np.ndarray):
        row = np.repeat(np.arange(len(size), dtype=np.int32), size)
        term = np.arange(len(weights)) - np.repeat(np.cumsum(size, dtype=np.int64) - size, size)
        some = np.flatnonzero(weights)
        some = some[np.argsort(term[some], kind="stable")]
        self.n, self.rows, self.weights = len(size), row[some], weights[some]
        self.terms, start = np.unique(term[some], return_index=True)
        self.cut = np.append(start, len(some))
        self.most = max(int(self.weights.max()), -int(self.weights.min())) if len(some) else 0

    def of(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        i = int(np.searchsorted(self.terms, t))
        lo, hi = (self.cut[i], self.cut[i + 1]) if i < len(self.terms) and self.terms[i] == t else (0, 0)
        return self.rows[lo:hi], self.weights[lo:hi]


def accumulate(queries: Postings, block: Postings) -> np.ndarray:
    """Scores (query, row of the block) of all pairs."""
    bound = queries.most * block.most * max(1, min(len(queries.terms), len(block.terms)))
    kind = np.int32 if bound < 2**31 else np.int64 if bound < 2**63 else object
    scores = np.zeros((queries.n, block.n), kind)
    for t in queries.terms.tolist():
        rows, w = block.of(t)
        if not len(rows):
            continue
        q, x = queries.of(t)
        add = np.multiply.outer(x.astype(kind), w.astype(kind))
        if len(rows) == block.n and len(q) == queries.n:  # a term that all rows have
            scores += add
        elif len(q) == queries.n:
            scores[:, rows] += add
        else:
            scores[np.ix_(q, rows)] += add
    return scores


def select(scores: np.ndarray, ids: np.ndarray, asked: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(query, places of its ``k`` best rows, ties to the smaller id); rows come by id."""
    for i, x in enumerate(scores):
        lo, hi = np.searchsorted(ids, asked[i]), np.searchsorted(ids, asked[i], "right")
        at = np.arange(len(ids)) if lo == hi else np.delete(np.arange(len(ids)), np.s_[lo:hi])
        x = x[at]
        if len(at) > k:
            least = np.partition(x, len(x) - k)[len(x) - k]
            above, equal = np.flatnonzero(x > least), np.flatnonzero(x == least)
            at = at[np.sort(np.concatenate((above, equal[:k - len(above)])))]
        yield i, at


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "id", weights_col: str = "weights") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of greatest inner product with each
    query, without the rows of the query's own id. Both frames have an id and an
    array<long> of weights by term."""
    def sound(df: DataFrame) -> DataFrame:
        w = F.col(weights_col)
        return df.filter(F.col(id_col).isNotNull() & w.isNotNull() & F.forall(w, lambda x: x.isNotNull())).select(
            F.col(id_col).cast("long").alias("id"), w.cast("array<bigint>").alias("weights"))

    blocks, groups = cut_lineage(_packed(sound(rows), BLOCK_ROWS)), cut_lineage(_packed(sound(queries), GROUP_ROWS))
    nb, ng = blocks.count(), groups.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    side = min(CELL, max(1, int((nb * ng / (4 * cores)) ** 0.5)))
    down, across = -(-nb // side) or 1, -(-ng // side) or 1

    def stripe(n: int) -> F.Column:
        return F.pmod(F.xxhash64("part"), F.lit(n)).cast("int")  # cogroup sends keys of other types to other partitions

    left = blocks.select(stripe(down).alias("r"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("c"), "data")
    right = groups.select(F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("r"), stripe(across).alias("c"), "part", "data")

    def cell(key: tuple, b: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        names = ("part", "i", "query_id", "vec_id", "high", "low")
        out = [[np.empty(0, np.int64)] for _ in names]
        asked = [(part, ids, Postings(size, w)) for part, (ids, size, w) in zip(g["part"], map(unpack, g["data"]))]
        for ids, size, w in map(unpack, b["data"]) if asked else ():
            postings = Postings(size, w)
            for part, own, q in asked:
                scores = accumulate(q, postings)
                for i, at in select(scores, ids, own, k):
                    s = scores[i, at] if scores.dtype == object else scores[i, at].astype(np.int64)
                    high = s >> 63
                    for column, x in zip(out, (part, i, own[i], ids[at], np.clip(high, LOWEST, HIGHEST), s & HIGHEST)):
                        column.append(np.broadcast_to(np.asarray(x, np.int64), len(at)))
        return pd.DataFrame({name: np.concatenate(column) for name, column in zip(names, out)})

    found = left.groupBy("r", "c").cogroup(right.groupBy("r", "c")).applyInPandas(
        cell, "part long, i long, query_id long, vec_id long, high long, low long")
    rank = F.row_number().over(Window.partitionBy("part", "i").orderBy(F.desc("high"), F.desc("low"), "vec_id"))
    score = F.when(F.col("high") > 0, F.lit(HIGHEST)).when(F.col("high") < -1, F.lit(LOWEST)).otherwise(
        F.col("low") + F.when(F.col("high") < 0, F.lit(LOWEST)).otherwise(F.lit(0)))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))
