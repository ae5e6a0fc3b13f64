"""Nearest neighbours by a hierarchical k-means tree (operator 5).

``fit_tree`` splits a bounded sample of vectors (about ``sample`` rows) by
k-means into ``branch`` children, and those again, down to small leaves. Every
vector of the table is then indexed in its leaf. A query walks the tree best
bin first: a priority queue holds nodes by the inner product of the query with
their centres; popped leaves are visited. How many leaves are visited is
calibrated: for a sample of queries the exact neighbours are found by brute
force over all vectors, and the width grows until the leaves visited hold at
least ``recall`` of them.

Equal vectors are indexed once, with their ``k + 1`` smallest ids (no other can
be among k nearest), and equal queries are searched once. Leaves are cut into
blocks of at most ``BLOCK_ROWS`` vectors, so a popular region is many tasks.

Defined results: vectors that are null, zero, of another length than most, or
hold null or non-finite components, and rows with null ids, take no part (a
query among them gives no rows); ties go to the smaller id; a query's own id
never is its neighbour; fewer candidates than k give them all; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segstats.session import cut_lineage

BLOCK_ROWS = 20_000
QUERIES = 256


@dataclass
class Tree:
    """children[i]: node ids below node i (empty: a leaf); centres[i]; leaf number of each node or -1."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: list[int]

    @property
    def leaves(self) -> int:
        return max(self.leaf) + 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row, by the nearest child at every level."""
        out = np.empty(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf[node]
            elif len(rows):
                c = self.centres[kids]
                near = (x[rows] @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
                todo += [(kid, rows[near == i]) for i, kid in enumerate(kids)]
        return out

    def best_bins(self, q: np.ndarray):
        """Leaves in the order of a best-bin-first walk."""
        heap = [(0.0, 0)]
        while heap:
            _, node = heapq.heappop(heap)
            if self.children[node]:
                kids = self.children[node]
                for s, kid in zip(self.centres[kids] @ q, kids):
                    heapq.heappush(heap, (-float(s), kid))
            else:
                yield self.leaf[node]


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    c = x[np.sort(rng.choice(len(x), k, replace=False))].copy()
    near = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        near = (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c, near


def fit_tree(x: np.ndarray, branch: int, leaf_rows: int) -> Tree:
    """Tree over the rows of a bounded sample, split until nodes have at most ``leaf_rows`` rows."""
    rng = np.random.default_rng(0)
    centres, children, leaf = [x.mean(0)], [[]], [-1]
    todo, n_leaves = [(0, np.arange(len(x)))], 0
    while todo:
        node, rows = todo.pop()
        if len(rows) > leaf_rows:
            c, near = k_means(x[rows], min(branch, -(-len(rows) // leaf_rows)), rng)
            parts = [(c[i], rows[near == i]) for i in range(len(c)) if (near == i).any()]
            if len(parts) > 1:
                for centre, part in parts:
                    children[node].append(len(centres))
                    todo.append((len(centres), part))
                    centres.append(centre)
                    children.append([])
                    leaf.append(-1)
                continue
        leaf[node] = n_leaves
        n_leaves += 1
    return Tree(np.array(centres), children, leaf)


def _matrix(col) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(np.float64) if len(col) else np.zeros((0, 1))


def _top(q: np.ndarray, q_ids, x: np.ndarray, x_ids: np.ndarray, k: int) -> pd.DataFrame:
    """The k best rows of x for each row of q: rows that can be among them by the
    matrix product, then scores summed in one fixed order, ties to the smaller id."""
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for lo in range(0, len(q), 256):
        for i, s in enumerate(q[lo:lo + 256] @ x.T, lo):
            if len(s) > k:
                least = np.partition(s, len(s) - k)[len(s) - k]
                rows = np.flatnonzero(s >= least - 1e-9 * max(1.0, abs(least)))
            else:
                rows = np.arange(len(s))
            score = (q[i] * x[rows]).sum(1)
            best = np.lexsort((x_ids[rows], -score))[:k]
            out.append((np.full(len(best), q_ids[i]), x_ids[rows][best], score[best]))
    query, rep, score = (np.concatenate(c) for c in zip(*out))
    return pd.DataFrame({"query": query, "rep": rep, "score": score})


def _smallest_ids(v: DataFrame, keep: int) -> DataFrame:
    """(rep, vector, ids): distinct vectors with their ``keep`` smallest ids; the
    row limit per vector is applied before the shuffle."""
    w = Window.partitionBy("vector").orderBy("id")
    few = v.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= keep)
    return few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.element_at("ids", 1).alias("rep"), "vector", "ids")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, sample: int = 20_000, branch: int = 16, leaf_rows: int = 256,
            recall: float = 0.95, calibrate: int = 200, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, dict]:
    """(query_id, rank, vec_id, score) of the ``k`` nearest by inner product, and
    what the calibration found ({"visits", "leaves", "recall"}). ``queries`` has the
    same columns as ``vectors``."""
    spark = vectors.sparkSession

    def sound(df: DataFrame) -> DataFrame:
        c = F.col(vector_col)
        return df.filter(F.col(id_col).isNotNull() & c.isNotNull()).select(F.col(id_col).cast("long").alias("id"), c.alias("vector")).filter(
            F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0))

    v = sound(vectors)
    sizes = v.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sizes:
        return empty, {"visits": 0, "leaves": 0, "recall": 1.0}
    dim = sizes[0]["d"]
    reps = cut_lineage(_smallest_ids(v.filter(F.size("vector") == dim), k + 1))
    ask = cut_lineage(sound(queries).filter(F.size("vector") == dim).distinct())
    asked = cut_lineage(ask.groupBy("vector").agg(F.min("id").alias("query")).select("query", "vector"))
    n = reps.count()

    def share(m: int, total: int, col: str):
        return F.pmod(F.xxhash64(col, F.lit(3)), F.lit(1 << 30)) < int(min(1.0, m / max(1, total)) * (1 << 30))

    fit = reps.filter(share(sample, n, "rep")).orderBy("rep").select("vector").toPandas()  # about ``sample`` rows
    tree = fit_tree(_matrix(fit["vector"]), branch, max(leaf_rows * len(fit) // max(1, min(n, sample)), 8)) if len(fit) else Tree(
        np.zeros((1, dim)), [[]], [0])

    def place(frames):
        for f in frames:
            f["leaf"] = tree.assign(_matrix(f["vector"])) if len(f) else []
            yield f[["rep", "vector", "leaf"]]

    kind = reps.schema["vector"].dataType.simpleString()
    placed = cut_lineage(reps.select("rep", "vector").mapInPandas(place, f"rep long, vector {kind}, leaf long"))
    size = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}  # one row per leaf
    blocks_of = {leaf: -(-c // BLOCK_ROWS) for leaf, c in size.items()}

    trial = asked.filter(share(calibrate, asked.count(), "query")).orderBy("query").toPandas()  # about ``calibrate`` rows
    visits, reached = _calibrated(placed, trial, tree, size, k, recall)

    real = np.float32 if "float" in kind else np.float64

    def walk(frames):
        """Queries by leaf: one row for each leaf and ``QUERIES`` queries, ids and vectors packed."""
        for f in frames:
            for lo in range(0, len(f), QUERIES):
                ids, x = f["query"].to_numpy()[lo:lo + QUERIES], _matrix(f["vector"].iloc[lo:lo + QUERIES])
                at: dict[int, list[int]] = {}
                for i, q in enumerate(x):
                    have = 0
                    for seen, leaf in enumerate(tree.best_bins(q), 1):
                        at.setdefault(leaf, []).append(i)
                        have += size.get(leaf, 0)
                        if seen >= visits and have > k:
                            break
                rows = [(leaf, b, ids[i].tobytes(), x[i].astype(real).tobytes()) for leaf, i in at.items() for b in range(blocks_of.get(leaf, 0))]
                yield pd.DataFrame(rows, columns=["leaf", "part", "ids", "vectors"])

    parts = F.create_map(*[F.lit(int(x)) for item in blocks_of.items() for x in item])
    data = placed.withColumn("part", F.pmod(F.xxhash64("rep"), F.element_at(parts, F.col("leaf").cast("int"))).cast("long"))
    routed = asked.mapInPandas(walk, "leaf long, part long, ids binary, vectors binary")

    def scan(key, left, right):
        if not len(left) or not len(right):
            return pd.DataFrame({"query": [], "rep": [], "score": []})
        x, reps = _matrix(left["vector"]), left["rep"].to_numpy()
        return pd.concat([_top(np.frombuffer(v, real).reshape(-1, dim).astype(np.float64), np.frombuffer(i, np.int64), x, reps, k + 1)
                          for i, v in zip(right["ids"], right["vectors"])])

    near = data.groupBy("leaf", "part").cogroup(routed.groupBy("leaf", "part")).applyInPandas(scan, "query long, rep long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    near = near.withColumn("i", F.row_number().over(best)).filter(F.col("i") <= k + 1).drop("i")
    owners = ask.join(asked.withColumnRenamed("query", "q"), "vector").select(F.col("q").alias("query"), F.col("id").alias("query_id"))
    pairs = near.join(reps.select("rep", F.explode("ids").alias("vec_id")), "rep")
    first = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    pairs = pairs.withColumn("i", F.row_number().over(first)).filter(F.col("i") <= k + 1).drop("i")  # one of them may be the query itself
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = owners.join(pairs, "query").filter("query_id <> vec_id").withColumn("rank", rank).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score"), {"visits": visits, "leaves": tree.leaves, "recall": reached}


def _calibrated(placed: DataFrame, trial: pd.DataFrame, tree: Tree, size: dict, k: int, recall: float) -> tuple[int, float]:
    """(leaf visits, recall): the narrowest width (growing by an eighth) that
    finds ``recall`` of the exact neighbours of the trial queries."""
    if not len(trial):
        return tree.leaves, 1.0
    q, ids = _matrix(trial["vector"]), trial["query"].to_numpy()

    def exact(frames):
        for f in frames:
            if len(f):
                top = _top(q, ids, _matrix(f["vector"]), f["rep"].to_numpy(), k)
                yield top.merge(f[["rep", "leaf"]], on="rep")

    w = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    true = placed.mapInPandas(exact, "query long, rep long, score double, leaf long").withColumn(
        "i", F.row_number().over(w)).filter(F.col("i") <= k).select("query", "leaf").toPandas()  # trial x k rows
    place = {query: {leaf: i for i, leaf in enumerate(tree.best_bins(x))} for query, x in zip(ids, q)}
    at = np.array([place[a][b] for a, b in zip(true["query"], true["leaf"])])
    width = 1
    while (at < width).mean() < recall and width < tree.leaves:
        width = min(tree.leaves, max(width + 1, width * 9 // 8))
    return width, float((at < width).mean())
