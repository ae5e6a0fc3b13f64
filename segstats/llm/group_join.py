"""Exact set-similarity join with a token-group matrix (operator 6).

Documents are sets of word shingles; two link when their Jaccard similarity
reaches ``percent``. Steps:

0. *Candidates.* A third of all shingles (by hash) are asked whether another set
   holds them. A set of which more than 100 - percent in a hundred shingles are
   its own links with nothing and stays behind.
1. *Groups of similar documents.* The candidates' shingles are counted over all
   candidates (df). Ordered by (df, hash), linked sets share at least one of their
   first |x| - ceil(percent |x| / 100) + 1 shingles (prefix filter): the rarest
   ones, so sets that merely share lines or passages seldom meet. These shingles go
   to hash buckets (``blocks``); sets that share one are in one group (connected
   components of star edges).
2. *Token-group matrix.* Within a group, members with equal smallest shingles form
   subgroups of at most ``SUBGROUP`` sets, whose unions are the columns of a sparse
   matrix (shingle x subgroup). A query's overlap with each union bounds its
   overlap with every member; only subgroups whose bound reaches the threshold
   are opened, and their members compared exactly, unless already connected.
3. *Large groups* (more than ``CHUNK`` distinct sets) are cut into chunks. Every
   chunk is joined with itself and with the group's most central sets; what is
   not yet connected to the rest is then compared, in blocks, with all chunks.

Only texts of sets that share such a shingle travel; equal sets of a block of
documents travel once. Defined results: null text or text without words has an
empty set, links with nothing and is its own component; fewer words than a shingle
are one shingle; component_id is the smallest non-null doc_id of the component
(null only if all are null); rows with equal ids are separate documents; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segstats.llm.blocks import LAST, PLACE_BITS, answer, by_bucket, fresh, mix64, pack, pack_blocks, place, release, send, total_bytes, unpack, with_answers, word_hashes, word_spans
from segstats.llm.components import components
from segstats.llm.lattice_lm import lower_ascii
from segstats.llm.repeats import _key48, pack_keys, shared_bits
from segstats.session import cut_lineage

SUBGROUP = 32
CHUNK = 4000
LEADERS = 48
BUCKET_BYTES = 12 << 20
_C = np.uint64(0xA0761D6478BD642F)


def shingle_sets(d: tuple, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document of a block."""
    _, _, off, data, _ = d
    data = lower_ascii(data)
    s, e, at = word_spans(off, data)
    w = word_hashes(data, s, e)
    h = w[:max(0, len(w) - n + 1)]
    for i in range(1, n):
        h = mix64(h * _C + w[i:len(w) - n + 1 + i])
    out = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        if hi - lo >= n:
            out.append(np.unique(h[lo:hi - n + 1]))
        elif hi > lo:
            x = np.array([hi - lo], np.uint64)
            for i in range(lo, hi):
                x = mix64(x * _C + w[i:i + 1])
            out.append(x)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def prefix(x: np.ndarray, df: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of a set that a linked set must share one of, without those no other set holds."""
    first = np.lexsort((x, df))[:len(x) - -(-percent * len(x) // 100) + 1]
    return x[first[df[first] > 1]]


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    a, b = len(x), len(y)
    if percent * max(a, b) > 100 * min(a, b):
        return False
    if a > b:
        x, y = y, x
    at = np.searchsorted(y, x)
    same = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return (100 + percent) * same >= percent * (a + b)


class Matrix:
    """Sparse matrix (token x column): which of some token sets hold each token."""

    def __init__(self, columns: list[np.ndarray]):
        token = np.concatenate(columns)
        by = np.argsort(token, kind="stable")
        self.column = np.repeat(np.arange(len(columns)), [len(c) for c in columns])[by]
        self.tokens, start = np.unique(token[by], return_index=True)
        self.start, self.width = np.append(start, len(token)), len(columns)

    def overlaps(self, q: np.ndarray) -> np.ndarray:
        """Number of tokens of q in every column."""
        at = np.searchsorted(self.tokens, q)
        at = at[(at < len(self.tokens)) & (self.tokens[np.minimum(at, len(self.tokens) - 1)] == q)]
        n = self.start[at + 1] - self.start[at]
        src = np.repeat(self.start[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.column[src], minlength=self.width)


class TokenGroups:
    """Subgroups of similar sets and their token-group matrix."""

    def __init__(self, sets: list[np.ndarray], members: list[int]):
        self.members = np.array(sorted(members, key=lambda i: (int(sets[i][0]), len(sets[i]))))
        first = np.array([sets[i][0] for i in self.members])
        change = np.concatenate(([True], first[1:] != first[:-1]))
        begin = np.maximum.accumulate(np.where(change, np.arange(len(first)), 0))
        new = (np.arange(len(first)) - begin) % SUBGROUP == 0  # a subgroup has one smallest shingle
        self.group = np.cumsum(new) - 1
        start = np.flatnonzero(new)
        self.sets = [sets[i] for i in self.members]
        self.size = np.array([len(x) for x in self.sets])
        parts = [self.sets[a:b] for a, b in zip(start, [*start[1:], len(first)])]
        self.unions = Matrix([np.unique(np.concatenate(x)) if len(x) > 1 else x[0] for x in parts])
        self.least, self.most = np.minimum.reduceat(self.size, start), np.maximum.reduceat(self.size, start)
        self.rows: Matrix | None = None

    def open(self, q: np.ndarray, percent: int) -> np.ndarray:
        """Positions of the members of subgroups that may hold a set linked with q:
        overlap with the union against the least overlap a member needs."""
        overlap = self.unions.overlaps(q)
        fits = (100 * self.most >= percent * len(q)) & (percent * self.least <= 100 * len(q))
        fits &= (100 + percent) * overlap >= percent * (len(q) + self.least)
        return np.flatnonzero(fits[self.group])

    def linked(self, q: np.ndarray, at: np.ndarray, percent: int) -> np.ndarray:
        """Which of the members at the positions link with q (exact)."""
        if len(at) <= 24:
            return at[[linked(q, self.sets[j], percent) for j in at]]
        if self.rows is None:
            self.rows = Matrix(self.sets)
        return at[(100 + percent) * self.rows.overlaps(q)[at] >= percent * (len(q) + self.size[at])]


def join(labels: np.ndarray, i: int, others: np.ndarray) -> None:
    """Joins the components of i and of all ``others``; a component's label is its smallest index."""
    together = np.unique(np.append(labels[others], labels[i]))
    if len(together) > 1:
        labels[np.isin(labels, together)] = together[0]


def connect(sets: list[np.ndarray], labels: np.ndarray, queries: list[int], members: list[int], percent: int) -> None:
    """Joins every query with all members it links to (pairs already connected are not compared)."""
    if not len(queries) or not len(members):
        return
    groups = TokenGroups(sets, members)
    for i in queries:
        if (labels[groups.members] == labels[i]).all():
            continue
        at = groups.open(sets[i], percent)
        at = at[labels[groups.members[at]] != labels[i]]
        if len(at):
            join(labels, i, groups.members[groups.linked(sets[i], at, percent)])


def _sets(f: pd.DataFrame, n: int) -> list[np.ndarray]:
    """Shingle sets of the rows' texts (compressed texts travel: they are a third of their hashes)."""
    if not len(f):
        return []
    d = zstandard.ZstdDecompressor()
    texts = [d.decompress(b) for b in f["text"]]
    off = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    return shingle_sets((None, None, off, np.frombuffer(b"".join(texts), np.uint8), None), n)


def _edges(f: pd.DataFrame, labels: np.ndarray) -> pd.DataFrame:
    owner = f["owner"].to_numpy()
    return pd.DataFrame({"a": owner, "b": owner[labels]})


def _small(f: pd.DataFrame, n: int, percent: int) -> pd.DataFrame:
    """Star edges (owner, first owner of its component) of whole groups."""
    out = []
    for _, g in f.groupby("group", sort=True):
        sets, labels = _sets(g, n), np.arange(len(g))
        first: dict[bytes, int] = {}
        for i, x in enumerate(sets):
            labels[i] = first.setdefault(x.tobytes(), i)
        distinct = sorted(first.values())
        connect(sets, labels, distinct, distinct, percent)
        out.append(_edges(g, labels))
    release()
    return pd.concat(out)


def _large(members: DataFrame, n: int, percent: int) -> DataFrame:
    """Verified edges (a, b) of large groups; ``members``: group, owner, digest, text."""
    edge = "a long, b long"
    # equal sets (128-bit digests) are linked; one of them stands for all
    members = cut_lineage(members)
    first_of = cut_lineage(members.groupBy("group", "digest").agg(F.min("owner").alias("b")))
    equal = members.select("group", "digest", F.col("owner").alias("a")).join(first_of, ["group", "digest"]).select("a", "b")
    reps = cut_lineage(members.join(first_of.select(F.col("b").alias("owner")), "owner", "left_semi"))
    sizes = cut_lineage(reps.groupBy("group").agg(F.count(F.lit(1)).alias("n")))
    reps = cut_lineage(reps.join(sizes, "group").withColumn("chunk", F.pmod(F.xxhash64("digest"), F.ceil(F.col("n") / CHUNK))))
    chunks = reps.select("group", "chunk").distinct()

    # token counts of some sets score every set: central sets hold what most others hold
    some = reps.filter(F.pmod(F.xxhash64("digest", F.lit(5)), F.col("n")) < 200).select("group", "owner", "text")

    def replicated(few: DataFrame) -> DataFrame:  # toDF: columns of their own, so that both sides of a cogroup differ
        return few.join(chunks, "group").select("group", "chunk", "owner", "text").toDF("group", "chunk", "owner", "text")

    def score(key, left, right):
        right = right.sort_values("owner")
        tokens, count = np.unique(np.concatenate([np.empty(0, np.uint64), *_sets(right, n)]), return_counts=True)
        best = []
        for owner, x in zip(left["owner"], _sets(left, n)):
            at = np.minimum(np.searchsorted(tokens, x), max(0, len(tokens) - 1))
            hit = (tokens[at] == x) * count[at] if len(tokens) else np.zeros(1)
            best.append((float(hit.mean()), owner))
        best = sorted(best, key=lambda b: (-b[0], b[1]))[:LEADERS]
        return pd.DataFrame({"group": key[0], "score": [b[0] for b in best], "owner": [b[1] for b in best]})

    by = ["group", "chunk"]
    scored = reps.groupBy(*by).cogroup(replicated(some).groupBy(*by)).applyInPandas(score, "group long, score double, owner long")
    top = scored.groupBy("group").agg(F.slice(F.sort_array(F.collect_list(F.struct(-F.col("score"), "owner"))), 1, LEADERS).alias("t"))
    top = cut_lineage(top.select(F.explode("t.owner").alias("owner")))
    leaders = cut_lineage(reps.join(top, "owner", "left_semi").select("group", "owner", "text"))

    def inside(key, left, right):
        f = pd.concat([left[["owner", "text"]], right[["owner", "text"]]]).drop_duplicates("owner").sort_values("owner", ignore_index=True)
        sets, labels, central = _sets(f, n), np.arange(len(f)), set(right["owner"])
        lead = [i for i, o in enumerate(f["owner"]) if o in central]
        every = list(range(len(f)))
        connect(sets, labels, every, lead, percent)
        connect(sets, labels, every, every, percent)
        return _edges(f, labels)

    first = cut_lineage(reps.groupBy(*by).cogroup(replicated(leaders).groupBy(*by)).applyInPandas(inside, edge).filter("a <> b"))
    edges = first.unionByName(equal.filter("a <> b"))
    if first.isEmpty():
        known = reps.select("group", "chunk", "owner", "text", F.col("owner").alias("component"))
    else:
        known = reps.select("group", "chunk", "owner", "text").join(
            components(first).withColumnRenamed("node", "owner"), "owner", "left").withColumn("component", F.coalesce("component", "owner"))
    known = cut_lineage(known)
    per = known.groupBy("group", "component").count()
    main = cut_lineage(per.groupBy("group").agg(F.max_by("component", F.struct("count", "component")).alias("main")))
    rest = cut_lineage(known.join(main, "group").filter("component <> main"))
    left = cut_lineage(rest.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("parts")))
    rest = rest.join(left, "group").withColumn("part", F.pmod(F.xxhash64("owner", F.lit(7)), F.col("parts")))
    pairs = rest.join(chunks.withColumnRenamed("chunk", "other"), "group").select("group", F.col("other").alias("chunk"), "part", "owner", "text", "component")
    against = known.join(pairs.select("group", "chunk", "part").distinct(), by)

    def across(key, left, right):
        f = pd.concat([left, right]).drop_duplicates("owner").sort_values("owner", ignore_index=True)
        ask = set(left["owner"])
        seen: dict[int, int] = {}
        labels = np.array([seen.setdefault(c, i) for i, c in enumerate(f["component"])])
        connect(_sets(f, n), labels, [i for i, o in enumerate(f["owner"]) if o in ask], list(range(len(f))), percent)
        return _edges(f, labels)

    key = ["group", "chunk", "part"]
    cols = [*key, "owner", "text", "component"]
    more = pairs.select(*cols).groupBy(*key).cogroup(against.select(*cols).toDF(*cols).groupBy(*key)).applyInPandas(across, edge).filter("a <> b")
    return edges.unionByName(more)


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id of every document."""
    return _labelled(docs, n, percent, id_col, text_col).drop("component")


def _labelled(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """As ``jaccard_components``, and component: a number of its own for every component."""
    blocks = pack_blocks(docs, id_col, text_col, flag=F.xxhash64(text_col))
    buckets = max(4, -(-total_bytes(blocks) // BUCKET_BYTES))
    # prefixes of candidates are a small part of all shingles; fewer buckets meet a pair of sets less often
    few = max(4, buckets // 8)

    def owners(sets: list[np.ndarray]) -> tuple[dict[bytes, int], np.ndarray]:
        """Every document's first document of the block with an equal set (empty sets: itself)."""
        first: dict[bytes, int] = {}
        return first, np.array([first.setdefault(x.tobytes(), j) if len(x) else j for j, x in enumerate(sets)], np.int64)

    def asked(sets: list[np.ndarray]) -> tuple[list[int], np.ndarray, np.ndarray, tuple]:
        """Distinct sets; of the shingles asked about: set, distinct key (and whether several sets of the block hold it)."""
        mine = sorted(owners(sets)[0].values())
        some = [sets[j][(sets[j] >> np.uint64(40)) % np.uint64(3) == 0] for j in mine]
        x = np.concatenate([np.empty(0, np.uint64), *some])
        who = np.repeat(np.arange(len(mine)), [len(s) for s in some])
        h, inv, times = np.unique(x, return_inverse=True, return_counts=True)
        return mine, who, inv, (h, times > 1)

    def ask(block, d):
        _, _, _, (h, several) = asked(shingle_sets(d, n))
        for b, i in by_bucket(h, buckets):
            yield b, pack_keys(_key48(h[i]) | several[i].astype(np.uint64))

    def candidates(block, d, bits):
        """Sets of which enough shingles may be shared: (document, set) of a block."""
        sets = shingle_sets(d, n)
        mine, who, inv, (h, _) = asked(sets)
        held = np.zeros(len(h), bool)
        for b, i in by_bucket(h, buckets):
            held[i] = np.unpackbits(bits[b], count=len(i)).astype(bool)
        own = np.bincount(who, ~held[inv], len(mine))
        return [(j, sets[j]) for j, u in zip(mine, own) if 100 * u <= (100 - percent) * len(sets[j])]

    def distinct(found):
        """Of the candidates' shingles: which distinct one each is, the distinct ones, how many sets hold each."""
        h, inv, times = np.unique(np.concatenate([np.empty(0, np.uint64), *[x for _, x in found]]), return_inverse=True, return_counts=True)
        return inv, h, times

    def emit_counts(block, d, bits):
        _, h, times = distinct(candidates(block, d, bits))
        rows = [(b, pack((pack_keys(_key48(h[i])), times[i].astype(np.int32)))) for b, i in by_bucket(h, buckets)]
        return pd.DataFrame({"bucket": [b for b, _ in rows], "block": block, "data": [x for _, x in rows]})

    def count(names, parts):
        raw = np.concatenate([np.frombuffer(unpack(k), np.uint8).reshape(-1, 6) for k, _ in parts])
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :6] = raw
        _, inv = np.unique(wide.view(np.uint64).ravel(), return_inverse=True)
        df = np.bincount(inv, np.concatenate([t for _, t in parts])).astype(np.int32)[inv]
        for i, x in enumerate(np.split(df, np.cumsum([len(t) for _, t in parts])[:-1])):
            yield i, pack(x, 3)

    def emit(block, d, answers):
        found = candidates(block, d, {-1 - b: v for b, v in answers.items() if b < 0})
        inv, h, _ = distinct(found)
        df = np.zeros(len(h), np.int32)
        for b, i in by_bucket(h, buckets):
            df[i] = answers[b]
        df, at, sig = df[inv], 0, []
        for _, x in found:
            sig.append(prefix(x, df[at:at + len(x)], percent))
            at += len(x)
        who = np.repeat(np.array([j for j, _ in found], np.int32), [len(x) for x in sig])
        sig = np.concatenate([np.empty(0, np.uint64), *sig])
        rows = [(b, pack((np.ascontiguousarray(sig[i] >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), who[i])))
                for b, i in by_bucket(sig, few)]
        return pd.DataFrame({"bucket": [b for b, _ in rows], "block": block, "data": [x for _, x in rows]})

    def meet(key, f):
        f = f.sort_values("block")
        got = [(b, unpack(x)) for b, x in zip(f["block"], f["data"])]
        raw = np.concatenate([np.frombuffer(x[0], np.uint8).reshape(-1, 6) for _, x in got])
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :6] = raw
        sig = wide.view(np.uint64).ravel()
        owner = np.concatenate([place(b, x[1]) for b, x in got])
        order = np.argsort(sig, kind="stable")
        s, o = sig[order], owner[order]
        begin = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        lead = np.repeat(np.minimum.reduceat(o, begin), np.diff(np.append(begin, len(s))))
        e = np.unique(np.stack((o, lead), 1)[o != lead], axis=0)
        release()
        return pd.DataFrame({"a": e[:, 0], "b": e[:, 1]})

    def listed(frames):
        for f in frames:
            for block, x in zip(f["block"], f["data"]):
                d = unpack(x)
                sets = shingle_sets(d, n)
                owner = owners(sets)[1]
                least = np.full(len(sets), LAST, np.int64)
                np.minimum.at(least, owner, d[0])
                yield pd.DataFrame({"id": d[0], "null": d[1], "text_hash": d[4], "n_shingles": [len(x) for x in sets],
                                    "owner": place(block, owner), "least": least[owner]})
        release()

    every = cut_lineage(blocks.select("block", "data").mapInPandas(
        listed, "id long, null boolean, text_hash long, n_shingles long, owner long, least long"))
    # shuffled once, never stored: part hashes hardly compress
    sent = "bucket long, block long, data binary"
    bits = cut_lineage(answer(send(blocks, ask), shared_bits))  # one bit for each shingle asked about; used twice
    counts = answer(with_answers(blocks, bits, emit_counts, sent), count)
    replies = counts.unionByName(bits.select("block", (-1 - F.col("bucket")).alias("bucket"), "data"))
    sent = with_answers(blocks, replies, emit, sent)
    edges = cut_lineage(sent.groupBy("bucket").applyInPandas(meet, "a long, b long").distinct())
    labels = cut_lineage(_verified(blocks, edges, every, n, percent))
    out = every.join(labels, "owner", "left").withColumn("c", F.coalesce("component_id", "least"))
    last = F.lit(int(LAST))
    return out.select(F.when(~F.col("null"), F.col("id")).alias("doc_id"), "text_hash", "n_shingles",
                      F.when(F.col("c") != last, F.col("c")).alias("component_id"), F.coalesce("component", "owner").alias("component"))


def _verified(blocks: DataFrame, edges: DataFrame, every: DataFrame, n: int, percent: int) -> DataFrame:
    """(owner, component_id, component) of the owners that share a part with another."""
    spark = blocks.sparkSession
    if edges.isEmpty():
        return spark.createDataFrame([], "owner long, component_id long, component long")
    groups = cut_lineage(components(edges).select(F.col("node").alias("owner"), F.col("component").alias("group")))
    wanted = groups.select(F.shiftright("owner", PLACE_BITS).alias("block"), "owner", "group")

    def collect(key, left, right):
        if not len(left):
            raise ValueError(f"block {key[0]} of asked documents is missing")
        d = unpack(left["data"].iloc[0]) if len(right) else None
        if d is None:
            return pd.DataFrame({"group": [], "owner": [], "digest": [], "text": []})
        sets, z = shingle_sets(d, n), zstandard.ZstdCompressor(level=6)
        at = (right["owner"].to_numpy() & ((1 << PLACE_BITS) - 1)).tolist()
        return pd.DataFrame({
            "group": right["group"], "owner": right["owner"], "text": [z.compress(d[3][d[2][j]:d[2][j + 1]].tobytes()) for j in at],
            "digest": [hashlib.blake2b(sets[j].tobytes(), digest_size=16).digest() for j in at]})

    def members(wanted: DataFrame) -> DataFrame:
        return blocks.select("block", "data").groupBy("block").cogroup(wanted.groupBy("block")).applyInPandas(
            collect, "group long, owner long, digest binary, text binary")

    size = wanted.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    large = cut_lineage(size.filter(F.col("n") > CHUNK).select("group"))
    bins = max(8, wanted.count() // 2000)
    verified = members(wanted.join(large, "group", "left_anti")).withColumn("bin", F.pmod(F.xxhash64("group"), F.lit(int(bins)))).groupBy(
        "bin").applyInPandas(lambda key, f: _small(f.sort_values("owner", ignore_index=True), n, percent), "a long, b long")
    verified = cut_lineage(verified.withColumnRenamed("a", "owner").withColumnRenamed("b", "component"))
    if not large.isEmpty():
        links = _large(members(wanted.join(large, "group", "left_semi")), n, percent)
        verified = verified.unionByName(components(links).withColumnRenamed("node", "owner"))
    least = every.select("owner", "least").distinct()
    named = verified.join(least, "owner")
    lowest = cut_lineage(named.groupBy("component").agg(F.min("least").alias("component_id")))
    return named.join(lowest, "component").select("owner", "component_id", "component")


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: the first by (id, null last; text hash). Of rows that
    share both, the one whose columns come first as JSON text stays; rows without words
    are components of their own and all stay."""
    a, b, once = fresh(docs, "id", "hash", "once")
    # equal ids and texts are in one component
    solid = cut_lineage(_labelled(docs, n, percent, id_col, text_col).filter("n_shingles > 0").groupBy("doc_id", "text_hash").agg(
        F.min("component").alias("component"), F.count(F.lit(1)).alias("n")))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    first = solid.groupBy("component").agg(F.min(place).alias("f")).select(
        F.col("f.doc_id").alias(a), F.col("f.text_hash").alias(b), F.lit(True).alias(once))
    same = F.col("doc_id").eqNullSafe(F.col(a)) & (F.col("text_hash") == F.col(b))
    bad = cut_lineage(solid.join(first, same, "left").filter(F.col(once).isNull() | (F.col("n") > 1)).select(
        F.col("doc_id").alias(a), F.col("text_hash").alias(b), F.col(once).isNotNull().alias(once)))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(a)) & (F.xxhash64(text_col) == F.col(b))
    # the same plan at every size: both sides are shuffled once, however small the one is
    kept = docs.join(bad.hint("merge"), same, "left_anti")
    repeated = bad.filter(once)
    if repeated.isEmpty():
        return kept
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = docs.join(repeated, same, "left_semi").groupBy(F.col(id_col).cast("long").alias(a), F.xxhash64(text_col).alias(b)).agg(
        F.min_by(row, F.to_json(row)).alias(once))
    return kept.unionByName(one.select(f"{once}.*"))
