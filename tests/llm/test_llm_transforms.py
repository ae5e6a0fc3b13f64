"""Operators 11, 12 and 13 (and their queries on whole small tables) against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from segstats.llm import fill_middle, periodic, top_k
from segstats.llm.blocks import word_hashes, word_spans
from segstats.llm.queries import QUERIES


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def runs_by_hand(w, least=24, times=3):
    code = np.array([*map({x: i for i, x in enumerate(dict.fromkeys(w))}.get, w)], np.int64)
    n, out = len(w), []
    for q in range(1, n // times + 1):
        same = np.flatnonzero(np.diff(np.concatenate(([0], (code[q:] == code[:-q]).astype(np.int8), [0]))))
        for i, j in zip(same[::2], same[1::2]):
            length = int(j - i + q)
            if length >= max(least, times * q):
                x = code[i:i + length]
                if not any((x[p:] == x[:-p]).all() for p in range(1, q)):
                    out.append((int(i), length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def op11_by_hand(doc_id, text):
    w = words_of(text)
    n, h = len(w), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = runs_by_hand(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join("%d,%d,%d\n" % r for r in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_op11_query(spark, docs, rows, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op11_periodic"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = Counter(op11_by_hand(r[0], r[1]) for r in rows)
    assert Counter(map(tuple, out.collect())) == want
    assert sum(k[1] > 0 for k in want) > 5 and any(k[4] and k[4] > 1 for k in want)


@pytest.mark.parametrize("seed", range(4))
def test_runs_match_definition(seed):
    rng = random.Random(seed)
    for _ in range(100):
        docs, least = [], rng.choice([3, 6, 24])
        for _ in range(rng.randint(1, 5)):
            w = []
            for _ in range(rng.randint(0, 5)):
                root = [rng.choice("abcd"[:rng.randint(1, 4)]) for _ in range(rng.randint(1, 14))]
                w += (root * 7)[:rng.randint(1, 6 * len(root))]
            docs.append(w)
        texts = [" ".join(w).encode() for w in docs]
        off, data = np.cumsum([0] + [len(t) for t in texts]), np.frombuffer(b"".join(texts), np.uint8)
        s, e, first = word_spans(off, data)
        found = periodic.find_runs(word_hashes(data, s, e), first, least)
        for i, w in enumerate(docs):
            assert [(a - first[i], n, q) for a, n, q in found.tolist() if first[i] <= a < first[i + 1]] == runs_by_hand(w, least)


def test_names_in_wide_texts():
    # pairs of names that do not fit one 64-bit key beside the position, and hashes equal in their first bits
    a, b, at = np.array([2**31 - 2, 0, 2**31 - 2]), np.array([5, 1, 5]), np.array([0, 1, 2])
    order, head = periodic._by_pair(a, b, at, 100)
    assert order.tolist() == [1, 0, 2] and head.tolist() == [True, True, False]
    h = np.array([9, 8, 9, 8, 9], np.uint64)
    assert periodic._by_hash(h, np.arange(5)).tolist() == [1, 3, 0, 2, 4]
    with pytest.raises(ValueError):
        periodic.find_runs(h, np.array([0, 5]), 2, 2)


def test_collapsed_texts(to_docs):
    phrase = "one two three "
    out = {r.doc_id: r for r in periodic.periodic_runs(to_docs([
        (1, "x " + phrase * 10 + "y", None, None), (2, "a " * 200_000, None, None), (3, None, None, None), (4, " \n", None, None),
        (5, phrase * 7, None, None)])).collect()}
    assert out[1].collapsed == "x one two three y" and [tuple(r) for r in out[1].runs] == [(1, 30, 3)]
    assert out[2].collapsed == "a" and [tuple(r) for r in out[2].runs] == [(0, 200_000, 1)]
    assert (out[3].collapsed, out[3].n_words, out[4].collapsed, out[4].runs) == ("", 0, "", [])
    assert out[5].runs == [] and out[5].collapsed.split() == (phrase * 7).split()  # 21 words are too few


def op12_by_hand(doc_id, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = t[:a], t[a:b], t[b:]
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(t), sha(t)
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, sha(f"<S>{suffix}<P>{prefix}<M>{middle}"), sha(t)
    return doc_id, n, "psm", a, b - a, sha(f"<P>{prefix}<S>{suffix}<M>{middle}"), sha(t)


def test_op12_query(spark, to_docs, rows, tmp_path):
    more = rows + [(700 + i, t, None, None) for i, t in enumerate(
        ["<P", "<", "<<S", "a<S>b", "<M>", "é" * 10_000, "🙂" * 9_001, "x" * 4096, "x" * 8192 + "é", "S>" * 5000, "<P" * 3])]
    more += [(i, "short <" + "é<" * (i % 7), None, None) for i in range(800, 1100)]
    to_docs(more).write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op12_fill_middle"](spark, str(tmp_path))
    want = Counter(op12_by_hand(r[0], r[1]) for r in more)
    assert Counter(map(tuple, out.collect())) == want and {k[2] for k in want} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("units", ["chars", "words", "lines"])
def test_cuts_by_units(to_docs, units):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "é", "🙂", " ", "\n", "bc "]) for _ in range(rng.randint(0, 9000))) for _ in range(40)] + [" ", "\n\n", " x"]
    data = [(i, t, None, None) for i, t in enumerate(texts)]

    def pieces(t):
        if units == "chars":
            return list(t)
        if units == "lines":
            return t.splitlines(keepends=True)
        p = re.split(r"(?<=[ \n])(?=[^ \n])", t)
        return [x for x in ([p[0] + p[1], *p[2:]] if len(p) > 1 and not p[0].strip() else p) if x]

    out = {r.doc_id: r for r in fill_middle.transform(to_docs(data), units, plain_percent=0).collect()}
    for i, t in enumerate(texts):
        p, r = pieces(t), out[i]
        assert r.n == len(p) and "".join(p) == t
        if t:
            h = hashlib.sha256(f"1:{i}".encode()).hexdigest()
            a, b = sorted(int(h[8 * k:8 * k + 8], 16) % (len(p) + 1) for k in (0, 1))
            prefix, middle = "".join(p[:a]), "".join(p[a:b])
            assert (r.prefix_chars, r.middle_chars) == (len(prefix), len(middle)) and r.output.endswith("<M>" + middle)
    with pytest.raises(ValueError):
        fill_middle.transform(to_docs(data), "bytes")


def test_tree_totals():
    text = ("é🙂a" * 5000).encode()
    texts = [text, b"", b"q", text[:4096 * 3 + 1] if text[4096 * 3] < 128 else b"a" * 12_289]
    off, data = np.cumsum([0] + [len(t) for t in texts]), np.frombuffer(b"".join(texts), np.uint8)
    chars = fill_middle.char_starts(data)
    tree = fill_middle.BlockTree(off, chars, chars)
    assert tree.n.tolist() == [len(t.decode()) for t in texts]
    for share in (0, 0.1, 0.5, 0.9, 1):
        rank = (tree.n * share).astype(np.int64)
        byte, before = tree.cut(rank)
        assert before.tolist() == rank.tolist()
        assert [t[:x].decode() for t, x in zip(texts, byte)] == [t.decode()[:k] for t, k in zip(texts, rank)]


def top_by_hand(data, k=5, every=50):
    sound = [(i, [int(np.floor(256 * np.float64(x))) for x in v]) for i, v in data
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for q, x in sound:
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in sound if i != q)[:k]
            out.update((q, r + 1, i, -s) for r, (s, i) in enumerate(best))
    return out


def vectors(seed, n=700):
    rng = np.random.default_rng(seed)
    data = [(int(i), [float(x) for x in (rng.normal(size=6) * 0.01).round(rng.integers(0, 4))]) for i in rng.permutation(n)]
    hot = [0.5, -0.25, 0.0, 0.125, 0.0, 1.0]
    data += [(n + i, hot) for i in range(300)]  # one vector with many ids, as candidate and query
    data += [(None, hot), (5000, None), (5050, [0.1, None, 0.3]), (5100, [float("nan"), 1.0]), (5150, [float("inf")]), (5200, [0.0] * 6),
             (5250, []), (5300, [1.0]), (5350, [1.0] * 9), (5400, hot), (5400, hot), (5401, hot), (5401, hot)]
    return data


def as_table(spark, data):
    return spark.createDataFrame([(*d, 1, "clash") for d in data], "vec_id long, embedding array<double>, label int, id string").repartition(3)


@pytest.mark.parametrize("seed", [1, 2])
def test_op13_query(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr(top_k, "BLOCK_ROWS", 97)
    monkeypatch.setattr(top_k, "GROUP_ROWS", 5)
    as_table(spark, vectors(seed)).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = QUERIES["op13_top_k"](spark, str(tmp_path))
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    assert Counter(map(tuple, out.collect())) == top_by_hand(vectors(seed))


def test_op13_few_and_none(spark, tmp_path):
    for i, data in enumerate([[], [(0, [1.0])], [(0, [1.0]), (50, [0.5]), (3, [0.25])]]):
        as_table(spark, data).write.parquet(f"{tmp_path}/{i}/embeddings.parquet")
        assert Counter(map(tuple, QUERIES["op13_top_k"](spark, f"{tmp_path}/{i}").collect())) == top_by_hand(data)


def test_every_cell_meets(spark):
    """Many cells on many partitions: stripes of rows and of queries must name a cell alike."""
    rng = np.random.default_rng(3)
    data = [(i, rng.integers(-9, 9, 5).tolist()) for i in range(900)]
    df = spark.createDataFrame(data, "id long, weights array<long>").repartition(16)
    names = {"spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        got = Counter(map(tuple, top_k.top_k(df, df.filter("id % 9 = 0")).collect()))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = Counter()
    for q, x in data[::9]:
        best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in data if i != q)[:5]
        want.update((q, r + 1, i, -s) for r, (s, i) in enumerate(best))
    assert got == want


def test_sparse_and_wide_weights(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([0, 0, 0, rng.randint(-9, 9)]) for _ in range(40)]) for i in range(120)]
    for wide in (1, 10**6, 10**17):  # 32-bit, 64-bit and Python sums
        data = [(i, [x * wide for x in w]) for i, w in rows]
        df = spark.createDataFrame(data, "id long, weights array<long>")
        got = Counter(map(tuple, top_k.top_k(df, df.filter("id % 7 = 0"), 3).collect()))
        want = Counter()
        for q, x in data:
            if q % 7 == 0:
                best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in data if i != q)[:3]
                want.update((q, r + 1, i, min(max(-s, -2**63), 2**63 - 1)) for r, (s, i) in enumerate(best))
        assert got == want


def test_new_operators_on_no_rows(no_docs):
    assert periodic.periodic_runs(no_docs).count() == 0 and fill_middle.transform(no_docs).count() == 0
