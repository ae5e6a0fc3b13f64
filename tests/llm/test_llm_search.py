"""Operators 4, 5 and 6: planted cases and brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from segstats.llm import blocks, components, decontaminate, group_join, kmeans_tree

ITEM = "If a train leaves Boston at 40 km per hour and meets Alice after 3 hours how far did it go before noon"
SHORT = "What is the capital of France"


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, ITEM, "x"), (2, SHORT, "x"), (3, None, "x"), (4, "", "x"), (5, "12 13 14 15 16 17 18 19 20 21 22 23 24 25", "x")],
                                 "item_id long, text string, pos string")


def test_leaks(to_docs, benchmark):
    filler = "plain words of a clean document that go on and on without any question in it"
    other = ITEM.replace("40", "75").replace("Alice", "Maria").replace("Boston", "Denver").replace("3", "9").replace("km", "miles")
    mixed = ITEM + " and " + ITEM.replace("Alice", "Bob").lower()
    docs = to_docs([
        (1, f"{filler} {ITEM} {filler}", None, None), (2, f"{filler}. {other} {filler}", None, None), (3, filler, None, None),
        (4, SHORT, None, None), (5, f"{filler} {SHORT}", None, None), (6, None, None, None), (7, "", None, None),
        (8, " ".join(str(i) for i in range(300)), None, None), (None, ITEM, None, None), (9, mixed, None, None),
        (10, ITEM, None, None), (10, ITEM, None, None), (11, " ".join(ITEM.split()[:10]), None, None), (12, ITEM.upper(), None, None)])
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert set(got) >= {(1, 1), (2, 1), (4, 2), (5, 2), (None, 1), (9, 1), (10, 1)}
    assert not {d for d, _ in got} & {3, 6, 7, 8, 11}
    assert got[2, 1].n_slots == 6 and got[2, 1].n_changed == 5 and got[2, 1].consistency == 1.0
    assert got[1, 1].n_changed == 0
    kept = decontaminate.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns and {3, 6, 7, 8, 11} <= {r.doc_id for r in kept.collect()}
    assert not {1, 2, 4, 5, 10} & {r.doc_id for r in kept.collect()}


DENSE = "Add 1 2 and 3 4 then 5 6 7 8 9 10 11 12"


def test_number_dense_and_split_items(to_docs, spark):
    """All windows of a diagonal count once one holds plain words; inserted tokens split nothing."""
    nine = "solve 3 + 4 and then 5 6 7 8"
    bench = spark.createDataFrame([(1, DENSE), (2, nine), (3, ITEM)], "item_id long, text string")
    filler = "plain words of a clean document that go on."
    docs = to_docs([(1, DENSE, None, None), (2, f"{filler} {DENSE.replace('3 4', '77 4')}. {filler}", None, None), (3, nine, None, None),
                    (4, ITEM.replace("Alice", "Maria Smith"), None, None), (5, ITEM.replace("40 km", "about 40 km"), None, None),
                    (6, " ".join(str(i) for i in range(300)), None, None), (7, ITEM.replace("per hour and", "and"), None, None)])
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(1, 1), (2, 1), (3, 2), (4, 3), (5, 3), (7, 3)}


def test_case_space_and_short_items(to_docs, benchmark, spark):
    """Copies in another case or with other white space, items behind a word, short items as a sentence of their own."""
    nine = "If Tom reads books he learns many new words"
    bench = benchmark.select("item_id", "text").union(spark.createDataFrame([(6, nine)], "item_id long, text string"))
    filler = "plain words of a clean document that go on"
    docs = to_docs([(1, ITEM.upper(), None, None), (2, ITEM.lower(), None, None), (3, ITEM.title(), None, None),
                    (4, ITEM.replace(" ", "\n  "), None, None), (5, f"{filler} {nine.replace('Tom', 'Ann')}", None, None),
                    (6, f"{filler}. {SHORT}? {filler}", None, None), (7, f"{filler}\n{SHORT.upper()}\n{filler}", None, None),
                    (8, filler, None, None)])
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 6), (6, 2), (7, 2)}
    assert got[6, 2].doc_start == got[7, 2].doc_start == 9


def test_inconsistent_slots_are_no_leak(to_docs, spark):
    bench = spark.createDataFrame([(1, "so Ann told Bob that Ann likes Bob more than Ann said when Bob met Ann there at noon with Bob")], "item_id long, text string")
    a = "so Eve told Max that Eve likes Max more than Eve said when Max met Eve there at noon with Max"
    b = "so Eve told Max that Tom likes Joe more than Ida said when Lea met Kim there at noon with Sue"
    got = decontaminate.contaminated(to_docs([(1, a, None, None), (2, b, None, None)]), bench).collect()
    assert [r.doc_id for r in got] == [1]


def test_decontaminate_empty(to_docs, no_docs, benchmark, spark):
    assert decontaminate.contaminated(no_docs, benchmark).count() == 0
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(to_docs([(1, ITEM, None, None)]), empty).count() == 1


def exact(rows, k):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x, ids = np.array([v for _, v in ok]), np.array([i for i, _ in ok])
    out = {}
    for i, v in ok:
        if i % 20 == 0:
            keep = ids != i
            s = (x[keep] * v).sum(1)
            o = np.lexsort((ids[keep], -s))[:k]
            out[i] = list(zip(ids[keep][o].tolist(), s[o].tolist()))
    return out


def vectors(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 8))
    x = (centres[rng.integers(0, 12, n)] + 0.3 * rng.normal(size=(n, 8))).astype(np.float32)
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    for i in range(100, 200):  # one vector a hundred times
        rows[i] = (i, rows[100][1])
    odd = [(n, None), (n + 20, [0.0] * 8), (None, rows[0][1]), (n + 40, [float("nan")] + [1.0] * 7), (n + 1, [None] + [1.0] * 7),
           (n + 2, [float("inf")] * 8), (n + 60, [1.0, 2.0])]
    return rows + odd


@pytest.mark.parametrize("n", [15, 3000])
def test_nearest(spark, n):
    rows = vectors(max(n, 200)) if n > 15 else vectors(200)[:n]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, query string").repartition(3)
    out, how = kmeans_tree.nearest(df, df.filter("vec_id % 20 = 0"), k=20, sample=1000, leaf_rows=16, calibrate=50)
    want, got = exact(rows, 20), {}
    for r in sorted(out.collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    hit = 0
    for q, w in want.items():
        assert [r for r, _, _ in got[q]] == list(range(1, len(w) + 1))
        assert [(-s, v) for _, v, s in got[q]] == sorted((-s, v) for _, v, s in got[q])
        true = dict(w)
        for _, v, s in got[q]:
            assert v != q and (v not in true or s == pytest.approx(true[v], rel=1e-12))
        hit += len({v for _, v, _ in got[q]} & set(true))
    recall = hit / sum(map(len, want.values()))
    assert recall >= 0.9 and (n > 15 or recall == 1)
    assert how["visits"] < how["leaves"] or n == 15


def test_nearest_ties_and_empty(spark):
    rows = [(i, [1.0 if j == i % 8 else 0.0 for j in range(8)]) for i in range(160)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in kmeans_tree.nearest(df, df.filter("vec_id % 20 = 0"), k=20)[0].collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    for q, w in exact(rows, 20).items():
        assert [got[q][i] for i in range(1, 21)] == [v for v, _ in w]
    assert kmeans_tree.nearest(df.limit(0), df.limit(0))[0].count() == 0


def sets_of(rows, n):
    out = []
    for r in rows:
        t = (r[1] or "").encode()
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in t).split()
        out.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


def classes(rows, n, percent):
    sets, up = sets_of(rows, n), list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, r in enumerate(rows):
        k = root(i)
        known = [x for x in (least.get(k), r[0]) if x is not None]
        least[k] = min(known) if known else None
    return sorted(((r[0], len(sets[i]), least[root(i)]) for i, r in enumerate(rows)), key=str)


def family(seed, n, size):
    """Copies of a text with a changing number of edits, so similarities lie around the threshold."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    rows, texts = [], []
    for i in range(n):
        if texts and rng.random() < 0.8:
            t = rng.choice(texts).split()
            for _ in range(rng.randint(0, 1 + len(t) // 25)):
                p = rng.randrange(len(t) + 1)
                t[p:p + rng.choice([0, 1])] = [rng.choice(words)] * rng.choice([0, 1])
            t = " ".join(t) or "w1"
        else:
            t = " ".join(rng.choice(words) for _ in range(rng.randint(1, size)))
        texts.append(t)
        rows.append((i * 3, t, None, None))
    return rows


@pytest.mark.parametrize("case", ["edges", (1, 250, 60), (2, 250, 12), (3, 150, 200)])
@pytest.mark.parametrize("large", [False, True])
def test_components(to_docs, rows, case, large, monkeypatch):
    if large:  # every group is cut into chunks and joined through its central sets
        monkeypatch.setattr(group_join, "CHUNK", 5)
        monkeypatch.setattr(group_join, "LEADERS", 2)
    data = rows if case == "edges" else family(*case)
    got = group_join.jaccard_components(to_docs(data)).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect()), key=str) == classes(data, 4, 85)


def test_components_empty_and_keep_one(docs, rows, no_docs):
    assert group_join.jaccard_components(no_docs).count() == 0
    kept = group_join.keep_one(docs, n=5, percent=80)
    lead = {r[2] for r in classes(rows, 5, 80)}
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} - {None} == {x for x in lead if x is not None}


def test_keep_one_by_row(spark):
    """One row of each group stays: null ids, repeated rows, and near copies under one id."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(400)]) for _ in range(80)) for _ in range(4)]
    near = [t + " tail" for t in texts]
    rows = [(None, texts[0], "a"), (None, near[0], "a"), (None, texts[0], "b"),  # only null ids
            (5, texts[1], "a"), (5, texts[1], "a"), (5, texts[1], "b"), (6, near[1], "a"),  # repeated rows
            (7, texts[2], "a"), (7, near[2], "a"), (7, texts[3], "a"), (8, near[3], "a"),  # one id, two groups
            (9, None, "a"), (9, None, "a"), (9, "", "a")]  # no words
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    kept = group_join.keep_one(docs)
    assert kept.columns == docs.columns
    kept = [tuple(r) for r in kept.collect()]
    assert not set(kept) - set(rows)
    groups = [{texts[i], near[i]} for i in range(4)]
    assert [sum(r[1] in g for r in kept) for g in groups] == [1, 1, 1, 1]
    assert (5, texts[1], "a") in kept and (7, texts[3], "a") in kept
    assert sum(not r[1] for r in kept) == 3


def test_contraction(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    groups = {}
    for n, c in got.items():
        groups.setdefault(c, set()).add(n)
    assert sorted(map(sorted, groups.values())) == [list(range(51)), list(range(100, 140)), [200, 201]]


def test_components_of_many_partitions(spark, monkeypatch):
    """Documents of high partitions (2,048 and up) link, and do not mix with those of low ones (p and p + 4,096)."""
    rng = random.Random(5)
    parts = [3, 7, 2050, 2060, 4099, 4103]  # 4099 and 4103 are 3 and 7 modulo 4096
    texts = [" ".join(f"{k}x{rng.randrange(500)}" for _ in range(60)) for k in range(3)]
    docs = spark.createDataFrame([(p, f"{texts[i // 2]} tail{p}") for i, p in enumerate(parts)], "doc_id long, text string")
    bits, pack = getattr(blocks, "PLACE_BITS", 32), blocks.pack_blocks

    def far(docs, *args, **kw):  # partition i of the input stands for partition parts[i]
        high = F.element_at(F.array(*[F.lit(p) for p in parts]), (F.shiftright("block", bits) + 1).cast("int")).cast("long")
        return pack(docs, *args, **kw).withColumn("block", F.shiftleft(high, bits) + F.col("block") % (1 << bits))

    monkeypatch.setattr(group_join, "pack_blocks", far)
    docs = docs.repartitionByRange(6, "doc_id")
    got = {r.doc_id: r.component_id for r in group_join.jaccard_components(docs).collect()}
    assert got == {3: 3, 7: 3, 2050: 2050, 2060: 2050, 4099: 4099, 4103: 4099}


def test_place_fails_loudly():
    assert blocks.place((1 << 43) - 1, np.array([(1 << 20) - 1]))[0] == (1 << 63) - 1
    with pytest.raises(ValueError):
        blocks.place(1 << 43, np.array([0]))
