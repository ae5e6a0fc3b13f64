"""Operators 2 and 10 against direct removal of repeated windows; operator 8 against a scan."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from segstats.llm import fm_dedup, line_dedup, suffix_dedup
from segstats.llm.blocks import word_hashes, word_spans
from segstats.llm.suffix_dedup import intervals

LAST = 2**63 - 1


def removed(texts, length):
    """texts: (id, units); removed flags by the definition."""
    first = {}
    for i, t in texts:
        k = LAST if i is None else i
        for p in range(len(t) - length + 1):
            w = tuple(t[p:p + length])
            first[w] = min(first.get(w, LAST), k)
    out = []
    for i, t in texts:
        gone = [False] * len(t)
        k = LAST if i is None else i
        for p in range(len(t) - length + 1):
            if first[tuple(t[p:p + length])] < k:
                gone[p:p + length] = [True] * length
        out.append(gone)
    return out


def runs(gone):
    return sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))


def expect_bytes(rows, length):
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    return Counter((i, len(t), sum(g), runs(g), hashlib.sha256(bytes(c for c, x in zip(t, g) if not x)).hexdigest())
                   for (i, t), g in zip(texts, removed(texts, length)))


def expect_words(rows, length):
    texts = [(r[0], (r[1] or "").encode().split()) for r in rows]
    return Counter((i, len(t), sum(g), hashlib.sha256(b" ".join(c for c, x in zip(t, g) if not x)).hexdigest())
                   for (i, t), g in zip(texts, removed(texts, length)))


def random_rows(seed):
    rng = random.Random(seed)
    rows = [(i, "".join(rng.choice("ab \n") for _ in range(rng.randint(0, 400)))) for i in range(30)]
    for i in range(30):  # pieces of earlier texts, cut anywhere
        parts = []
        for _ in range(rng.randint(1, 4)):
            t = rows[rng.randrange(len(rows))][1]
            a = rng.randrange(len(t) + 1)
            parts.append(t[a:a + rng.randint(10, 150)])
        rows.append((rng.randrange(200), rng.choice(["", "é", "q "]).join(parts)))
    rng.shuffle(rows)
    return [(*r, None, None) for r in rows]


@pytest.mark.parametrize("seed", [None, 1, 2])
def test_bytes_match_definition(to_docs, rows, seed):
    data = rows if seed is None else random_rows(seed)
    got = suffix_dedup.remove_repeated_bytes(to_docs(data)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert Counter(map(tuple, got.collect())) == expect_bytes(data, 50)


@pytest.mark.parametrize("seed", [None, 3, 4])
def test_words_match_definition(to_docs, rows, seed):
    data = rows if seed is None else random_rows(seed)
    got = fm_dedup.remove_repeated_words(to_docs(data)).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert Counter(map(tuple, got.collect())) == expect_words(data, 13)


def test_spans_and_text(to_docs):
    p = "shared passage of more than fifty bytes, in both of the texts."
    docs = to_docs([(1, f"first {p} end", None, None), (2, f"other {p} tail", None, None)])
    out = {r.doc_id: r for r in suffix_dedup.remove_repeated_bytes(docs, with_text=True).collect()}
    assert bytes(out[1].text).decode() == f"first {p} end" and out[1].spans == []
    assert bytes(out[2].text).decode() == "othertail" and len(out[2].spans) == 1
    w = {r.doc_id: r for r in fm_dedup.remove_repeated_words(docs, window=5, with_text=True).collect()}
    assert bytes(w[2].text) == b"other tail" and [tuple(s) for s in w[2].spans] == [(1, 13)]


def test_empty_tables(no_docs):
    assert suffix_dedup.remove_repeated_bytes(no_docs).count() == 0
    assert fm_dedup.remove_repeated_words(no_docs).count() == 0
    assert line_dedup.dedup_line_runs(no_docs).count() == 0


def test_interval_tree():
    # suffixes of "banana": a, ana, anana, banana, na, nana
    assert sorted((d, i, j) for d, i, j, _ in intervals([1, 3, 0, 0, 2], 1)) == [(1, 0, 2), (2, 4, 5), (3, 1, 2)]


def test_fm_index_counts():
    text = np.array([1, 2, 1, 3, 1, 2, 1, 0])
    sa, marks = fm_dedup.suffix_array(text, 2)
    index = fm_dedup.FMIndex(text, sa)
    lo, hi = np.zeros(1, np.int64), np.full(1, len(text))
    for c in (1, 2, 1):  # pattern 1 2 1, from its end
        lo, hi = index.step(np.array([c]), lo, hi)
    assert sorted(sa[lo[0]:hi[0]].tolist()) == [0, 4]


def test_word_hashes_follow_bytes():
    texts = [b"aa b  aa", b"", b"aa" * 40_000 + b" b", b"\x0b"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    off = np.cumsum([0] + [len(t) for t in texts])
    s, e, at = word_spans(off, data)
    words = [data[a:b].tobytes() for a, b in zip(s, e)]
    assert words == [w for t in texts for w in t.split()] and at.tolist() == [0, 3, 3, 5, 5]
    h = word_hashes(data, s, e)
    assert len(set(h.tolist())) == len(set(words)) and h[0] == h[2] and h[1] == h[4]


def expect_lines(rows, m):
    solid = lambda x: bool(x.strip(" \t\n\r\x0b\x0c"))
    texts = {}
    for r in rows:
        texts[r[0], r[1]] = [x for x in (r[1] or "").split("\n") if solid(x)]
    key = lambda k, q: ((k[0] is None, k[0] or 0), q)
    out = Counter()
    first = {}
    for k, u in texts.items():
        for q in range(len(u) - m + 1):
            w = tuple(u[q:q + m])
            first[w] = min(first.get(w, key(k, q)), key(k, q))
    for r in rows:
        k = (r[0], r[1])
        u, gone = texts[k], set()
        for q in range(len(u) - m + 1):
            if first[tuple(u[q:q + m])] < key(k, q):
                gone.update(range(q, q + m))
        kept, q = [], -1
        for x in (r[1] or "").split("\n"):
            q += solid(x)
            if not solid(x) or q not in gone:
                kept.append(x)
        out[r[0], len(u), len(gone), runs([q in gone for q in range(len(u))]), "\n".join(kept)] += 1
    return out


@pytest.mark.parametrize("m", [1, 2, 3])
def test_lines_match_definition(docs, rows, m):
    data = [r for r in rows if r[0] is not None]  # texts with null ids are ordered by an internal hash
    got = line_dedup.dedup_line_runs(docs.filter("doc_id is not null"), m)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_lines", "n_removed", "n_runs", "kept_text").collect()) == expect_lines(data, m)
    assert line_dedup.dedup_line_runs(docs, m).count() == len(rows)


def longest_copies(rows, m):
    """By (id, text, line): the longest run of at least ``m`` lines that also begins at an earlier place, its first place and number of places."""
    texts = {(r[0], r[1]): (r[1] or "").split("\n") if r[1] else [] for r in rows}
    places, out = [(k, q) for k, u in sorted(texts.items()) for q in range(len(u))], {}
    for k, q in places:
        u = texts[k]
        for n in range(len(u) - q, m - 1, -1):
            same = [p for p in places if texts[p[0]][p[1]:p[1] + n] == u[q:q + n]]
            if same[0] < (k, q):
                out[k, q] = (n, same[0], len(same))
                break
    return out


@pytest.mark.parametrize("m", [1, 2, 3, 5])
def test_longest_repeated_runs(to_docs, m):
    rng = np.random.default_rng(m)
    long = [f"x{i}" for i in range(23)]
    texts = ["\n".join(rng.choice(list("ab"), 9)) for _ in range(3)] + ["\n".join(long), "\n".join(["p", *long[3:20], "q", *long[1:8]]), "\n".join([*long[2:19], "q"])]
    rows = [(i, t, None, None) for i, t in enumerate(texts)] + [(9, "a\na\na\na\na\na\na", None, None), (2, texts[2], None, None), (10, "", None, None)]
    expect = longest_copies(rows, m)
    hashes = {r.h: r.text for r in to_docs(rows).selectExpr("xxhash64(text) AS h", "text").collect()}
    got = line_dedup.repeated_runs(to_docs(rows), m).collect()
    assert {((r.doc_id, hashes[r.text_hash]), r.line): (r.length, ((r["first"].id, hashes[r["first"].text_hash]), r["first"].line), r.copies) for r in got} == expect
    assert len(got) == len(expect) and max(n for n, _, _ in expect.values()) == 17


def test_steps_reach_every_length():
    assert line_dedup._steps(2, 3) == [(2, 8), (1, 4), (0, 2), (0, 1)] and line_dedup._steps(5, 1) == [(0, 3), (0, 2), (0, 1)] and line_dedup._steps(1, 1) == []
