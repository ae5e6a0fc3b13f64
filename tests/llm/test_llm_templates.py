"""Operator 4 against a token-by-token twin in Python: templates, windows, diagonals and slots."""

import random
from collections import defaultdict

import pytest
import regex
from pyspark.sql import functions as F

from segstats.llm import decontaminate

UNITS = set(decontaminate.UNITS.split())
GOOD = regex.compile(r"[\p{L}\p{N}]")


def tokens_of(text, kind):
    """(type or word, value) tokens; kind 0 has names, kind 1 has not."""
    raw, out, was = [t for t in regex.split(r"[\s\p{Z}\x01\x02]+", text or "")], [], None
    raw = raw if raw[0] else raw[1:]
    for i, t in enumerate(x for x in raw if x):
        last = raw[i - 1][-1] if i else ""
        if kind == 0 and regex.match(r"\p{Lu}", t) and regex.match(r"[\p{L}\p{N},;:]", last):
            if was == "p" and GOOD.match(last):
                out[-1][1] += t
            else:
                out.append(["\x01p", t])
            was = "p"
        elif regex.match(r"[^\s\p{L}\p{N}]{0,3}[0-9]", t):
            out.append(["\x01n", t])
            was = "n"
        elif was == "n" and any(t.lower().startswith(u) and not GOOD.match(t[len(u):]) for u in UNITS):
            out.append(["\x01u", t])
            was = "u"
        else:
            out.append(["", t])
            was = None
    out = [(k, regex.sub(r"[^\p{L}\p{N}]", "", v.lower())) for k, v in out]
    return [(k or v, v) for k, v in out if k or v]


def found_by_hand(doc, item, window=8, min_tokens=13, min_literals=3, near=4, consistent=0.8, inside=5):
    """Number of equal windows of the best consistent stretch, or None."""
    forms = [(0, tokens_of(item, 0)), (0, tokens_of("x " + (item or ""), 0)[1:]), (1, tokens_of(item, 1))]
    best = []
    for v, (kind, x) in enumerate(forms):
        y = tokens_of(doc, kind)
        a, b = [t for t, _ in x], [t for t, _ in y]
        if not a or (v == 1 and a == [t for t, _ in forms[0][1]]):
            continue
        plain = [not t.startswith("\x01") for t in a]
        if len(a) < window:
            if sum(plain) < min(min_literals, len(a)):
                continue
            at = [j for j in range(len(b) - len(a) + 1) if b[j:j + len(a)] == a] if len(a) >= inside else []
            pairs = [{(i, j + i) for i in range(len(a))} for j in at[:1]]
            whole = [s for s in [doc, *regex.split(r"(?<=[.?!])\s+|\s*\n\s*", doc or "")] if v != 1 and [t for t, _ in tokens_of(s, kind)] == a]
            ways = [([(x[i], y[j]) for i, j in p], 1) for p in pairs] + [(list(zip(x, tokens_of(s, kind))), 1) for s in whole]
        else:
            starts = range(len(a) - window + 1)
            rich = [i for i in starts if sum(plain[i:i + window]) >= min_literals]
            need = min(len(a), min_tokens) - window + 1
            least = max(1, need - (len(starts) - len(rich)))
            equal = defaultdict(set)
            for i in starts:
                for j in range(len(b) - window + 1):
                    if a[i:i + window] == b[j:j + window]:
                        equal[j - i].add(i)
            ways = []
            for band in {s // near + e for s in equal for e in (0, 1)}:
                shifts = [s for s in equal if s // near in (band, band - 1) and equal[s] & set(rich)]
                if len(set().union(*(equal[s] & set(rich) for s in shifts))) < least:
                    continue
                n = len(set().union(*(equal[s] for s in shifts)))
                if n >= need:
                    places = {(i + k, i + s + k) for s in shifts for i in equal[s] for k in range(window)}
                    ways.append(([(x[i], y[j]) for i, j in places], n))
        for pairs, n in ways:
            pairs = {(p[1], q[1]) if p[0].startswith("\x01") else None for p, q in pairs} - {None}
            if not pairs or min(len({p for p, _ in pairs}), len({q for _, q in pairs})) / len(pairs) >= consistent:
                best.append(n)
    return max(best, default=None)


ITEMS = ["If a train leaves Boston at 40 km per hour and meets Alice after 3 hours how far did it go before noon",
         "Ann has 12 apples and gives Bob Smith 5 apples each day. How many days until Ann has no more than 2 apples?",
         "What is the capital of France", "Who wrote it?", "so Ann told Bob that Ann likes Bob more than Ann said when Bob met Ann there",
         "Add 1 2 and 3 4 then 5 6 7 8 9 10 11 12", "", None, "solve this (3%) now"]


def varied(rng, text):
    swap = {"Boston": "Denver", "Alice": "Maria Lopez", "40": "$75", "3": "9.5", "Ann": "Eve", "Bob": "Max", "km": "miles", "12": "31", "5": "6"}
    out = []
    for t in text.split():
        r = rng.random()
        out += [swap.get(t, t)] if r < 0.5 else [t, "well"] if r > 0.98 else [t] if r < 0.97 else []
    s = rng.choice([" ", " ", " ", "\n", "  ", " "]).join(out)
    return rng.choice([str, str, str.lower, str.upper, lambda x: x + "."])(s)


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(4)
    filler = "plain words of the clean text, Berlin and 7 kg; No one asks É 42km-away U2 x".split()
    docs = [" ".join(rng.choice(filler) for _ in range(rng.randint(0, 9))) for _ in range(30)]
    for _ in range(90):
        around = [" ".join(rng.choice(filler) for _ in range(rng.randint(0, 6))) + rng.choice(["", ".", ","]) for _ in range(2)]
        docs.append(rng.choice([" ", "\n", ". "]).join([around[0], varied(rng, rng.choice([i for i in ITEMS if i])), around[1]]))
    docs += [None, "", ITEMS[0] * 3, "word " * 20_000 + ITEMS[0], " ".join(ITEMS[1] for _ in range(5))]
    return docs + docs[40:44]


def test_templates_match_twin(spark, cases):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases + [t for t in ITEMS])], "i long, text string")
    for kind in (0, 1):
        got = df.select("i", "text", decontaminate.template(F.col("text"), names=not kind).alias("t"),
                        decontaminate.template(F.col("text"), True, not kind).alias("v")).collect()
        for r in got:
            want = tokens_of(r.text, kind)
            assert r.t == [k for k, _ in want]
            assert r.v == [k + v if k.startswith("\x01") else k for k, v in want]


@pytest.mark.parametrize("piece", [1, 7, None])
def test_windows_in_pieces(spark, monkeypatch, piece):
    """The windows of a document are those of an item, whatever piece they are laid out in."""
    monkeypatch.setattr(decontaminate, "PIECE", piece or decontaminate.PIECE)
    df = spark.createDataFrame([(i, i % 2, list(range(i))) for i in (0, 1, 4, 5, 6, 30)], "id long, kind int, h array<long>")
    want = df.select("id", F.posexplode(decontaminate.window_hashes(F.col("h"), 5, F.col("kind"))).alias("pos", "hash"))
    got = decontaminate.windows_of(df, 5, "id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 1 + 2 + 26


def test_matches_twin(spark, to_docs, cases):
    bench = spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string")
    rows = [(i if i % 9 else 9, t, None, None) for i, t in enumerate(cases)]  # ids repeat, with other texts
    got = defaultdict(dict)
    for r in decontaminate.contaminated(to_docs(rows), bench).collect():
        got[r.doc_id, r.text_hash][r.item_id] = r.n_windows
    hashes = {t: h for t, h in spark.createDataFrame([(t,) for t in cases if t is not None], "t string").select("t", F.xxhash64("t")).distinct().collect()}
    n = 0
    for i, t, *_ in rows:
        want = {k for k, item in enumerate(ITEMS) if found_by_hand(t, item) is not None}
        have = got.get((i, hashes.get(t)), {})
        assert set(have) == want, (t, have, want)
        n += len(want)
    assert n > 40
    clean = decontaminate.decontaminate(to_docs(rows), bench)
    assert clean.count() == sum(not any(found_by_hand(t, item) for item in ITEMS) for _, t, *_ in rows)
