"""Operator 9 against interpolated Kneser-Ney by dictionaries, and on awkward training data."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from segstats.llm import langid
from segstats.llm.queries import QUERIES

SOUNDS = {"aa": ["ba", "na", "lo", "mi"], "bb": ["sch", "er", "ung", "ich"], "cc": ["tz", "qu", "ox", "pli"]}


def text_of(rng, lang, n):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def codes_of(text):
    words = "".join(c.lower()[0] if c.isalpha() else " " for c in text).split(" ")
    out, text = [], " ".join(words)
    for c in text:
        if c != " " or (out and out[-1] != " "):
            out.append(c)
    return "   " + "".join(out)


class ByHand:
    """Counts of n-grams in dictionaries, probabilities by recursion."""

    def __init__(self, texts_by_lang):
        self.tables, letters = {}, set()
        for lang, texts in texts_by_lang.items():
            top = Counter()
            for t in map(codes_of, texts):
                top.update(t[i - 3:i + 1] for i in range(3, len(t)))
            tables = {4: top}
            for n in (3, 2, 1):
                tables[n] = Counter(g[1:] for g in tables[n + 1])
            self.tables[lang] = tables
            letters |= set(tables[1])
        self.v = len(letters) + 1

    def p(self, lang, gram):
        n = len(gram)
        if not n:
            return 1 / self.v
        c = self.tables[lang][n]
        ones, twos = sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
        d = min(max(ones / max(ones + 2 * twos, 1), 0.05), 0.95)
        of = self.contexts(lang, n)[gram[:-1]]
        lower = self.p(lang, gram[1:])
        return max(c[gram] - d, 0) / of[0] + d * of[1] / of[0] * lower if of else lower

    def contexts(self, lang, n):
        if (lang, n) not in self.__dict__.setdefault("cache", {}):
            by = defaultdict(list)
            for g, x in self.tables[lang][n].items():
                by[g[:-1]].append(x)
            self.cache[lang, n] = defaultdict(tuple, {g: (sum(x), len(x)) for g, x in by.items()})
        return self.cache[lang, n]

    def bits(self, lang, text):
        t = codes_of(text)
        return -sum(math.log2(self.p(lang, t[i - 3:i + 1])) for i in range(3, len(t))) / max(1, len(t) - 3)


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(11)
    return [(i, text_of(rng, lang, rng.randint(5, 60)), lang, "s") for i, lang in enumerate(["aa", "bb", "cc"] * 40)]


def test_scores_match_dictionaries(to_docs, labelled):
    hand = ByHand({k: [r[1] for r in labelled if r[2] == k] for k in SOUNDS})
    model = langid.fit(to_docs(labelled))
    rng = random.Random(5)
    asked = [(i, text_of(rng, rng.choice("abc") * 2, rng.randint(1, 30)), None, None) for i in range(40)]
    asked += [(90, "Banalo! 12 SCHERUNG", None, None), (91, "ñandú 🙂 日本", None, None), (92, "b", None, None)]
    for r in langid.identify(to_docs(asked), model).collect():
        text = next(t for i, t, *_ in asked if i == r.doc_id)
        bits = {k: hand.bits(k, text) for k in SOUNDS}
        assert r.bits == pytest.approx(min(bits.values()), abs=1e-4)
        assert bits[r.lang_pred] == pytest.approx(min(bits.values()), abs=1e-4)


def test_null_and_repeated_ids_train(spark, to_docs, monkeypatch):
    """Many more labelled rows on one id than the sample holds: the draw goes by id and text."""
    rng = random.Random(2)
    for own in (None, 7):
        rows = [(own, text_of(rng, lang, 20), lang, "s") for lang in ["aa", "bb"] * 500]
        rows += [(own, rows[0][1], "aa", "s")] * 700  # equal rows are one training document
        model = langid.fit(to_docs(rows), sample_docs=100)
        assert model.langs == ["aa", "bb"] and np.isfinite(model.limits).all()
        asked = [(i, text_of(rng, lang, 30), None, lang) for i, lang in enumerate(["aa", "bb"] * 20)]
        got = {r.doc_id: r for r in langid.identify(to_docs(asked), model).collect()}
        assert all(got[i].lang_pred == lang and not got[i].rejected for i, _, _, lang in asked)
    one = langid.fit(to_docs([(1, "ba na lo", "aa", "s")]))  # a single row is enough to learn, not to reject
    assert one.langs == ["aa"] and not any(r.rejected for r in langid.identify(to_docs([(2, "mi lo qu", None, None)]), one).collect())


def test_long_texts_go_in_slices(to_docs, labelled, monkeypatch):
    model = langid.fit(to_docs(labelled))
    rng = random.Random(8)
    long = "".join(rng.choice(["é", " ", "schung ", "\n\n", "🙂", "1", "ich", "日"]) for _ in range(3000))
    data = np.frombuffer(("ba " + long + long + "na").encode(), np.uint8)
    off = np.array([0, 3, len(data) - 2, len(data), len(data)])
    whole = model.entropies(off, data)
    for size in (7, 64, 1001):
        monkeypatch.setattr(langid, "CHUNK", size)
        parts = model.entropies(off, data)
        assert parts[0] == pytest.approx(whole[0], abs=1e-9)
        assert parts[1].tolist() == whole[1].tolist() and parts[2].tolist() == whole[2].tolist()


def test_memory_of_a_long_text(to_docs, labelled):
    import tracemalloc

    model = langid.fit(to_docs(labelled))
    data = np.frombuffer(b"scherung lomi " * 600_000, np.uint8)  # 8 MB
    model.entropies(np.array([0, 1000]), data[:1000])
    tracemalloc.start()
    model.entropies(np.array([0, len(data)]), data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6


def test_unlabelled_corpus_is_kept(spark, to_docs, tmp_path):
    rng = random.Random(3)
    docs = to_docs([(i, text_of(rng, "aa", 40), None, "s") for i in range(50)] + [(None, None, None, "s")])
    assert langid.keep_identified(docs, langid.fit(docs)).count() == 51
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "no such text in any of the documents of this corpus at all")], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    kept = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {i for i in range(50)} <= kept
    assert all(r.lang_pred == "und" for r in QUERIES["op9_langid"](spark, str(tmp_path)).collect())
