"""Small tables with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

import pytest

CLASH = ["id", "size", "hash", "block", "bucket", "group", "label", "rank", "row", "data", "flag", "text_hash", "component",
         "owner", "n", "line", "pos", "tokens", "shard", "copies", "__s", "__id", "__hash", "__copies", "count"]


def sentence(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def make_rows():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    few = ["ab", "cd", "The", "é", "ñandú", "x"]
    rows = []
    for i in range(40):
        rows.append((i, sentence(rng, words, rng.randint(3, 90)), rng.choice(["en", "de"]), f"s{i % 4}"))
    base = sentence(rng, words, 120)
    rows += [(100 + i, base, "en", "s0") for i in range(15)]  # exact copies
    for i in range(25):  # near copies
        t = base.split()
        for _ in range(rng.randint(1, 5)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((200 + i, " ".join(t), "en", "s1"))
    passage = sentence(rng, words, 60)
    rows += [(300 + i, f"{sentence(rng, words, 30)}\n{passage}\n{sentence(rng, words, 30)}", "de", "s2") for i in range(8)]
    rows += [(400 + i, "\n".join(sentence(rng, few, 4) for _ in range(rng.randint(1, 12))), "es", "s3") for i in range(20)]
    rows += [(500, sentence(rng, words, 30_000), "en", "s0"), (501, "z" * 5000, "en", "s0"), (502, "a b " * 4000, None, "s1")]
    rows += [(600, None, "en", "s0"), (601, "", "en", None), (602, " \n\t ", None, "s9"), (603, "one two", "en", "s1"),
             (604, "One TWO", "en", "s1"), (None, "null id text with some words in it", "en", "s2"), (None, None, None, None),
             (605, "123 456 !!!", "en", "s2"), (606, "same row twice " * 9, "en", "s2"), (606, "same row twice " * 9, "en", "s2"),
             (607, "日本語 テキスト 🙂 emoji", None, "s2"), (-5, base + " tail", "en", "s2")]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def to_docs(spark):
    def make(rows):
        schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASH)
        df = spark.createDataFrame([(*r, *["clash"] * len(CLASH)) for r in rows], schema)
        return df.repartition(3) if rows else df
    return make


@pytest.fixture(scope="session")
def docs(to_docs, rows):
    return to_docs(rows)


@pytest.fixture(scope="session")
def no_docs(to_docs):
    return to_docs([])
