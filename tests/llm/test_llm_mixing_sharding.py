"""Operators 1 and 7: laws of the result, and a direct computation of targets."""

from collections import Counter, defaultdict
from zlib import crc32

import pytest

from segstats.llm import mixing, sharding


def words(t):
    return len((t or "").encode().split())


def targets(sizes, cap=3):
    """Share by weight, cap, reshare the excess, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, left = {}, sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        total = sum(weight[s] for s in rest)
        share = {s: left * weight[s] / total for s in rest}
        over = [s for s in rest if share[s] > cap * sizes[s]]
        if not over:
            return full | share
        for s in over:
            full[s] = cap * sizes[s]
            left -= full[s]


def test_targets_and_takes(docs, rows):
    got = mixing.mix_plan(docs).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((r[0], r[3], words(r[1])) for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += words(r[1])
    want = targets(dict(sizes))
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9)
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 3
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s, t in taken.items():
        assert abs(t - want[s]) <= largest[s] / 2 + 1


def test_refinement_gives_the_same_threshold(docs, monkeypatch):
    a = sorted(map(str, mixing.mix_plan(docs).collect()))
    monkeypatch.setattr(mixing, "EXACT_ROWS", 0)  # refine down to single hashes
    assert sorted(map(str, mixing.mix_plan(docs).collect())) == a


@pytest.mark.parametrize("same_text", [True, False])
def test_source_on_one_id(to_docs, same_text):
    """A source whose rows share one id (and text) is split at its target like any other."""
    data = [(7, "a b c d e f" if same_text else f"a b c d e {i}", None, "one") for i in range(900)]
    data += [(1000 + i, "x y z " * 5, None, "two") for i in range(200)] + [(None, "p q", None, "two")] * 40
    got = mixing.mix_plan(to_docs(data)).collect()
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert len(got) == len(data) and all(abs(taken[s] - target[s]) <= 8 for s in target)
    assert 0 < target["one"] % 5400 and len({r.copies for r in got if r.source == "one"}) == 2
    out = Counter(r.source for r in mixing.mix(to_docs(data)).collect())
    assert out == Counter({s: sum(r.copies for r in got if r.source == s) for s in target})


def test_mix_repeats_rows(docs, no_docs):
    copies = Counter()
    for r in mixing.mix_plan(docs).collect():
        copies[r.doc_id] += r.copies
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == +copies
    assert mixing.mix(no_docs).count() == 0 and mixing.mix_plan(no_docs).count() == 0


def check_law(got, rows, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (r[0], len((r[1] or "").encode()) + 1, crc32((r[1] or "").encode())) for r in rows)
    by = defaultdict(list)
    for r in got:
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < shards
        by[r.shard].append(r.slot)
    n = [len(by[s]) for s in range(shards)]
    assert max(n) - min(n) <= 1
    for s in by:
        assert sorted(by[s]) == list(range(len(by[s])))


def test_rows_law(docs, rows, no_docs):
    got = sharding.shard_documents(docs).collect()
    check_law(got, rows, 16)
    assert sharding.shard_documents(no_docs).count() == 0
    check_law(sharding.shard_documents(docs, shards=200).collect(), rows, 200)  # more shards than rows


def test_copies_stay_together(to_docs):
    data = [(i, f"text {i // 3 if i < 300 else i}", None, None) for i in range(1600)]
    got = sharding.shard_documents(to_docs(data), shards=16).collect()
    check_law(got, data, 16)
    shards = defaultdict(set)
    for r in got:
        shards[r.text_crc32].add(r.shard)
    assert sum(len(s) > 1 for s in shards.values()) <= 2


def test_large_group_is_split(to_docs, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 20)  # buckets of a large group
    data = [(i, "copy" if i % 3 == 0 else f"t{i}", None, None) for i in range(900)]
    check_law(sharding.shard_documents(to_docs(data), shards=16).collect(), data, 16)


def test_large_group_of_equal_rows_is_split(to_docs, monkeypatch):
    """Many rows with one id and text: no cell holds more than about BUCKET_ROWS of them."""
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 20)
    data = [(None, "copy", None, None)] * 400 + [(5, "copy", None, None)] * 300 + [(i, f"t{i % 700}", None, None) for i in range(900)]
    cells, real = [], sharding.ranked
    monkeypatch.setattr(sharding, "ranked", lambda rows: cells.append(
        rows.groupBy("label", "part", "place", "big", "sub").count().agg({"count": "max"}).first()[0]) or real(rows))
    check_law(sharding.shard_documents(to_docs(data), shards=16).collect(), data, 16)
    assert cells[0] <= 60


def test_quotas_hold():
    q = sharding._quotas([10, 10], {(0, 1): 8, (1, 0): 2}, 12)
    assert q[1, 0] == 1.0 and 8 * q[0, 1] == pytest.approx(4)  # two swapped, two into the room left
