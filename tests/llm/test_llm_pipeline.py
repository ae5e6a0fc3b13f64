"""The pipeline against its stages checked by brute force, and the registered queries."""

import importlib.util
from collections import Counter, defaultdict
from zlib import crc32

import pytest

import corpus_pipeline
from segstats.llm import decontaminate, langid, mixing
from segstats.llm.queries import ORACLE_SQL, QUERIES
from segstats.session import cut_lineage
from tests.conftest import SF_SMALL


def test_names():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline(spark, tmp_path):
    from importlib import import_module

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = docs.collect()
    # 1: nothing clean is rejected; 2: one of each brute-force class; 3: no benchmark text is left
    model = langid.fit(langid.train_split(docs))
    ok = {r.doc_id for r in langid.identify(docs, model).filter("not rejected").collect()}
    assert len(ok) >= 0.95 * len(rows)
    path = import_module("pathlib").Path(__file__).with_name("test_llm_search.py")
    spec = importlib.util.spec_from_file_location("llm_search_cases", path)
    search = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(search)
    left = [r for r in rows if r.doc_id in ok]
    lead = {c for _, _, c in search.classes([(r.doc_id, r.text) for r in left], 5, 80)}
    deduped = docs.filter(docs.doc_id.isin(sorted(lead)))
    bench = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    items = [r.text for r in bench.collect()]
    clean = decontaminate.decontaminate(deduped, bench)
    ids = {r.doc_id for r in clean.collect()}
    assert not any(i in r.text for r in rows if r.doc_id in ids for i in items)
    assert all(any(" ".join(i.split()[:13]) in " ".join(r.text.split()) for i in items) for r in rows if r.doc_id in lead - ids)
    want = Counter()
    for r in mixing.mix_plan(clean).collect():
        want[r.doc_id] += r.copies
    got = QUERIES and corpus_pipeline.run(spark, SF_SMALL).collect()
    assert Counter(r.doc_id for r in got) == +want
    by = defaultdict(int)
    for r in got:
        by[r.shard] += 1
    assert max(by.values()) - min(by.values()) <= 1


@pytest.fixture(scope="module")
def bench_rows():
    return [(1, "If a train leaves Boston at 40 km per hour and meets Alice after 3 hours how far did it go before noon"), (2, None), (3, "")]


def test_pipeline_on_awkward_rows(spark, to_docs, rows, bench_rows, tmp_path):
    """Nulls, empty and long texts, repeated rows and ids, and columns whose names the stages use themselves."""
    leak = bench_rows[0][1].replace("40", "55").replace("Alice", "Maria")
    data = rows + [(900, f"some words before. {leak} and words behind", "en", "s0")] + [rows[0]] * 3
    docs = to_docs(data)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench_rows, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = now
        now = cut_lineage(stage(spark, now, str(tmp_path)))
        assert now.columns == docs.columns, name
        extra = now.distinct().exceptAll(before.distinct())
        assert extra.count() == 0, name  # rows of the stage before, nothing else
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text_crc32) for r in out) == Counter((r.doc_id, crc32((r.text or "").encode())) for r in now.collect())
    assert 900 not in {r.doc_id for r in out} and 600 not in {r.doc_id for r in out}
    kept = Counter((r.doc_id, r.text_crc32) for r in out)
    assert max(kept.values()) <= 3 and len({c for _, c in kept}) == len(kept)  # one of each text, at most three times


def test_pipeline_leaves_one_table(spark, to_docs, rows, bench_rows, tmp_path, monkeypatch):
    to_docs(rows[:30]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench_rows, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    base = tmp_path / "shared"
    monkeypatch.setattr(corpus_pipeline, "ensure_checkpoint_dir", lambda spark: str(base))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(str(i), lambda spark, docs, sf_dir: docs) for i in range(4)])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 30
    assert [p.name for p in base.glob("*/*")] == ["3-3"]


def test_pipeline_on_empty_tables(spark, no_docs, tmp_path):
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
