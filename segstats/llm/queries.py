"""One registered query per operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segstats.llm import (
    decontaminate, fill_middle, fm_dedup, group_join, kmeans_tree, langid, lattice_lm, line_dedup, mixing, periodic, sharding, suffix_dedup, top_k,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {"op1_mixing": mixing.ORACLE, "op8_line_dedup": line_dedup.ORACLE}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources weigh 5, 2, 1 in turn; at most 3 copies of a document."""
    return mixing.mix_plan(_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that also start in an earlier document."""
    out = suffix_dedup.remove_repeated_bytes(_table(spark, sf_dir, "documents"), min_bytes=50)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the documents whose crc32(doc_id) mod 10 is not 0, one component
    per language among them."""
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return lattice_lm.score_texts(_table(spark, sf_dir, "documents"), train=crc % 10 != 0, component=F.col("lang"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per contaminated (document, benchmark item)."""
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("text_hash")


def op5_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 nearest by inner product for every vec_id divisible by 20."""
    vectors = _table(spark, sf_dir, "embeddings")
    return kmeans_tree.nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20)[0]


def op6_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have Jaccard >= 0.85."""
    return group_join.jaccard_components(_table(spark, sf_dir, "documents"), n=4, percent=85).drop("text_hash")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 shards under the law ``rows``."""
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), shards=16)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least two lines, later copies deleted."""
    out = line_dedup.dedup_line_runs(_table(spark, sf_dir, "documents"), min_lines=2)
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from labelled documents whose crc32(doc_id) mod 4 is not 2."""
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(langid.train_split(docs))
    return langid.identify(docs, model).withColumn("held_out", langid.held_out(F.col("doc_id")))


def op10_fm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 13 words that also start in an earlier document."""
    out = fm_dedup.remove_repeated_words(_table(spark, sf_dir, "documents"), window=13)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def replanted(docs: DataFrame) -> DataFrame:
    """doc_id, text: of the documents whose h = crc32(doc_id) ends in 0, every word i >= a is
    word a + (i - a) % p (a = g % n, p = 1 + (n - a) / (3 + g % 8), g = h / 10)."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    own = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
    g, n = F.floor(F.col("h") / 10), F.size("words")
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("words", a + 1, p), F.ceil((n - a) / p).cast("int")))
    text = F.array_join(F.slice(F.concat(F.slice("words", F.lit(1), a), tail), F.lit(1), n), " ")
    return own.select("doc_id", F.when((F.col("h") % 10 == 0) & (n > 0), text).otherwise(F.col("text")).alias("text"))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least three periods and 24 words; a tenth of the documents is made periodic first."""
    out = periodic.periodic_runs(replanted(_table(spark, sf_dir, "documents")), min_words=24, times=3)
    best = periodic.best_run(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return out.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two seeded cuts by code points, a tenth plain, a fifth of the rest suffix first."""
    out = fill_middle.transform(_table(spark, sf_dir, "documents"), units="chars", seed=1, plain_percent=10, spm_percent=20)
    text = fill_middle.restore(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                      F.sha2(text.cast("binary"), 256).alias("restored_sha256"))


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5 greatest inner products of floor(256 x) vectors for every vec_id divisible by 50."""
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), top_k.quantized(F.col("embedding"), 256).alias("weights"))
    return top_k.top_k(rows, rows.filter(F.col("id") % 50 == 0), k=5)


ORACLE_SQL["op12_fill_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
  ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""

ORACLE_SQL["op13_top_k"] = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
t AS (SELECT r, generate_subscripts(embedding, 1) AS term, unnest(embedding) AS x FROM e),
bad AS (SELECT DISTINCT r FROM t WHERE x IS NULL OR NOT isfinite(x)),
w AS (SELECT r, term, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS w FROM t WHERE r NOT IN (SELECT r FROM bad)),
v AS (SELECT r, vec_id FROM e WHERE r NOT IN (SELECT r FROM bad)),
pairs AS (SELECT q.r AS q, c.r AS c, sum(q.w * c.w) AS s FROM w q JOIN v ON v.r = q.r AND v.vec_id % 50 = 0 JOIN w c ON c.term = q.term GROUP BY q.r, c.r),
scored AS (SELECT q.r AS q, q.vec_id AS query_id, c.vec_id, CAST(coalesce(p.s, 0) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id LEFT JOIN pairs p ON p.q = q.r AND p.c = c.r WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""

for _f in (op1_mixing, op2_suffix_dedup, op3_lattice_lm, op4_decontaminate, op5_kmeans_tree, op6_group_join, op7_sharding,
           op8_line_dedup, op9_langid, op10_fm_dedup, op11_periodic, op12_fill_middle, op13_top_k):
    QUERIES[_f.__name__] = _f
