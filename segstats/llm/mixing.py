"""Mixing sources to target weights by hash-threshold histograms (operator 1).

Every document has a uniform hash of its id and text. Per source the sizes are summed by
hash bucket; the bucket in which a source's budget runs out is found by prefix
sums over that small histogram, and only this boundary bucket is refined (the
next bits of the hash) until few rows are left, where the exact hash threshold
is read off. A document is then taken by comparing its hash with its source's
threshold: no sorting, one pass. Thresholds for growing budgets are nested, so
a smaller mix is contained in a larger one; a source whose target exceeds its
size takes every document whole (at most ``max_repeat`` times) and the
threshold decides the extra copy.

Only DataFrame operations. Defined results: null text has size 0; a null source
is a source (ranked last); a null doc_id is hashed like an empty one; rows equal in id and text
share a hash, and where it is the boundary as many of them are taken as bring the source
nearest to its target (they are numbered by input partition, so even a source of one
repeated row is split and sits in no single task); an empty table
gives an empty result; extra columns are kept by ``mix`` and ignored by ``mix_plan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segstats.llm.blocks import fresh
from segstats.session import cut_lineage

HASH_BITS = 60
LEVEL_BITS = 10  # 1,024 buckets of each source per level
EXACT_ROWS = 10_000  # boundary buckets of at most so many rows are read off exactly

WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column | str) -> Column:
    """Words of the text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def row_hash(doc_id: Column, text: Column) -> Column:
    """60-bit hash of the id's decimal text, a colon and the document's text."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def repeating_weights(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """Adds ``weight``: sources in code-point order (null last) weigh ``weights``,
    repeating. ``sizes`` holds one row per source."""
    i = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), i % len(weights) + 1))


def share_targets(sizes: DataFrame, max_repeat: int = 3) -> DataFrame:
    """``target`` of each source (source, source_size, weight): all sizes are shared
    by weight, no target above ``max_repeat`` x its source's size, the excess
    reshared by weight until none is above. One row per source, so windows over
    this table stay small: sources fill up in the order of size / weight."""
    order = [F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()]
    w = Window.orderBy(*order)
    s = sizes.select(
        "source", "source_size", "weight",
        (F.sum("source_size").over(Window.partitionBy()) - max_repeat * F.coalesce(F.sum("source_size").over(
            w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("double").alias("__left"),
        F.sum("weight").over(w.rowsBetween(0, Window.unboundedFollowing)).alias("__weights"),
        F.row_number().over(w).alias("__i"))
    fits = F.col("__left") * F.col("weight") <= float(max_repeat) * F.col("source_size") * F.col("__weights")
    first = F.min(F.when(fits, F.struct("__i", "__left", "__weights"))).over(Window.partitionBy())
    s = s.withColumn("__f", first)
    return s.select(
        "source", "source_size",
        F.when(F.col("__i") < F.col("__f.__i"), float(max_repeat) * F.col("source_size"))
        .otherwise(F.col("__f.__left") * F.col("weight") / F.col("__f.__weights")).alias("target"))


def thresholds(slim: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, whole, threshold, quota): every document is taken
    ``whole`` times, and once more if its hash is below ``threshold``; of the rows at the
    threshold ``quota`` are (-1 and 0 for a source without words)."""
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")
    plan = cut_lineage(targets.withColumn("whole", whole).withColumn(
        "budget", F.col("target") - F.col("whole") * F.col("source_size")))
    rows = slim.select("source", "size", "hash")
    # where the budget runs out so far: buckets of the hash's first bits, and the size before the bucket
    edge, shift = plan.select("source", "budget", F.lit(0).cast("long").alias("edge"), F.lit(0).cast("long").alias("before")), HASH_BITS

    def inside(edge: DataFrame, shift: int) -> DataFrame:
        e = edge.withColumnRenamed("source", "__s")
        return rows.join(e, F.col("source").eqNullSafe(F.col("__s")) & (F.shiftright("hash", shift) == F.col("edge"))).drop("__s")

    def cumulative(hist: DataFrame) -> DataFrame:
        upto = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("cell"))
        return hist.withColumn("upto", upto)

    while True:
        shift -= LEVEL_BITS
        hist = inside(edge, shift + LEVEL_BITS).groupBy(
            "source", "budget", "before", F.shiftright("hash", shift).alias("cell")).agg(
            F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"))
        cut = cumulative(hist).filter(F.col("upto") > F.col("budget")).groupBy("source").agg(
            F.min_by(F.struct("budget", F.col("cell").alias("edge"), (F.col("upto") - F.col("size")).alias("before"), "rows"),
                     "cell").alias("c"))
        edge = cut_lineage(cut.select("source", "c.*"))
        most = edge.agg(F.max("rows")).first()[0] or 0
        edge = edge.drop("rows")
        if most <= EXACT_ROWS or shift == 0:
            break
    exact = cumulative(inside(edge, shift).groupBy("source", "budget", "before", F.col("hash").alias("cell")).agg(
        F.sum("size").alias("size"), F.max("size").alias("one"))).filter(F.col("upto") > F.col("budget"))
    room = F.col("budget") - (F.col("upto") - F.col("size"))
    quota = F.floor((2 * room + F.col("one")) / (2 * F.col("one"))).cast("long")  # the nearest number of rows
    last = exact.groupBy(F.col("source").alias("__s")).agg(F.min_by(F.struct("cell", quota.alias("quota")), "cell").alias("__c"))
    out = plan.join(last, F.col("source").eqNullSafe(F.col("__s")), "left")
    # one row per source; read back, its size decides whether it is broadcast
    return cut_lineage(out.select("source", "source_size", "target", "whole", F.coalesce("__c.cell", F.lit(-1)).cast("long").alias("threshold"),
                                  F.coalesce("__c.quota", F.lit(0)).cast("long").alias("quota")))


def _copies(rows: DataFrame, source: str, hash_: str, whole: str, threshold: str, quota: str, out: str) -> DataFrame:
    """``rows`` (with their source's plan) with the number of copies ``out``. The rows at a threshold are
    written and numbered: counts by source and input partition give offsets, so a partition's rows are all a window holds."""
    sure = rows.filter(F.col(hash_) != F.col(threshold)).withColumn(out, F.col(whole) + (F.col(hash_) < F.col(threshold)).cast("long"))
    row, part, s, p, off = fresh(rows, "row", "part", "source", "part_", "offset")
    edge = cut_lineage(rows.filter(F.col(hash_) == F.col(threshold)).withColumn(row, F.monotonically_increasing_id()))
    edge = edge.withColumn(part, F.shiftright(row, 33))
    n = edge.groupBy(F.col(source).alias(s), F.col(part).alias(p)).count()
    before = Window.partitionBy(s).orderBy(p)
    n = cut_lineage(n.select(s, p, (F.sum("count").over(before) - F.col("count")).alias(off)))
    at = F.col(off) + F.row_number().over(Window.partitionBy(source, part).orderBy(row))
    edge = edge.join(n, F.col(source).eqNullSafe(F.col(s)) & (F.col(part) == F.col(p))).withColumn(out, at)
    edge = edge.withColumn(out, F.col(whole) + (F.col(out) <= F.col(quota)).cast("long"))
    return sure.unionByName(edge.drop(row, part, s, p, off))


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return cut_lineage(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        row_hash(F.col(id_col), F.col(text_col)).alias("hash")))


def _plan(slim: DataFrame, weigh, max_repeat: int) -> DataFrame:
    sizes = cut_lineage(slim.groupBy("source").agg(F.sum("size").alias("source_size")))
    return thresholds(slim, share_targets(weigh(sizes), max_repeat))


def mix_plan(docs: DataFrame, weigh=repeating_weights, max_repeat: int = 3, id_col: str = "doc_id",
             text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size (words), source_size, target,
    copies, taken (size x copies). ``weigh`` adds ``weight`` to (source, source_size)."""
    slim = _measured(docs, id_col, text_col, source_col)
    plan = _plan(slim, weigh, max_repeat).withColumnRenamed("source", "__s")
    rows = slim.join(plan, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    return _copies(rows, "source", "hash", "whole", "threshold", "quota", "copies").select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weigh=repeating_weights, max_repeat: int = 3, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed documents: every column of ``docs``, each row as often as the mix takes it."""
    slim = _measured(docs, id_col, text_col, source_col)
    s, h, whole, threshold, quota, copies = fresh(docs, "s", "hash", "whole", "threshold", "quota", "copies")
    plan = _plan(slim, weigh, max_repeat).select(
        F.col("source").alias(s), F.col("whole").alias(whole), F.col("threshold").alias(threshold), F.col("quota").alias(quota))
    rows = docs.withColumn(h, row_hash(F.col(id_col), F.col(text_col))).join(plan, F.col(source_col).eqNullSafe(F.col(s)))
    taken = _copies(rows, source_col, h, whole, threshold, quota, copies).filter(F.col(copies) > 0)
    names = [f"`{c}`" for c in docs.columns]
    return taken.withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*names)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS ss FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
                  WHEN 0 THEN 5::DOUBLE WHEN 1 THEN 2::DOUBLE ELSE 1::DOUBLE END AS w FROM s),
o AS (SELECT *, (sum(ss) OVER () - 3 * coalesce(sum(ss) OVER (
                  ORDER BY ss / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS l,
             sum(w) OVER (ORDER BY ss / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rw,
             row_number() OVER (ORDER BY ss / w, source NULLS LAST) AS i FROM w),
f AS (SELECT * FROM o WHERE l * w <= 3::DOUBLE * ss * rw ORDER BY i LIMIT 1),
t AS (SELECT o.source, o.ss, CASE WHEN o.i < f.i THEN 3::DOUBLE * o.ss ELSE f.l * o.w / f.rw END AS target FROM o, f),
p AS (SELECT *, CASE WHEN ss = 0 THEN 0 ELSE floor(target / ss) END::BIGINT AS whole FROM t),
c AS (SELECT source, h, sum(size) AS hs, max(size) AS one,
             sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM d GROUP BY source, h),
b AS (SELECT c.source, c.h, floor((2 * (target - whole * ss - (upto - hs)) + one) / (2 * one))::BIGINT AS quota,
             row_number() OVER (PARTITION BY c.source ORDER BY c.h) AS i
      FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source WHERE upto > target - whole * ss),
x AS (SELECT source, h AS edge, quota FROM b WHERE i = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY source, h) AS number FROM d),
e AS (SELECT n.doc_id, n.source, n.size, p.ss, p.target,
             p.whole + CASE WHEN h < x.edge OR h = x.edge AND number <= quota THEN 1 ELSE 0 END AS copies
      FROM n JOIN p ON n.source IS NOT DISTINCT FROM p.source LEFT JOIN x ON n.source IS NOT DISTINCT FROM x.source)
SELECT doc_id, source, size, ss AS source_size, target, copies, size * copies AS taken FROM e
"""
