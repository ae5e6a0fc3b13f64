"""Line dedup by prefix doubling over line sequences (operator 8).

Documents are sequences of line ids (64-bit hashes of the lines that are not
blank). Prefix doubling names the runs of ``min_lines``, twice, four times, ... as
many lines that begin at a place, each from two names of half the length, and goes on
until no name repeats. Names are hashes, so equal runs get equal names without a
global sort; a place whose run is alone in the corpus takes no part in longer ones.

The names are then walked from the longest to the shortest, down to a single line, and split
the places of a shared run of ``min_lines`` lines into the inner nodes of the suffix tree: a node is an interval of
the suffix array with its longest common prefix, its number of places and its first place. A node is an item of
the node above through its first place alone, so all steps together hold at most about two items a place.
Every place is an item but not the first of one node at most: that node is the longest run that begins there
and also at an earlier place. The lines of these runs are deleted.

Only DataFrame operations: the first names are built inside each document's row, then
exchanged as (name, place); groups keep a count and their smallest place (partial
aggregation), so a run that a third of all documents share never meets in one task.

Defined results: blank lines are no units, never break a run and are kept; null
or empty text has no lines and keeps the empty text; repeated runs inside one
document count (the later copy goes); places are judged on the input; null
doc_id sorts last; rows with equal id and text are one document and get equal
rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segstats.session import cut_lineage

SOLID = r"[^\x20\x09-\x0D]"
DOC = ["no_id", "id", "text_hash"]  # a document: is its id null, its id (0 for null), its text
DOC_TYPES = ["no_id boolean", "id long", "text_hash long"]


def _pairs(names: Column, step: int) -> Column:
    """Names of runs made of the runs that begin ``step`` apart."""
    n = F.size(names) - step
    return F.when(n >= 1, F.zip_with(F.slice(names, 1, F.greatest(n, F.lit(1))), F.slice(names, step + 1, F.greatest(n, F.lit(1))),
                                     lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>"))


def run_names(units: Column, length: int) -> Column:
    """Names of all runs of ``length`` units by prefix doubling."""
    names, have = F.transform(units, lambda u: F.xxhash64(u)), 1
    while have < length:
        step = min(have, length - have)
        names, have = _pairs(names, step), have + step
    return names


def _place() -> Column:
    return F.struct(*DOC, "line")


def _repeating(runs: DataFrame) -> DataFrame:
    """The rows of ``runs`` (one for each place) whose name occurs at several places."""
    runs = cut_lineage(runs)
    names = runs.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("name")
    # sorted joins at every size (large sides are split by AQE)
    return cut_lineage(runs.join(names.hint("merge"), "name", "left_semi"))


def named_places(docs: DataFrame, min_lines: int, id_col: str = "doc_id", text_col: str = "text") -> list[DataFrame]:
    """(no_id, id, text_hash, line, name) of the places whose run of ``min_lines``, 2 * ``min_lines``, 4 * ``min_lines``, ...
    lines occurs at several places, a table for each length up to the last one that has any."""
    key = F.col(id_col).cast("long")
    d = docs.select(key.isNull().alias("no_id"), F.coalesce(key, F.lit(0).cast("long")).alias("id"), F.xxhash64(text_col).alias("text_hash"),
                    F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: x.rlike(SOLID)).alias("units"))
    runs = cut_lineage(d.select(*DOC, F.posexplode(run_names(F.col("units"), min_lines)).alias("line", "name")))
    shared = runs.groupBy("name").agg(F.min(_place()).alias("first"), F.max(_place()).alias("last")).filter("first <> last").select("name")
    levels, step = [], min_lines
    level = cut_lineage(runs.join(shared.hint("merge"), "name", "left_semi").distinct())
    while not level.isEmpty():
        levels.append(level)
        other = F.first("name").over(Window.partitionBy(*DOC).orderBy("line").rangeBetween(step, step))
        longer = level.withColumn("other", other).filter("other is not null").select(*DOC, "line", F.xxhash64("name", "other").alias("name"))
        level, step = _repeating(longer), 2 * step
    return levels


def _steps(min_lines: int, levels: int) -> list[tuple[int, int]]:
    """(number of a level, lines) of the walk: its names say whether so many more lines are shared. Names of
    ``min_lines`` lines also tell fewer, as the lines before are known to be shared."""
    out = [(j, min_lines << j) for j in reversed(range(levels if levels > 1 else 0))]
    open_ = min_lines  # fewer lines than these may still be shared
    while open_ > 1:
        open_ = -(-open_ // 2)
        out.append((0, open_))
    return out


def _split(items: DataFrame, level: DataFrame, length: int, lines: int) -> DataFrame:
    """One step of the walk: the items of a node that share ``lines`` more lines go to a node of their own, which
    stays in the old one as the item of its first place; a node all of whose items share them becomes longer."""
    at = level.select(*DOC, F.col("line").alias("at"), F.col("name").alias("key"))
    known = cut_lineage(items.withColumn("at", F.col("line") + F.col("length") + (lines - length)).join(at.hint("merge"), [*DOC, "at"], "left").drop("at"))
    groups = cut_lineage(known.groupBy("node", "length", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("copies"), F.min(_place()).alias("first")))
    sizes = groups.groupBy("node").agg(F.sum("n").alias("size"))
    made = cut_lineage(groups.filter("key is not null and n > 1").join(sizes.hint("merge"), "node").withColumn("whole", F.col("n") == F.col("size"))
                       .withColumn("below", F.when(F.col("whole"), F.col("node")).otherwise(F.xxhash64("node", "length", "key", F.lit(lines)))))
    keyed = known.filter("key is not null").join(made.select("node", "key", "below").hint("merge"), ["node", "key"], "left")
    moved = keyed.select(F.coalesce("below", "node").alias("node"), F.when(F.col("below").isNotNull(), F.col("length") + lines).otherwise(F.col("length")).alias("length"),
                         *DOC, "line", "copies")
    stay = known.filter("key is null").drop("key").select(*moved.columns)
    above = made.filter("not whole").select("node", "length", "first.*", "copies").select(*moved.columns)
    return cut_lineage(moved.unionByName(stay).unionByName(above))


def run_items(docs: DataFrame, min_lines: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inner nodes of the suffix tree that are at least ``min_lines`` lines long, by their items: node, length (lines that all its
    places share), no_id, id, text_hash, line (a place; the first one of a longer node), copies (places of the item)."""
    levels = named_places(docs, min_lines, id_col, text_col)
    if not levels:
        return docs.sparkSession.createDataFrame([], f"node long, length int, {', '.join(DOC_TYPES)}, line int, copies long")
    items = levels[0].select(F.col("name").alias("node"), F.lit(min_lines).alias("length"), *DOC, "line", F.lit(1).cast("long").alias("copies"))
    for j, lines in _steps(min_lines, len(levels)):
        items = _split(items, levels[j], min_lines << j, lines)
    return items


def repeated_runs(docs: DataFrame, min_lines: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Later copies: doc_id, text_hash, line (unit number from 0), length: the longest run of at least ``min_lines`` lines
    that begins there and also at an earlier place; copies: the number of its places; first: the
    earliest of them (no_id, id, text_hash, line)."""
    items = run_items(docs, min_lines, id_col, text_col)
    nodes = cut_lineage(items.groupBy("node").agg(F.min(_place()).alias("first"), F.sum("copies").alias("copies")))
    later = items.drop("copies").join(nodes.hint("merge"), "node").filter(_place() > F.col("first"))
    return later.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "text_hash", "line", "length", "copies", "first")


def _lines(runs: str) -> Column:
    """The lines that the runs (line, length) of a document cover, in order. Runs of one document end in the order
    in which they begin, so each adds the lines after the end of the one before."""
    before = lambda i: F.get(runs, i - 1)
    spans = F.transform(runs, lambda r, i: F.struct(
        F.greatest(r["line"], F.coalesce(before(i)["line"] + before(i)["length"], F.lit(0))).alias("a"), (r["line"] + r["length"]).alias("b")))
    return F.flatten(F.transform(F.filter(spans, lambda s: s["a"] < s["b"]), lambda s: F.sequence(s["a"], s["b"] - 1)))


def dedup_line_runs(docs: DataFrame, min_lines: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, n_runs (maximal removed
    runs), kept_text (all other lines, blank ones included)."""
    later = repeated_runs(docs, min_lines, id_col, text_col)
    per = later.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(
        F.sort_array(F.collect_list(F.struct("line", "length"))).alias("runs"))
    per = cut_lineage(per.select("__id", "__hash", _lines("runs").alias("gone")))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"),
                    F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    j = d.join(per.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")), "left")
    lines = F.split("text", "\n")
    n = F.size("lines")
    solid = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("lines", i).rlike(SOLID))
    none = F.array().cast("array<int>")
    j = j.withColumn("lines", lines).withColumn("solid", solid).withColumn("gone", F.coalesce("gone", none))
    at = F.transform("gone", lambda u: F.element_at("solid", u + 1))
    kept = F.transform(F.array_except(F.sequence(F.lit(1), n), at), lambda i: F.element_at("lines", i))
    runs = F.size(F.array_except("gone", F.transform("gone", lambda u: u + 1)))
    return j.select("doc_id", F.size("solid").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"),
                    runs.cast("long").alias("n_runs"),
                    F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS p FROM d),
u AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY p) AS q FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
w AS (SELECT *, lead(line) OVER (PARTITION BY r ORDER BY q) AS nxt FROM u),
f AS (SELECT line, nxt, min((doc_id, q)) AS first FROM w WHERE nxt IS NOT NULL GROUP BY line, nxt),
s AS (SELECT w.r, w.q FROM w JOIN f USING (line, nxt) WHERE (w.doc_id, w.q) > f.first),
g AS (SELECT r, q FROM s UNION SELECT r, q + 1 FROM s),
a AS (SELECT l.r, l.p, l.line, u.q, g.q AS gone, lag(g.q) OVER (PARTITION BY l.r, u.q IS NULL ORDER BY u.q) AS prev
      FROM l LEFT JOIN u ON l.r = u.r AND l.p = u.p LEFT JOIN g ON u.r = g.r AND u.q = g.q)
SELECT d.doc_id, count(a.q) AS n_lines, count(a.gone) AS n_removed,
       count(*) FILTER (WHERE a.gone IS NOT NULL AND a.prev IS NULL) AS n_runs,
       sha256(coalesce(string_agg(a.line, chr(10) ORDER BY a.p) FILTER (WHERE a.gone IS NULL), '')) AS kept_sha256
FROM d JOIN a ON d.r = a.r GROUP BY d.r, d.doc_id
"""
