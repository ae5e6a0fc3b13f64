"""Sharding by balanced label propagation (operator 7).

``shard_documents`` puts every document into one of ``shards`` shards; linked
documents (equal texts) move towards the shard of most of their neighbours.
Every linked document starts in the shard of its hash. A round pre-aggregates the
neighbours' shards of each group of links, joins the most frequent one back to
the members, and admits moves under capacity quotas: the flow between each
pair of shards is cut so that the linked rows of no shard pass its ``capacity``
(all rows over shards); which members move is decided by their hashes. Rounds stop
when nothing moves. Unlinked documents then fill each shard's remaining room, and
shards are evened by rank, in the order of (label, groups between two halves of
unlinked rows), so the cuts between neighbouring shards fall on unlinked rows
wherever there are any.
Law ``rows``: counts differ by at most one, slots are gapless from 0.

A group that holds a third of all rows is split by the quotas; ranks come from
buckets of bounded size (a large group has buckets of its own), whose offsets
are prefix sums over their counts. Only (shards x shards) flows reach the driver.

Defined results: null text counts as empty (size 1, crc 0); null and repeated
doc_ids are ordinary rows (equal rows are interchangeable); an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segstats.session import cut_lineage

BUCKET_ROWS = 4000  # rows ranked together


def _quotas(loads: list[int], flows: dict[tuple[int, int], int], capacity: float) -> dict[tuple[int, int], float]:
    """Share of each flow (from, to) to admit so that no shard passes its capacity.

    Opposite flows are exchanged in full; the remaining flows into a shard share
    the room left in it."""
    allowed = {f: min(n, flows.get(f[::-1], 0)) for f, n in flows.items()}
    for to in range(len(loads)):
        rest = {f: n - allowed[f] for f, n in flows.items() if f[1] == to and n > allowed[f]}
        room = max(0.0, capacity - loads[to])
        total = sum(rest.values())
        for f, n in rest.items():
            allowed[f] += n * min(1.0, room / total)
    return {f: allowed[f] / n for f, n in flows.items() if allowed[f] > 0}


def _loads(linked: DataFrame, shards: int) -> list[int]:
    got = {label: n for label, n in linked.groupBy("label").count().collect()}  # one row per shard
    return [got.get(s, 0) for s in range(shards)]


def propagate(linked: DataFrame, shards: int, rounds: int, capacity: float) -> tuple[DataFrame, list[int]]:
    """Labels of linked rows (row, doc_id, group, label) after the rounds of label
    propagation, and how many have each label."""
    spark = linked.sparkSession
    loads = _loads(linked, shards)
    for r in range(rounds):
        votes = linked.groupBy("group", "label").count()
        best = votes.groupBy("group").agg(
            F.max_by("label", F.struct("count", -F.col("label"))).alias("want"), F.max("count").alias("most"),
            F.sum("count").alias("all")).filter("most < all")
        # few groups still differ; the table's size decides how it is joined
        asked = linked.join(cut_lineage(best.select("group", "want")), "group", "left")
        moving = cut_lineage(asked)
        flows = {(a, b): n for a, b, n in moving.filter("want <> label").groupBy("label", "want").count().collect()}
        share = _quotas(loads, flows, capacity)
        if not share:
            break
        quota = F.broadcast(spark.createDataFrame(  # at most shards x shards rows
            [(a, b, s) for (a, b), s in share.items()], "label int, want int, share double"))
        u = F.pmod(F.xxhash64("doc_id", "group", F.lit(r + 3)), F.lit(1 << 30)) / float(1 << 30)
        moved = cut_lineage(moving.join(quota, ["label", "want"], "left").select(
            "row", "doc_id", "group", F.when(u < F.col("share"), F.col("want")).otherwise(F.col("label")).alias("label")))
        linked, loads = moved, _loads(moved, shards)
    return linked, loads


def ranked(rows: DataFrame) -> DataFrame:
    """Adds ``rank`` (from 0) in the order of (label, part, place, group, ...)."""
    key = ["label", "part", "place", "big", "sub"]
    cells = rows.groupBy(*key).count()
    parts = cells.groupBy("label", "part").agg(F.sum("count").alias("n"))
    before = parts.select("label", "part", (F.sum("n").over(Window.orderBy("label", "part")) - F.col("n")).alias("base"))
    w = Window.partitionBy("label", "part").orderBy("place", "big", "sub")
    # about rows / BUCKET_ROWS cells; (3 x shards) bases
    cells = cut_lineage(cells.join(F.broadcast(before), ["label", "part"]).select(
        *key, (F.col("base") + F.sum("count").over(w) - F.col("count")).alias("offset")))
    inner = Window.partitionBy(*key).orderBy("group", "doc_id", "size", "row")
    return rows.join(cells, key).withColumn("rank", F.col("offset") + F.row_number().over(inner) - 1)


def shard_documents(docs: DataFrame, shards: int = 16, rounds: int = 4,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = cut_lineage(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("group")))
    groups = cut_lineage(slim.groupBy("group").count().filter("count > 1"))
    n = slim.count()
    rows = cut_lineage(slim.join(groups, "group", "left"))
    start = F.pmod(F.xxhash64("group", "doc_id"), F.lit(shards)).cast("int")
    linked = rows.filter("count is not null").select("row", "doc_id", "group", start.alias("label"))
    labels, loads = propagate(cut_lineage(linked), shards, rounds, n / shards)
    room = [max(0.0, n / shards - x) for x in loads]
    upto = [sum(room[:s + 1]) / max(1e-9, sum(room)) for s in range(shards - 1)]
    u = F.pmod(F.xxhash64("group", "doc_id", F.lit(2)), F.lit(1 << 30)) / float(1 << 30)
    fill = sum((F.when(u >= F.lit(x), 1).otherwise(0) for x in upto), F.lit(0))
    places = max(1, n // (3 * shards * BUCKET_ROWS))
    # equal rows of a large group (a null or repeated id) are cells of their own, cut by row
    hot = rows.filter(F.col("count") > BUCKET_ROWS).groupBy("group", "doc_id").count().filter(F.col("count") > BUCKET_ROWS)
    hot = cut_lineage(hot.select(F.col("group").alias("hot_group"), F.col("doc_id").alias("hot_id"), F.col("count").alias("equal")))
    rows = rows.join(hot, (F.col("group") == F.col("hot_group")) & F.col("doc_id").eqNullSafe(F.col("hot_id")), "left").drop("hot_group", "hot_id")
    big = F.col("count") > BUCKET_ROWS
    one = F.col("equal").isNotNull()
    half = F.pmod(F.xxhash64("doc_id", "group", F.lit(1)), F.lit(2)).cast("int") * 2
    rows = rows.join(cut_lineage(labels.select("row", F.col("label").alias("moved"))), "row", "left").select(
        "row", "doc_id", "size", "text_crc32", "group", F.coalesce("moved", fill).alias("label"),
        F.when(F.col("count").isNotNull(), 1).otherwise(half).alias("part"),
        F.pmod(F.xxhash64("group"), F.lit(places)).alias("place"),
        F.when(one, F.concat("group", F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).when(
            big, F.col("group")).otherwise("").alias("big"),
        F.when(one, F.pmod(F.xxhash64("row"), F.ceil(F.col("equal") / BUCKET_ROWS))).when(
            big, F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("count") / BUCKET_ROWS))).otherwise(0).alias("sub"))
    q, m = divmod(n, shards)
    rank = F.col("rank")
    shard = F.when(rank < m * (q + 1), F.floor(rank / (q + 1))).otherwise(m + F.floor((rank - m * (q + 1)) / max(1, q)))
    start = F.least(F.col("shard"), F.lit(m)) * (q + 1) + F.greatest(F.col("shard") - m, F.lit(0)) * q
    return ranked(cut_lineage(rows)).withColumn("shard", shard.cast("int")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (rank - start).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
