"""Benchmark decontamination by template canonicalisation (operator 4).

Words of a text become template tokens: numbers, capitalised names inside
sentences (a run of them is one slot), and units after numbers become typed
placeholders; other words are lower-cased and lose their punctuation. A second,
case-folded template has no name slots: it meets copies whose case changed. Items
also have the typed template of their text behind a word, where a capitalised
first word is a name. Windows of ``window`` tokens of the documents are hash-joined
with those of the benchmark that hold ``min_literals`` plain words, so a question
whose numbers, names or units were replaced still meets its template. On the
diagonals (equal distance of positions) that so meet, all windows are compared,
those without plain words too; diagonals at most ``NEAR`` tokens apart are added
up, so an inserted or removed token splits nothing. Where the equal windows of a
document and an item are as many as ``min_tokens`` tokens of the item (or all of
a shorter one) have, slots are checked: every value of the item must stand for one
value of the document and the other way round (``min_consistency``: distinct values
over distinct pairs). Items shorter than a window match documents or sentences and
lines of documents whose whole template equals theirs; those of at least ``min_inside``
tokens also match inside a sentence, by windows of their own length.

Only DataFrame operations. The join uses the *distinct* hashes of the
benchmark, written first, so that their measured size decides whether they are
broadcast (else it is a shuffled join).

Defined results: null or empty texts and items match nothing; an item without any
window of ``min_literals`` plain words is no evidence; rows with equal id and
text share one result row; a null doc_id is an id of its own; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segstats.llm.blocks import fresh
from segstats.session import cut_lineage

MARK = "\u0001"  # starts a slot: MARK + type (p name, n number, u unit) + value
JOIN = "\u0002"  # between the words of one name
PIECE = 1 << 15
NEAR = 4  # diagonals at most so far apart are added up
# Units recognised after a number.
UNITS = ("mm cm dm km m mg g kg t ml cl l s sec second seconds min minute minutes h hour hours day days week weeks "
         "month months year years inch inches ft foot feet yd yard yards mile miles mph kmh oz lb lbs pound pounds "
         "euro euros dollar dollars cent cents percent degrees watt watts kw volt volts hz liter liters litre litres "
         "meter meters metre metres gram grams kilometer kilometers kilogram kilograms")
# Every pattern begins with a fixed character, so the search skips to it; tokens have one space before them.
SPACE = r"[\s\p{Z}\x01\x02&&[^ ]][\s\p{Z}\x01\x02]*| [\s\p{Z}\x01\x02]+"
FIRST = r" (?=[A-Z\p{Lu}])(?<=[a-z\p{L}\p{N},;:] )"  # before a capitalised word behind a word
NAME = FIRST + r"\S++(?: (?=[A-Z\p{Lu}])(?<=[a-z\p{L}\p{N}] )\S++)*+"  # such a word and the capitalised words behind it
INNER = r"(?:(?<=[\p{L}\p{N},;:] )(?=\p{Lu})|\G(?!\A))(\S*[\p{L}\p{N}]) (?=\p{Lu})"  # a word of a name that goes on
NUMBER = r" ([^\s\p{L}\p{N}\x01]{0,3}+\d\S*+)"
UNIT = r"(\x01n\S*+ )((?i:" + "|".join(UNITS.split()) + r")(?![\p{L}\p{N}])\S*+)"
MARKS = r"[^a-z0-9 \x01\p{L}\p{N}]+"


def spaced(text: Column) -> Column:
    """The text with one space before every word and no other white space."""
    return F.concat(F.lit(" "), F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))


def templated(t: Column, values: bool = False, names: bool = True) -> Column:
    """Template tokens of a ``spaced`` text, each behind a space."""
    keep = "$1" if values else ""
    if names and values:
        t = F.regexp_replace(F.regexp_replace(t, INNER, "$1" + JOIN), FIRST + r"(\S++)", " " + MARK + "p$1")
    elif names:
        t = F.regexp_replace(t, NAME, " " + MARK + "p")
    t = F.regexp_replace(t, NUMBER, " " + MARK + "n" + keep)
    t = F.regexp_replace(t, UNIT, "$1" + MARK + "u" + keep.replace("1", "2"))
    return F.regexp_replace(F.lower(t), MARKS, "")


def words(t: Column) -> Column:
    return F.array_remove(F.split(t, " "), "")


def template(text: Column, values: bool = False, names: bool = True) -> Column:
    """Template tokens (array<string>); with ``values`` the slots keep their values;
    without ``names`` names are lower-cased words like others."""
    return words(templated(spaced(text), values, names))


def is_slot(token: Column) -> Column:
    return token.startswith(MARK)


def types(values: Column) -> Column:
    """Template tokens without the values of slots."""
    return F.transform(values, lambda w: F.when(is_slot(w), F.substring(w, 1, 2)).otherwise(w))


def token_hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.xxhash64(w))


def window_hashes(hashes: Column, window: int, kind: Column) -> Column:
    """Hash of every window of the token hashes, by start; null without any. ``hashes`` is
    a column of the input: elements are read by position, nothing is copied."""
    n = F.size(hashes)
    return F.when(n >= window, F.transform(F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(
        *[F.get(hashes, i + k) for k in range(window)], kind)))


def windows_of(hashed: DataFrame, window: int, *keep: str) -> DataFrame:
    """keep..., pos, hash: the windows of column ``h`` (hashes as in ``window_hashes``). Shifted slices are
    laid side by side and hashed as columns; at most ``PIECE`` windows of a text are laid out at a time."""
    n = F.greatest(F.least(F.size("h") - F.col("s") - window + 1, F.lit(PIECE)), F.lit(0))
    pieces = hashed.select(*keep, "kind", "h", F.explode(F.sequence(F.lit(0), F.greatest(F.size("h") - window, F.lit(0)), F.lit(PIECE))).alias("s"))
    side = F.arrays_zip(*[F.slice("h", F.col("s") + k + 1, n).alias(f"h{k}") for k in range(window)])
    rows = pieces.select(*keep, "kind", "s", F.posexplode(side).alias("i", "z"))
    names = [f.name for f in rows.schema["z"].dataType.fields]
    return rows.select(*keep, (F.col("s") + F.col("i")).alias("pos"), F.xxhash64(*[F.col("z").getField(x) for x in names], "kind").alias("hash"))


def _kinds(t: Column) -> Column:
    """(kind, t): the typed (kind 0) and the case-folded template (1) of a ``spaced`` text."""
    return F.array(*[F.struct(F.lit(k).alias("kind"), templated(t, names=not k).alias("t")) for k in (0, 1)])


def _hashed(docs: DataFrame, *keep: str) -> DataFrame:
    """keep..., kind, h (token hashes) of the two templates of column ``text``."""
    t = docs.select(*keep, spaced(F.col("text")).alias("t")).select(*keep, F.explode(_kinds(F.col("t"))).alias("s"))
    return t.select(*keep, "s.kind", token_hashes(words(F.col("s.t"))).alias("h"))


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item_id, item_hash, variant, kind, values, tokens: the templates of each item."""
    text = F.col(text_col)
    behind = template(F.concat(F.lit("x "), F.coalesce(text, F.lit(""))), True)  # as it stands behind a word
    b = benchmark.select(F.col(item_col).alias("item_id"), F.xxhash64(text).alias("item_hash"), template(text, True).alias("t"),
                         F.slice(behind, 2, F.greatest(F.size(behind) - 1, F.lit(0))).alias("b"), template(text, True, False).alias("f"))
    forms = F.array(*[F.struct(F.lit(i).alias("variant"), F.lit(k).alias("kind"), F.col(c).alias("values"))
                      for i, (k, c) in enumerate([(0, "t"), (0, "b"), (1, "f")])])
    same = types(F.col("t")) == types(F.col("b"))
    forms = F.filter(forms, lambda v: (F.size(v["values"]) > 0) & ((v["variant"] != 1) | ~same))
    b = b.dropDuplicates(["item_id", "item_hash"]).select("item_id", "item_hash", F.explode(forms).alias("v"))
    return cut_lineage(b.select("item_id", "item_hash", "v.*").withColumn("tokens", types(F.col("values"))))


def _sentences(text: Column) -> Column:
    """The whole text, then its sentences and lines."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=[.?!])\s+|\s*\n\s*"), lambda p: p != "")
    return F.concat(F.array(F.coalesce(text, F.lit(""))), F.when(F.size(parts) > 1, parts).otherwise(F.array().cast("array<string>")))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 8, min_tokens: int = 13, min_literals: int = 3,
                 min_consistency: float = 0.8, min_inside: int = 5, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per (document, item): doc_id, text_hash, item_id, doc_start (token),
    n_windows, n_tokens (tokens of the item covered), item_tokens, n_slots, n_changed, consistency."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    items = _items(benchmark, item_col, item_text_col)
    size = F.size("tokens")
    plain = lambda tokens: F.size(F.filter(tokens, lambda w: ~is_slot(w)))
    rich = F.filter(F.sequence(F.lit(0), size - window), lambda i: plain(F.slice("tokens", i + 1, window)) >= min_literals)
    need = F.least(size, F.lit(min_tokens)) - window + 1
    items = items.withColumn("hashes", token_hashes(F.col("tokens")))
    long = items.filter(size >= window).withColumn("windows", window_hashes(F.col("hashes"), window, F.col("kind"))).withColumn("rich", rich)
    long = cut_lineage(long.withColumn("need", need).withColumn(
        "least", F.greatest(F.lit(1), F.col("need") - (size - window + 1 - F.size("rich")))).drop("hashes"))
    key = ["doc_id", "text_hash", "item_id", "item_hash", "variant", "kind"]
    grams = long.select("item_id", "item_hash", "variant", "kind", "windows", "least", F.explode("rich").alias("item_pos"))
    grams = cut_lineage(grams.withColumn("hash", F.get("windows", F.col("item_pos"))).drop("windows"))
    wanted = cut_lineage(grams.select("hash").distinct())
    windows = windows_of(_hashed(d, "doc_id", "text_hash"), window, "doc_id", "text_hash")
    # few windows remain; repeated rows of one document count once
    hits = cut_lineage(windows.join(wanted, "hash", "left_semi").distinct())
    diagonal = hits.join(grams, "hash").groupBy(*key, "least", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(
        F.collect_set("item_pos").alias("at"))
    # every two diagonals at most NEAR apart are in one band
    band = F.floor(F.col("shift") / NEAR)
    found = cut_lineage(diagonal.withColumn("band", F.explode(F.array(band, band + 1))).groupBy(*key, "least", "band").agg(
        F.sort_array(F.collect_set("shift")).alias("shifts"), F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("n"))
        .filter(F.col("n") >= F.col("least")).select(*key, "shifts").distinct())
    scored = _aligned(found, d, long, window)
    short = cut_lineage(items.filter((size < window) & (plain("tokens") >= F.least(F.lit(min_literals), size))))
    lengths = sorted(r[0] for r in short.select(size).distinct().collect())  # below ``window``
    if lengths:
        scored = scored.unionByName(_sentence_matches(d, short, window))
    for n in lengths:
        if n >= min_inside:
            scored = scored.unionByName(_inside_matches(d, short.filter(size == n), n))
    return _consistent(scored, min_consistency)


def _rows_of(d: DataFrame, found: DataFrame, *more: str) -> DataFrame:
    """The rows of ``d`` that were found, once each (and for each of ``more``): __id, __hash, more..., text."""
    ids = cut_lineage(found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), *more).distinct())
    return d.join(ids, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))).select(
        "__id", "__hash", *more, "text").dropDuplicates(["__id", "__hash", *more])


def _of_kind(text: Column) -> Column:
    """Template with values, of the kind in column ``kind``."""
    return F.when(F.col("kind") == 0, template(text, True)).otherwise(template(text, True, False))


def _known(found: DataFrame, items: DataFrame) -> DataFrame:
    """``found`` with the columns of its item's variant."""
    known = items.withColumnsRenamed({"item_id": "__item", "item_hash": "__item_hash", "variant": "__variant"}).drop("kind")
    return found.join(known, F.col("item_id").eqNullSafe(F.col("__item")) & (F.col("item_hash") == F.col("__item_hash"))
                      & (F.col("variant") == F.col("__variant")))


def _with_texts(found: DataFrame, d: DataFrame) -> DataFrame:
    """``found`` with the values and the token hashes of its document's template, built once for each document and kind."""
    texts = _rows_of(d, found, "kind").select("__id", "__hash", F.col("kind").alias("__kind"), _of_kind(F.col("text")).alias("doc_values"))
    texts = cut_lineage(texts.withColumn("doc_hashes", token_hashes(types(F.col("doc_values")))))
    return found.join(texts, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")) & (F.col("kind") == F.col("__kind")))


def _paired(met: Column, length: int) -> Column:
    """The values that the windows ``met`` (i: item, j: document) lay upon each other."""
    places = F.array_distinct(F.flatten(F.transform(met, lambda m: F.transform(
        F.sequence(F.lit(0), F.lit(length - 1)), lambda k: F.struct((m["i"] + k).alias("i"), (m["j"] + k).alias("j"))))))
    return F.transform(places, lambda m: F.struct(F.get("values", m["i"]).alias("a"), F.get("doc_values", m["j"]).alias("b")))


def _aligned(found: DataFrame, d: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """All equal windows on the diagonals found, with the slots they pair."""
    both = _with_texts(found, d)
    both = both.withColumn("doc_windows", window_hashes(F.col("doc_hashes"), window, F.col("kind"))).drop("doc_hashes")
    both = cut_lineage(_known(both, items.drop("rich", "least")))
    met = F.flatten(F.transform("shifts", lambda s: F.transform(
        F.filter(F.sequence(F.lit(0), F.size("windows") - 1), lambda i: F.get("windows", i) == F.get("doc_windows", i + s)),
        lambda i: F.struct(i.alias("i"), (i + s).alias("j")))))
    both = both.withColumn("met", met).withColumn("n_windows", F.size(F.array_distinct(F.col("met.i"))).cast("long"))
    both = both.filter(F.col("n_windows") >= F.col("need"))
    return both.select("doc_id", "text_hash", "item_id", F.array_min("met")["j"].cast("int").alias("doc_start"), "n_windows",
                       (F.array_max("met.i") - F.array_min("met.i") + window).alias("n_tokens"), F.size("tokens").alias("item_tokens"),
                       _paired(F.col("met"), window).alias("pairs"))


def _inside_matches(d: DataFrame, short: DataFrame, n: int) -> DataFrame:
    """Stretches of ``n`` tokens inside documents that equal an item of ``n`` tokens."""
    whole = short.select(window_hashes(F.col("hashes"), n, F.col("kind"))[0].alias("hash"), "item_id", "item_hash", "variant", "kind")
    whole = cut_lineage(whole)
    windows = windows_of(_hashed(d, "doc_id", "text_hash"), n, "doc_id", "text_hash")
    hits = windows.join(whole, "hash").groupBy("doc_id", "text_hash", "item_id", "item_hash", "variant", "kind").agg(F.min("pos").alias("pos"))
    found = cut_lineage(hits)
    both = _known(_with_texts(found, d), short)
    met = F.array(F.struct(F.lit(0).alias("i"), F.col("pos").alias("j")))
    return both.select("doc_id", "text_hash", "item_id", F.col("pos").cast("int").alias("doc_start"), F.lit(1).cast("long").alias("n_windows"),
                       F.size("tokens").alias("n_tokens"), F.size("tokens").alias("item_tokens"), _paired(met, n).alias("pairs"))


def _sentence_matches(d: DataFrame, short: DataFrame, window: int) -> DataFrame:
    """Documents, sentences and lines whose whole template equals a short item's."""
    short = short.filter("variant <> 1")
    wanted = cut_lineage(short.select(F.xxhash64("hashes", "kind").alias("hash"), "item_id", "item_hash", "variant", "kind"))
    units = d.select("doc_id", "text_hash", F.posexplode(_sentences(F.col("text"))).alias("unit", "text"))
    units = _hashed(units, "doc_id", "text_hash", "unit").filter(F.size("h").between(1, window - 1)).select(
        "doc_id", "text_hash", "unit", F.xxhash64("h", "kind").alias("hash"))
    found = cut_lineage(units.join(wanted, "hash").drop("hash").distinct())
    both = found.join(_rows_of(d, found), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")))
    both = cut_lineage(_known(both, short.drop("hashes")).withColumn("parts", _sentences(F.col("text"))))
    before = F.array_join(F.slice("parts", 2, F.greatest(F.col("unit") - 1, F.lit(0))), " ")
    both = both.withColumn("doc_values", _of_kind(F.get("parts", F.col("unit"))))
    return both.select("doc_id", "text_hash", "item_id", F.size(template(before)).alias("doc_start"), F.lit(1).cast("long").alias("n_windows"),
                       F.size("tokens").alias("n_tokens"), F.size("tokens").alias("item_tokens"),
                       F.arrays_zip(F.col("values").alias("a"), F.col("doc_values").alias("b")).alias("pairs"))


def _consistent(scored: DataFrame, least: float) -> DataFrame:
    """Compare the slots of aligned stretches and keep the best stretch of each pair."""
    both = scored.withColumn("pairs", F.filter("pairs", lambda p: is_slot(p["a"]) & is_slot(p["b"])))
    n_pairs = F.size(F.array_distinct("pairs"))
    distinct = F.least(F.size(F.array_distinct(F.transform("pairs", lambda p: p["a"]))),
                       F.size(F.array_distinct(F.transform("pairs", lambda p: p["b"]))))
    scored = both.select(
        "doc_id", "text_hash", "item_id", "doc_start", "n_windows", "n_tokens", "item_tokens", F.size("pairs").alias("n_slots"),
        F.size(F.filter("pairs", lambda p: p["a"] != p["b"])).alias("n_changed"),
        F.when(n_pairs == 0, 1.0).otherwise(distinct / n_pairs).alias("consistency"))
    rest = ["doc_start", "n_windows", "n_tokens", "item_tokens", "n_slots", "n_changed", "consistency"]
    return scored.filter(F.col("consistency") >= least).groupBy("doc_id", "text_hash", "item_id").agg(
        F.max_by(F.struct(*rest), F.struct("n_windows", F.col("n_slots"), -F.col("doc_start"))).alias("b")).select(
        "doc_id", "text_hash", "item_id", "b.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without those that hold a benchmark item."""
    a, b = fresh(docs, "id", "hash")
    bad = cut_lineage(contaminated(docs, benchmark, id_col=id_col, text_col=text_col, **options).select(
        F.col("doc_id").alias(a), F.col("text_hash").alias(b)).distinct())
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col(a)) & (F.xxhash64(text_col) == F.col(b)), "left_anti")
