"""Language ID by interpolated Kneser-Ney character models (operator 9).

``fit`` counts character n-grams of a bounded sample of labelled documents (about
``sample_docs`` distinct ones per language, chosen by the hash of id and text; each
language keeps at least the one of smallest hash) and builds one interpolated Kneser-Ney
model per language. All languages share sorted arrays of 64-bit n-gram hashes,
each with one row of log-probabilities (a column per language), and sorted
arrays of context hashes with the back-off weights for n-grams no language has
seen. ``identify`` scores every whole text: the language with the lowest cross-
entropy per character wins; a text whose cross-entropy lies more than ``z``
calibrated deviations above what its language's own documents have is rejected.
A tenth of the sample measures level and deviation under a model of the other nine
tenths (the final model has all). They are medians (of the documents that this model
assigns to their label, deviations shrunk for short ones), so mislabelled, noisy or
very short labelled documents do not lift the limit; with nothing to measure, nothing is
rejected for its cross-entropy.

Text is reduced to lower-case letters with single spaces for everything else; letters
beyond the first 65,536 code points share 6,400 codes. Texts are scored in slices of at
most ``CHUNK`` bytes, long ones slice by slice with the context carried on.
Defined results: null text or text without a letter is ``und`` (score 0,
rejected); rows without a lang do not train; without any training row all texts are
``und`` and none is rejected (``keep_identified`` keeps every row: there is nothing to
judge by); ties go to the first language by name; null doc_id counts as the id '';
rows equal in id and text are one training document and are scored alike; extra columns
are kept by ``keep_identified``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segstats.llm.blocks import mix64, release, utf8_parts
from segstats.session import cut_lineage

ORDER = 4
CHUNK = 1 << 18
NEAR_CHARS = 400  # shorter calibration documents scatter more: deviations are divided by sqrt(1 + NEAR_CHARS / characters)
BITS = np.uint64(16)  # of a code: an n-gram is one number, its last character lowest
_MASK = [np.uint64((1 << 16 * n) - 1) for n in range(ORDER + 1)]


def _letter_codes() -> np.ndarray:
    """Lower-case code of every code point below 65,536; 0 where it is no letter."""
    return np.array([ord(c.lower()[0]) if (c := chr(i)).isalpha() else 0 for i in range(0x10000)], np.uint32)


_CODES: list[np.ndarray] = []


def letters(off: np.ndarray, data: np.ndarray, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, first n-gram end of each document, letters of each document): each
    document is ORDER - 1 spaces, then its letters with single spaces between words.
    ``before``: the last ORDER - 1 codes of what comes before the (one) document."""
    if not _CODES:
        _CODES.append(_letter_codes())
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    starts = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[off]
    code = _CODES[0][np.minimum(points, 0xFFFF)]
    for p in np.unique(points[points > 0xFFFF]):  # codes of the private use area, which has no letters
        code[points == p] = 0xE000 + ord(chr(p).lower()[0]) % 0x1900 if chr(p).isalpha() else 0
    solid = code != 0
    first = np.zeros(len(code) + 1, bool)
    first[starts] = True
    inside = before is not None and before[-1] != 0
    keep = solid | np.concatenate(([inside], solid[:-1] & ~first[1:-1]))[:len(code)]  # one space after a word
    n = np.diff(np.concatenate(([0], np.cumsum(keep)))[starts])
    out = np.zeros(len(n) * (ORDER - 1) + int(n.sum()), np.uint32)
    begin = np.concatenate(([0], np.cumsum(n + ORDER - 1)))[:-1] + ORDER - 1
    at = np.repeat(begin - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(int(n.sum()))
    out[at] = code[keep]
    if before is not None:
        out[:ORDER - 1] = before
    ends = np.concatenate(([0], np.cumsum(solid)))[starts]
    return out, np.stack((begin, begin + n), 1), np.diff(ends)


def _slices(off: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first document, n-grams, their number in each document, letters of each document) of
    whole documents of about CHUNK bytes together, or of one part of a longer one."""
    lo = 0
    while lo < len(off) - 1:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + CHUNK, "right")) - 1)
        at, before = off[lo], None
        while at < off[hi] or before is None:
            to = min(at + CHUNK, off[hi])
            while to < off[hi] and data[to] & 0xC0 == 0x80:
                to -= 1
            seq, span, alpha = letters(off[lo:hi + 1] - at if to == off[hi] and before is None else np.array([0, to - at]), data[at:to], before)
            n = span[:, 1] - span[:, 0]
            ends = np.repeat(span[:, 0] - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(int(n.sum()))
            yield lo, packed(seq, ends), n, alpha
            at, before = to, seq[1 - ORDER:]
        lo = hi


def packed(seq: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The n-grams of ORDER codes that end at ``at``, as one number each."""
    out = seq[at].astype(np.uint64)
    for k in range(1, ORDER):
        out |= seq[at - k].astype(np.uint64) << np.uint64(16 * k)
    return out


class Table:
    """Rows of a sorted array of hashes; a directory of their first bits bounds each search."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order].astype(np.float32)
        self.bits = np.uint64(64 - max(1, int(len(keys) * 4).bit_length()))
        edge = np.arange((1 << (64 - int(self.bits))) + 1, dtype=np.uint64)
        top = self.keys >> self.bits
        self.first = np.searchsorted(top, edge).astype(np.int32)
        self.most = int(np.diff(self.first).max()) if len(keys) else 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 if absent."""
        row = np.full(len(h), -1, np.int32)
        if not len(self.keys):
            return row
        at = self.first[h >> self.bits]
        for j in range(self.most):
            i = np.minimum(at + j, len(self.keys) - 1)
            row = np.where(self.keys[i] == h, i, row)
        return row


@dataclass
class Model:
    langs: list[str]
    grams: list[Table]  # by order from 1
    contexts: list[Table]  # contexts of orders from 2
    unknown: np.ndarray
    limits: np.ndarray  # median and deviation between documents (medians) of each language

    def entropies(self, off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bits per character by document and language, characters, letters)."""
        docs = len(off) - 1
        bits, size, alpha = np.zeros((docs, len(self.langs))), np.zeros(docs, np.int64), np.zeros(docs, np.int64)
        for lo, grams, n, n_letters in _slices(off, data):
            some = np.flatnonzero(n)
            if len(some):
                first = (np.cumsum(n) - n)[some]
                bits[lo + some] -= np.add.reduceat(self.score_grams(grams), first, axis=0, dtype=np.float64)
            size[lo:lo + len(n)] += n
            alpha[lo:lo + len(n)] += n_letters
        return bits / np.maximum(size, 1)[:, None], size, alpha

    def score(self, seq: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log2 probability of the characters at ``at`` for each language."""
        return self.score_grams(packed(seq, at))

    def score_grams(self, grams: np.ndarray) -> np.ndarray:
        """log2 probability of the last character of each n-gram for each language."""
        out = np.zeros((len(grams), len(self.langs)), np.float32)
        todo = np.arange(len(grams))
        for n in range(ORDER, 0, -1):
            row = self.grams[n - 1].find(mix64(grams & _MASK[n]))
            hit = row >= 0
            out[todo[hit]] += self.grams[n - 1].values[row[hit]]
            todo, grams = todo[~hit], grams[~hit]
            if not len(todo):
                return out
            if n > 1:
                row = self.contexts[n - 2].find(mix64(grams >> BITS & _MASK[n - 1]))
                known = row >= 0
                out[todo[known]] += self.contexts[n - 2].values[row[known]]
        out[todo] += self.unknown
        return out


def kneser_ney(rows: np.ndarray, lang: np.ndarray, count: np.ndarray, langs: list[str]) -> Model:
    """Interpolated Kneser-Ney from n-grams of ORDER codes (one number each, or a row of codes),
    their languages and counts."""
    n_lang = len(langs)
    if rows.ndim == 2:
        rows = packed(rows.ravel(), np.arange(ORDER - 1, rows.size, ORDER))
    grams, contexts = [None] * ORDER, [None] * (ORDER - 1)
    union, tables = {}, {}
    for n in range(ORDER, 0, -1):  # counts: occurrences at the top, below it the distinct characters to the left
        union[n], inv = np.unique(rows, return_inverse=True)
        tables[n] = np.zeros((len(union[n]), n_lang))
        np.add.at(tables[n], (inv, lang), count)
        if n > 1:
            pairs = np.unique(inv * n_lang + lang)
            rows, lang, count = union[n][pairs // n_lang] & _MASK[n - 1], pairs % n_lang, np.ones(len(pairs))
    v = len(union[1]) + 1
    below = np.full((1, n_lang), 1.0 / v)
    unknown = None
    for n in range(1, ORDER + 1):
        c = tables[n]
        n1, n2 = (c == 1).sum(0), (c == 2).sum(0)
        d = np.clip(n1 / np.maximum(n1 + 2 * n2, 1), 0.05, 0.95)
        ctx, ci = np.unique(union[n] >> BITS, return_inverse=True)  # one empty context for n = 1
        total, types = np.zeros((len(ctx), n_lang)), np.zeros((len(ctx), n_lang))
        np.add.at(total, ci, c)
        np.add.at(types, ci, c > 0)
        gamma = np.where(total > 0, d * types / np.maximum(total, 1), 1.0)
        if n == 1:
            lower = np.repeat(below, len(c), 0)
            unknown = np.log2(gamma[0] / v)
        else:
            lower = below[np.searchsorted(union[n - 1], union[n] & _MASK[n - 1])]
            contexts[n - 2] = Table(mix64(ctx), np.log2(gamma))
        p = np.maximum(c - d, 0) / np.maximum(total[ci], 1) + gamma[ci] * lower
        grams[n - 1] = Table(mix64(union[n]), np.log2(p))
        below = p
    return Model(langs, grams, contexts, unknown.astype(np.float32), np.full((n_lang, 2), np.inf))


def _median(x: np.ndarray, weight: np.ndarray) -> float:
    order = np.argsort(x, kind="stable")
    w = np.cumsum(weight[order])
    return float(x[order][np.searchsorted(w, w[-1] / 2)])


def calibrate(lang: np.ndarray, h: np.ndarray, n: np.ndarray, n_lang: int) -> np.ndarray:
    """(median, deviation) of each language from the cross-entropies ``h`` of documents of ``n`` characters.
    A deviation is at least that of all languages' documents together; a language without
    documents has the largest values, and without any document nothing is rejected."""
    if not len(h):
        return np.full((n_lang, 2), np.inf)
    order = np.lexsort((n, h, lang))  # the same result for every order of the rows
    lang, h, n = lang[order], h[order], n[order]
    out, weight = np.full((n_lang, 2), -np.inf), np.minimum(n, NEAR_CHARS).astype(np.float64)
    off = np.zeros(len(h))
    for i in np.unique(lang):
        of = lang == i
        out[i, 0] = _median(h[of], weight[of])
        off[of] = np.abs(h[of] - out[i, 0]) / np.sqrt(1 + NEAR_CHARS / n[of])
    pooled = 1.4826 * _median(off, weight)
    for i in np.unique(lang):
        out[i, 1] = max(1.4826 * _median(off[lang == i], weight[lang == i]), pooled)
    return np.where(np.isfinite(out), out, out.max(0))


def _id_crc(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def fit(docs: DataFrame, sample_docs: int = 2500, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang") -> Model | None:
    """Model of the labelled ``docs``; None without any. ``sample_docs`` bounds the
    (expected) number of distinct documents per language that are read."""
    key = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col))
    d = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), key.alias("key"))
    d = d.withColumn("u", F.pmod(F.xxhash64("key", F.lit(9)), F.lit(1 << 30)) / float(1 << 30))
    sizes = {r[0]: (r[1], r[2]) for r in d.groupBy("lang").agg(  # one row per language
        F.approx_count_distinct("key", 0.02), F.min("u")).collect()}
    if not sizes:
        return None
    langs = sorted(sizes)
    code = {k: i for i, k in enumerate(langs)}
    share = {k: max(min(1.0, sample_docs / max(n, 1)), np.nextafter(least, 2)) for k, (n, least) in sizes.items()}
    share = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, float(share[k]))]), F.col("lang"))
    sample = d.withColumn("u", F.col("u") / share).filter("u < 1").groupBy("lang", "key").agg(
        F.first("text").alias("text"), F.first("u").alias("u")).select("lang", "text", (F.col("u") < 0.1).alias("held"))
    sample = cut_lineage(sample)  # about sample_docs texts per language, read twice

    def count(batches):
        for b in batches:
            off, data = utf8_parts(b.column(1))
            kind = 2 * np.array([code[x] for x in b.column(0).to_pylist()], np.int64) + np.asarray(b.column(2)).astype(np.int64)
            for lo, grams, n, _ in _slices(off, data):
                own = np.repeat(kind[lo:lo + len(n)], n)
                for k in np.unique(own):
                    got, times = np.unique(grams[own == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got), k)), pa.array(got.view(np.int64)), pa.array(times.astype(np.int64))],
                                                     ["kind", "gram", "n"])
        release()

    got = (sample.mapInArrow(count, "kind long, gram long, n long").groupBy("kind", "gram").agg(F.sum("n").alias("n"))
           .toPandas().sort_values(["kind", "gram"]))  # distinct n-grams of the bounded sample
    if not len(got):
        return None

    def model_of(rows) -> Model:
        rows = rows.assign(kind=rows["kind"] // 2).groupby(["kind", "gram"], as_index=False)["n"].sum()
        return kneser_ney(rows["gram"].to_numpy(np.int64).view(np.uint64), rows["kind"].to_numpy(np.int64), rows["n"].to_numpy(np.float64), langs)

    model, learned = model_of(got), got[got["kind"] % 2 == 0]
    if not len(learned):
        return model
    trial = model_of(learned)

    def measure(batches):
        for b in batches:
            lang = np.array([code[x] for x in b.column(0).to_pylist()], np.int64)
            h, n, _ = trial.entropies(*utf8_parts(b.column(1)))
            ok = (n > 0) & (h.argmin(1) == lang) if len(h) else n > 0  # mislabelled documents say nothing about their label
            yield pa.RecordBatch.from_arrays([pa.array(lang[ok]), pa.array(h[np.arange(len(lang)), lang][ok]), pa.array(n[ok])], ["lang", "h", "n"])
        release()

    seen = sample.filter("held").select("lang", "text").mapInArrow(measure, "lang long, h double, n long").toPandas()  # of the bounded sample
    model.limits = calibrate(*(seen[c].to_numpy() for c in ("lang", "h", "n")), len(langs))
    return model


def _judge(model: Model | None, z: float, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index of the language or -1, score, bits, rejected) of each text."""
    off, data = utf8_parts(text)
    if model is None:
        n = len(off) - 1
        return np.full(n, -1), np.zeros(n), np.zeros(n), np.zeros(n, bool)
    h, n, alpha = model.entropies(off, data)
    best = np.where(alpha > 0, h.argmin(1), -1) if len(h) else np.zeros(0, np.int64)
    bits = h.min(1) if len(h) else np.zeros(0)
    odds = np.exp2(-(h - bits[:, None]) * np.clip(n, 1, 40)[:, None]).sum(1)
    level, dev = model.limits[best].T
    # short texts scatter more than those of the calibration; this shrinks with the root of the length
    limit = level + z * dev + 12.0 / np.sqrt(np.maximum(n, 1))
    return best, np.where(best >= 0, 1 / odds, 0.0), bits, (best < 0) | (bits > limit)


def identify(docs: DataFrame, model: Model | None, z: float = 6.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (posterior of the language against the others, 0 to
    1), bits (cross-entropy per character), rejected."""
    names = [*(model.langs if model else []), "und"]

    def run(batches):
        for b in batches:
            best, score, bits, rejected = _judge(model, z, b.column(1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([names[i] for i in best], pa.string()), pa.array(score), pa.array(bits), pa.array(rejected)],
                ["doc_id", "lang_pred", "score", "bits", "rejected"])
        release()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double, bits double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model | None, z: float = 6.0, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected (all columns); all of them without a model."""
    if model is None:
        return docs
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(~_judge(model, z, b.column(at))[3]))
        release()

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    return _id_crc(doc_id) % 4 == 2


def train_split(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents that may be learned from."""
    return docs.filter(~held_out(F.col(id_col)))

