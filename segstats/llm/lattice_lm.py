"""Scoring texts with a subword lattice (operator 3).

A word is generated as a sequence of pieces of an existing vocabulary, its
first piece beginning with the word mark; its probability is the sum over *all*
segmentations, by a forward recursion in log space over the lattice of pieces.
The vocabulary's own scores give the first piece probabilities; ``em_rounds``
rounds of expectation maximisation (forward-backward over all distinct training
words) fit them to each component of the corpus (here: its languages). Training
documents also know words as wholes, so a token's probability in component z is

    (c_z + (V_z + 1) * (c / N + lattice_z) / 2) / (N_z + V_z + 1)

(Witten-Bell: component, then corpus and lattice in equal parts). The text's
probability is marginal over segmentations and over components, the end counts
as a token; a text is scored without looking at its own component.

Distinct words of each block of documents meet in buckets (see ``blocks``):
counts, expectations and lattice sums are computed once per distinct word over
the whole corpus, and each block gets its words' values back. Only expected
uses summed by component and piece reach the driver.

Defined results: null text is empty (one token: the end); a null doc_id counts
as the id ''; rows with equal ids are separate documents; null is a component of
its own; without training documents only the lattice of the vocabulary's scores
speaks; bytes that no piece covers are pieces of their own, so every text has a
positive probability; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segstats.llm.blocks import (
    by_bucket, mix64, pack, pack_blocks, send, total_bytes, unpack, with_answers, word_hashes, word_spans, _powers,
    _BYTE, _STEP, _STEP_INV,
)
from segstats.session import cut_lineage

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = 0x20  # the word mark, as a byte that no word contains
SHORT = 64  # longer words are summed one by one
BUCKET_BYTES = 24 << 20
_P, _PI = _powers(_STEP, SHORT + 2), _powers(_STEP_INV, SHORT + 2)


def read_vocabulary(path: str = VOCABULARY) -> tuple[list[bytes], np.ndarray]:
    """(pieces, scores) of an existing subword model; pieces as lower-case bytes
    with the word mark first, and every single byte as a last resort."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    best: dict[bytes, float] = {}
    for i in range(m.get_piece_size()):
        if m.is_control(i) or m.is_unknown(i) or m.is_byte(i):
            continue
        b = m.id_to_piece(i).replace("▁", " ").encode()
        if b and not any(c in b[1:] for c in b"\x20\t\n\r\x0b\x0c") and b == b.lower() and b[:1] not in b"\t\n\r\x0b\x0c":
            best[b] = max(best.get(b, -1e9), m.get_score(i))
    low = min(best.values(), default=0.0)
    for c in range(256):
        if c not in (9, 10, 11, 12, 13):
            best.setdefault(bytes([c]), low * 4 - 1e5)
    pieces = sorted(best)
    return pieces, np.array([best[p] for p in pieces])


class Lattice:
    """Pieces with log-probabilities by component; the last row of ``logp`` is the end token."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        self.pieces, self.logp = pieces, logp
        self.index = {p: i for i, p in enumerate(pieces)}
        size = np.array([len(p) for p in pieces])
        data = np.frombuffer(b"".join(pieces), np.uint8)
        end = np.cumsum(size)
        some = np.flatnonzero(size <= SHORT + 1)  # longer ones occur in long words only, which look pieces up by their bytes
        keys = np.array([_key(data[end[i] - size[i]:end[i]]) for i in some], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], some[order].astype(np.int32)
        self.bits = np.uint64(64 - int(len(keys) * 8).bit_length())
        edge = np.arange((1 << (64 - int(self.bits))) + 1, dtype=np.uint64)
        self.first = np.searchsorted(self.keys >> self.bits, edge).astype(np.int32)
        self.most = int(np.diff(self.first).max())
        self.sizes = [int(s) for s in np.unique(size)]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece of each hash; -1 if there is none."""
        at = self.first[h >> self.bits]
        row = np.full(len(h), -1, np.int32)
        for j in range(self.most):
            i = np.minimum(at + j, len(self.keys) - 1)
            row = np.where(self.keys[i] == h, self.ids[i], row)
        return row

    def edges(self, words: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """{(start, end): (rows, pieces)} of a (words x bytes) matrix that begins with the mark."""
        n, width = words.shape
        c = np.concatenate((np.zeros((n, 1), np.uint64), np.cumsum(_BYTE[words] * _P[:width], 1, dtype=np.uint64)), 1)
        out = {}
        for i in range(width):
            for size in self.sizes:
                if i + size <= width:
                    got = self.find(mix64((c[:, i + size] - c[:, i]) * _PI[i] + np.uint64(size)))
                    rows = np.flatnonzero(got >= 0)
                    if len(rows):
                        out[i, i + size] = rows, got[rows]
        return out

    def forward(self, n: int, width: int, edges, z=slice(None)) -> np.ndarray:
        """Log sums over the segmentations of every prefix, by component: (width + 1, n, components)."""
        logp = self.logp[:, z]
        a = np.full((width + 1, n, logp.shape[1]), -np.inf)
        a[0] = 0
        for (i, j), (rows, piece) in sorted(edges.items()):
            a[j, rows] = np.logaddexp(a[j, rows], a[i, rows] + logp[piece])
        return a

    def expected(self, n: int, width: int, edges, z: int, into: np.ndarray) -> None:
        """Adds the expected uses of each piece in the words under component z."""
        logp = self.logp[:, z]
        a = self.forward(n, width, edges, slice(z, z + 1))[:, :, 0]
        b = np.full((width + 1, n), -np.inf)
        b[width] = 0
        for (i, j), (rows, piece) in sorted(edges.items(), key=lambda x: -x[0][1]):
            b[i, rows] = np.logaddexp(b[i, rows], b[j, rows] + logp[piece])
        for (i, j), (rows, piece) in edges.items():
            into += np.bincount(piece, np.exp(a[i, rows] + logp[piece] + b[j, rows] - a[width, rows]), len(into))

    def long_word(self, word: bytes, z: int, into: np.ndarray | None = None) -> float:
        """One word of any length under component z, step by step."""
        w, logp = b" " + word, self.logp[:, z].tolist()
        steps = [[(j - s, self.index[w[j - s:j]]) for s in self.sizes if s <= j and w[j - s:j] in self.index] for j in range(len(w) + 1)]
        a = [0.0]
        for j in range(1, len(w) + 1):
            x = [a[i] + logp[p] for i, p in steps[j]]
            top = max(x)
            a.append(top + math.log(sum(math.exp(v - top) for v in x)))
        if into is not None:
            b = [-math.inf] * len(w) + [0.0]
            for j in range(len(w), 0, -1):
                for i, p in steps[j]:
                    v = b[j] + logp[p]
                    b[i] = v if b[i] == -math.inf else max(b[i], v) + math.log1p(math.exp(-abs(b[i] - v)))
                    into[p] += math.exp(a[i] + v - a[-1])
        return a[-1]

    def _batches(self, size: np.ndarray, data: np.ndarray):
        """(rows, matrix) of short words of one length, and (row, bytes) of long ones."""
        start = np.cumsum(size) - size
        for width in np.unique(size):
            every = np.flatnonzero(size == width)
            if width > SHORT:
                yield from ((r, data[start[r]:start[r] + width].tobytes()) for r in every)
                continue
            for rows in np.array_split(every, -(-len(every) // 20_000)):
                m = np.full((len(rows), width + 1), MARK, np.uint8)
                m[:, 1:] = data[start[rows][:, None] + np.arange(width)]
                yield rows, m

    def words(self, size: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Log-probability of each word (sizes, concatenated bytes) by component."""
        out = np.empty((len(size), self.logp.shape[1]))
        for rows, m in self._batches(size, data):
            if isinstance(m, bytes):
                out[rows] = [self.long_word(m, z) for z in range(out.shape[1])]
            else:
                out[rows] = self.forward(len(m), m.shape[1], self.edges(m))[m.shape[1]]
        return out

    def uses(self, size: np.ndarray, data: np.ndarray, z: int, into: np.ndarray) -> None:
        """Adds the expected uses of each piece in the words (once each) under component z."""
        for _, m in self._batches(size, data):
            if isinstance(m, bytes):
                self.long_word(m, z, into)
            else:
                self.expected(len(m), m.shape[1], self.edges(m), z, into)


def _key(b: np.ndarray) -> np.uint64:
    h = np.array([np.sum(_BYTE[b] * _P[:len(b)], dtype=np.uint64)], np.uint64) + np.uint64(len(b))
    return mix64(h)[0]


def start_probabilities(scores: np.ndarray) -> np.ndarray:
    """Log-probabilities from the vocabulary's scores alone: by rank of the score
    (models that store merge ranks and models that store log-probabilities order
    pieces alike), the end token last."""
    rank = np.empty(len(scores))
    rank[np.argsort(-scores, kind="stable")] = np.arange(len(scores))
    w = np.append(1 / (rank + 10), 0.01)
    w[:-1][scores < -1e5] = 1e-7
    return np.log(w / w.sum())


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def _block_words(d: tuple):
    """Words of a block: hashes of the distinct ones, where the first of each
    stands, the distinct word of every word, and each document's range of words."""
    _, _, off, data, flags = d
    data = lower_ascii(data)
    s, e, at = word_spans(off, data)
    h, first, inv = np.unique(word_hashes(data, s, e), return_index=True, return_inverse=True)
    return data, s[first], e[first], h, inv, at, flags


def _gather(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = e - s
    at = np.repeat(s - np.cumsum(size) + size, size) + np.arange(size.sum())
    return size, data[at]


def _spread(size: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    end = np.cumsum(size)
    return word_hashes(data, end - size, end), end


def score_texts(docs: DataFrame, train: F.Column, component: F.Column | None = None, vocabulary: str = VOCABULARY,
                em_rounds: int = 2, id_col: str = "doc_id", text_col: str = "text", add: float = 0.1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (smoothed
    unigram over words), score (log10 probability of the text under the lattice
    model). ``train``: boolean column of the documents to learn from;
    ``component``: column with few values, read on training documents only."""
    kind = F.coalesce(component.cast("string"), F.lit("")) if component is not None else F.lit("")
    counted = docs.filter(train).groupBy(kind.alias("k")).count().collect()  # one row per component
    names = sorted(r["k"] for r in counted) or [""]
    ends = np.array([dict((r["k"], r["count"]) for r in counted).get(x, 0) for x in names], np.float64)
    number = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(names) for x in (k, i + 1)]), kind)
    blocks = pack_blocks(docs, id_col, text_col, flag=F.when(train, number).otherwise(0))
    n, parts = max(4, -(-total_bytes(blocks) // BUCKET_BYTES)), len(names)
    pieces, scores = read_vocabulary(vocabulary)

    def emit(block, d):
        data, s, e, h, inv, at, flags = _block_words(d)
        part = np.repeat(flags, np.diff(at))
        count = np.stack([np.bincount(inv[part == z + 1], minlength=len(h)) for z in range(parts)], 1).astype(np.int32)
        for b, i in by_bucket(h, n):
            yield b, pack((*_gather(data, s[i], e[i]), count[i]))

    def merge(key, f):
        size, data, count = (np.concatenate(x) for x in zip(*[unpack(v) for v in f["data"]]))
        h, end = _spread(size, data)
        u, first, inv = np.unique(h, return_index=True, return_inverse=True)
        c = np.stack([np.bincount(inv, count[:, z], len(u)) for z in range(parts)], 1).astype(np.int64)
        return pd.DataFrame({"bucket": [key[0]], "tokens": [c.sum(0)], "types": [(c > 0).sum(0)], "known": [int((c.sum(1) > 0).sum())],
                             "data": [pack((*_gather(data, end[first] - size[first], end[first]), c))]})

    sent = cut_lineage(send(blocks, emit))
    words = cut_lineage(sent.groupBy("bucket").applyInPandas(
        merge, "bucket long, tokens array<long>, types array<long>, known long, data binary"))
    total = words.agg(*[F.coalesce(F.sum(F.element_at(c, z + 1)), F.lit(0)).cast("double") for c in ("tokens", "types") for z in range(parts)],
                      F.coalesce(F.sum("known"), F.lit(0)).cast("double")).first()
    n_part, v_part = np.array(total[:parts]) + ends, np.array(total[parts:2 * parts]) + (ends > 0)
    n_train, v = int(n_part.sum()), total[-1] + (ends.sum() > 0)

    logp = np.repeat(start_probabilities(scores)[:, None], parts, 1)
    for _ in range(em_rounds if n_train else 0):
        now = logp

        def expect(frames, now=now):
            lattice = Lattice(pieces, now)
            use = np.zeros((parts, len(pieces)))
            for f in frames:
                for x in f["data"]:
                    size, data, c = unpack(x)
                    end = np.cumsum(size)
                    for z in range(parts):
                        seen = c[:, z] > 0
                        lattice.uses(*_gather(data, (end - size)[seen], end[seen]), z, use[z])
            z, some = np.nonzero(use)
            yield pd.DataFrame({"part": z, "piece": some, "uses": use[z, some]})

        got = words.select("data").mapInPandas(expect, "part long, piece long, uses double").groupBy("part", "piece").agg(
            F.sum("uses").alias("uses")).collect()  # at most components x pieces rows
        use = np.full((len(pieces) + 1, parts), 0.01)
        for r in got:
            use[r["piece"], r["part"]] += r["uses"]
        use[-1] += 1
        logp = np.log(use / use.sum(0))

    def reply(key, left, right):
        lattice = Lattice(pieces, logp)
        size, data, c = unpack(right["data"].iloc[0])
        known, _ = _spread(size, data)
        lat = lattice.words(size, data).astype(np.float32)
        order = np.argsort(known)
        out = []
        for block, x in zip(left["block"], left["data"]):
            h, _ = _spread(*unpack(x)[:2])
            at = order[np.searchsorted(known[order], h)]
            out.append((int(block), key[0], pack((c[at], lat[at]))))
        return pd.DataFrame(out, columns=["block", "bucket", "data"])

    replies = sent.groupBy("bucket").cogroup(words.groupBy("bucket")).applyInPandas(reply, "block long, bucket long, data binary")
    share = np.log(np.where(ends > 0, ends, 1) / max(1.0, ends.sum())) if ends.sum() else np.zeros(parts)

    def base_of(c):
        return np.log10((c.sum(1) + add) / (n_train + add * (v + 1)))

    def model_of(c, lat):
        """Natural log-probability of tokens with counts c and lattice sums lat, by component."""
        with np.errstate(divide="ignore"):
            if not n_train:
                return lat
            whole = np.log(c.sum(1) / n_train)[:, None]
            back = np.logaddexp(whole, lat) + np.log((v_part + 1) / 2)
            return np.logaddexp(np.log(c), back) - np.log(n_part + v_part + 1)

    def finish(block, d, answers):
        data, s, e, h, inv, at, flags = _block_words(d)
        c, lat = np.zeros((len(h), parts), np.int64), np.zeros((len(h), parts))
        for b, i in by_bucket(h, n):
            c[i], lat[i] = answers[b]
        n_docs = len(at) - 1
        doc = np.repeat(np.arange(n_docs), np.diff(at))
        total = lambda x: np.bincount(doc, x[inv], n_docs)
        token = model_of(c, lat)
        by_part = np.stack([total(token[:, z]) for z in range(parts)], 1) + model_of(ends[None, :], logp[-1:]) + share
        return pd.DataFrame({
            "doc_id": pd.array(np.where(d[1], 0, d[0]), "Int64"), "no_id": d[1], "held_out": flags == 0, "n_tokens": np.diff(at) + 1,
            "n_known": total((c.sum(1) > 0).astype(float)).astype(np.int64) + (ends.sum() > 0), "train_tokens": n_train,
            "base_score": total(base_of(c)) + base_of(ends[None, :])[0], "score": np.logaddexp.reduce(by_part, 1) / math.log(10)})

    out = with_answers(blocks, replies, finish, "doc_id long, no_id boolean, held_out boolean, n_tokens long, n_known long, "
                       "train_tokens long, base_score double, score double")
    return out.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")
