"""Fill-in-the-middle transformation with a Fenwick tree over text blocks (operator 12).

A text is cut at two seeded places into prefix, middle and suffix and written as
prefix-suffix-middle (``psm``) or suffix-prefix-middle (``spm``) behind sentinels, or
left as it is (``plain``). Places are counted in units (code points, words or lines).
The UTF-8 bytes of a text are divided into fixed blocks; a Fenwick tree over the blocks
holds how many units and how many code points start in each. A cut descends the tree by
binary lifting to the block that holds its unit and looks only there for the byte.
The trees of all texts of a chunk lie one after the other in flat arrays, and all cuts
descend together. Nothing is decoded; the memory of a task is a few times its chunk
(``CHUNK`` bytes, or one longer text).

The draws come from the SHA-256 of the seed and the id (``draws``), so every run gives
the same rows. ``restore`` rebuilds the text from output and form with SQL functions.

Defined results: a null or empty text is ``plain`` with output '' and no units; a text
that holds a sentinel is ``plain``; a null id is hashed as ''; repeated rows give equal
rows; both cuts may fall on one place (empty middle) or on the ends; an empty table
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segstats.llm.blocks import utf8_parts, word_spans

BLOCK = 4096
CHUNK = 4 << 20
SENTINELS = ("<P>", "<S>", "<M>")


def char_starts(data: np.ndarray) -> np.ndarray:
    """Is the byte the first of a code point?"""
    return (data & 0xC0) != 0x80


def unit_starts(off: np.ndarray, data: np.ndarray, units: str) -> np.ndarray:
    """Is the byte the first of a unit? A text's first unit begins with the text; a word
    keeps the white space behind it, a line its line feed."""
    if units == "chars":
        return char_starts(data)
    out = np.zeros(len(data), bool)
    if units == "words":
        s, _, first = word_spans(off, data)
        out[np.delete(s, first[:-1][first[:-1] < first[1:]])] = True
    elif units == "lines":
        out[1:] = data[:-1] == 10
    else:
        raise ValueError(f"units: chars, words or lines, not {units}")
    out[off[:-1][off[:-1] < off[1:]]] = True
    return out


class BlockTree:
    """Fenwick trees over the blocks of texts that lie one after the other."""

    def __init__(self, off: np.ndarray, units: np.ndarray, chars: np.ndarray):
        self.off, self.units, self.chars = off, units, chars
        self.blocks = -(-np.diff(off) // BLOCK)
        self.base = np.concatenate(([0], np.cumsum(self.blocks)))
        number = np.arange(self.base[-1]) - np.repeat(self.base[:-1], self.blocks)
        edges = np.repeat(off[:-1], self.blocks) + number * BLOCK
        at = np.arange(1, self.base[-1] + 1)
        low = (number + 1) & -(number + 1)  # a node sums the last ``low`` blocks up to its own
        self.trees = []
        for mask in (units, chars):
            counts = np.add.reduceat(mask.view(np.uint8), edges, dtype=np.int64) if len(edges) else np.zeros(0, np.int64)
            sums = np.concatenate(([0], np.cumsum(counts)))
            self.trees.append(sums[at] - sums[at - low])
        sums = np.concatenate(([0], np.cumsum(self._total(self.trees[0]))))
        self.n = sums[1:] - sums[:-1]

    def _total(self, tree: np.ndarray) -> np.ndarray:
        """Sum of all blocks of each text, by the prefix walk."""
        at, out = self.blocks.copy(), np.zeros(len(self.blocks), np.int64)
        while (live := np.flatnonzero(at)).size:
            out[live] += tree[self.base[live] + at[live] - 1]
            at[live] &= at[live] - 1
        return out

    def cut(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(byte, code points before it) of the place behind the first ``rank`` units of each text."""
        at, left, chars = (np.zeros(len(rank), np.int64), rank.astype(np.int64), np.zeros(len(rank), np.int64))
        step = 1 << int(self.blocks.max(initial=0)).bit_length()
        while step := step >> 1:
            node = at + step
            i = np.flatnonzero(node <= self.blocks)
            i = i[self.trees[0][self.base[i] + node[i] - 1] <= left[i]]
            left[i] -= self.trees[0][self.base[i] + node[i] - 1]
            chars[i] += self.trees[1][self.base[i] + node[i] - 1]
            at[i] = node[i]
        byte = np.minimum(self.off[:-1] + at * BLOCK, self.off[1:])
        for i in np.flatnonzero(at < self.blocks):  # inside the block
            lo, hi = byte[i], min(byte[i] + BLOCK, self.off[i + 1])
            inside = np.flatnonzero(self.units[lo:hi])[left[i]]
            byte[i] = lo + inside
            chars[i] += np.count_nonzero(self.chars[lo:lo + inside])
        return byte - self.off[:-1], chars


def draws(doc_id: Column, seed: int = 1) -> list[Column]:
    """The first four 8-digit groups of the SHA-256 of ``seed:id``, as unsigned integers."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, units: str = "chars", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n (units), form, prefix_chars, middle_chars (code
    points; null if plain), output."""
    if units not in ("chars", "words", "lines"):
        raise ValueError(f"units: chars, words or lines, not {units}")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    h = draws(F.col(id_col), seed)
    plain = (text == "") | (h[2] % 100 >= 100 - plain_percent)
    for s in SENTINELS:
        plain = plain | text.contains(s)
    slim = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), h[0].alias("h1"), h[1].alias("h2"),
                       F.when(plain, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm").alias("form"))
    p, s, m = (x.encode() for x in SENTINELS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off, data = utf8_parts(b.column(1))
            h1, h2 = np.asarray(b.column(2)), np.asarray(b.column(3))
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(off, off[lo] + CHUNK, "right")) - 1)
                o, d = off[lo:hi + 1] - off[lo], data[off[lo]:off[hi]]
                chars = char_starts(d)
                tree = BlockTree(o, chars if units == "chars" else unit_starts(o, d, units), chars)
                x, y = h1[lo:hi] % (tree.n + 1), h2[lo:hi] % (tree.n + 1)
                (first, before), (second, until) = tree.cut(np.minimum(x, y)), tree.cut(np.maximum(x, y))
                form, out, raw = b.column(4).slice(lo, hi - lo).to_pylist(), [], memoryview(np.ascontiguousarray(d))
                for i, f in enumerate(form):
                    t = raw[o[i]:o[i + 1]]
                    prefix, middle, suffix = t[:first[i]], t[first[i]:second[i]], t[second[i]:]
                    out.append(bytes(t) if f == "plain" else b"".join((p, prefix, s, suffix, m, middle) if f == "psm" else
                                                                      (s, suffix, p, prefix, m, middle)))
                cut = np.array([f == "plain" for f in form], bool)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(tree.n), pa.array(form, pa.string()), pa.array(before, mask=cut),
                     pa.array(until - before, mask=cut), pa.array(out, pa.binary()).cast(pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
                lo = hi

    kind = docs.schema[id_col].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of: no part of it holds a sentinel, so each
    sentinel occurs once."""
    p, s, m = SENTINELS

    def between(head: str, tail: str) -> Column:
        return F.substring_index(F.substring_index(output, head, -1), tail, 1)

    middle = F.substring_index(output, m, -1)
    return F.when(form == "psm", F.concat(between(p, s), middle, between(s, m))).when(
        form == "spm", F.concat(between(p, m), middle, between(s, p))).otherwise(output)
