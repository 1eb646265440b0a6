"""Benchmark decontamination by spaced-seed hashing.

Texts become tokens: maximal runs of ASCII letters and digits and non-ASCII
bytes, A-Z lowered.  Each mask in ``MASKS`` marks with 1 the token positions
that a seed hashes and with 0 those it ignores.  Hashes of the test items and
of all documents are joined, and around each hit the tokens are compared on
the same alignment: a document overlaps an item if ``window`` aligned tokens
have at most ``mismatches`` substitutions.  Items of 8 to 12 tokens must
match as a whole with at most one substitution; shorter ones (or NULL) are no
evidence and match nothing.

The masks are chosen so that every window of 13 tokens with any two
substitutions, and every window of 8 with any one, holds an intact seed; the
result is therefore that of comparing all windows (tests/llm do).

Items are handled in blocks of at most ``block_bytes`` of text, each sent to
the tasks whole (its size is checked: blocks are made by size), so there is
one pass over the documents a block and no shuffle of documents.  A longer
single item is a block of its own.

Defined cases: NULL or empty documents match nothing; repeated documents and
items give repeated result rows; an empty table on either side gives no rows;
only doc_id, item_id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import byteops as B
from .common import map_arrow

U64 = np.uint64
MASKS = ("111111", "11011011", "11100111", "10000011111")
TOKEN = np.zeros(256, bool)
TOKEN[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True
_ODD = np.random.default_rng(7).integers(0, 1 << 62, (len(MASKS), 16), dtype=np.uint64) * U64(2) + U64(1)


@dataclass(frozen=True)
class DecontamParams:
    window: int = 13
    mismatches: int = 2
    min_tokens: int = 8
    short_mismatches: int = 1
    block_bytes: int = 16 << 20


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, per-row bounds)."""
    s, e, bounds = B.runs(TOKEN[buf], off)
    return B.byte_spans(B.LOWER[buf]).hash(s, e), bounds


def seeds(tok: np.ndarray, bounds: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, token positions) of one mask's seeds, within rows."""
    span = len(MASKS[mask])
    end = np.repeat(bounds[1:], np.diff(bounds))
    at = np.flatnonzero(np.arange(len(tok)) + span <= end)
    key = np.zeros(len(at), U64)
    for j, on in enumerate(MASKS[mask]):
        if on == "1":
            key += tok[at + j] * _ODD[mask, j]
    return B.mix(key), at


class ItemIndex:
    """Seeds of a block of items, by mask, with the tokens to verify on."""

    def __init__(self, texts: list[str], p: DecontamParams):
        tok, size = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        for _, buf, off in B.chunks(pa.array(texts, pa.large_string())):
            t, bounds = tokens(buf, off)
            tok.append(t)
            size.append(np.diff(bounds))
        self.tok, size = np.concatenate(tok), np.concatenate(size)
        self.off = np.append(0, np.cumsum(size))
        self.item = np.repeat(np.arange(len(size)), size)
        self.need = np.where(size >= p.window, p.window - p.mismatches, size - p.short_mismatches)
        self.masks = []
        usable = size >= p.min_tokens
        for m in range(len(MASKS)):
            key, at = seeds(self.tok, self.off, m)
            keep = usable[self.item[at]]
            key, at = key[keep], at[keep]
            order = np.argsort(key, kind="stable")
            uniq, first = np.unique(key[order], return_index=True)
            self.masks.append((B.HashIndex(uniq), np.append(first, len(key)), at[order]))

    def overlaps(self, tok: np.ndarray, bounds: np.ndarray, p: DecontamParams, most: int = 100_000):
        """(row, item, first token, end token, most equal tokens in a window)
        of every row and item that overlap."""
        row_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        found = []
        for m in range(len(MASKS)):
            index, first, place = self.masks[m]
            key, at = seeds(tok, bounds, m)
            got = index.find(key)
            hit = np.flatnonzero(got >= 0)
            size = first[got[hit] + 1] - first[got[hit]]
            start = 0
            total = np.cumsum(size)
            while start < len(hit):
                stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + most, "right")))
                part, n = hit[start:stop], size[start:stop]
                within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                q = place[np.repeat(first[got[part]], n) + within]
                for k in range(0, len(q), most):
                    found.append(self._verify(tok, bounds, row_of, np.repeat(at[part], n)[k:k + most], q[k:k + most],
                                              len(MASKS[m]), p))
                start = stop
        found = [f for f in found if len(f[0])]
        if not found:
            return None
        row, item, lo, hi, best = map(np.concatenate, zip(*found, strict=True))
        key, where = np.unique(row * len(self.need) + item, return_inverse=True)
        a, z, b = np.full(len(key), 1 << 60), np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        np.minimum.at(a, where, lo)
        np.maximum.at(z, where, hi)
        np.maximum.at(b, where, best)
        row, item = key // len(self.need), key % len(self.need)
        return row, item, a - bounds[row], z - bounds[row], b

    def _verify(self, tok, bounds, row_of, at, q, span, p):
        """Windows around seed hits on their alignment."""
        reach, w = p.window - 1, p.window
        k = np.arange(-reach, span + reach)
        row, item = row_of[at], self.item[q]
        i, j = at[:, None] + k, q[:, None] + k
        inside = ((i >= bounds[row][:, None]) & (i < bounds[row + 1][:, None])
                  & (j >= self.off[item][:, None]) & (j < self.off[item + 1][:, None]))
        same = inside & (tok[np.where(inside, i, 0)] == self.tok[np.where(inside, j, 0)])
        total = np.zeros((len(at), len(k) + 1), np.int64)
        np.cumsum(same, axis=1, out=total[:, 1:])
        count = total[:, w:] - total[:, :-w]
        best = count.max(1)
        ok = best >= self.need[item]
        good = count[ok] >= self.need[item[ok]][:, None]
        lo = good.argmax(1) - reach
        hi = good.shape[1] - 1 - good[:, ::-1].argmax(1) - reach + w
        lo = np.maximum(at[ok] + lo, bounds[row[ok]])
        hi = np.minimum(at[ok] + hi, bounds[row[ok] + 1])
        return row[ok], item[ok], lo, hi, best[ok]


def _blocks(items: DataFrame, p: DecontamParams):
    """Blocks of items as (ids, texts), each of bounded size."""
    items = items.where(F.col("text").isNotNull()).select("item_id", "text")
    total = items.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n = -(-2 * total // p.block_bytes)         # twice: blocks by hash are uneven
    for b in range(n):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == b) if n > 1 else items
        got = part.toArrow()
        yield got.column("item_id"), got.column("text").to_pylist()


_indexes: dict = {}


def _index(held, p) -> ItemIndex:
    texts = held.value
    if id(texts) not in _indexes:
        _indexes.clear()
        _indexes[id(texts)] = (texts, ItemIndex(texts, p))
    return _indexes[id(texts)][1]


def overlaps(docs: DataFrame, items: DataFrame, p: DecontamParams = DecontamParams()) -> DataFrame:
    """(doc_id, item_id, first_token, end_token, equal_tokens) of every
    document and item that overlap; tokens count from 0 in the document."""
    spark = docs.sparkSession
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    item_type = items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {doc_type}, item_id {item_type}, first_token long, end_token long, equal_tokens long"
    parts = []
    for ids, texts in _blocks(items, p):
        held, names = spark.sparkContext.broadcast(texts), ids.combine_chunks()

        def run(batch, held=held, names=names):
            index, out = _index(held, p), []
            for rows, buf, off in B.chunks(batch.column(1)):
                got = index.overlaps(*tokens(buf, off), p)
                if got is not None:
                    out.append((got[0] + rows.start, *got[1:]))
            if not out:
                return None
            row, item, *rest = map(np.concatenate, zip(*out, strict=True))
            return [batch.column(0).take(pa.array(row)), names.take(pa.array(item)), *map(pa.array, rest)]

        parts.append(map_arrow(docs.select("doc_id", "text"), run, schema))
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], schema)


def remove_overlapping(docs: DataFrame, items: DataFrame, p: DecontamParams = DecontamParams()) -> DataFrame:
    """The rows of ``docs`` that overlap no item; columns unchanged."""
    at = docs.columns.index("text")
    for _, texts in _blocks(items, p):
        held = docs.sparkSession.sparkContext.broadcast(texts)

        def run(batch, held=held):
            index, clean = _index(held, p), np.ones(batch.num_rows, bool)
            for rows, buf, off in B.chunks(batch.column(at)):
                got = index.overlaps(*tokens(buf, off), p)
                if got is not None:
                    clean[got[0] + rows.start] = False
            return [c.filter(pa.array(clean)) for c in batch.columns]

        docs = map_arrow(docs, run, docs.schema)
    return docs
