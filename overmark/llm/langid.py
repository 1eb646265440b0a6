"""Language identification by prediction by partial matching.

Each language has a byte context tree of variable order (0 to
``max_order``), frozen after training.  A byte is coded in the longest
context the language has seen; if the byte is new there, the coder pays the
escape probability (distinct followers / (followers + distinct)) and goes to
the next shorter context, at last to 1/256.  A text's code length is the sum
over its bytes; the language with the shortest code wins (ties: the name
first in order), and ``score`` is its posterior under equal priors.

Code lengths under frozen statistics depend on the last max_order + 1 bytes
alone, so they are tabled once per n-gram seen in training and looked up in
Arrow batches.  Training takes a bounded sample of labelled rows
(``docs_per_language`` of smallest hash); its trees are bounded by it.
Letters A-Z and the two-byte capitals U+00C0-U+00DE count as small.

The posterior only tells the learned languages from each other.  Whether a
text is in one of them at all shows in its code length: ``fit`` holds an
eighth of the learning rows back (by hash of the text) and sets, per language,
the most bits a byte may take: ``margin`` times the median of the rows
held back.  A text that takes more, ``START`` bits apart, is ``refused``.  A
language with no row held back has the widest of the others' limits; with none
at all nothing is refused.

Defined cases: NULL text and text with no letter give ``und`` with score 0 and are
refused; a refused text with letters has the nearest learned language; with no
learned language every row is ``und`` and refused; the language of repeated rows
is the same; other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import byteops as B
from .common import fresh, map_arrow

U64 = np.uint64
START = 32.0              # bits that a text's first bytes may take on top


@dataclass(frozen=True)
class PpmParams:
    docs_per_language: int = 200
    max_order: int = 3
    margin: float = 4.0


@dataclass(frozen=True)
class PpmModel:
    """``grams[k]``: n-grams of k+1 bytes seen in training; ``code[k]``: bits
    of their last byte per language; ``contexts[k]``: the k bytes that came
    before a byte; ``escape[k]``: bits per language for leaving them."""
    languages: list[str]
    grams: list[np.ndarray]
    code: list[np.ndarray]
    contexts: list[np.ndarray]
    escape: list[np.ndarray]
    limit: np.ndarray | None = None      # most bits per byte, per language


def fold(buf: np.ndarray) -> np.ndarray:
    low = B.LOWER[buf]
    capital = np.zeros(len(buf), bool)
    capital[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
    return low + (capital * 32).astype(np.uint8)


def ngrams(buf: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The last ``width`` bytes at each byte of each row as one number, rows
    being preceded by zero bytes; and the offsets."""
    pad = width - 1
    rows = len(off) - 1
    place = np.arange(len(buf)) + pad * (np.repeat(np.arange(rows), np.diff(off)) + 1)
    wide = np.zeros(len(buf) + pad * rows, U64)
    wide[place] = fold(buf)
    key = np.zeros(len(buf), U64)
    for k in range(width):
        key |= wide[place - k] << U64(8 * k)
    return key, off


def train(docs: DataFrame, p: PpmParams = PpmParams()) -> PpmModel:
    """``docs``: the rows (doc_id, text, lang) that may be learned from."""
    h = F.xxhash64(F.col("doc_id").cast("string"), "text")
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    ids = (usable.select(F.col("doc_id").alias("id"), F.col("lang").alias("language"), h.alias("h"))
           .withColumn("n", F.row_number().over(Window.partitionBy("language").orderBy("h", "id")))
           .where(F.col("n") <= p.docs_per_language).select("h", "language").distinct())
    rows = usable.select(h.alias("h"), F.col("lang").alias("language"), "text").join(ids, ["h", "language"])
    width = p.max_order + 1

    def count(batch):
        lang, keys = batch.column(0), []
        names = lang.to_pylist()
        of = {x: i for i, x in enumerate(sorted(set(names)))}
        code = np.array([of[x] for x in names])
        out = {}
        for rows, buf, off in B.chunks(batch.column(1), 1 << 20):
            key, off = ngrams(buf, off, width)
            who = np.repeat(code[rows], np.diff(off))
            for i in np.unique(who):
                for k in range(1, width + 1):
                    g, c = np.unique(key[who == i] & U64((1 << 8 * k) - 1), return_counts=True)
                    out.setdefault((i, k), []).append((g, c))
        back = {i: x for x, i in of.items()}
        cols = [[], [], [], []]
        for (i, k), parts in out.items():
            g = np.concatenate([x for x, _ in parts])
            c = np.concatenate([x for _, x in parts])
            cols[0] += [back[i]] * len(g)
            cols[1].append(np.full(len(g), k, np.int32))
            cols[2].append(g.astype(np.int64))
            cols[3].append(c.astype(np.int64))
        if not cols[0]:
            return None
        return [pa.array(cols[0]), *(pa.array(np.concatenate(x)) for x in cols[1:])]

    got = (map_arrow(rows.select("language", "text"), count, "language string, k int, gram long, n long")
           .groupBy("language", "k", "gram").agg(F.sum("n").alias("n")).toArrow())
    return build(got.column("language").to_pylist(), got.column("k").to_numpy(), got.column("gram").to_numpy(),
                 got.column("n").to_numpy(), width)


def build(language: list[str], k: np.ndarray, gram: np.ndarray, n: np.ndarray, width: int) -> PpmModel:
    """Tables of code lengths from counts of n-grams."""
    names = sorted(set(language))
    of = {x: i for i, x in enumerate(names)}
    who = np.array([of[x] for x in language], np.int64)
    gram = gram.astype(U64)
    grams, code, contexts, escape = [], [], [], []
    for order in range(width):
        at = k == order + 1
        keys, where = np.unique(gram[at], return_inverse=True)
        count = np.zeros((len(keys), len(names)))
        np.add.at(count, (where, who[at]), n[at])
        before, ctx = np.unique(keys >> U64(8), return_inverse=True)
        total, distinct = np.zeros((2, len(before), len(names)))
        np.add.at(total, ctx, count)
        np.add.at(distinct, ctx, count > 0)
        shorter = code[-1][np.searchsorted(grams[-1], keys & U64((1 << 8 * order) - 1))] if order else 8.0
        with np.errstate(divide="ignore", invalid="ignore"):
            leave = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
            own = -np.log2(count / (total + distinct)[ctx])
        grams.append(keys)
        code.append(np.where(count > 0, own, leave[ctx] + shorter))
        contexts.append(before)
        escape.append(leave)
    return PpmModel(names, grams, code, contexts, escape)


def fit(docs: DataFrame, p: PpmParams = PpmParams()) -> PpmModel:
    """A model of ``docs`` (as for ``train``) that also refuses texts in none
    of its languages."""
    back = F.coalesce(F.pmod(F.xxhash64("text"), F.lit(8)) == 0, F.lit(False))
    model = train(docs.where(~back), p)
    if not model.languages:
        model = train(docs, p)
    label = _labeller(docs.sparkSession, model)

    def run(batch):
        got = label(batch.column(1), batch.column(2))
        return None if got is None else [batch.column(0), got[0], got[2]]

    rows = docs.where(back & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.lit(True).alias("letters"))
    usual = (map_arrow(rows, run, "lang string, said string, bits double").where("lang = said").groupBy("lang")
             .agg(F.percentile_approx("bits", 0.5, 10_000).alias("bits")).collect())      # one row a language
    at = {r.lang: p.margin * r.bits for r in usual}
    wide = max(at.values(), default=np.inf)
    return replace(model, limit=np.array([at.get(x, wide) for x in model.languages]))


class Coder:
    """Code lengths of texts under a model, per language."""

    def __init__(self, m: PpmModel):
        self.m = m
        self.gram = [B.HashIndex(g) for g in m.grams]
        self.context = [B.HashIndex(g) for g in m.contexts]

    def bits(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        m, width = self.m, len(self.m.grams)
        key, off = ngrams(buf, off, width)
        at = self.gram[-1].find(key)
        rest = np.flatnonzero(at < 0)
        out = np.empty((len(off) - 1, len(m.languages)))
        late = np.zeros((len(rest), len(m.languages)))
        left = np.arange(len(rest))
        for order in range(width - 1, -1, -1):      # unseen at order+1 bytes: escape, then one byte less
            mask = U64((1 << 8 * order) - 1)
            g = key[rest[left]]
            ctx = self.context[order].find((g >> U64(8)) & mask)
            late[left[ctx >= 0]] += m.escape[order][ctx[ctx >= 0]]
            if order == 0:
                late[left] += 8.0
                break
            found = self.gram[order - 1].find(g & mask)
            late[left[found >= 0]] += m.code[order - 1][found[found >= 0]]
            left = left[found < 0]
        at[rest] = 0
        for lang in range(len(m.languages)):
            x = m.code[-1][:, lang][at] if len(m.grams[-1]) else np.zeros(len(key))
            x[rest] = late[:, lang]
            out[:, lang] = B.per_row(x, off)
        return out


def predict(docs: DataFrame, model: PpmModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_byte, refused) of every row:
    ``lang_pred`` is the nearest learned language (``und``: no letter),
    ``refused`` says that the text is in none of them."""
    id_type = docs.schema[id_col].dataType.simpleString()
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    label = _labeller(docs.sparkSession, model)

    def run(batch):
        got = label(batch.column(1), batch.column(2))
        return None if got is None else [batch.column(0), *got]

    return map_arrow(docs.select(id_col, text_col, letters), run,
                     f"{id_col} {id_type}, lang_pred string, score double, bits_per_byte double, refused boolean")


def _labeller(spark, model: PpmModel):
    held = spark.sparkContext.broadcast(model)

    def label(text, letters):
        if not len(text):
            return None
        m = held.value
        if not m.languages:
            n = len(text)
            return [pa.array(["und"] * n), pa.array(np.zeros(n)), pa.array(np.zeros(n)), pa.array(np.ones(n, bool))]
        coder = _coder(held)
        bits, size = [], []
        for _, buf, off in B.chunks(text, 1 << 20):
            bits.append(coder.bits(buf, off))
            size.append(np.diff(off))
        bits, size = np.concatenate(bits), np.concatenate(size)
        best = bits.argmin(1)
        least = bits.min(1)
        score = 1 / np.exp2(np.minimum(least[:, None] - bits, 0)).sum(1)
        known = letters.to_numpy(zero_copy_only=False).astype(bool)
        refused = ~known
        if m.limit is not None:
            refused |= least > m.limit[best] * size + START
        names = np.array([*m.languages, "und"], object)[np.where(known, best, len(m.languages))]
        return [pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0)),
                pa.array(np.where(size > 0, least / np.maximum(size, 1), 0.0)), pa.array(refused)]

    return label


_coders: dict = {}


def _coder(held) -> Coder:
    """One coder per model in a Python worker."""
    model = held.value
    if id(model) not in _coders:
        _coders.clear()
        _coders[id(model)] = Coder(model)      # holds the model, so its id stays its own
    return _coders[id(model)]


def keep_known(docs: DataFrame, model: PpmModel, min_score: float = 0.0) -> DataFrame:
    """The rows of ``docs`` that are not refused and whose language is known
    with at least ``min_score``; columns unchanged."""
    held = _labeller(docs.sparkSession, model)
    at = docs.columns.index("text")
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias(fresh(docs, "has_letter"))
    fields = docs.schema

    def run(batch):
        n = batch.num_columns - 1
        got = held(batch.column(at), batch.column(n))
        if got is None:
            return None
        good = pc.and_(pc.invert(got[3]), pc.greater_equal(got[1], min_score))
        return [c.filter(good) for c in batch.columns[:n]]

    return map_arrow(docs.select("*", letters), run, fields)
