"""Quality rules: counts over whole texts, and a hashed word and character
n-gram logistic regression with calibrated probabilities.

Words are runs of bytes other than ASCII white space.  The regression sees,
per text, the share of each hashed word and of each hashed character
trigram.  It is fitted on a bounded sample of labelled rows
(``QualityParams.max_rows``, the rows of smallest key hash); everything else
covers all rows.  Four fifths of the sample give the weights, the last fifth
the calibration (a sigmoid of the raw score).  Scoring runs in Arrow batches
with fixed thresholds.

Defined cases: a NULL or empty text has no words, all counts 0, and fails the
base rules; with no usable label of one of the two classes the model gives
every text probability 1, so the base rules decide alone; labels that are
NULL or not 0/1 are left out; repeated rows are scored alike; other columns
of the input, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import byteops as B
from .common import map_arrow

U64 = np.uint64
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class QualityParams:
    max_rows: int = 3000        # labelled rows that the fit may use
    bits: int = 10              # 2**bits hashed words and as many trigrams
    rounds: int = 300
    ridge: float = 1e-3
    threshold: float = 0.5      # keep from this probability on
    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray         # 2 * 2**bits: words, then trigrams
    bias: float
    slope: float                # calibration: sigmoid(slope * raw + shift)
    shift: float
    bits: int


def _features(buf, off, bits: int):
    """Hashed features of a chunk: (words, their bounds, trigrams, their bounds)."""
    s, e, bounds = B.words(buf, off)
    word = B.byte_spans(buf).hash(s, e)
    low = B.LOWER[buf].astype(np.uint32)
    tri = np.zeros(len(buf), np.uint32)
    if len(buf) > 2:
        tri[:-2] = low[:-2] << 16 | low[1:-1] << 8 | low[2:]
    tri = (tri * np.uint32(2654435761)) >> np.uint32(32 - bits)
    # the last two bytes of a row begin no trigram of its own; they are left out
    last = np.maximum(off[1:] - 2, off[:-1])
    return s, e, word, bounds, tri, np.stack([off[:-1], last])


def matrix(text: pa.Array, bits: int) -> np.ndarray:
    """Feature rows: shares of hashed words and of hashed trigrams."""
    d, out = 1 << bits, []
    for _, buf, off in B.chunks(text):
        _, _, word, bounds, tri, span = _features(buf, off, bits)
        x = np.zeros((len(off) - 1, 2 * d), np.float32)
        for r in range(len(off) - 1):
            w, t = word[bounds[r]:bounds[r + 1]], tri[span[0, r]:span[1, r]]
            x[r, :d] = np.bincount((w >> U64(64 - bits)).astype(np.int64), minlength=d) / max(1, len(w))
            x[r, d:] = np.bincount(t, minlength=d) / max(1, len(t))
        out.append(x)
    return np.concatenate(out) if out else np.zeros((0, 2 * d), np.float32)


def sample(docs: DataFrame, labels: DataFrame, p: QualityParams) -> DataFrame:
    """(fold key, label, text) of at most ``max_rows`` labelled texts."""
    rows = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
            .select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("y"),
                    F.xxhash64("doc_id").alias("h"))
            .orderBy("h", "y").limit(p.max_rows))
    # at most max_rows rows of 20 bytes: small enough to broadcast by construction
    return docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(rows), "id").select("h", "y", "text")


def fit(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams()) -> QualityModel:
    """Weights from the bounded sample: tasks hash the texts, the driver fits
    a matrix of max_rows by 2**(bits+1) floats."""
    bits = p.bits

    def rows(batch):
        x = matrix(batch.column(2), bits)
        return [batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())]

    got = map_arrow(sample(docs, labels, p), rows, "h long, y int, x binary").toArrow()
    h = got.column("h").to_numpy()
    y = got.column("y").to_numpy().astype(np.float64)
    order = np.lexsort((y, h))
    h, y = h[order], y[order]
    raw = got.column("x").to_pylist()
    none = QualityModel(np.zeros(2 << bits), 0.0, 0.0, 40.0, bits)
    if len(set(y)) < 2:
        return none
    x = np.stack([np.frombuffer(raw[i], np.float32) for i in order])
    fold = B.mix(h.astype(U64)) % U64(5) == 0
    if len(set(y[~fold])) < 2:
        fold[:] = False
    w, b = _logistic(x[~fold], y[~fold], p)
    held = fold if len(set(y[fold])) == 2 else np.ones(len(y), bool)
    slope, shift = _sigmoid(x[held] @ w + b, y[held])
    return QualityModel(w, b, slope, shift, bits)


def _logistic(x, y, p: QualityParams):
    """Ridge logistic regression by accelerated gradient on scaled columns."""
    scale = 1 / (x.std(0) + 1e-4)
    mean = x.mean(0)
    z = ((x - mean) * scale).astype(np.float32)
    n, d = z.shape
    v = np.ones(d, np.float32)
    for _ in range(15):                      # largest eigenvalue gives the step
        v = z.T @ (z @ v) / n
        top = float(np.linalg.norm(v))
        v = v / max(top, 1e-12)
    step = 1 / (0.25 * max(top, 1.0) * 1.05 + p.ridge + 0.25)
    w = look = np.zeros(d, np.float32)
    b = lookb = float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
    for k in range(p.rounds):
        g = (1 / (1 + np.exp(-np.clip(z @ look + lookb, -40, 40))) - y).astype(np.float32)
        w2 = look - step * (z.T @ g / n + p.ridge * look)
        b2 = lookb - step * float(g.mean())
        m = k / (k + 3)
        look, lookb = w2 + m * (w2 - w), b2 + m * (b2 - b)
        w, b = w2, b2
    w = w.astype(np.float64) * scale
    return w, float(b - mean @ w)


def _sigmoid(raw, y):
    """Calibration by Newton's method with smoothed targets."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a * raw + c, -40, 40)))
        g, s = q - t, q * (1 - q) + 1e-9
        ga, gc = (g * raw).sum() + 1e-3 * (a - 1), g.sum()
        haa, hac, hcc = (s * raw * raw).sum() + 1e-3, (s * raw).sum(), s.sum()
        det = haa * hcc - hac * hac
        if not det > 1e-12:
            break
        da, dc = (hcc * ga - hac * gc) / det, (haa * gc - hac * ga) / det
        a, c = a - np.clip(da, -1, 1), c - np.clip(dc, -2, 2)
    return (float(a), float(c)) if a > 0 else (1.0, 0.0)


def _repeats(key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """True where an equal key of the same row exists, and the order used."""
    k = B.mix(key + row.astype(U64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(k, kind="stable")
    same = k[order][1:] == k[order][:-1]
    return order, same


def counts(buf: np.ndarray, off: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Per row: words, code points in words, symbols, repeated lines, words in
    repeated windows."""
    rows = len(off) - 1
    s, e, bounds = B.words(buf, off)
    spans = B.byte_spans(buf)
    n_words = np.diff(bounds)
    in_word = ~B.SPACE[buf]
    chars = B.per_row(in_word & ((buf & 0xC0) != 0x80), off)
    symbols = B.per_row(SYMBOLS[buf], off)
    # lines: runs of bytes other than \n; empty ones have no word and never count
    ls, le, lb = B.runs(buf != 10, off)
    wordy = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(in_word, out=wordy[1:])
    has = wordy[le] > wordy[ls]
    row = np.repeat(np.arange(rows), np.diff(lb))[has]
    order, same = _repeats(spans.hash(ls[has], le[has]), row)
    dup = np.bincount(row[order][1:][same], minlength=rows)
    # windows of consecutive words
    word_row = np.repeat(np.arange(rows), n_words)
    at = np.flatnonzero(np.arange(len(s)) + window <= bounds[word_row + 1]) if len(s) else np.zeros(0, np.int64)
    order, same = _repeats(B.Spans(spans.hash(s, e)).hash(at, at + window), word_row[at])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(s) + 1, np.int64)
    np.add.at(step, at[twice], 1)
    np.add.at(step, at[twice] + window, -1)
    repeat = B.per_row(np.cumsum(step[:-1]) > 0, bounds) if len(s) else np.zeros(rows, np.int64)
    return n_words, chars, symbols, dup, repeat


def probability(buf, off, m: QualityModel) -> np.ndarray:
    d = 1 << m.bits
    _, _, word, bounds, tri, span = _features(buf, off, m.bits)
    score = np.full(len(off) - 1, m.bias)
    got = m.weights[:d][(word >> U64(64 - m.bits)).astype(np.int64)]
    score += B.per_row(got, bounds) / np.maximum(1, np.diff(bounds))
    total = np.zeros(len(tri) + 1)
    np.cumsum(m.weights[d:][tri], out=total[1:])
    score += (total[span[1]] - total[span[0]]) / np.maximum(1, span[1] - span[0])
    return 1 / (1 + np.exp(-np.clip(m.slope * score + m.shift, -40, 40)))


SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, probability double")


def score(docs: DataFrame, model: QualityModel, p: QualityParams = QualityParams()) -> DataFrame:
    """doc_id with the counts, the base verdict, the calibrated probability
    and the final verdict of every row of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        cols = []
        for _, buf, off in B.chunks(batch.column(1)):
            n = counts(buf, off, p.window)
            prob = probability(buf, off, held.value)
            failed = (n[0] < p.min_words) | (100 * n[4] > p.max_repeat_percent * n[0])
            cols.append([*n, failed, ~failed & (prob >= p.threshold), prob])
        if not cols:
            return None
        return [batch.column(0), *(pa.array(np.concatenate(x)) for x in zip(*cols, strict=True))]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, {SCHEMA}")
