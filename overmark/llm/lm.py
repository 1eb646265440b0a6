"""Language-model scores by a log-bilinear model trained with
noise-contrastive estimation.

Tokens are words (runs other than ASCII white space, A-Z lowered) and one end
per text.  Counts of all tokens of the learning rows are made by Spark.

*Vocabulary.*  All words of at most 64 bytes that were seen ``least_seen``
times, 2 for small inputs and as the square root of the tokens for large ones,
so the vocabulary grows with the input and so does the share of tokens it
covers, while its tables grow slower than the input.

*Model.*  Classes are the most frequent words one by one, bins of the other
vocabulary words by rank (wider down the ranks, as their square root), the
end, and one for words outside the vocabulary.  With context vectors r of all
vocabulary words, class vectors q, biases b and a matrix C_i per context
place, h = r_u C_1 + r_v C_2 and s(k | u, v) = h q_k + b_k; a word of a bin has
a vector and a bias of its own, and P(w | u, v) = P(bin | u, v) P(w | bin, u, v),
both exact softmaxes.  Tasks run stochastic gradients of noise-contrastive
losses (noise classes shared by a minibatch, noise words of the bin per word)
over all their learning texts from a common start and send the rows they
touched; each row is averaged by its touches.  Normalisers are computed for
the context pairs that occur; those of the most frequent contexts are tabled.
A word outside the vocabulary costs its class's probability times the word's
share of the smoothed unigram mass outside the other classes, so the model is
normalised over all words seen and one unseen.

*Counts of rare words.*  Vocabulary words are looked up in tasks; a text's
other words go through a join with the counts.

Defined cases: NULL text is empty (one end token); with nothing to learn
from, base and model both give an end and a word probability 1/1 (N = V = 0);
a NULL doc_id is learned from and not held out; repeated rows are scored
alike; other columns are not read.  Averaging depends on how the input is
split, so scores agree only over equal splits.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from . import byteops as B
from .common import BATCH_BYTES, map_arrow, written

U64 = np.uint64
END = ""          # no word is empty, so the end can have this name


@dataclass(frozen=True)
class LmParams:
    classes: int = 1024
    width: int = 16
    noise: int = 48
    batch: int = 4096
    rate: float = 0.1
    within: int = 2          # noise words per word of a bin
    head: int | None = None  # words of the vocabulary at most; None: all seen ``least_seen`` times
    workers: int = 1024      # tasks that train at most; their averages are summed
    seed: int = 3


@dataclass(frozen=True)
class Counts:
    words: pa.Array          # the vocabulary, most frequent first, without the end
    count: np.ndarray
    ends: int
    n: int
    v: int


def _lists(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.Array:
    """Strings of the spans s:e."""
    size = e - s
    at = np.append(0, np.cumsum(size))
    data = buf[np.repeat(s - at[:-1], size) + np.arange(at[-1])]
    return pa.Array.from_buffers(pa.large_string(), len(s), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data.tobytes())])


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over the texts, the end as the empty word."""
    def run(batch):
        words, n = [pa.array([END], pa.large_string())], [np.array([batch.num_rows])]
        for _, buf, off in B.chunks(batch.column(0), BATCH_BYTES):
            buf = B.LOWER[buf]
            s, e, _ = B.words(buf, off)
            hashes = B.byte_spans(buf).hash(s, e)
            order = np.argsort(hashes)
            hashes = hashes.take(order)
            first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])[:len(order)])
            words.append(_lists(buf, s[order[first]], e[order[first]]))
            n.append(np.diff(first, append=len(order)))
        return [pa.concat_arrays(words), pa.array(np.concatenate(n))]

    return map_arrow(docs.select("text"), run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def head_of(counts: DataFrame, p: LmParams) -> Counts:
    total = counts.agg(F.sum("c"), F.count("*")).head()
    ends = counts.where(F.col("word") == END).head()
    n = int(total[0] or 0)
    rows = counts.where(F.octet_length("word").between(1, 64) & (F.col("c") >= least_seen(n))).orderBy(F.desc("c"), "word")
    rows = (rows if p.head is None else rows.limit(p.head)).toArrow()
    return Counts(rows.column("word").cast(pa.large_string()).combine_chunks(), rows.column("c").to_numpy(),
                  int(ends.c) if ends else 0, n, int(total[1]))


def least_seen(n: int) -> int:
    """How often a vocabulary word is seen in ``n`` tokens."""
    return max(2, isqrt(n) // 1000)


class Vocabulary:
    """Words by rank, the end and the open word, and their classes."""

    def __init__(self, c: Counts, p: LmParams):
        self.words = v = len(c.words)
        self.end, self.open = v, v + 1
        self.listed = v if v <= p.classes - 2 else (p.classes - 2) // 4
        edge = np.linspace(self.listed ** 0.5, v ** 0.5, p.classes - 1 - self.listed) ** 2
        edge = np.unique(np.append(np.arange(self.listed), np.rint(edge).astype(np.int64)))
        self.lo = np.append(edge[edge < v], [v, v + 1])
        self.size = np.diff(np.append(self.lo, v + 2))
        self.classes = len(self.lo)
        self.kind = np.repeat(np.arange(self.classes), self.size)
        whole = c.n + c.v + 1
        x = np.append((c.count + 1) / whole, (c.ends + 1) / whole)
        x = np.append(x, max(1 - x.sum(), 1e-9))
        self.unigram = np.add.reduceat(x, self.lo)
        self.unigram /= self.unigram.sum()
        self.share = (x[:v] / np.add.reduceat(x, self.lo)[self.kind[:v]])      # of a word in its class


class Reader:
    """Texts as vocabulary numbers."""

    def __init__(self, c: Counts, p: LmParams):
        buf, off = B.utf8(c.words)
        self.index = B.HashIndex(B.byte_spans(buf).hash(off[:-1], off[1:]))
        self.vocabulary = Vocabulary(c, p)

    def read(self, buf: np.ndarray, off: np.ndarray):
        """(lowered bytes, word starts, ends, hashes, place in the vocabulary
        or -1, row bounds, numbers with ends, their row bounds)."""
        buf = B.LOWER[buf]
        s, e, bounds = B.words(buf, off)
        hashes = B.byte_spans(buf).hash(s, e)
        at = self.index.find(hashes)
        rows = len(off) - 1
        word = np.full(len(s) + rows, self.vocabulary.end, np.int64)
        word[np.arange(len(s)) + np.repeat(np.arange(rows), np.diff(bounds))] = np.where(at >= 0, at, self.vocabulary.open)
        return buf, s, e, hashes, at, bounds, word, bounds + np.arange(rows + 1)


def contexts(kind: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers one and two before each token; ends before a text."""
    u, v = np.full(len(kind), end), np.full(len(kind), end)
    u[1:] = kind[:-1]
    v[2:] = kind[:-2]
    u[bounds[:-1]] = end
    v[bounds[:-1]] = end
    second = bounds[:-1] + 1
    v[second[second < bounds[1:]]] = end
    return u, v


@dataclass
class Lbl:
    r: np.ndarray            # contexts x width
    q: np.ndarray            # classes x width
    b: np.ndarray
    c: np.ndarray            # 2 x width x width
    own: np.ndarray          # words x (width and bias), within their class

    @cached_property
    def reach(self) -> tuple[float, float]:
        """The length of the longest class's or word's vector, the largest bias."""
        own, bias = self.own[:, :-1], self.own[:, -1]
        return (max(np.sqrt(_row_dots(x, x).max(initial=0)) for x in (self.q, own)),
                max(np.abs(x).max(initial=0) for x in (self.b, bias)))

    @staticmethod
    def start(unigram: np.ndarray, p: LmParams, share: np.ndarray | None = None) -> Lbl:
        """``share``: of the vocabulary words in their classes; without it
        the contexts are the classes."""
        rng = np.random.default_rng(p.seed)
        n, d = len(unigram), p.width
        share = np.zeros(0) if share is None else share
        small = lambda rows: rng.standard_normal((rows, d), np.float32) * np.float32(0.1)
        q, r = small(n), small(len(share) + 2 if len(share) else n)
        own = np.column_stack([small(len(share)), np.log(share).astype(np.float32)])
        return Lbl(r, q, np.log(unigram).astype(np.float32), np.stack([np.eye(d), np.eye(d) / 2]).astype(np.float32), own)


def _logistic(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)), in place."""
    np.clip(x, -30, 30, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _put(x: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """x[at] = rows, each row as one item."""
    item = f"V{x.shape[1] * x.itemsize}"
    x.view(item)[:, 0][at] = rows.view(item)[:, 0]


def _row_dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, y)


class Trainer:
    """Stochastic gradients of the noise-contrastive losses, scaled per
    parameter by their past squares."""

    def __init__(self, voc: Vocabulary, p: LmParams):
        self.voc, self.p, self.rng = voc, p, np.random.default_rng(p.seed + 1)
        self.m = m = Lbl.start(voc.unigram, p, voc.share)
        self.past = [np.full(x.shape, 1e-2, np.float32) for x in (m.q, m.b, m.c)]
        self.past_r, self.past_own = (np.full(x.shape, y, np.float32) for x, y in ((m.r, 1e-4), (m.own, 1e-1)))
        self.past_r[:p.classes] = 1e-2
        self.seen_r, self.seen_own, self.tokens = np.zeros(len(m.r), np.float32), np.zeros(len(m.own), np.float32), 0
        self.cdf = np.cumsum(voc.unigram)
        self.shift = np.log(p.noise * voc.unigram).astype(np.float32)
        self.within = np.log(p.within / voc.size).astype(np.float32)

    @staticmethod
    def _sums(at, rows, n):
        """Sums of ``rows`` by their place ``at`` below ``n``."""
        d = rows.shape[1]
        cell = (at[:, None] * d + np.arange(d)).ravel()
        return np.bincount(cell, rows.ravel(), n * d).astype(np.float32).reshape(n, d)

    def _touch(self, x, past, seen, at, rows, times=None):
        """Step of the rows ``at`` of a large matrix by their summed gradients;
        ``times``: the touches that each of ``rows`` is the sum of."""
        order = np.argsort(at)
        at = at.take(order)
        first = np.append(0, np.flatnonzero(np.diff(at)) + 1)
        some = at.take(first)
        count = np.diff(first, append=len(at))
        g = rows.take(order.take(first), 0)
        many = count > 1                        # the rest need no sum
        if many.any():
            part, start = order[np.repeat(many, count)], np.append(0, np.cumsum(count[many])[:-1])
            g[many] = np.add.reduceat(rows.take(part, 0), start, axis=0)
        times = count if times is None else np.add.reduceat(times.take(order), first)
        squares = g * g
        squares += past.take(some, 0)
        _put(past, some, squares)
        g /= np.sqrt(squares, out=squares)
        g *= np.float32(self.p.rate)
        g += x.take(some, 0)
        _put(x, some, g)
        seen[some] += times

    def step(self, u, v, w):
        m, p, voc = self.m, self.p, self.voc
        k, n = voc.kind[w], voc.classes
        noise = np.minimum(np.searchsorted(self.cdf, self.rng.random(p.noise) * self.cdf[-1], "right"), n - 1)
        ru, rv = m.r.take(u, 0), m.r.take(v, 0)
        hb = np.ones((len(w), p.width + 1), np.float32)         # with a one for the biases
        h = hb[:, :-1]
        np.add(ru @ m.c[0], rv @ m.c[1], out=h)
        qw, qn = m.q.take(k, 0), m.q[noise]
        gw = _logistic(_row_dots(h, qw) + (m.b - self.shift)[k])
        gn = _logistic((self.shift - m.b)[noise] - h @ qn.T)
        np.negative(gn, out=gn)
        dh = gw[:, None] * qw + gn @ qn
        dq = self._sums(k, gw[:, None] * hb, n) + self._sums(noise, gn.T @ hb, n)
        dq, db = dq[:, :-1], dq[:, -1]
        binned = np.flatnonzero(voc.size[k] > 1)
        if len(binned):
            kb, hb = k[binned], hb.take(binned, 0)
            size = voc.size[kb]
            drawn = voc.lo[kb, None] + (self.rng.random((len(binned), p.within)) * size[:, None]).astype(np.int64)
            at = np.column_stack([w[binned], drawn])
            own = m.own.take(at, 0)
            g = -_logistic(self.within[kb, None] - np.einsum("ijk,ik->ij", own, hb))
            g[:, 0] += 1
            _put(dh, binned, dh.take(binned, 0) + np.einsum("ij,ijk->ik", g, own)[:, :-1])
            self._touch(m.own, self.past_own, self.seen_own, at.ravel(), (g[:, :, None] * hb[:, None]).reshape(-1, p.width + 1))
        dc = np.stack([ru.T @ dh, rv.T @ dh])
        scale = np.float32(len(w) ** 0.5)
        # a token's second context is the first of the token before it, but at the start of a text
        du, dv = (dh / scale) @ m.c[0].T, (dh / scale) @ m.c[1].T
        same = np.append(v[1:] == u[:-1], False)
        du[same] += dv[1:][same[:-1]]
        other = np.flatnonzero(~np.append(False, same[:-1]))
        self._touch(m.r, self.past_r, self.seen_r, np.append(u, v[other]), np.concatenate([du, dv[other]]),
                    np.append(1 + same, np.ones(len(other), np.int64)))
        for x, g, past in zip((m.q, m.b, m.c), (dq, db, dc), self.past, strict=True):
            g = g / scale
            past += g * g
            x += np.float32(p.rate) * g / np.sqrt(past)
        self.tokens += len(w)

    def touched(self):
        """(row numbers, weights, moves from the start) of the parameter rows
        this task moved, in the order of ``_matrices``."""
        first, start = 0, _matrices(Lbl.start(self.voc.unigram, self.p, self.voc.share))
        every = np.float32(self.tokens)
        for x, was, seen in zip(_matrices(self.m), start, (self.seen_r, self.seen_own, every, every, every), strict=True):
            at = np.arange(len(x)) if seen is every else np.flatnonzero(seen)
            yield first + at, np.broadcast_to(seen if seen is every else seen[at], at.shape), x[at] - was[at]
            first += len(x)


def _matrices(m: Lbl) -> list[np.ndarray]:
    """The parameters as views of rows."""
    return [m.r, m.own, m.q, m.b[:, None], m.c.reshape(-1, m.c.shape[2])]


SLICE = 1 << 14                # parameter rows that are averaged together
PART = StructType([StructField("slice", LongType()), *(StructField(x, BinaryType()) for x in ("at", "weight", "x"))])


def _parts(at, weight, rows, wide: int):
    """Sorted parameter rows as one record per slice; moves are sent in half
    precision, as they are small against what they are added to."""
    cut = np.append(0, np.flatnonzero(np.diff(at // SLICE)) + 1)
    for i, j in zip(cut, np.append(cut[1:], len(at)), strict=True) if len(at) else ():
        x = np.zeros((j - i, wide), np.float16)
        x[:, :rows.shape[1]] = rows[i:j]
        one = (at[i] // SLICE, (at[i:j] % SLICE).astype(np.int32), weight[i:j].astype(np.float32), x)
        yield pa.RecordBatch.from_arrays([pa.array([int(one[0])]), *(pa.array([y.tobytes()], pa.binary()) for y in one[1:])],
                                         PART.names)


def train(docs: DataFrame, c: Counts, p: LmParams) -> Lbl:
    """Every task trains on all its texts; each parameter row is averaged by
    how often a task touched it."""
    held = docs.sparkSession.sparkContext.broadcast(c)
    wide = p.width + 1

    def run(batches):
        t = None
        for batch in batches:
            for _, buf, off in B.chunks(batch.column(0)):
                if t is None:
                    reader = _reader(held.value, p)
                    t = Trainer(reader.vocabulary, p)
                *_, word, bounds = reader.read(buf, off)
                u, v = contexts(word, bounds, reader.vocabulary.end)
                for i in range(0, len(word), p.batch):
                    t.step(u[i:i + p.batch], v[i:i + p.batch], word[i:i + p.batch])
        if t is not None:
            for some in t.touched():
                yield from _parts(*some, wide)

    def average(batches):
        held: dict[int, tuple] = {}
        for batch in batches:
            for number, at, weight, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total, rows = held.setdefault(number, (np.zeros(SLICE), np.zeros((SLICE, wide))))
                at, weight = np.frombuffer(at, np.int32), np.frombuffer(weight, np.float32)
                total[at] += weight
                rows[at] += weight[:, None] * np.frombuffer(x, np.float16).reshape(-1, wide)
        for number, (total, rows) in held.items():
            at = np.flatnonzero(total)
            yield from _parts(number * SLICE + at, total[at], rows[at] / total[at, None], wide)

    trained = docs.select("text").coalesce(p.workers).mapInArrow(run, PART)
    parts = trained.repartition("slice").mapInArrow(average, PART).select("slice", "at", "x").toLocalIterator()
    voc = Vocabulary(c, p)
    m = Lbl.start(voc.unigram, p, voc.share)
    views = _matrices(m)
    first = np.append(0, np.cumsum([len(x) for x in views]))
    for part in parts:                          # one mean per vocabulary row at most
        at = part["slice"] * SLICE + np.frombuffer(part["at"], np.int32)
        x = np.frombuffer(part["x"], np.float16).reshape(-1, wide)
        for view, lo, hi in zip(views, first[:-1], first[1:], strict=True):
            mine = (at >= lo) & (at < hi)
            view[at[mine] - lo] += x[mine, :view.shape[1]]
    return m


TO_TWO = np.float32(np.log2(np.e))     # exp(x) = 2 ** (x * TO_TWO), which takes less time
BLOCK = 1 << 17                        # powers held at a time, to stay in a core's cache


def _log_sums(h: np.ndarray, q: np.ndarray, near: bool, block: np.ndarray | None = None) -> np.ndarray:
    """Natural logs of the sums over q's rows of 2 ** (h q), both with a column
    for the biases; ``near``: the powers fit a float; ``block``: room for them,
    a row of h at least."""
    block = np.empty(max(BLOCK, len(q)), np.float32) if block is None else block
    step = len(block) // len(q)
    sums, ones = np.empty(len(h), np.float32), np.ones(len(q), np.float32)
    for i in range(0, len(h), step):
        some = h[i:i + step]
        s, top = np.matmul(q, some.T, out=block[:len(q) * len(some)].reshape(len(q), -1)), 0
        if not near:
            top = s.max(0)
            s -= top
        sums[i:i + step] = top + np.log2(ones @ np.exp2(s, out=s))
    sums /= TO_TWO
    return sums


def _hidden(m: Lbl, ru: np.ndarray, rv: np.ndarray) -> tuple[np.ndarray, bool]:
    """h of context vectors with a one for the biases, and whether all its
    exp(s) fit a float."""
    h = np.ones((len(rv), m.q.shape[1] + 1), np.float32)
    np.add(ru @ m.c[0], rv @ m.c[1], out=h[:, :-1])
    length, bias = m.reach
    return h, bool(np.sqrt(_row_dots(h, h).max(initial=0)) * length + bias < 60)


def log_probabilities(m: Lbl, voc: Vocabulary, z: np.ndarray, u: np.ndarray, v: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Natural log of P(word | u, v) in the vocabulary, normalised exactly;
    ``z``: the normalisers of pairs of the first contexts."""
    h, near = _hidden(m, m.r.take(u, 0), m.r.take(v, 0))
    k, q = voc.kind.take(word), np.column_stack([m.q, m.b])
    out = _row_dots(h, q.take(k, 0))
    h *= TO_TWO
    tabled = (u < len(z)) & (v < len(z))
    out[tabled] -= z[u[tabled], v[tabled]]
    rest = np.flatnonzero(~tabled)
    pair = u[rest] * len(m.r) + v[rest]
    order = np.argsort(pair)
    new = np.diff(pair.take(order), prepend=-1) != 0
    block = np.empty(max(BLOCK, len(q), voc.size.max()), np.float32)
    out[rest[order]] -= _log_sums(h.take(rest[order[new]], 0), q, near, block).take(np.cumsum(new) - 1)
    binned = np.flatnonzero(voc.size.take(k) > 1)
    if len(binned):
        binned = binned.take(np.argsort(k[binned].astype(np.int32), kind="stable"))
        kb, h = k[binned], h.take(binned, 0)
        sums = np.empty(len(binned), np.float32)
        cut = np.append(0, np.flatnonzero(np.diff(kb)) + 1)
        lo, size = voc.lo[kb[cut]], voc.size[kb[cut]]
        for i, j, a, n in zip(cut.tolist(), [*cut[1:].tolist(), len(kb)], lo.tolist(), size.tolist(), strict=True):
            sums[i:j] = _log_sums(h[i:j], m.own[a:a + n], near, block)
        out[binned] += _row_dots(h, m.own.take(word[binned], 0)) / TO_TWO - sums
    return out


def normalisers(spark, m: Lbl, p: LmParams) -> np.ndarray:
    """log of the sum over classes of exp(s), for every pair [u, v] of the
    first ``classes`` contexts."""
    n = min(p.classes, len(m.r))
    held = spark.sparkContext.broadcast(Lbl(m.r[:n], m.q, m.b, m.c, m.own[:0]))

    def run(batch):
        m, out = held.value, []
        q = np.column_stack([m.q, m.b])
        for u in batch.column(0).to_pylist():
            h, near = _hidden(m, m.r[u:u + 1], m.r)
            out.append(_log_sums(h * TO_TWO, q, near).tobytes())
        return [batch.column(0).cast(pa.int64()), pa.array(out, pa.binary())]

    rows = map_arrow(spark.range(n), run, "u long, z binary").collect()      # classes rows of classes floats
    return np.stack([np.frombuffer(r.z, np.float32) for r in sorted(rows, key=lambda r: r.u)])


_readers: dict = {}


def _reader(c: Counts, p: LmParams) -> Reader:
    """One reader per broadcast counts in a Python worker."""
    if id(c) not in _readers:
        _readers.clear()
        _readers[id(c)] = (Reader(c, p), c)      # holds the counts, so their id stays their own
    return _readers[id(c)][0]


def score(docs: DataFrame, learn, p: LmParams = LmParams()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score);
    ``learn`` is the condition of the rows to learn from."""
    spark = docs.sparkSession
    learn = F.coalesce(learn, F.lit(True))
    known = written(count_words(docs.where(learn)), "lm-counts")
    c = head_of(known, p)
    m = train(docs.where(learn), c, p)
    held = spark.sparkContext.broadcast((c, m, normalisers(spark, m, p)))
    whole = c.n + c.v + 1
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch):
        c, m, z = held.value
        reader = _reader(c, p)
        voc = reader.vocabulary
        base = np.log10(voc.unigram)
        log_c = np.append(np.log10((c.count + 1) / whole), 0.0)
        log_end = np.log10((c.ends + 1) / whole)
        cols, words, tf, size = [], [], [], []
        for _, buf, off in B.chunks(batch.column(3), 2 << 20):
            buf, s, e, hashes, at, bounds, word, wb = reader.read(buf, off)
            own = log_probabilities(m, voc, z, *contexts(word, wb, voc.end), word).astype(np.float64) / np.log(10)
            value = log_c[at]                                   # 0 for words outside the vocabulary
            rows, row = len(off) - 1, np.repeat(np.arange(len(off) - 1), np.diff(bounds))
            cols.append([np.diff(wb), B.per_row(at >= 0, bounds) + (c.ends > 0), B.per_row(value, bounds) + log_end,
                         B.per_row(own, wb) - base[-1] * B.per_row(at < 0, bounds)])
            rare = np.flatnonzero(at < 0)
            hsh = hashes[rare]
            order = np.lexsort((hsh, row[rare]))
            new = np.append(True, (hsh[order][1:] != hsh[order][:-1]) | (row[rare][order][1:] != row[rare][order][:-1]))[:len(rare)]
            first = np.flatnonzero(new)
            tf.append(np.diff(np.append(first, len(rare))))
            pick = rare[order[first]]
            words.append(_lists(buf, s[pick], e[pick]))
            size.append(np.bincount(row[pick], minlength=rows))
        if not cols:
            return None
        off = np.append(0, np.cumsum(np.concatenate(size))).astype(np.int32)
        tail = pa.ListArray.from_arrays(pa.array(off), pa.concat_arrays(words).cast(pa.string()))
        times = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(tf).astype(np.int64)))
        return [*batch.columns[:3], *(pa.array(np.concatenate(x)) for x in zip(*cols, strict=True)), tail, times]

    each = map_arrow(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", (~learn).alias("held_out"), "text"), run,
                     f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, "
                     "score double, tail array<string>, times array<long>")
    each = written(each, "lm-rows")
    pairs = each.select("row", F.explode(F.arrays_zip("tail", "times")).alias("x")).select(
        "row", F.col("x.tail").alias("word"), F.col("x.times").alias("t"))
    rare = (pairs.join(known, "word", "left").groupBy("row")
            .agg(F.sum(F.when(F.col("c") > 0, F.col("t")).otherwise(0)).alias("more"),
                 F.sum(F.col("t") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(whole)))).alias("low")))
    out = each.drop("tail", "times").join(rare, "row", "left")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
                      F.lit(c.n).cast("long").alias("train_tokens"),
                      (F.col("base_score") + F.coalesce("low", F.lit(0.0))).alias("base_score"),
                      (F.col("score") + F.coalesce("low", F.lit(0.0))).alias("score"))
