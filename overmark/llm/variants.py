"""Spelling variants: words one edit apart, joined by pivotal bigrams.

Bigrams are ordered by how many words hold them, rare ones first.  A word's
prefix is its three rarest bigrams (two times the one edit, and one), with
all occurrences that tie with the third.  Three bigrams include two that do
not overlap; a small dynamic programme chooses the disjoint pair that the
fewest words share: the pivots.  One edit cannot touch both, so one pivot
stands unchanged in every word one edit away.  Of two such words take the one
whose third bigram comes first: its pivot is also in the other's prefix.  So
pivots are looked up among prefixes only.  The edit also fixes where:
words of equal length hold the bigram at the same place, a word one longer at
the same place or one later, one shorter at the same place or one before.
And it lies after the first pivot or before the second: then the letters up
to the first, or from the second on, are equal too.  The join key is a hash
of the bigram, the length, the place and those letters; the join's condition
verifies the pair by edit distance, so only true pairs leave it.  Before that
it compares the words' letters as sets of 64 hashed bits: one edit takes one
letter away and adds one at most.

The table of bigram counts has 2**16 hashed entries whatever the input (a
shared entry only makes a bigram count as less rare).

``group`` takes any table of distinct words with counts; ``count_words``
makes one from texts.  Words under ``MIN_LENGTH`` code points have no three
bigrams to choose from and stay without near words.

Defined cases: NULL and empty texts give no words; very long texts are
counted whole; repeated rows count each time; a NULL id reaches ``spell`` as
None; NULL words or counts are dropped by ``group``; ties for the form go to
the word first in code-point order; an empty table gives none; other columns
are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import byteops as B
from .common import map_arrow, written

LETTERS = r"[A-Za-zÀ-ÿ]+"
MIN_LENGTH = 5
SLOTS = 1 << 16
U64 = np.uint64


def count_words(docs: DataFrame, spell: Callable[[object, str], str] = lambda key, run: run,
                min_length: int = MIN_LENGTH, min_count: int = 3) -> DataFrame:
    """(word, n): runs of letters with A-Z lower-cased, passed through
    ``spell(doc_id, run)``, counted over all texts.  A chunk's counts are
    summed in its task before they are exchanged."""
    letters = re.compile(LETTERS)

    def rows(batch):
        total: Counter = Counter()
        ids = batch.column(0).to_pylist()
        for rows_, buf, off in B.chunks(batch.column(1)):
            raw = B.LOWER[buf].tobytes()
            for key, a, b in zip(ids[rows_], off[:-1], off[1:]):
                for run, n in Counter(letters.findall(raw[a:b].decode())).items():
                    word = spell(key, run)
                    if len(word) >= min_length:
                        total[word] += n
        return [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())]

    return (map_arrow(docs.select("doc_id", "text"), rows, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count))


def _bigrams(words: pa.Array):
    """Code points of all words end to end, words' bounds, and per bigram
    (word, place, code)."""
    text = words.to_pylist()
    bounds = np.append(0, np.cumsum([len(w) for w in text])).astype(np.int64)
    points = np.frombuffer("".join(text).encode("utf-32-le"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(text)), np.diff(bounds))
    i = np.flatnonzero(np.arange(len(points)) + 1 < bounds[owner + 1])
    return points, bounds, owner[i], i - bounds[owner[i]], points[i] << 21 | points[i + 1]


def _slot(code: np.ndarray) -> np.ndarray:
    return (B.mix(code.astype(U64)) % U64(SLOTS)).astype(np.int64)


def bigram_counts(vocab: DataFrame) -> np.ndarray:
    """Words a hashed bigram stands in (occurrences), SLOTS entries."""
    def rows(batch):
        n = np.bincount(_slot(_bigrams(batch.column(0))[4]), minlength=SLOTS)
        at = np.flatnonzero(n)
        return [pa.array(at), pa.array(n[at])]

    got = (map_arrow(vocab.select("word"), rows, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
           .toArrow())                                     # at most SLOTS rows
    out = np.zeros(SLOTS, np.int64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out


def pivots(place: np.ndarray, weight: np.ndarray, wanted: int = 2, width: int = 2) -> np.ndarray:
    """For each row of ascending places, True at ``wanted`` of them that lie
    ``width`` apart or more and have the least total weight: cost[:, j, c] is
    the least weight of c places among the first j, taking the j-th or not."""
    m, k = place.shape
    never = np.int64(1) << 60
    cost = np.full((m, k + 1, wanted + 1), never)
    cost[:, :, 0] = 0
    free = (place[:, None, :] <= place[:, :, None] - width).sum(2)      # earlier places that do not overlap
    row = np.arange(m)
    for j in range(k):
        taken = cost[row, free[:, j], :-1] + weight[:, j, None]
        cost[:, j + 1, 1:] = np.minimum(cost[:, j, 1:], taken)
    chosen = np.zeros((m, k), bool)
    at, left = np.full(m, k), np.full(m, wanted)
    for j in range(k - 1, -1, -1):
        take = (at == j + 1) & (left > 0) & (cost[row, j + 1, left] < cost[row, j, left])
        chosen[take, j] = True
        left[take] -= 1
        at = np.where(take, free[:, j], np.where(at == j + 1, j, at))
    return chosen


def _signatures(words: pa.Array, n: pa.Array, counts: np.ndarray):
    """Columns side, sig, letters, last_rank, last_code, word, n: prefix rows (side 0)
    and pivot rows (side 1).  ``sig`` hashes the bigram, length, place and the
    letters left (0) or right (1) of it; the first pivot has one with those on
    its left, the second with those on its right, for every length and place
    that an edit on the other side can leave it at.  (last_rank,
    last_code) is the third bigram's place in the order."""
    points, bounds, owner, place, code = _bigrams(words)
    size = np.diff(bounds)
    rank = counts[_slot(code)]
    order = np.lexsort((place, code, rank, owner))
    owner, place, code, rank = owner[order], place[order], code[order], rank[order]
    at = bounds[owner] + place
    spans = B.Spans(B.mix(points.astype(U64) + U64(1)))
    sides = [spans.hash(bounds[owner], at), spans.hash(at + 2, bounds[owner + 1])]
    bit = U64(1) << (B.mix(points.astype(U64)) & U64(63))
    letters = np.bitwise_or.reduceat(np.append(bit, U64(0)), bounds[:-1]).astype(np.int64)
    first = np.searchsorted(owner, np.arange(len(size)))
    usable = np.flatnonzero(size >= MIN_LENGTH)
    three = first[usable][:, None] + np.arange(3)
    last_rank, last_code = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    last_rank[usable], last_code[usable] = rank[three[:, 2]], code[three[:, 2]]
    inside = np.flatnonzero((size[owner] >= MIN_LENGTH)
                            & ((rank < last_rank[owner]) | ((rank == last_rank[owner]) & (code <= last_code[owner]))))
    three = np.take_along_axis(three, np.argsort(place[three], 1), 1)
    chosen = three[pivots(place[three], rank[three])].reshape(-1, 2)
    out = [[], [], []]

    def add(side, i, hand, more, shift):
        where = (size[owner[i]] + more) << 32 | (place[i] + shift) << 1 | hand
        sig = B.mix(B.mix(sides[hand][i] ^ B.mix(code[i].astype(U64))) ^ where.astype(U64))
        for col, x in zip(out, (np.full(len(i), side, np.int32), sig.astype(np.int64), owner[i])):
            col.append(x)

    for hand in (0, 1):
        add(0, inside, hand, 0, 0)
        for more in (-1, 0, 1):                            # an edit on the left moves the bigram
            add(1, chosen[:, hand], hand, more, more * hand)
    side, sig, w = (np.concatenate(x) for x in out)
    take = pa.array(w)
    return [pa.array(side), pa.array(sig), pa.array(letters[w]), pa.array(last_rank[w]), pa.array(last_code[w]),
            words.take(take), n.take(take)]


def near_pairs(vocab: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n) of all words one edit apart, each pair once."""
    counts = bigram_counts(vocab)
    rows = written(map_arrow(vocab.select("word", "n"), lambda x: _signatures(x.column(0), x.column(1), counts),
                             "side int, sig long, letters long, last_rank long, last_code long, word string, n long"),
                   "variant-signatures")
    pivot = rows.where("side = 1").select("sig", *[F.col(c).alias(f"p_{c}") for c in rows.columns[2:]])
    prefix = rows.where("side = 0").drop("side")
    earlier = (F.col("p_last_rank") < F.col("last_rank")) | (
        (F.col("p_last_rank") == F.col("last_rank")) & (F.col("p_last_code") <= F.col("last_code")))
    alike = F.bit_count(F.col("p_letters").bitwiseXOR(F.col("letters"))) <= 2
    cond = (pivot["sig"] == prefix["sig"]) & alike & earlier & (F.levenshtein("p_word", "word", 1) == 1)
    one, two = F.struct(F.col("p_word").alias("w"), F.col("p_n").alias("n")), F.struct(F.col("word").alias("w"), F.col("n"))
    return (pivot.join(prefix, cond)
            .select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b"))
            .distinct().select(F.col("a.w").alias("a"), F.col("a.n").alias("a_n"),
                               F.col("b.w").alias("b"), F.col("b.n").alias("b_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form): forms followed to the last one.
    Every round each word takes its form's form, so chains halve; a form's
    count is at least twice its word's, so there is no cycle and a chain has
    at most log2 of the largest count links."""
    up = written(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(up.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variant-roots")
        up = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            return up


def group(vocab: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for a table of distinct words."""
    vocab = written(vocab.where(F.col("word").isNotNull() & F.col("n").isNotNull())
                    .select("word", F.col("n").cast("long").alias("n")), "variant-words")
    pairs = near_pairs(vocab)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))
    )).alias("x")).select("x.*")
    best = both.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"),
                                         F.min(F.struct(-F.col("near_n"), F.col("near"))).alias("top"))
    fits = -F.col("top.col1") >= 2 * F.col("n")
    near = written(best.select("word", "n_near", F.when(fits, F.col("top.near")).alias("form"),
                               F.when(fits, -F.col("top.col1")).alias("form_n")), "variant-near")
    root = roots(near.where("form IS NOT NULL"))
    return (vocab.join(near, "word", "left").join(root, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                    F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))
