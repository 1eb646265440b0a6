"""N-gram Jaccard join by PartEnum signatures, and its components.

A document's set holds the hashes of its distinct word n-grams (a shorter
text: its whole word sequence as one).  Two documents link when
``100 * |intersection| >= percent * |union|``.

Documents with equal sets form a class; the work is on classes.

1. *Signatures.*  Sizes are cut into bands such that linked sets lie in the
   same or in neighbouring bands.  A set signs for its own band and the next
   one, so any linked pair has a band label in common.  Sets of one label that
   link differ in at most k features.  The feature domain is dealt into n1
   partitions and each of these into n2 parts.  With n1 * (k2 + 1) > k, two
   linked sets differ in at most k2 features of some partition, so they agree
   on n2 - k2 of its parts: every subset of n2 - k2 parts of every partition
   is a signature (the hash of the features in it).  There are ``spare`` more
   partitions than that takes, hence spare + 1 agreements; a set with at most
   ``spare`` empty signatures leaves these out, a set with more signs them
   too.  No linked pair is lost.  n1, n2 and k2 are chosen per label for the
   most features a signature within a number of signatures (``scheme``).  Sets
   of one band meet under both labels; their own band's is enough.
2. *Stars.*  In each group of equal signatures every class is paired with the
   group's first class only (its hub).  Each class is verified with its
   smallest hub, then with those other hubs that are still in another
   component.  Large groups of near copies become one component here, at
   about one pair a class.
3. *Other hubs.*  Each group that still spans several components draws
   another hub; each class is verified with the nearest one, by sketch, of its
   groups' hubs in other components.  This is done ``turns`` times.
4. *Rest.*  Groups that even then span several components are joined with
   themselves, only across components, with an exact lower bound of the
   difference (the Hamming distance of 1024-bit parity sketches) in the join
   condition.  Groups that are large
   for their sets' sizes, as a passage in many texts makes them, are not: of
   two linked sets, each has a feature of the other among its rarest
   ``n - ceil(percent n / 100) + 1`` (``_rarest``; any order of the features
   that all sets share will do), so the classes of large groups meet on one of
   these instead.  The pairs that pass are verified and joined to the
   components.

Verification compares the sets themselves.  Nothing is capped: all pairs of a
group are covered by 2 to 4.

Defined cases: texts without words, and NULL, have an empty set and link with
nothing (component: own doc_id); a NULL doc_id has a NULL component and links
with nothing; repeated rows come back repeated; empty table: no rows; other
columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import byteops as B
from .common import fresh, map_arrow, written

U64 = np.uint64
SKETCH = 1024
WORDS = tuple(f"s{i}" for i in range(SKETCH // 64))      # the columns of a sketch
FOLDS = ("f0", "f1")                                     # and of a sketch whose words are added up to two
CROWD = 96                # members of a group a rare feature of its sets, above which it isn't joined with itself


@dataclass(frozen=True)
class JaccardParams:
    words: int = 5
    percent: int = 80
    broadcast_ids: int = 500_000     # ids of 8 bytes sent to all tasks at most
    turns: int = 2                   # draws of other hubs before all pairs that are left


@dataclass(frozen=True)
class Label:
    first: int          # partitions
    second: int         # parts of a partition
    differ: int         # parts that a subset leaves out
    spare: int

    @property
    def subsets(self) -> list[tuple[int, ...]]:
        return list(combinations(range(self.second), self.second - self.differ))


def _spared(k: int, least: int, differ: int, second: int) -> tuple[Label, float, int]:
    """The scheme of these parts, its features and signatures a set of
    ``least`` features: spare partitions for the empty ones expected."""
    subsets, spare = math.comb(second, differ), 0
    while True:
        first = k // (differ + 1) + 1 + spare
        features = least / first * (second - differ) / second
        mean = first * subsets * math.exp(-features)
        wanted = min(math.ceil(mean + 4 * math.sqrt(mean)), k + 2) if k else 0
        if wanted <= spare:
            return Label(first, second, differ, spare), features, first * subsets
        spare = wanted


def scheme(k: int, least: int) -> Label:
    """Partitions and parts for sets of at least ``least`` features that differ
    in at most ``k``: the most features a signature within 96 signatures or
    7/4 of those that undivided partitions would take."""
    plain = _spared(k, least, 0, 1)
    most = max(96, 7 * plain[2] // 4)
    divided = [_spared(k, least, differ, second)
               for differ in range(1, min(k, 4) + 1) for second in range(differ + 1, differ + 6)]
    return max([plain, *(x for x in divided if x[2] <= most)], key=lambda x: x[1])[0]


@lru_cache(maxsize=4)
def labels(percent: int, largest: int) -> tuple[np.ndarray, list[Label]]:
    """Lower bounds of the size bands up to ``largest`` and, per label t, the
    scheme for sets of bands t-1 and t."""
    low = [1]
    while low[-1] <= largest:
        low.append(low[-1] * 100 // percent + 1)
    low.append(low[-1] * 100 // percent + 1)
    low.append(low[-1] * 100 // percent + 1)
    return np.array(low), [scheme((100 - percent) * 2 * (low[t + 1] - 1) // (100 + percent), low[max(t - 1, 0)])
                           for t in range(len(low) - 1)]


def shingles(buf: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes by row, ascending; per-row bounds)."""
    buf = B.LOWER[buf]
    s, e, bounds = B.words(buf, off)
    spans = B.Spans(B.byte_spans(buf).hash(s, e))
    n = np.diff(bounds)
    row = np.repeat(np.arange(len(n)), n)
    at = np.flatnonzero(np.arange(len(s)) + words <= bounds[row + 1]) if len(s) else np.zeros(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < words))
    h = np.concatenate([spans.hash(at, at + words), spans.hash(bounds[short], bounds[short + 1])])
    row = np.concatenate([row[at], short])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(n) + 1))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def class_keys(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name a set."""
    return B.mix(_sums(B.mix(h), bounds)), B.mix(_sums(B.mix(h ^ U64(0x5851F42D4C957F2D)), bounds))


def sketches(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Parity of the features in each of 1024 cells: rows of 16 longs.  Two
    sketches differ in at most as many bits as the sets in features."""
    rows = len(bounds) - 1
    row = np.repeat(np.arange(rows), np.diff(bounds))
    cell = (B.mix(h ^ U64(0x9FB21C651E98DF25)) & U64(SKETCH - 1)).astype(np.int64)
    odd = np.zeros(rows * SKETCH, np.uint8)
    np.add.at(odd, row * SKETCH + cell, np.uint8(1))         # wraps at 256, which keeps the parity
    return np.packbits(odd.reshape(rows, SKETCH) & 1, axis=1).view(np.int64).reshape(rows, len(WORDS))


def signatures(h: np.ndarray, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, signature, step) of each row's signatures, for its own band
    (step 0) and the next one (step 1)."""
    size = np.diff(bounds)
    rows, sigs, steps = [np.zeros(0, np.int64)], [np.zeros(0, U64)], [np.zeros(0, np.int8)]
    if size.any():
        # bands depend on the size alone; the table is cut at a power of two
        low, table = labels(percent, 1 << int(size.max()).bit_length())
        band = np.searchsorted(low, size, "right") - 1
        row = np.repeat(np.arange(len(size)), size)
        weight = B.mix(h + U64(0xA0761D6478BD642F))
        for step in (0, 1):
            for label in np.unique(band[size > 0]) + step:
                who = np.flatnonzero((size > 0) & (band + step == label))
                its = np.flatnonzero(band[row] + step == label)
                at, sig = _label_signatures(h[its], weight[its], np.searchsorted(who, row[its]), len(who),
                                            int(label), table[label])
                rows.append(who[at])
                sigs.append(sig)
                steps.append(np.full(len(at), step, np.int8))
    return np.concatenate(rows), np.concatenate(sigs), np.concatenate(steps)


def _label_signatures(h, weight, row, rows: int, label: int, s: Label) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) under one label; ``row`` is that of each feature."""
    salt = B.mix(np.array([label], U64) * U64(0x2545F4914F6CDD1D) + U64(11))[0]
    x = B.mix(h ^ salt)
    first = ((x >> U64(32)) * U64(s.first)) >> U64(32)
    second = ((x & U64(0xFFFFFFFF)) * U64(s.second)) >> U64(32)
    cell = (row * s.first + first.astype(np.int64)) * s.second + second.astype(np.int64)
    shape = (rows, s.first, s.second)
    total = np.zeros(rows * s.first * s.second, U64)
    np.add.at(total, cell, weight)
    total = total.reshape(shape)
    count = np.bincount(cell, minlength=total.size).reshape(shape)
    held = np.stack([total[:, :, x].sum(2, dtype=U64) for x in map(list, s.subsets)], 2)
    full = np.stack([count[:, :, x].sum(2) > 0 for x in map(list, s.subsets)], 2)
    empty = (~full).sum((1, 2))
    at, i, j = np.nonzero(full | (empty > s.spare)[:, None, None])
    name = B.mix(salt + (i * len(s.subsets) + j).astype(U64))
    return at, B.mix(held[at, i, j] ^ name)


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _describe(p: JaccardParams):
    """doc_id, size, class key and sketch of each document."""
    def run(batch):
        cols = []
        for _, buf, off in B.chunks(batch.column(1)):
            h, bounds = shingles(buf, off, p.words)
            c1, c2 = class_keys(h, bounds)
            cols.append([np.diff(bounds), c1, c2, *sketches(h, bounds).T])
        if not cols:
            return None
        n, *rest = (np.concatenate(x) for x in zip(*cols, strict=True))
        return [batch.column(0), batch.column(2), pa.array(n), *map(_i64, rest)]
    return run


def _sign(p: JaccardParams):
    """(signature, step, class) of each class that a batch holds."""
    def run(batch):
        out, seen = [], np.zeros(0, U64)
        for _, buf, off in B.chunks(batch.column(0)):
            h, bounds = shingles(buf, off, p.words)
            c1, _ = class_keys(h, bounds)
            _, first = np.unique(c1, return_index=True)
            new = np.zeros(len(c1), bool)
            new[first] = True
            new &= ~np.isin(c1, seen)
            seen = np.concatenate([seen, c1[new]])
            size = np.where(new, np.diff(bounds), 0)
            h = h[np.repeat(new, np.diff(bounds))]
            row, sig, step = signatures(h, np.append(0, np.cumsum(size)), p.percent)
            out.append((sig, step, c1[row]))
        if not out:
            return None
        sig, step, c1 = (np.concatenate(x) for x in zip(*out, strict=True))
        return [_i64(sig), pa.array(step), _i64(c1)]
    return run


def _sets(p: JaccardParams):
    def run(batch):
        cols = [[], [], []]
        for _, buf, off in B.chunks(batch.column(0)):
            h, bounds = shingles(buf, off, p.words)
            for x, y in zip(cols[:2], class_keys(h, bounds), strict=True):
                x.append(y)
            cols[2] += [h[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        if not cols[2]:
            return None
        return [_i64(np.concatenate(cols[0])), _i64(np.concatenate(cols[1])), pa.array(cols[2], pa.binary())]
    return run


def _features(p: JaccardParams):
    """(class, feature) of each set that a batch holds."""
    def run(batch):
        cols = [[], [], []]
        for _, buf, off in B.chunks(batch.column(0)):
            h, bounds = shingles(buf, off, p.words)
            for x, y in zip(cols[:2], class_keys(h, bounds), strict=True):
                x.append(np.repeat(y, np.diff(bounds)))
            cols[2].append(h)
        return [_i64(np.concatenate(x)) for x in cols] if cols[2] else None
    return run


def _linked(percent: int):
    """Of pairs with both sets, those that link."""
    def run(batch):
        sets = [batch.column(2).to_pylist(), batch.column(3).to_pylist()]
        good = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(*sets, strict=True)):
            a, b = np.frombuffer(x, U64), np.frombuffer(y, U64)
            both = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
            good[i] = 100 * both >= percent * (len(a) + len(b) - both)
        return [c.filter(pa.array(good)) for c in batch.columns[:2]]
    return run


def _apart_bits(a: str, b: str, words: tuple[str, ...] = WORDS):
    """Hamming distance of two classes' sketches."""
    return sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in words), F.lit(0))


def _folds():
    """A sketch as two words; these differ in no more bits than the sketches."""
    return [reduce(lambda x, y: x.bitwiseXOR(y), map(F.col, WORDS[i::len(FOLDS)])).alias(f) for i, f in enumerate(FOLDS)]


def _close(a: str, b: str, percent: int, words: tuple[str, ...] = WORDS):
    """May two described classes link, by size and sketch?"""
    col = lambda t, c: F.col(f"{t}.{c}")
    apart = _apart_bits(a, b, words)
    small, large = F.least(col(a, "n"), col(b, "n")), F.greatest(col(a, "n"), col(b, "n"))
    return ((100 * small >= percent * large)
            & ((100 + percent) * apart <= (100 - percent) * (small + large)))


def _texts(keys: DataFrame, docs: DataFrame, classes: DataFrame, p: JaccardParams) -> DataFrame:
    """The text of one document a class, the one of smallest id."""
    ids = written(classes.join(keys, "key", "left_semi").select(F.col("rep").alias("doc_id")).distinct(), "jaccard-ids")
    if ids.count() <= p.broadcast_ids:
        ids = F.broadcast(ids)
    return docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").select("text")


def _verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, p: JaccardParams) -> DataFrame:
    """The pairs (a, b) of class keys that link."""
    keys = written(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "jaccard-keys")
    texts = _texts(keys, docs, classes, p)
    sets = (map_arrow(texts, _sets(p), "c1 long, c2 long, members binary")
            .select(_key(F.col("c1"), F.col("c2")).alias("key"), "members")
            .join(keys, "key", "left_semi").groupBy("key").agg(F.first("members").alias("members")))
    both = (pairs.join(sets.select(F.col("key").alias("a"), F.col("members").alias("of_a")), "a")
            .join(sets.select(F.col("key").alias("b"), F.col("members").alias("of_b")), "b"))
    return map_arrow(both.select("a", "b", "of_a", "of_b"), _linked(p.percent), "a binary, b binary")


def _key(c1, c2):
    return F.unhex(F.concat(F.lpad(F.hex(c1), 16, "0"), F.lpad(F.hex(c2), 16, "0")))


def _settled(edges: DataFrame) -> bool:
    """Is every edge (a, b) a ray of a star, that is, has each ``a`` one edge
    and is it no ``b``?"""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("rays"), F.lit(0).alias("centre")).union(
        edges.select("b", F.lit(0), F.lit(1)))
    return (ends.groupBy("node").agg(F.sum("rays").alias("rays"), F.max("centre").alias("centre"))
            .where("rays > 0 AND rays + centre > 1").isEmpty())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the edges (a, b): the smallest node reachable,
    for every node but the smallest of each component.  Alternating large and
    small stars; each round is a written table."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                  "star")
    while not _settled(now):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
                 .union(least.select("a", F.col("m").alias("b"))).distinct())
        now = written(small, "star")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def extended(found: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` of the edges behind ``found`` and of ``links``: only the
    components that ``links`` joins are worked on."""
    return _after(found, _merged(found, links))


def _merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """(component, now) of the components that ``links`` joins with smaller ones."""
    return written(components(_between(links, found)).withColumnsRenamed({"component": "now", "node": "component"}), "star-merged")


def _after(found: DataFrame, merged: DataFrame) -> DataFrame:
    if merged.isEmpty():
        return found
    return written(_moved(found, merged).select("node", "component")
                   .union(merged.select("component", "now")), "star-found")


def _moved(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """``rows`` with the components that theirs went into."""
    return rows.join(merged, "component", "left").withColumn("component", F.coalesce("now", "component")).drop("now")


def _between(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The components (a, b) that ``pairs`` joins."""
    return _apart(pairs, found).select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).distinct()


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components, with these."""
    out = pairs
    for end in ("a", "b"):
        out = (out.join(found.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")), end, "left")
               .withColumn(f"of_{end}", F.coalesce(f"of_{end}", end)))
    return out.where("of_a <> of_b").select("a", "b", "of_a", "of_b")


def _with_components(classes: DataFrame, found: DataFrame) -> DataFrame:
    return (classes.join(found.withColumnRenamed("node", "key"), "key", "left")
            .withColumn("component", F.coalesce("component", "key")))


def _members(shared: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """The members of the signature groups, with folded sketches and components."""
    described = _with_components(classes.select("c1", "key", "n", *_folds()), found)
    return shared.select("sig", "step", "c1").distinct().join(described, "c1").drop("c1")


def _open_members(member: DataFrame) -> DataFrame:
    """Those of groups that span several components.  Components only grow, so
    of these alone can any be open later."""
    spans = (member.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
             .where("lo <> hi").select("sig"))
    return written(member.join(spans, "sig"), "jaccard-open")


def _meet(a: str, b: str):
    """In different components, and not two sets of one band under the next
    band's label (these meet under their own, too)."""
    return (F.col(f"{a}.component") != F.col(f"{b}.component")) & (F.col(f"{a}.step") + F.col(f"{b}.step") < 2)


def _described(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those that may link, with their sketches' distance ``d`` a feature."""
    x, y, sketch = classes.alias("x"), classes.alias("y"), ("key", "n", *WORDS)
    return (pairs.join(x.select(*(F.col(f"x.{c}") for c in sketch)).alias("x"), F.col("a") == F.col("x.key"))
            .join(y.select(*(F.col(f"y.{c}") for c in sketch)).alias("y"), F.col("b") == F.col("y.key"))
            .where(_close("x", "y", percent))
            .select("a", "b", (_apart_bits("x", "y") / (F.col("x.n") + F.col("y.n"))).alias("d")))


def _nearest_hubs(member: DataFrame, classes: DataFrame, turn: int, percent: int) -> DataFrame:
    """(a, b), a < b: each class with one hub of another component, the nearest
    by sketch of those that its groups draw in this turn."""
    drawn = F.xxhash64("key", "sig", F.lit(turn))
    described = ("step", "key", "component", "n", *FOLDS)
    hub = (member.groupBy("sig").agg(F.min_by(F.struct(*described), drawn).alias("h"))
           .select("sig", *(F.col(f"h.{c}").alias(c) for c in described)))
    x, y = member.alias("x"), hub.alias("y")
    pairs = (x.join(y, (F.col("x.sig") == F.col("y.sig")) & _meet("x", "y") & _close("x", "y", percent, FOLDS))
             .select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct())
    return (_described(pairs, classes, percent).groupBy(F.col("a").alias("of"))
            .agg(F.min(F.struct("d", F.col("b").alias("hub"))).alias("m"))
            .select(F.least("of", "m.hub").alias("a"), F.greatest("of", "m.hub").alias("b")).distinct())


def _rare(percent: int):
    """How many of a set's n features hold one of any set that links."""
    return F.expr(f"n - ({percent} * n + 99) div 100 + 1")


def _rarest(keys: DataFrame, docs: DataFrame, classes: DataFrame, p: JaccardParams) -> DataFrame:
    """(key, feature): the features of each class that the fewest of these
    classes have, as many as a linked set can't all lack."""
    texts = _texts(keys, docs, classes, p)
    has = written(map_arrow(texts, _features(p), "c1 long, c2 long, feature long")
                  .select(_key(F.col("c1"), F.col("c2")).alias("key"), "feature")
                  .join(keys, "key", "left_semi").distinct(), "jaccard-features")
    seen = has.groupBy("feature").agg(F.count(F.lit(1)).alias("seen"))
    of = Window.partitionBy("key")
    return (has.join(seen, "feature")
            .select("key", "feature", F.row_number().over(of.orderBy("seen", "feature")).alias("place"),
                    F.count(F.lit(1)).over(of).alias("n"))
            .where(F.col("place") <= _rare(p.percent)).select("key", "feature"))


def _rest(member: DataFrame, docs: DataFrame, classes: DataFrame, p: JaccardParams) -> DataFrame:
    """(a, b), a < b: all pairs of members that may link across components,
    by group, and those of large groups by a rare feature."""
    sketch = classes.select("key", *WORDS)

    def pairs(rows, on, apart):
        described = rows.drop(*FOLDS).join(sketch, "key")
        x, y = described.alias("x"), described.alias("y")
        return (x.join(y, (F.col(f"x.{on}") == F.col(f"y.{on}")) & (F.col("x.key") < F.col("y.key")) & apart
                       & _close("x", "y", p.percent))
                .select(F.col("x.key").alias("a"), F.col("y.key").alias("b")))

    large = written(member.groupBy("sig").agg(F.count(F.lit(1)).alias("members"), F.max(_rare(p.percent)).alias("rare"))
                    .where(F.col("members") > CROWD * F.col("rare")).select("sig"), "jaccard-large")
    if large.isEmpty():
        return pairs(member, "sig", _meet("x", "y")).distinct()
    crowd = written(member.join(large, "sig", "left_semi").select("key", "component", "n").distinct(), "jaccard-crowd")
    rare = written(_rarest(crowd.select("key"), docs, classes, p).join(crowd, "key"), "jaccard-rare")
    return (pairs(member.join(large, "sig", "left_anti"), "sig", _meet("x", "y"))
            .union(pairs(rare, "feature", F.col("x.component") != F.col("y.component"))).distinct())


def link_components(docs: DataFrame, p: JaccardParams = JaccardParams()) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    return _placed(docs, p).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, p: JaccardParams = JaccardParams()) -> DataFrame:
    """``docs`` with one row of each component, that of smallest doc_id (of
    repeated ids, one row).  Rows without words or without an id all stay.
    Columns unchanged."""
    mark = fresh(docs, "mark")
    named = docs.withColumn(mark, F.xxhash64("text"))
    wordy = F.coalesce(F.col("doc_id").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    first = (_placed(docs, p).where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("component_key")
             .agg(F.min(F.struct("doc_id", "mark")).alias("x")).select(F.col("x.doc_id").alias("doc_id"), F.col("x.mark").alias(mark)))
    one = named.where(wordy).join(written(first, "jaccard-kept"), ["doc_id", mark], "left_semi").dropDuplicates(["doc_id", mark])
    return named.where(~wordy).unionByName(one).select(*docs.columns)


def _placed(docs: DataFrame, p: JaccardParams) -> DataFrame:
    """(doc_id, mark, n_shingles, component_id, component_key), ``mark`` being
    a hash of the text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    each = written(map_arrow(text, _describe(p), f"doc_id {kind}, mark long, n long, c1 long, c2 long, "
                             + ", ".join(f"{s} long" for s in WORDS))
                   .withColumn("key", _key(F.col("c1"), F.col("c2"))), "jaccard-docs")
    classes = written(each.where("n > 0 AND doc_id IS NOT NULL").groupBy("key", "c1")
                      .agg(F.min("doc_id").alias("rep"), *(F.first(x).alias(x) for x in ("n", *WORDS))),
                      "jaccard-classes")

    group = Window.partitionBy("sig")
    signed = map_arrow(docs.where("doc_id IS NOT NULL").select("text"), _sign(p), "sig long, step byte, c1 long")
    shared = written(signed.select("sig", "step", "c1", F.min("c1").over(group).alias("hub"),
                                   F.max("c1").over(group).alias("top"), F.min("step").over(group).alias("own"))
                     .where("hub <> top AND own = 0").select("sig", "step", "c1", "hub"), "jaccard-shared")
    x, y = classes.alias("x"), classes.alias("y")
    star = shared.where("c1 <> hub").select("hub", "c1").distinct().alias("s")
    pairs = written(star.join(x, F.col("s.hub") == F.col("x.c1")).join(y, F.col("s.c1") == F.col("y.c1"))
                    .where(_close("x", "y", p.percent)).select(F.col("x.key").alias("a"), F.col("y.key").alias("b")),
                    "jaccard-pairs")
    # each class with its smallest hub first; what that leaves in different components, with its other hubs
    one = written(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "jaccard-first")
    found = components(written(_verify(one, docs, classes, p), "jaccard-links"))
    other = written(_apart(pairs, found).select("a", "b").join(one, ["a", "b"], "left_anti"), "jaccard-other")
    if not other.isEmpty():
        found = extended(found, written(_verify(other, docs, classes, p), "jaccard-links"))

    # groups that still span several components: other hubs, then all that is left
    tried = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    member = _open_members(_members(shared, classes, found))
    for turn in range(p.turns):
        near = written(_nearest_hubs(member, classes, turn, p.percent).join(tried, ["a", "b"], "left_anti"), "jaccard-near")
        if near.isEmpty():
            break
        merged = _merged(found, written(_verify(near, docs, classes, p), "jaccard-links"))
        found, member = _after(found, merged), _open_members(_moved(member, merged))
        tried = tried.union(near)
    more = _rest(member, docs, classes, p)
    more = written(more.join(tried, ["a", "b"], "left_anti"), "jaccard-more")
    if not more.isEmpty():
        found = extended(found, written(_verify(more, docs, classes, p), "jaccard-links"))
    placed = _with_components(classes, found)

    smallest = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_key = placed.join(smallest, "component").select("key", "component_id", F.col("component").alias("component_key"))
    return (each.join(of_key, "key", "left")
            .select("doc_id", "mark", F.col("n").alias("n_shingles"), "component_key",
                    F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
                    .otherwise(F.col("doc_id")).alias("component_id")))
