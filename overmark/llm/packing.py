"""Best-fit packing of token sequences, with bounds that certify it.

Documents are tokenised, ended by a separator and, where longer than a
sequence, cut: whole sequences from the end, the rest as first piece.  Whole
sequences stand alone.  The other pieces are packed by size only:

1. Pieces are dealt to parts of about ``part_pieces`` and each part packs its
   own by best-fit decreasing: longest first, into the open sequence with the
   least room that is enough.
2. A family of dual feasible functions bounds the number of sequences from
   below: such a function maps sizes so that the sum over any set that fits is
   at most 1, so the sum over all pieces, rounded up, is needed by every
   packing.  Martello and Toth's thresholds, rounding to k-ths, and the
   staircase with steps of a size are used.  A part whose count equals its
   bound is certified: no packing of its pieces has fewer.
3. Sums add over parts, so they also bound the whole.  While there are more
   sequences than that bound, parts exchange: a part with a gap gives the
   pieces of all its sequences with room, a certified one those of its
   least filled sequence (what its rounding up left).  They are dealt anew,
   into parts of the same size, and packed again.  A round that saves nothing
   is dropped: what it took in stays as it was packed.  After the first such
   round certified parts give all their sequences with room, too; ``tries``
   of those in a row, each dealt in another way, end the exchange.

A part holds only (key, size) of its pieces; token ids are written once, read
back and joined by key.  What comes to the driver is one row of sums, the size
of the family, a round.

Defined cases: NULL and empty texts are the separator alone; very long texts
are cut like others; repeated rows and repeated or NULL ids are documents of
their own; equal sizes are taken in order of key; an empty table gives no
rows; other columns, whatever their names, are not read; the text of the
special token in a document becomes that token.
"""

from __future__ import annotations

import base64
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import byteops as B
from .common import map_arrow, written


@dataclass(frozen=True)
class PackParams:
    length: int = 2048          # tokens of a sequence
    separator: int = 0          # id after every document
    part_pieces: int = 4096     # pieces of a part
    thresholds: int = 64        # functions of each kind in the family
    tries: int = 3              # wide rounds in a row without a saving that end the exchange


def vocabulary() -> tuple[str, str]:
    """(ranks, pattern) of the byte-level vocabulary of byte_bpe_50k.json.
    The same vocabulary as ranks gives the same ids as that file (the tests
    compare the two over every code point) in a third of the time."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), encoding="ascii") as f:
        return f.read(), public_tokenizers.PATTERN


SPECIAL = {"<|endoftext|>": 50256}      # fixed value: the vocabulary's special token
_encoders: dict = {}


def encoder(ranks: str, pattern: str):
    """The encoder of a vocabulary, one kept in a worker."""
    key = zlib.crc32(ranks.encode()), pattern
    if key not in _encoders:
        import tiktoken

        _encoders.clear()
        _encoders[key] = tiktoken.Encoding("packing", pat_str=pattern, special_tokens=SPECIAL, mergeable_ranks={
            base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines())})
    return _encoders[key]


def cut(n: int, length: int) -> list[int]:
    """Piece lengths of ``n`` tokens: whole sequences, the rest first."""
    return ([n % length] if n % length else []) + [length] * (n // length)


def pieces(docs: DataFrame, p: PackParams = PackParams()) -> DataFrame:
    """key (of the piece), doc_id, piece, start, length, ids; a written table.
    The vocabulary is read on the driver and sent with the tasks."""
    data = docs.sparkSession.sparkContext.broadcast(vocabulary())   # the file's size, whatever the input

    def rows(batch):
        encode = encoder(*data.value)
        own, piece, start, length, ids = [], [], [], [], []
        at = 0
        for rows_, buf, off in B.chunks(batch.column(1)):
            raw = buf.tobytes()
            for a, b in zip(off[:-1], off[1:]):
                got = encode.encode_to_numpy(raw[a:b].decode(), allowed_special="all")
                got = np.append(got.astype(np.int32), np.int32(p.separator))
                begin = 0
                for k, n in enumerate(cut(len(got), p.length)):
                    own.append(at)
                    piece.append(k)
                    start.append(begin)
                    length.append(n)
                    ids.append(got[begin:begin + n])
                    begin += n
                at += 1
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        bounds = np.append(0, np.cumsum(length)).astype(np.int64)
        return [batch.column(0).take(pa.array(own, pa.int64())), pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(flat)).cast(pa.list_(pa.int32()))]

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = map_arrow(docs.select("doc_id", "text"), rows,
                    f"doc_id {kind}, piece int, start long, length long, ids array<int>")
    return written(got.select(F.monotonically_increasing_id().alias("key"), "*"), "packing-pieces")


def best_fit(sizes: list[int], length: int) -> list[int]:
    """Sequence of each of ``sizes`` (longest first), numbered from 0.  Open
    sequences are stacked by room; a bit per room that some sequence has finds
    the least that is enough."""
    open_by_room: list[list[int]] = [[] for _ in range(length + 1)]
    rooms, used, out = 0, 0, []
    for size in sizes:
        enough = rooms >> size
        if enough:
            room = size + (enough & -enough).bit_length() - 1
            seq = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms ^= 1 << room
        else:
            room, seq, used = length, used, used + 1
        left = room - size
        if left:
            open_by_room[left].append(seq)
            rooms |= 1 << left
        out.append(seq)
    return out


def family(length: int, thresholds: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(numerators per function and size 0..length, denominators): dual
    feasible functions in whole numbers."""
    x = np.arange(length + 1, dtype=np.int64)
    num, den = [x], [length]
    for t in np.unique(np.linspace(1, length // 2, thresholds).astype(np.int64)).tolist():
        num.append(np.where(x > length - t, length, np.where(x >= t, x, 0)))
        den.append(length)
        small, large = 2 * (x // t), 2 * (length // t - (length - x) // t)
        num.append(np.where(2 * x > length, large, np.where(2 * x == length, length // t, small)))
        den.append(2 * (length // t))
    for k in range(1, thresholds + 1):
        whole = (k + 1) * x % length == 0
        num.append(np.where(whole, k * x, (k + 1) * x // length * length))
        den.append(k * length)
    return np.stack(num), np.array(den, np.int64)


def bound(sums, den) -> int:
    """Sequences that any packing needs, from the functions' sums."""
    return max((-(-int(s) // int(d)) for s, d in zip(sums, den)), default=0)


def _deal(items: DataFrame, n: int, turn: int, p: PackParams) -> DataFrame:
    parts = max(1, -(-n // p.part_pieces))
    return items.withColumn("part", F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(parts)))


def _round(items: DataFrame, n: int, turn: int, p: PackParams) -> DataFrame:
    """One row a sequence: part, seq, its keys, their sizes and places, and
    whether its pieces are exchanged in a narrow and in a wide round; and one
    a part (seq -1) with the functions' sums."""
    num, den = family(p.length, p.thresholds)

    def pack(t):
        part, key, size = t["part"][0].as_py(), t["key"].to_numpy(), t["size"].to_numpy()
        order = np.lexsort((key, -size))
        key, size = key[order], size[order]
        seq = np.array(best_fit(size.tolist(), p.length), np.int64)
        used = int(seq.max()) + 1
        sums = num @ np.bincount(size, minlength=p.length + 1)
        fill = np.bincount(seq, weights=size, minlength=used).astype(np.int64)
        wide = fill < p.length
        narrow = wide if bound(sums, den) < used else wide & (np.arange(used) == fill.argmin())
        order = np.argsort(seq, kind="stable")
        bounds = pa.array(np.searchsorted(seq[order], np.arange(used + 1)), pa.int32())
        begin = np.cumsum(size[order]) - size[order]
        begin -= np.repeat(np.cumsum(fill) - fill, np.diff(bounds))
        lists = [pa.ListArray.from_arrays(bounds, pa.array(x, pa.int64())) for x in (key[order], size[order], begin)]
        none = pa.nulls(1, pa.list_(pa.int64()))
        return pa.Table.from_arrays(
            [pa.array(np.full(used + 1, part)), pa.array(np.append(np.arange(used), -1)),
             pa.array(np.append(narrow, False)), pa.array(np.append(wide, False)),
             *[pa.concat_arrays([x, none]) for x in lists],
             pa.array([None] * used + [sums.tolist()], pa.list_(pa.int64()))],
            names=["part", "seq", "narrow", "wide", "keys", "sizes", "begins", "sums"])

    dealt = _deal(items, n, turn, p)
    return written(dealt.groupBy("part").applyInArrow(
        pack, "part long, seq long, narrow boolean, wide boolean, keys array<long>, sizes array<long>, "
              "begins array<long>, sums array<long>").withColumn("turn", F.lit(turn)), "packing-round")


def _least(packed: DataFrame, den: np.ndarray) -> int:
    """The functions' bound on all parts together."""
    sums = packed.where("seq = -1").agg(F.array(*[
        F.coalesce(F.sum(F.get("sums", F.lit(i))), F.lit(0)) for i in range(len(den))])).first()[0]
    return bound(sums, den)


def _count(sequences: DataFrame) -> tuple[int, int]:
    """Sequences and their pieces."""
    return tuple(sequences.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("keys")), F.lit(0))).first())


def assign(items: DataFrame, p: PackParams = PackParams()) -> tuple[DataFrame, dict]:
    """(key, sequence_id, offset) for rows (key, size), and the certificate:
    sequences used, the bound on any packing, rounds of exchange."""
    whole = items.where(F.col("size") >= p.length).select(
        "key", (-F.col("key") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    n_whole = whole.count()
    rest = items.where(F.col("size") < p.length).select("key", "size")
    first = _round(rest, rest.count(), 0, p)
    least = _least(first, family(p.length, p.thresholds)[1])
    rows = first.where("seq >= 0").drop("sums")
    used, turn, mode, failed = rows.count(), 0, "narrow", 0
    while used > least and failed < p.tries:
        given, n = _count(rows.where(mode))
        if given < 2:
            if mode == "wide":
                break
            mode = "wide"
            continue
        turn += 1
        out = (rows.where(mode).select(F.explode(F.arrays_zip("keys", "sizes")).alias("x"))
               .select(F.col("x.keys").alias("key"), F.col("x.sizes").alias("size")))
        again = _round(out, n, turn, p).where("seq >= 0").drop("sums")
        now = again.count()
        if now < given:
            rows, used, failed = rows.where(~F.col(mode)).unionByName(again), used - given + now, 0
        elif mode == "wide":
            failed += 1
        else:
            mode = "wide"
    ids = F.shiftleft(F.col("turn").cast("long"), 56) + F.shiftleft("part", 24) + F.col("seq")
    placed = rows.select(
        ids.alias("sequence_id"), F.explode(F.arrays_zip("keys", "begins")).alias("x")).select(
        F.col("x.keys").alias("key"), "sequence_id", F.col("x.begins").alias("offset"))
    return placed.unionByName(whole), {"sequences": used + n_whole, "bound": least + n_whole, "rounds": turn}


def pack(docs: DataFrame, p: PackParams = PackParams()) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset of all pieces."""
    table = pieces(docs, p)
    placed, _ = assign(table.select("key", F.col("length").alias("size")), p)
    return table.join(placed, "key").drop("key")
