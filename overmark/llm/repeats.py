"""Removal of repeated byte strings by a distributed merge of suffix runs.

Texts are UTF-8 bytes.  A byte goes if a ``span``-byte string over it also
starts in a document with a smaller doc_id; strings are judged on the input.

Each window of ``span`` bytes has a minimizer: the place of its smallest
hashed ``gram``-byte string.  Equal windows have equal minimizers, so windows
need comparing only within one minimizer string; the windows of a text that
share a minimizer place form a block, one string of at most
2 * span - gram bytes.

1. Minimizer hashes of all texts are grouped; those in two documents stay.
2. Every task cuts the blocks of the staying minimizers from its texts, sorts
   them, and sends them front-coded (shared prefix length, rest) as sorted
   runs, dealt by minimizer.
3. A loser tree merges a part's runs.  It keeps, for every competitor, the
   prefix length it shares with the last output; unequal lengths decide
   without looking at bytes, equal ones compare from there on, so no known
   prefix is compared again.  Equal blocks come out together: all but the
   smallest document's go whole.
4. What is left of a minimizer with several different blocks (the borders of
   repeats) is compared window by window, on the bytes.

Exact copies are found first by digest and only the smallest document of each
text takes part.

Defined cases: NULL is empty; a NULL doc_id is neither smaller nor larger, so
nothing is removed there or because of it; repeated doc_ids never match each
other; texts under ``span`` bytes keep all; empty table: no rows; only doc_id
and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import byteops as B
from .common import map_arrow, written

U64 = np.uint64
SPAN, GRAM = 50, 24
PLACE = 30                     # bits for a byte position within a chunk


def blocks(buf: np.ndarray, off: np.ndarray, span: int = SPAN, gram: int = GRAM):
    """(row, first window, last window, minimizer place, minimizer hash)."""
    none = np.zeros(0, np.int64)
    n = len(buf)
    if n < span:
        return none, none, none, none, none.astype(U64)
    at = np.arange(n - gram + 1)
    hashes = B.byte_spans(buf).hash(at, at + gram)
    key = (hashes >> U64(PLACE)) << U64(PLACE) | at.astype(U64)
    least, size, width = key, 1, span - gram + 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[:len(least) - (width - size)], least[width - size:])
    start = np.arange(n - span + 1)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[:len(start)]
    fits = start + span <= off[row + 1]
    start, row = start[fits], row[fits]
    place = (least[start] & U64((1 << PLACE) - 1)).astype(np.int64)
    new = np.append(True, (place[1:] != place[:-1]) | (row[1:] != row[:-1]))[:len(place)]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1 if len(first) else first
    return row[first], start[first], start[last], place[first], hashes[place[first]]


def _minimizers(batch):
    """(minimizer hash, doc, mark), each text of a batch once."""
    doc, mark = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    out = []
    # of equal texts in a batch the smallest document speaks
    order = np.lexsort((doc, mark))
    lead = np.zeros(len(doc), bool)
    lead[order[np.append(True, mark[order][1:] != mark[order][:-1])[:len(order)]]] = True
    for rows, buf, off in B.chunks(batch.column(2)):
        row, _, _, _, h = blocks(buf, off)
        keep = lead[rows][row]
        row, h = row[keep], h[keep]
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        new = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))[:len(h)]
        out.append((h[new], doc[rows][row[new]], mark[rows][row[new]]))
    if not out:
        return None
    h, d, m = (np.concatenate(x) for x in zip(*out, strict=True))
    return [pa.array(h.view(np.int64)), pa.array(d), pa.array(m)]


def front_code(strings: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Shared prefix lengths with the string before, and the rests."""
    shared = np.zeros(len(strings), np.uint8)
    if len(strings) > 1:
        size = np.array([len(s) for s in strings])
        flat = np.zeros((len(strings), size.max()), np.uint8)
        flat[np.arange(size.max()) < size[:, None]] = np.frombuffer(b"".join(strings), np.uint8)
        differ = flat[1:] != flat[:-1]
        upto = np.where(differ.any(1), differ.argmax(1), size.max())
        shared[1:] = np.minimum(upto, np.minimum(size[1:], size[:-1]))
    return shared, [s[k:] for s, k in zip(strings, shared.tolist(), strict=True)]


RUN = "part long, shared binary, rest_size binary, rest binary, doc binary, mark binary, first binary, inner binary, gram binary"


def _runs(parts: int):
    """Sorted front-coded runs of a chunk's blocks, one row a part."""
    def run(batch):
        doc, mark, wanted = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
        ends = np.append(0, np.cumsum(wanted.value_lengths().to_numpy()))
        hashes = wanted.flatten().to_numpy().view(U64)
        cols: list[list] = [[] for _ in range(9)]
        for rows, buf, off in B.chunks(batch.column(2)):
            row, a, z, place, h = blocks(buf, off)
            mine = hashes[ends[rows.start]:ends[rows.stop]]
            of = np.repeat(np.arange(rows.stop - rows.start), np.diff(ends[rows.start:rows.stop + 1]))
            salt = B.mix(np.arange(rows.stop - rows.start).astype(U64) + U64(1))
            keep = np.isin(h ^ salt[row], mine ^ salt[of])
            row, a, z, place, h = row[keep], a[keep], z[keep], place[keep], h[keep]
            part = (h % U64(parts)).astype(np.int64)
            raw = buf.tobytes()
            text = [raw[x:y + SPAN] for x, y in zip(a.tolist(), z.tolist(), strict=True)]
            for p in np.unique(part):
                order = sorted(np.flatnonzero(part == p).tolist(), key=text.__getitem__)
                shared, rest = front_code([text[i] for i in order])
                o = np.array(order)
                for c, x in zip(cols, (
                        int(p), shared.tobytes(), np.array([len(r) for r in rest], np.uint8).tobytes(), b"".join(rest),
                        doc[rows][row[o]].tobytes(), mark[rows][row[o]].tobytes(),
                        (a[o] - off[row[o]]).tobytes(), (place[o] - a[o]).astype(np.uint8).tobytes(), h[o].tobytes()),
                        strict=True):
                    c.append(x)
        if not cols[0]:
            return None
        return [pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])]
    return run


def _strings(shared: bytes, size: bytes, rest: bytes):
    """(shared length, string) of a front-coded run."""
    at, last = 0, b""
    for k, n in zip(shared, size, strict=True):
        last = last[:k] + rest[at:at + n]
        at += n
        yield k, last


def merge(runs: list) -> tuple[list[int], list[int], list[bytes]]:
    """Runs (iterators of (shared length with the one before, string)) merged
    by a loser tree: the run of each output, its shared length with the output
    before, and the string."""
    k = 1
    while k < len(runs):
        k *= 2
    empty = iter(())
    runs = [*runs, *[empty] * (k - len(runs))]
    now: list = [next(r, (0, None))[1] for r in runs]
    known = [0] * k                     # shared with the last output (or with who won against it)
    loser = [0] * (2 * k)

    def play(x, y):
        """Winner and loser; the loser's known length becomes that with the winner."""
        a, b = now[x], now[y]
        if a is None:
            return y, x
        if b is None:
            return x, y
        i, j = known[x], known[y]
        if i != j:
            return (x, y) if i > j else (y, x)
        top = min(len(a), len(b))
        while i < top and a[i] == b[i]:
            i += 1
        if i == top:
            first = len(a) < len(b) or (len(a) == len(b) and x < y)
        else:
            first = a[i] < b[i]
        if first:
            known[y] = i
            return x, y
        known[x] = i
        return y, x

    winners = [0] * (2 * k)
    for i in range(k):
        winners[k + i] = i
    for node in range(k - 1, 0, -1):
        winners[node], loser[node] = play(winners[2 * node], winners[2 * node + 1])
    top = winners[1] if k > 1 else 0
    who, share, out = [], [], []
    while now[top] is not None:
        who.append(top)
        share.append(known[top])
        out.append(now[top])
        known[top], now[top] = next(runs[top], (0, None))
        node = (k + top) >> 1
        while node:
            rival = loser[node]
            if now[rival] is not None:
                top, loser[node] = play(top, rival)
            node >>= 1
    return who, share, out


def _resolve(batches):
    """Byte ranges to remove, per document, from the runs of whole parts."""
    held: dict[int, list] = {}
    for batch in batches:
        for row in batch.to_pylist():
            held.setdefault(row["part"], []).append(row)
    for rows in held.values():
        got = _part(rows)
        if got is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], ["doc_id", "mark", "lo", "hi"])


def _part(rows):
    who, share, strings = merge([_strings(r["shared"], r["rest_size"], r["rest"]) for r in rows])
    if not who:
        return None
    # outputs of one run come in its order
    who = np.array(who)
    size = [len(r["rest_size"]) for r in rows]
    begin = np.append(0, np.cumsum(size))
    order = np.argsort(who, kind="stable")
    index = np.empty(len(who), np.int64)
    index[order] = begin[who[order]] + np.arange(len(who)) - np.searchsorted(who[order], who[order])
    doc, mark, first = (np.frombuffer(b"".join(r[c] for r in rows), np.int64)[index] for c in ("doc", "mark", "first"))
    inner = np.frombuffer(b"".join(r["inner"] for r in rows), np.uint8)[index].astype(np.int64)
    gram = np.frombuffer(b"".join(r["gram"] for r in rows), U64)[index]
    length = np.array([len(s) for s in strings])
    share = np.array(share)
    new = np.append(True, (share[1:] < length[1:]) | (length[1:] != length[:-1]))
    group = np.cumsum(new) - 1
    smallest = np.full(group[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(smallest, group, doc)
    gone = doc > smallest[group]
    out = [(doc[gone], mark[gone], first[gone], first[gone] + length[gone])]
    # borders: minimizers with several different blocks, the smallest document of each
    head = np.flatnonzero(new)
    _, of, many = np.unique(gram[head], return_inverse=True, return_counts=True)
    border = head[many[of] > 1]
    if len(border):
        size = length[border]
        off = np.append(0, np.cumsum(size))
        buf = np.frombuffer(b"".join(strings[i] for i in border), np.uint8)
        count = size - SPAN + 1
        block = np.repeat(np.arange(len(border)), count)
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = off[block] + step
        h = B.byte_spans(buf).hash(at, at + SPAN)
        owner = smallest[group[border]][block]
        order = np.lexsort((owner, h))
        same = h[order][1:] == h[order][:-1]
        left, right = at[order][:-1][same], at[order][1:][same]
        for i in range(0, len(left), 1 << 16):       # equal hashes must be equal bytes
            x, y = left[i:i + (1 << 16), None] + np.arange(SPAN), right[i:i + (1 << 16), None] + np.arange(SPAN)
            if (buf[x] != buf[y]).any():
                raise RuntimeError("two different strings have one hash")
        lead = np.flatnonzero(np.append(True, ~same))
        least = np.empty(len(at), np.int64)
        least[order] = np.repeat(owner[order][lead], np.diff(np.append(lead, len(at))))
        # all documents that hold the block and have not lost it whole
        sure = least < owner
        edge = np.diff(np.concatenate([[0], (sure & True).astype(np.int8), [0]]))
        lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        # runs may cross blocks: cut them there
        starts = np.cumsum(count) - count
        cuts = np.unique(np.concatenate([lo, starts[sure[starts]]]))
        ends = np.minimum(hi[np.searchsorted(hi, cuts, "right")], (starts + count)[block[cuts]])
        i, a, z = block[cuts], step[cuts], step[ends - 1] + SPAN
        # equal blocks of the same smallest document (repeated in it) share its ranges
        member = np.flatnonzero(~gone)
        by = np.argsort(group[member], kind="stable")
        member = member[by]
        lo_m = np.searchsorted(group[member], group[border[i]])
        hi_m = np.searchsorted(group[member], group[border[i]], "right")
        n = hi_m - lo_m
        which = member[np.repeat(lo_m, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        out.append((doc[which], mark[which], first[which] + np.repeat(a, n), first[which] + np.repeat(z, n)))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _cut(batch):
    """Removed bytes, runs and the digest of what is kept."""
    doc, mark, text, ranges = batch.columns
    ends = np.append(0, np.cumsum(ranges.value_lengths().to_numpy()))
    lo, hi = (ranges.flatten().field(i).to_numpy() for i in (0, 1))
    buf, off = B.utf8(text)
    removed, spans, digest = [], [], []
    for r in range(len(text)):
        raw = buf[off[r]:off[r + 1]]
        step = np.zeros(len(raw) + 1, np.int64)
        np.add.at(step, lo[ends[r]:ends[r + 1]], 1)
        np.add.at(step, hi[ends[r]:ends[r + 1]], -1)
        gone = np.cumsum(step[:-1]) > 0
        removed.append(int(gone.sum()))
        spans.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
        digest.append(hashlib.sha256(raw[~gone].tobytes()).hexdigest())
    return [doc, mark, pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest)]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    each = written(named.select("doc_id", "mark", F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("md5"),
                                F.sha2("text", 256).alias("whole")), "repeats-docs")
    first = each.where("doc_id IS NOT NULL").groupBy("md5").agg(F.min("doc_id").alias("first"))
    each = each.join(first, "md5", "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    speakers = each.where(f"doc_id IS NOT NULL AND NOT copy AND n_bytes >= {SPAN}").select("doc_id", "mark").distinct()

    live = named.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= SPAN))
    group = Window.partitionBy("gram")
    shared = (map_arrow(live, _minimizers, "gram long, doc_id long, mark long")
              .select("*", F.min("doc_id").over(group).alias("lo"), F.max("doc_id").over(group).alias("hi"))
              .where("lo <> hi").join(speakers, ["doc_id", "mark"], "left_semi")
              .groupBy("doc_id", "mark").agg(F.collect_set("gram").alias("grams")))
    shared = written(shared, "repeats-minimizers")
    total = shared.agg(F.sum(F.size("grams"))).head()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // 200_000))

    texts = live.dropDuplicates(["doc_id", "mark"])
    cut = map_arrow(texts.join(shared, ["doc_id", "mark"]).select("doc_id", "mark", "text", "grams"), _runs(parts), RUN)
    ranges = (cut.repartition(parts, "part").mapInArrow(_resolve, "doc_id long, mark long, lo long, hi long")
              .groupBy("doc_id", "mark").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")))
    changed = written(map_arrow(texts.join(ranges, ["doc_id", "mark"]).select("doc_id", "mark", "text", "ranges"), _cut,
                                "doc_id long, mark long, removed long, spans long, kept string"), "repeats-changed")
    whole = F.col("copy") & (F.col("n_bytes") >= SPAN)
    return each.join(changed, ["doc_id", "mark"], "left").select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "whole")).alias("kept_sha256"))
