"""SentencePiece encoding by forward filtering and backward sampling, and
lossless decoding.

A text's bytes span a lattice whose arcs are vocabulary pieces (``▁`` stands
for a space) and, for characters without a piece, byte pieces.  An arc weighs
``alpha * score - piece_cost``.  Forward filtering sums the weights of all
segmentations up to each position; sampling then draws the last piece from
its exact conditional probability and goes backward.  No piece holds a space
after another character or a line break, so the lattice falls apart before
spaces and around line breaks, and the forward pass runs once per distinct
part of a chunk, for all parts at once.

Every draw is a hash of (seed, row key, byte position), so a row's
segmentation depends on nothing but its key, its text and the seed.  There
is no dummy prefix and no normalisation, and a ``▁`` in the text is coded in
bytes, so joining the pieces' bytes gives back the text exactly.

The vocabulary file is read on the driver and sent as tables (its size is
that of the file); tasks need no files.

Defined cases: NULL text gives NULL ids and back; empty text gives no ids;
equal keys with equal texts get equal ids; memory in a task follows the
chunk, or the longest text; other columns are not read.
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
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass(frozen=True)
class PieceParams:
    alpha: float = 1e-3
    piece_cost: float = 2.0
    byte_cost: float = 40.0
    seed: int = 0


@dataclass(frozen=True)
class Vocabulary:
    """Pieces' bytes with offsets, their weights, the byte pieces' ids."""
    data: bytes
    off: np.ndarray
    weight: np.ndarray
    normal: np.ndarray
    byte_id: np.ndarray


def load(path: str = MODEL, p: PieceParams = PieceParams()) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    raw, weight, normal = [], [], []
    byte_id = np.full(256, -1, np.int64)
    for i in range(sp.get_piece_size()):
        text = sp.id_to_piece(i)
        if sp.is_byte(i):
            value = int(text[3:5], 16)
            byte_id[value] = i
            raw.append(bytes([value]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            raw.append(b"")
        else:
            raw.append(text.replace("▁", " ").encode())
        plain = bool(raw[-1]) and not sp.is_byte(i)
        if plain and (" " in text.replace("▁", " ").lstrip(" ") or "\n" in text):
            raise ValueError(f"piece {i} crosses a word boundary")
        normal.append(plain)
        weight.append(p.alpha * sp.get_score(i) - p.piece_cost if plain else -p.byte_cost)
    if (byte_id < 0).any():
        raise ValueError("the vocabulary lacks byte pieces")
    return Vocabulary(b"".join(raw), np.append(0, np.cumsum([len(x) for x in raw])), np.array(weight),
                      np.array(normal), byte_id)


class Sampler:
    def __init__(self, v: Vocabulary):
        self.v = v
        self.buf = np.frombuffer(v.data, np.uint8)
        size = np.diff(v.off)
        spans = B.byte_spans(self.buf)
        ids = np.flatnonzero(v.normal)
        keys, piece = [], []
        for n in range(1, int(size[ids].max()) + 1):     # all prefixes; a whole piece carries its id
            own = ids[size[ids] >= n]
            keys.append(spans.hash(v.off[own], v.off[own] + n))
            piece.append(np.where(size[own] == n, own, -1))
        keys, piece = np.concatenate(keys), np.concatenate(piece)
        order = np.lexsort((-piece, keys))               # the piece before bare prefixes
        keys, piece = keys[order], piece[order]
        first = np.append(True, keys[1:] != keys[:-1])
        self.prefix, self.piece = B.HashIndex(keys[first]), piece[first]

    def _lattice(self, buf: np.ndarray, off: np.ndarray):
        """Arcs (start, end, id) of parts that lie end to end in ``buf``."""
        n, spans = len(buf), B.byte_spans(buf)
        stop = np.repeat(off[1:], np.diff(off))
        lead = (buf & 0xC0) != 0x80
        at = np.flatnonzero(lead)
        width = np.diff(np.append(at, n))
        own = np.zeros(n, bool)                           # characters with a piece
        width_at = np.zeros(n, np.int64)
        width_at[at] = width
        starts, ends, ids = [], [], []
        size = 1
        while len(at):
            at = at[at + size <= stop[at]]
            got = self.prefix.find(spans.hash(at, at + size))
            at, got = at[got >= 0], got[got >= 0]
            hit = self.piece[got] >= 0
            s, i = at[hit], self.piece[got[hit]]
            starts.append(s)
            ends.append(s + size)
            ids.append(i)
            own[s[width_at[s] == size]] = True
            size += 1
        chars = np.flatnonzero(lead) if n else np.zeros(0, np.int64)
        covered = np.repeat(own[chars], width) if len(chars) else np.zeros(0, bool)
        head = n - len(covered)                           # stray bytes before the first character
        bare = np.flatnonzero(np.concatenate([np.zeros(head, bool), covered]) == 0)
        starts.append(bare)
        ends.append(bare + 1)
        ids.append(self.v.byte_id[buf[bare]])
        return (np.concatenate(x) for x in (starts, ends, ids))

    def encode(self, buf: np.ndarray, off: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, per-row bounds); ``key`` is a 64-bit row key."""
        n = len(buf)
        if n == 0:
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        cut = np.zeros(n, bool)
        cut[off[:-1][off[:-1] < n]] = True
        space, line = buf == 32, buf == 10
        cut[1:] |= (space[1:] & ~space[:-1]) | line[:-1] | line[1:]
        s = np.flatnonzero(cut)
        e = np.append(s[1:], n)
        _, first, part = np.unique(B.byte_spans(buf).hash(s, e), return_index=True, return_inverse=True)
        size = (e - s)[first]
        uoff = np.append(0, np.cumsum(size))
        ubuf = buf[np.repeat(s[first] - uoff[:-1], size) + np.arange(uoff[-1])]

        start, end, ids = self._lattice(ubuf, uoff)
        of = np.repeat(np.arange(len(size)), size)[start]
        a, z = start + of, end + of                       # nodes: one more than bytes in each part
        depth = end - uoff[of]
        order = np.lexsort((z, depth))
        a, z, ids, depth = a[order], z[order], ids[order], depth[order]
        gain = self.v.weight[ids]
        total = np.zeros(uoff[-1] + len(size))
        into = np.flatnonzero(np.append(True, z[1:] != z[:-1]))       # first arc of each node
        width = np.diff(np.append(into, len(z)))
        share = np.empty(len(z))
        # one step per depth, all parts together
        step = np.append(np.searchsorted(depth[into], np.arange(1, depth[-1] + 1)), len(into))
        for lo, hi in zip(step[:-1], step[1:], strict=True):
            x, y = into[lo], into[hi] if hi < len(into) else len(z)
            if x == y:
                continue
            value = total[a[x:y]] + gain[x:y]
            at = into[lo:hi] - x
            top = np.maximum.reduceat(value, at)
            rel = np.exp(value - np.repeat(top, width[lo:hi]))
            mass = np.add.reduceat(rel, at)
            total[z[into[lo:hi]]] = top + np.log(mass)
            share[x:y] = rel / np.repeat(mass, width[lo:hi])
        # cumulative shares within each node, the last one open
        run = np.cumsum(share)
        run -= np.repeat(run[into] - share[into], width)
        run[into + width - 1] = np.inf
        first_arc = np.zeros(len(total), np.int64)
        first_arc[z[into]] = into

        out = np.full(n, -1, np.int32)
        row = np.searchsorted(off, s, "right") - 1
        base = off[row]                                    # hashed positions count from the row's start
        node, pos = uoff[part + 1] + part, e.copy()
        bottom = uoff[part] + part
        left = np.arange(len(s))
        while len(left):
            h = B.mix(key[row[left]] ^ ((pos[left] - base[left] + 1).astype(U64) * U64(0x9E3779B97F4A7C15)))
            u = (h >> U64(11)).astype(np.float64) * 2.0 ** -53
            arc = first_arc[node[left]]
            late = np.flatnonzero(run[arc] <= u)
            while len(late):
                arc[late] += 1
                late = late[run[arc[late]] <= u[late]]
            pos[left] -= z[arc] - a[arc]
            out[pos[left]] = ids[arc]
            node[left] = a[arc]
            left = left[a[arc] != bottom[left]]
        begun = out >= 0
        count = np.append(0, np.cumsum(begun))
        return out[begun], count[off]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of rows of ids."""
        size = np.diff(self.v.off)[ids]
        at = np.append(0, np.cumsum(size))
        buf = self.buf[np.repeat(self.v.off[ids] - at[:-1], size) + np.arange(at[-1])]
        return buf, at[bounds]


_samplers: dict = {}


def _sampler(held) -> Sampler:
    v = held.value
    if id(v) not in _samplers:
        _samplers.clear()
        _samplers[id(v)] = Sampler(v)
    return _samplers[id(v)]


def row_key(df: DataFrame, key_col: str, p: PieceParams):
    return F.xxhash64(F.col(key_col).cast("string"), F.lit(p.seed))


def encode(docs: DataFrame, vocabulary: Vocabulary, p: PieceParams = PieceParams()) -> DataFrame:
    """(doc_id, ids, n_pieces, lossless) of every row; ``lossless`` is read
    back by decoding the ids."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch):
        if not batch.num_rows:
            return None
        sampler, text = _sampler(held), batch.column(2)
        key = B.mix(batch.column(1).to_numpy().view(U64))
        ids, size, same = [], [], []
        for rows, buf, off in B.chunks(text):
            got, bounds = sampler.encode(buf, off, key[rows])
            back, boff = sampler.decode(got, bounds)
            ids.append(got)
            size.append(np.diff(bounds))
            fits = np.diff(boff) == np.diff(off)
            if len(back) == len(buf) and fits.all():
                same.append(B.per_row(back != buf, off) == 0)
            else:
                same.append(np.array([bool(f) and (back[boff[i]:boff[i + 1]] == buf[off[i]:off[i + 1]]).all()
                                      for i, f in enumerate(fits)]))
        size = np.concatenate(size)
        off = np.append(0, np.cumsum(size))
        null = np.append(text.is_null().to_numpy(zero_copy_only=False), False)
        lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32), mask=null), pa.array(np.concatenate(ids), pa.int32()))
        return [batch.column(0), lists, pa.array(size), pa.array(np.concatenate(same))]

    return map_arrow(docs.select("doc_id", row_key(docs, "doc_id", p), "text"), run,
                     f"doc_id {kind}, ids array<int>, n_pieces long, lossless boolean")


def decode(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, text) of rows with ``ids``."""
    held = rows.sparkSession.sparkContext.broadcast(vocabulary)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batch):
        if not batch.num_rows:
            return None
        lists = batch.column(1)
        null = lists.is_null().to_numpy(zero_copy_only=False)
        size = np.where(null, 0, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
        buf, off = _sampler(held).decode(lists.flatten().to_numpy(), np.append(0, np.cumsum(size)))
        raw = buf.tobytes()
        text = [None if x else raw[a:b].decode() for x, a, b in zip(null, off[:-1], off[1:], strict=True)]
        return [batch.column(0), pa.array(text, pa.string())]

    return map_arrow(rows.select("doc_id", "ids"), run, f"doc_id {kind}, text string")
