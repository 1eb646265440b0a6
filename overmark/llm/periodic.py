"""Periodic runs of words by seeding and extending diagonals.

A run is a stretch of words with smallest period q (words q apart are equal),
at least ``max(min_length, 2 * q)`` long, that no neighbouring word extends.
On the diagonal of lag q (the pairs of words q apart) it is a stretch of at
least ``max(min_length - q, q)`` equal pairs.

1. Lags go in bands, the first below ``min_length``, then doubling.  A band's
   smallest stretch is its guaranteed overlap k, so every run of the band
   holds a k-gram that occurs again one lag later.  Words repeat in a k-gram
   only where shorter grams repeated, so each band looks at what the last
   one left.
2. k-grams are indexed by a hash, per document, and occurrence pairs whose
   distance lies in the band are seeds.  A pair whose left neighbours are
   equal too goes on the same diagonal from one word before and is covered by
   the extension begun there; groups are cut into segments of equal left
   neighbours and only pairs of different ones are listed.  A k-gram of
   smallest period p recurs without a change of neighbour only inside a
   repetition, so the pairs listed in a band stay in proportion to the words,
   however often one word repeats.
3. Seeds are extended on the words themselves (a hash that lies only costs
   time), smaller lags first.  A table holds, by place and lag, the furthest
   word covered; a seed whose lag is a multiple of one that already covers it
   is not extended: its stretch is that one's again, with a period that is
   not the smallest.

Memory and work follow a chunk of about 1 MB of text (or one longer text):
a band sorts what the last left, and there are about log2(words) bands.

Defined cases: NULL and empty texts, and texts of white space, have no words
and no runs; very long texts are read whole; rows are handled one by one, so
repeated rows and repeated or NULL ids give a row each; an empty table gives
none; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import byteops as B
from .common import map_arrow

MIN_LENGTH = 12
SCHEMA = ("doc_id {}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def _seeds(seq, spans, at, doc, lo: int, hi: int, k: int):
    """(places whose k-gram occurs again in the document, seed starts, lags
    in [lo, hi)).  ``at`` are candidate places, ascending."""
    key = spans.hash(at, at + k) ^ B.mix(doc[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    key, pos = key[order], at[order]
    same = key[1:] == key[:-1]
    again = np.append(False, same) | np.append(same, False)
    key, pos = key[again], pos[again]
    if not len(pos):
        return pos, pos, pos
    fresh = np.append(True, key[1:] != key[:-1])
    group = np.cumsum(fresh) - 1
    left = seq[pos - 1]
    cut = fresh.copy()
    cut[1:] |= left[1:] != left[:-1]
    seg = np.cumsum(cut) - 1
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(pos))
    wide = np.int64(len(seq) + hi + 1)
    place = group * wide + pos                            # ascending over all groups
    starts, lags = [], []
    t, s = np.arange(len(pos)), 1
    while len(t):
        nxt = seg[t] + s
        ok = nxt < len(first)
        t, nxt = t[ok], nxt[ok]
        f = first[nxt]
        ok = (group[f] == group[t]) & (pos[f] < pos[t] + hi)
        t, nxt, f = t[ok], nxt[ok], f[ok]
        differs = left[f] != left[t]
        u, f, e = t[differs], f[differs], last[nxt[differs]]
        a = np.maximum(f, np.searchsorted(place, place[u] + lo))
        b = np.minimum(e, np.searchsorted(place, place[u] + hi))
        n = np.maximum(b - a, 0)
        if n.sum():
            own = np.repeat(np.arange(len(u)), n)
            other = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + a[own]
            starts.append(pos[u][own])
            lags.append(pos[other] - pos[u][own])
        s += 1
    none = np.zeros(0, np.int64)
    return np.sort(pos), np.concatenate([none, *starts]), np.concatenate([none, *lags])


def _matched(seq, i: int, j: int) -> int:
    """Equal words from ``i`` and ``j`` on (the last word of ``seq`` is its own)."""
    done, step, n = 0, 64, len(seq) - j
    while done < n:
        m = min(step, n - done)
        differs = seq[i + done:i + done + m] != seq[j + done:j + done + m]
        x = int(differs.argmax())
        if differs[x]:
            return done + x
        done, step = done + m, step * 4
    return done


def find(ids: np.ndarray, off: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """Rows (start, length, period) of all runs in documents of word numbers
    ``ids[off[r]:off[r+1]]``, places counted in ``ids``, by start and period."""
    n, rows = len(ids), len(off) - 1
    seq = np.empty(n + rows + 1, np.int64)                # every document between words of its own
    doc = np.repeat(np.arange(rows), np.diff(off))
    own = np.ones(len(seq), bool)
    own[np.arange(n) + doc + 1] = False
    seq[~own] = ids
    seq[own] = -1 - np.arange(rows + 1)
    owner = np.zeros(len(seq), np.int64)
    owner[~own] = doc
    end = (off[1:] + np.arange(1, rows + 1))              # place after each document's last word
    spans = B.Spans(B.mix(seq.astype(np.uint64) * np.uint64(2) + np.uint64(0x5851F42D4C957F2D)))
    at = np.flatnonzero(~own)
    longest = int(np.diff(off).max(initial=0))
    lo, hi, k = 1, min_length, (min_length + 1) // 2
    covered: dict[int, list[tuple[int, int]]] = {}
    found = []
    while max(min_length, 2 * lo) <= longest:
        at = at[at + k <= end[owner[at]]]
        if not len(at):
            break
        at, starts, lags = _seeds(seq, spans, at, owner, lo, hi, k)
        for x in np.lexsort((starts, lags)):
            i, q = int(starts[x]), int(lags[x])
            here = covered.setdefault(i, [])
            if any(q % p == 0 and reach >= i + q + k for p, reach in here):
                continue
            stretch = _matched(seq, i, i + q)
            here.append((q, i + q + stretch))
            if stretch >= max(min_length - q, q):
                found.append((i - 1 - int(owner[i]), q + stretch, q))
        lo, hi, k = hi, 2 * hi, hi
    return np.array(sorted((s, q, length) for s, length, q in found), np.int64).reshape(-1, 3)[:, [0, 2, 1]]


def _keep(n: int, found: np.ndarray) -> np.ndarray:
    """False for words that some run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 0] + found[:, 1], -1)
    return np.cumsum(edge[:n]) == 0


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """doc_id, n_words, all runs by start and period, and the text without
    the words that repeat a period (joined by one space)."""
    run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def rows(batch):
        n_words, runs, collapsed = [], [], []
        for _, buf, off in B.chunks(batch.column(1)):
            raw = buf.tobytes()
            words = [raw[a:b].split() for a, b in zip(off[:-1], off[1:])]
            bounds = np.append(0, np.cumsum([len(w) for w in words]))
            number = defaultdict(count().__next__)
            ids = np.fromiter((number[w] for ws in words for w in ws), np.int64, int(bounds[-1]))
            got = find(ids, bounds, min_length)
            keep = _keep(len(ids), got)
            cut = np.searchsorted(got[:, 0], bounds)
            for r, ws in enumerate(words):
                mine, base = got[cut[r]:cut[r + 1]], int(bounds[r])
                n_words.append(len(ws))
                runs.append([{"start": int(s) - base, "length": int(m), "period": int(q)} for s, m, q in mine])
                if len(mine):
                    ws = [w for w, k in zip(ws, keep[base:base + len(ws)].tolist()) if k]
                collapsed.append(b" ".join(ws).decode())
        return [batch.column(0), pa.array(n_words, pa.int64()), pa.array(runs, run), pa.array(collapsed, pa.string())]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), rows, SCHEMA.format(kind))
