"""License scans by patience alignment of texts with notice templates.

Texts and templates become tokens (runs of ASCII letters and digits and
non-ASCII bytes, A-Z lowered).  Template and text are aligned: equal ends are
matched, words unique to both become anchors, the longest increasing run of
anchors is kept, and the gaps between are aligned in turn; a gap without
anchors adds its longest common subsequence.  Coverage is the share of the
template's tokens that are matched.

Where to align.  A template with distinguishing phrases (``PHRASES``: name and
version, by which rival licenses differ) is aligned around every place that
holds its first phrase, which is the first anchor: what comes before and after
it, up to one template length more than the template has there and not beyond
the phrase's next place.  Every phrase must stand unbroken in the aligned
stretch.  A template without phrases is looked for in windows of three template
lengths, one template length apart; a window that holds too few of the
template's words, counted, is passed over (that bound is exact).  When a window
matches, the text before and after the match is searched again.

Which matches stay.  Of overlapping matches of a text the one with most matched
tokens stays, then the one of higher coverage, then the template named first;
all others, that is every disjoint notice, are returned.

Defined cases: NULL or empty texts give no rows; repeated documents give
repeated rows; only doc_id and text are read.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import byteops as B
from .common import map_arrow
from .decontam import tokens

# The notices as their licenses word them.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "BSD": "Released under the BSD License",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                    "provided that the following conditions are met",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "EPL-2.0": "Licensed under the Eclipse Public License, Version 2.0",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                "associated documentation files, to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
                "is hereby granted, provided that the above copyright notice and this permission notice appear in all "
                "copies",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
                "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
                "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
                "subject to the following conditions: The above copyright notice and this permission notice shall be "
                "included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", "
                "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
                "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
                "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
                "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
                "OTHER DEALINGS IN THE SOFTWARE",
}
# What tells a notice from its rivals; each phrase has to stand unbroken.
PHRASES = {
    "Apache-2.0": ["Apache License", "2.0"],
    "BSD": ["BSD License"],
    "CC-BY-4.0": ["CC BY 4.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0"],
    "EPL-2.0": ["Eclipse Public License", "2.0"],
    "GPL-2.0": ["GNU General Public License", "2"],
    "GPL-3.0": ["GNU General Public License", "3"],
    "LGPL-2.1": ["Lesser General Public License", "2.1"],
    "LGPL-3.0": ["Lesser General Public License", "3"],
    "AGPL-3.0": ["Affero General Public License", "3"],
    "MIT": ["MIT License"],
    "MPL-2.0": ["Mozilla Public License", "2.0"],
    "ISC-text": ["copy modify and or distribute this software"],
    "MIT-full": ["hereby granted free of charge"],
}
COVERAGE = 0.8


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs, sorted by the first, that increases in the second."""
    tops, last, before = [], [], []
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tops, y)
        before.append(last[k - 1] if k else -1)
        if k == len(tops):
            tops.append(y)
            last.append(i)
        else:
            tops[k], last[k] = y, i
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def _common(a: list, b: list) -> int:
    """Length of the longest common subsequence, one bit per token of ``a``."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        m = where.get(x)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def align(a: list, b: list) -> tuple[int, list[tuple[int, int]]]:
    """(matched tokens, matched positions that anchors and equal ends give)."""
    count, pairs, todo = 0, [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            pairs.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            pairs.append((j, m))
        if i >= j or k >= m:
            continue
        once: list[dict] = []
        for seq, lo, hi in ((a, i, j), (b, k, m)):
            at: dict = {}
            for x in range(lo, hi):
                at[seq[x]] = -1 if seq[x] in at else x
            once.append(at)
        anchors = _increasing([(x, once[1][w]) for w, x in once[0].items() if x >= 0 and once[1].get(w, -1) >= 0])
        if not anchors:
            count += _common(a[i:j], b[k:m])
            continue
        for x, y in [*anchors, (j, m)]:
            todo.append((i, x, k, y))
            i, k = x + 1, y + 1
        pairs += anchors
    return count + len(pairs), sorted(pairs)


def _tokens(texts: list[str]) -> list[list[int]]:
    got, bounds = tokens(*B.utf8(pa.array(texts, pa.string())))
    return [got[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _place(phrase: list, seq: list) -> int:
    """First place of ``phrase`` in ``seq``, -1 if there is none."""
    return next((i for i in range(len(seq) - len(phrase) + 1) if seq[i:i + len(phrase)] == phrase), -1)


def disjoint(found: list[tuple]) -> list[tuple]:
    """Of overlapping (template, matched, first, end, coverage) the best stays."""
    kept: list[tuple] = []
    for x in sorted(found, key=lambda x: (-x[1], -x[4], x[0], x[2])):
        if all(x[3] <= k[2] or k[3] <= x[2] for k in kept):
            kept.append(x)
    return sorted(kept, key=lambda x: x[2])


class Templates:
    def __init__(self, notices: dict[str, str], phrases: dict[str, list[str]]):
        self.names = list(notices)
        self.tok = _tokens(list(notices.values()))
        self.phrases = [_tokens(phrases.get(n, [])) for n in self.names]
        for name, own, ph in zip(self.names, self.tok, self.phrases, strict=True):
            if any(not p or _place(p, own) < 0 for p in ph):
                raise ValueError(f"phrases of {name} are not in its notice")
        words = np.unique(np.array([x for t in self.tok for x in t], np.uint64))
        self.index = B.HashIndex(words)
        self.count = np.stack([np.bincount(self.index.find(np.array(t, np.uint64)), minlength=len(words)) for t in self.tok])

    def scan(self, tok: np.ndarray, bounds: np.ndarray, coverage: float):
        """(row, template, matched, first token, end token), rows in order, of
        the disjoint matches that reach ``coverage``."""
        word = self.index.find(tok)
        hits = np.flatnonzero(word >= 0)
        row = np.searchsorted(bounds, hits, "right") - 1
        found: dict[int, list[tuple]] = {}
        for t, own in enumerate(self.tok):
            need = int(np.ceil(coverage * len(own) - 1e-9))
            look = self._around(t, tok, word, hits, row, bounds, need) if self.phrases[t] else \
                self._windows(t, tok, word, hits, row, bounds, need)
            for r, n, first, end in look:
                found.setdefault(r, []).append((t, n, first, end, n / len(own)))
        for r in sorted(found):
            for t, n, first, end, _ in disjoint(found[r]):
                yield r, t, n, first, end

    def _around(self, t, tok, word, hits, row, bounds, need):
        own, phrases = self.tok[t], self.phrases[t]
        seed = phrases[0]
        ids = self.index.find(np.array(seed, np.uint64))
        keep = word[hits] == ids[0]
        at, who = hits[keep], row[keep]
        for j in range(1, len(seed)):
            fits = at + j < bounds[who + 1]
            at, who = at[fits], who[fits]
            fits = word[at + j] == ids[j]
            at, who = at[fits], who[fits]
        i, m = _place(seed, own), len(seed)
        for x, (p, r) in enumerate(zip(at.tolist(), who.tolist(), strict=True)):
            lo, hi = int(bounds[r]), int(bounds[r + 1])
            if x and who[x - 1] == r:
                lo = max(lo, min(int(at[x - 1]) + m, p))
            if x + 1 < len(at) and who[x + 1] == r:
                hi = min(hi, max(int(at[x + 1]), p + m))
            lo, hi = max(lo, p - i - len(own)), min(hi, p + 2 * len(own) - i)
            before, after = tok[lo:p].tolist(), tok[p + m:hi].tolist()
            # from the phrase outwards: equal ends next to it are matched first
            n1, left = align(own[:i][::-1], before[::-1])
            n2, right = align(own[i + m:], after)
            if n1 + n2 + m < need:
                continue
            first = p - 1 - left[-1][1] if left else p
            end = p + m + right[-1][1] + 1 if right else p + m
            stretch = tok[first:end].tolist()
            if all(_place(q, stretch) >= 0 for q in phrases[1:]):
                yield r, n1 + n2 + m, first - int(bounds[r]), end - int(bounds[r])

    def _windows(self, t, tok, word, hits, row, bounds, need):
        own = self.tok[t]
        mine = self.count[t][word[hits]] > 0
        at, who = hits[mine], row[mine]
        for r in np.flatnonzero(np.bincount(who, minlength=len(bounds) - 1) >= need).tolist():
            todo = [(int(bounds[r]), int(bounds[r + 1]))]
            while todo:
                start, stop = todo.pop()
                place = at[np.searchsorted(at, start):np.searchsorted(at, stop)]
                best = None
                steps = np.unique(np.concatenate([(place - start) // len(own) - s for s in range(3)]))
                for s in steps[steps >= 0]:
                    lo = int(start + s * len(own))
                    hi = min(lo + 3 * len(own), stop)
                    inside = place[np.searchsorted(place, lo):np.searchsorted(place, hi)]
                    if len(inside) < need:
                        continue
                    have = np.bincount(word[inside], minlength=self.count.shape[1])
                    if np.minimum(have, self.count[t]).sum() < need:
                        continue
                    n, pairs = align(own, tok[lo:hi].tolist())
                    if n >= need and (best is None or n > best[0]):
                        first, last = (pairs[0][1], pairs[-1][1] + 1) if pairs else (0, hi - lo)
                        best = (n, lo + first, lo + last)
                if best:
                    yield r, best[0], best[1] - int(bounds[r]), best[2] - int(bounds[r])
                    todo += [(start, best[1]), (best[2], stop)]


def scan(docs: DataFrame, notices: dict[str, str] = NOTICES, coverage: float = COVERAGE,
         phrases: dict[str, list[str]] = PHRASES) -> DataFrame:
    """(doc_id, license, coverage, matched_tokens, first_token, end_token), a
    row for every notice of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch):
        t, rows = Templates(notices, phrases), []
        for at, buf, off in B.chunks(batch.column(1)):
            rows += [(r + at.start, *x) for r, *x in t.scan(*tokens(buf, off), coverage)]
        if not rows:
            return None
        row, which, n, first, end = map(list, zip(*rows, strict=True))
        return [batch.column(0).take(pa.array(row)), pa.array([t.names[i] for i in which]),
                pa.array([x / len(t.tok[i]) for x, i in zip(n, which, strict=True)]), pa.array(n), pa.array(first), pa.array(end)]

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, license string, coverage double, "
                     "matched_tokens long, first_token long, end_token long")
