import random
from functools import lru_cache

from overmark.llm import licenses as L


def lcs(a, b):
    @lru_cache(None)
    def f(i, j):
        if i == len(a) or j == len(b):
            return 0
        return max(1 + f(i + 1, j + 1) if a[i] == b[j] else 0, f(i + 1, j), f(i, j + 1))
    return f(0, 0)


def patience(a, b):
    """The recursion as the method states it."""
    n = 0
    while a and b and a[0] == b[0]:
        a, b, n = a[1:], b[1:], n + 1
    while a and b and a[-1] == b[-1]:
        a, b, n = a[:-1], b[:-1], n + 1
    anchors = [(a.index(w), b.index(w)) for w in a if a.count(w) == 1 == b.count(w)]
    best = [[]]
    for x in anchors:                                   # longest increasing, by brute force
        best += [c + [x] for c in best if not c or c[-1][1] < x[1]]
    top = max(map(len, best))
    if not top:
        return {n + lcs(tuple(a), tuple(b))}
    out = set()
    for run in (c for c in best if len(c) == top):
        totals, i, j = {0}, 0, 0
        for x, y in [*run, (len(a), len(b))]:
            totals = {t + s for t in totals for s in patience(a[i:x], b[j:y])}
            i, j = x + 1, y + 1
        out |= {n + top + t for t in totals}
    return out


def test_alignment_against_recursion():
    rng = random.Random(2)
    for _ in range(1500):
        a = [rng.randrange(9) for _ in range(rng.randrange(0, 9))]
        b = [rng.randrange(9) for _ in range(rng.randrange(0, 10))]
        n, pairs = L.align(a, b)
        assert n in patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
        assert L._common(a, b) == lcs(tuple(a), tuple(b))


def test_scan_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {(r.doc_id, r.license) for r in L.scan(docs).collect()}
    want = set()
    for r in docs.collect():
        low = r.text.lower()
        want |= {(r.doc_id, k) for k, v in L.NOTICES.items() if v.lower() in low}
    assert want and got >= want
    assert len(got - want) <= 0.02 * len(got)


def test_edits_and_edges(spark):
    mit = L.NOTICES["MIT-text"]
    words = mit.split()
    edited = " ".join(words[:6] + ["quite", "freely"] + words[8:])
    rows = [(1, None), (2, ""), (3, mit), (4, edited.upper()), (5, "x " * 9000 + mit + " y" * 50 + "\n" + mit), (3, mit),
            (6, " ".join(words[:len(words) // 2])), (None, "Released under the MIT License"), (7, "the of and to is by for in")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, license string")
    got = sorted(((r.doc_id or 0, r.license, round(r.coverage, 2)) for r in L.scan(df).collect()))
    assert [g[:2] for g in got] == [(0, "MIT"), (3, "MIT-text"), (3, "MIT-text"), (4, "MIT-text"), (5, "MIT-text"), (5, "MIT-text")]
    assert got[1][2] == 1.0 and 0.8 <= got[3][2] < 1 and got[4][2] == 1.0
    assert L.scan(df.limit(0)).count() == 0


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = [[] for _ in texts]
    for r in sorted(L.scan(df).collect(), key=lambda r: (r.doc_id, r.first_token)):
        out[r.doc_id].append(r.license)
    return out


def test_rival_phrases(spark):
    probes = {
        "Released under the BSD License": ["BSD"],
        "Released under the Apache License": [],
        "the album was released under the label with a license": [],
        "Licensed under CC BY 4.0": ["CC-BY-4.0"],
        "Licensed under CC BY-SA 4.0": ["CC-BY-SA-4.0"],
        "Licensed under CC BY-NC-SA 4.0.": ["CC-BY-NC-SA-4.0"],
        "This work is licensed under the GNU General Public License, version 2": ["GPL-2.0"],
        "This work is licensed under the GNU Lesser General Public License, version 3": ["LGPL-3.0"],
        "This work is licensed under the GNU Affero General Public License, version 3": ["AGPL-3.0"],
        "Licensed under the Eclipse Public License, Version 2.0": ["EPL-2.0"],
        "Code licensed under the Apache license (Version 2.0), prose released under the terms of the MIT license":
            ["Apache-2.0", "MIT"],
    }
    assert dict(zip(probes, found(spark, list(probes)), strict=True)) == probes


def test_every_notice_of_its_own_and_all_disjoint_spans(spark):
    names = list(L.NOTICES)
    assert found(spark, list(L.NOTICES.values())) == [[n] for n in names]
    sep = " and then something else was said about it all, at some length, before going on "
    assert found(spark, [sep.join(L.NOTICES.values()), "\n".join(["Released under the MIT License"] * 7)]) == [names, ["MIT"] * 7]
    filler = "word " * 3000
    mit = L.NOTICES["MIT"]
    assert found(spark, [f"{mit} {filler} {mit}", f"{filler}{L.NOTICES['MIT-text']} {filler}{L.NOTICES['MIT-text']}"]) == [
        ["MIT"] * 2, ["MIT-text"] * 2]


def test_scan_against_all_stretches():
    """Templates with a phrase: every stretch around a phrase, by plain recursion."""
    rng = random.Random(5)
    words = ["under", "the", "mit", "license", "released", "x"]
    own, seed = ["released", "under", "the", "mit", "license"], ["mit", "license"]
    t = L.Templates({"MIT": "Released under the MIT License"}, {"MIT": ["MIT License"]})
    seen = 0
    for _ in range(400):
        text = [rng.choice(words) for _ in range(rng.randrange(2, 25))]
        at = [p for p in range(len(text) - 1) if text[p:p + 2] == seed]
        sure, may = set(), set()         # of longest runs of anchors, equally long ones may match differently
        for x, p in enumerate(at):
            lo = max(at[x - 1] + 2 if x else 0, p - 3 - 5)
            totals = patience(own[:3][::-1], text[lo:p][::-1])
            sure |= {p} if min(totals) + 2 >= 4 else set()
            may |= {p} if max(totals) + 2 >= 4 else set()
        tok, bounds = L.tokens(*L.B.utf8(L.pa.array([" ".join(text)])))
        got = {e - 2 for _, _, _, _, e in t.scan(tok, bounds, 0.8)}
        assert sure <= got <= may, (text, got, sure, may)
        seen += len(got)
    assert seen > 50
