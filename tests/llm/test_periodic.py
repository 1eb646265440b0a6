import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from overmark.llm import periodic as P
from overmark.llm import queries as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, least=12):
    """Every lag's stretches of equal words, those of a smaller period left out."""
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if n >= max(least, 2 * q) and all(any(w[x] != w[x + p] for x in range(i, i + n - p)) for p in range(1, q)):
                out.append((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def fibonacci(n):
    x, y = ["a"], ["a", "b"]
    while len(y) < n:
        x, y = y, y + x
    return y[:n]


def test_runs_match_brute_force():
    rng = random.Random(7)
    for _ in range(800):
        docs = []
        for _ in range(rng.randint(1, 5)):
            n, a, kind = rng.randint(0, 120), rng.choice([1, 2, 3, 6]), rng.random()
            w = [rng.randrange(a) for _ in range(n)]
            if kind < .3 and n:
                p = rng.randint(1, max(1, n // 3))
                w = [w[i % p] for i in range(n)]
            elif kind < .7:
                u = [rng.randrange(a) for _ in range(rng.randint(1, 9))] * rng.randint(1, 9)
                w = (u + w[:rng.randint(0, 3)]) * rng.randint(1, 4)
            docs.append(w)
        off = np.append(0, np.cumsum([len(d) for d in docs]))
        got = P.find(np.array([x for d in docs for x in d], np.int64), off).tolist()
        want = [[s + int(off[i]), n, q] for i, d in enumerate(docs) for s, n, q in brute(d)]
        assert got == sorted(want, key=lambda r: (r[0], r[2]))
    ids = {"a": 0, "b": 1}
    w = fibonacci(400)
    assert [tuple(r) for r in P.find(np.array([ids[x] for x in w], np.int64), np.array([0, 400])).tolist()] == brute(w)


@pytest.mark.parametrize("w,runs", [([0] * 300_000, 1), ([0, 1] * 150_000, 1), (([0] * 50 + [1]) * 4000, 4001)])
def test_one_word_many_times_stays_cheap(w, runs):
    assert len(P.find(np.array(w, np.int64), np.array([0, len(w)]))) == runs


def contract(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 8000")
    short = docs.collect()
    want = sorted(contract(r.doc_id, r.text) for r in short)
    path = P_table(spark, docs)
    got = sorted(tuple(r) for r in Q.QUERIES["op12_periodic_runs"](spark, path).collect())
    assert got == want and any(r[1] for r in want)


def P_table(spark, docs):
    from overmark.session import scratch_path
    path = scratch_path(spark, "test")
    docs.write.parquet(f"{path}/documents.parquet")
    return path


def test_edges(spark):
    long = " ".join(["x y z"] * 40_000)
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "a " * 12), (4, "a " * 12), (None, "b c\n" * 30),
            (5, long), (6, "a b " * 20), (7, "é ü " * 9 + "\U0001F600")]
    df = spark.createDataFrame([(*r, "n", 3, "c") for r in rows], "doc_id long, text string, runs string, n_words int, collapsed string")
    got = {(r.doc_id, r.n_words): r for r in P.find_runs(df).collect()}
    assert P.find_runs(df).count() == len(rows) and P.find_runs(df.limit(0)).count() == 0
    for i in (1, 2, 3):
        assert got[i, 0].runs == [] and got[i, 0].collapsed == ""
    assert [tuple(x) for x in got[4, 12].runs] == [(0, 12, 1)] and got[4, 12].collapsed == "a"
    assert [tuple(x) for x in got[None, 60].runs] == [(0, 60, 2)] and got[None, 60].collapsed == "b c"
    assert [tuple(x) for x in got[5, 120_000].runs] == [(0, 120_000, 3)]
    assert got[6, 20].collapsed == "a b" and got[7, 19].collapsed == "é ü \U0001F600"
    want = sorted(contract(i, t) for i, t in rows if i is not None and i != 5)
    got = Q.QUERIES["op12_periodic_runs"](spark, P_table(spark, df)).collect()
    assert sorted(tuple(r) for r in got if r.doc_id is not None and r.doc_id != 5) == want and len(got) == len(rows)
