import random
import re
from collections import defaultdict

import numpy as np
import pytest

from overmark.llm import jaccard as J
from overmark.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def shingle_set(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1)))


def brute(rows, n, percent):
    """component of each row index, by all pairs that share a shingle."""
    sets = [shingle_set(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    for i, s in enumerate(sets):
        if rows[i][0] is None:
            continue
        count = defaultdict(int)
        for x in s:
            for j in where[x]:
                if j < i and rows[j][0] is not None:
                    count[j] += 1
        for j, c in count.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        low[r] = min(low.get(r, d), d) if d is not None else low.get(r)
    return sorted(((d, len(sets[i]), low[find(i)] if d is not None else None) for i, (d, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_query_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got(QUERIES["op8_jaccard_join"](spark, SF)) == brute(rows, 4, 85)


@pytest.mark.parametrize(("words", "percent"), [(1, 80), (2, 85), (1, 50)])
def test_dense_neighbourhoods_and_edges(spark, words, percent):
    rng = random.Random(words * 100 + percent)
    rows = [(None, "a b c d e"), (900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "a b c d e"),
            (905, "a b c d e"), (905, "q r s t u"), (906, "q r s t u"), (907, "x " * 4000)]
    for i in range(220):
        base = [f"w{j}" for j in range(rng.choice([3, 6, 7, 12, 30, 80]))]
        for _ in range(rng.randrange(0, max(2, len(base) // 4))):
            base[rng.randrange(len(base))] = f"z{rng.randrange(3000 if i % 2 else 5)}"
        rows.append((i, " ".join(base)))
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, key string, n int")
    p = J.JaccardParams(words=words, percent=percent)
    assert got(J.link_components(df, p)) == brute(rows, words, percent)
    assert J.link_components(df.limit(0), p).count() == 0


def test_linked_pairs_share_a_signature():
    """The pigeonhole bound, on random pairs near the threshold."""
    rng = np.random.default_rng(3)
    for percent in (80, 85):
        for _ in range(400):
            n = int(rng.integers(1, 900))
            a = rng.integers(1, 1 << 62, n, dtype=np.uint64)
            cut = int(rng.integers(0, max(1, n * (100 - percent) // 100) + 1))
            b = np.concatenate([a[cut:], rng.integers(1, 1 << 62, int(rng.integers(0, 2)), dtype=np.uint64)])
            a, b = np.unique(a), np.unique(b)
            both = len(np.intersect1d(a, b))
            if not len(b) or 100 * both < percent * (len(a) + len(b) - both):
                continue
            sig = [set(J.signatures(x, np.array([0, len(x)]), percent)[1].tolist()) for x in (a, b)]
            assert sig[0] & sig[1]


def test_schemes_hold_the_bound():
    """Enough partitions for the difference, and divided ones where they pay."""
    for percent in (50, 80, 85):
        low, table = J.labels(percent, 4096)
        for t, s in enumerate(table):
            k = (100 - percent) * 2 * (low[t + 1] - 1) // (100 + percent)
            assert (s.first - s.spare) * (s.differ + 1) > k and s.second > s.differ
            assert len(s.subsets) == len({frozenset(x) for x in s.subsets})
        assert any(s.differ for s in table) or percent == 50


def test_keep_one(spark):
    rows = [(5, "a b c d e f g"), (3, "A b c d e f g"), (3, "a b c d e f g"), (3, "other words here now then"), (9, None),
            (9, None), (10, ""), (None, "a b c d e f g"), (7, "lone text of a few words")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, mark int")
    kept = J.keep_one(df)
    assert kept.columns == df.columns and {r.mark for r in kept.collect()} == {1}
    left = sorted(map(tuple, kept.select("doc_id", "text").collect()), key=str)
    assert len(left) == 7 and sum(r[0] == 3 for r in left) == 2 and not any(r[0] == 5 for r in left)
    assert sorted(r[0] for r in left if r[0] is not None) == [3, 3, 7, 9, 9, 10]


def test_components_in_two_steps(spark):
    """All edges at once and a part of them after the others, against union-find."""
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(40)] + [(7, 7)]
    low = {x: x for e in edges for x in e}
    for _ in low:
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    want = sorted((x, y) for x, y in low.items() if x != y)
    frame = lambda e: spark.createDataFrame(e, "a long, b long")
    assert got(J.components(frame(edges))) == sorted(want, key=str)
    assert got(J.extended(J.components(frame(edges[::2])), frame(edges[1::2]))) == sorted(want, key=str)
    first = J.components(frame(edges))
    assert got(J.extended(first, frame(edges[:5]))) == sorted(want, key=str)
    assert J.components(frame([])).count() == 0 and got(J.extended(J.components(frame([])), frame(edges))) == sorted(want, key=str)


def test_texts_with_one_passage_meet_on_rare_features(spark, monkeypatch):
    """All texts share a passage and its signatures, few link: not all pairs of such a group are compared."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    passage = [word(6) for _ in range(30)]
    rows = [(i, " ".join(passage + [word(7) for _ in range(8)])) for i in range(200)]
    rows += [(1000 + i, rows[i][1][:-7] + word(7)) for i in range(0, 200, 8)]
    tables, write = {}, J.written
    monkeypatch.setattr(J, "CROWD", 4)
    monkeypatch.setattr(J, "written", lambda df, name: tables.setdefault(name, write(df, name)) if name in ("jaccard-rare", "jaccard-crowd")
                        else write(df, name))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = got(J.link_components(df, J.JaccardParams(words=3, percent=80, turns=0)))
    assert found == brute(rows, 3, 80) and len({x[2] for x in found}) == 200
    met = sum(n * (n - 1) // 2 for (n,) in tables["jaccard-rare"].groupBy("feature").count().select("count").collect())
    assert tables["jaccard-crowd"].count() > 100 and met < 1000
    for key, n in tables["jaccard-rare"].groupBy("key", "n").count().select("n", "count").collect():
        assert n == key - -(-80 * key // 100) + 1
