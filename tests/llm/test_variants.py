import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from overmark.llm import queries as Q
from overmark.llm import variants as V

DOCS = "/root/testdata/sf0.01/documents.parquet"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] or a[i:] == b[i + 1:] or a[i + 1:] == b[i:]


def brute(vocab):
    """Neighbours by common deletions of one letter, each pair then compared."""
    shared = defaultdict(set)
    for w in vocab:
        for x in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            shared[x].add(w)
    near = defaultdict(set)
    for group in shared.values():
        for a, b in itertools.permutations(group, 2):
            if one_edit(a, b):
                near[a].add(b)
    form = {}
    for w, others in near.items():
        top = min(others, key=lambda x: (-vocab[x], x))
        if vocab[top] >= 2 * vocab[w]:
            form[w] = top
    out = []
    for w, n in vocab.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), vocab.get(form.get(w))))
    return sorted(out, key=lambda r: r[0])


def rows(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])


def test_query_matches_brute_force(spark):
    n = Counter()
    for r in spark.read.parquet(DOCS).collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{r.doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    want = brute({w: c for w, c in n.items() if len(w) >= 5 and c >= 3})
    got = rows(Q.QUERIES["op11_spelling_variants"](spark, "/root/testdata/sf0.01"))
    assert got == want and sum(r[1] is not None for r in want) > 1000


def test_dense_words_and_chains(spark):
    rng = np.random.default_rng(5)
    vocab = {"".join(rng.choice(list("abé"), rng.integers(5, 9))): int(2 ** rng.integers(0, 12)) for _ in range(1500)}
    vocab |= {"aaaaaa": 5, "aaaaa": 5, "aaaaaaa": 40, "zzzzz": 1, "\U0001F600bcdef": 1, "\U0001F600bcdefg": 2}
    df = spark.createDataFrame([(w, n, "x") for w, n in vocab.items()], "word string, n int, form string")
    assert rows(V.group(df)) == brute(vocab)


def test_pivots_are_the_cheapest_disjoint_pair():
    rng = np.random.default_rng(0)
    for k, wanted in ((3, 2), (6, 3)):
        place = np.array([np.sort(rng.choice(14, k, replace=False)) for _ in range(400)])
        weight = rng.integers(0, 9, place.shape)
        got = V.pivots(place, weight, wanted)
        for r in range(len(place)):
            fits = [c for c in itertools.combinations(range(k), wanted)
                    if all(place[r, b] - place[r, a] >= 2 for a, b in itertools.pairwise(c))]
            if fits:
                chosen = tuple(np.flatnonzero(got[r]))
                assert chosen in fits
                assert weight[r, list(chosen)].sum() == min(weight[r, list(c)].sum() for c in fits)


def test_edges(spark):
    texts = [(1, None), (2, ""), (3, "Grüßen grüßen GRÜSSEN"), (3, "grüßen"), (None, "colour " * 4 + "color color color"),
             (4, "kitten " * 60_000), (5, "abcd " * 9)]
    df = spark.createDataFrame([(*t, 1, "w") for t in texts], "doc_id long, text string, n int, word string")
    words = V.count_words(df)
    assert {tuple(r) for r in words.collect()} == {("grüßen", 3), ("colour", 4), ("color", 3), ("kitten", 60_000)}
    got = {r[0]: r for r in rows(V.group(words))}
    assert got["color"][1:] == (None, "color", 3, 1, None) and got["kitten"][4] == 0
    assert V.count_words(df.limit(0)).count() == 0 and V.group(words.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, 3), ("words", None), ("abc", 5), ("abd", 50), ("", 1)], "word string, n long")
    assert rows(V.group(odd)) == [("", None, "", 1, 0, None), ("abc", None, "abc", 5, 0, None), ("abd", None, "abd", 50, 0, None)]
    assert Q.misspell(None, "word") == "word"
