from collections import Counter

import numpy as np
import pytest

from overmark.llm import pieces as P

U64 = np.uint64


@pytest.fixture(scope="module")
def vocabulary():
    return P.load()


@pytest.fixture(scope="module")
def sampler(vocabulary):
    return P.Sampler(vocabulary)


def segmentations(v, raw):
    """Every segmentation of ``raw`` with its weight, by recursion."""
    table = {v.data[v.off[i]:v.off[i + 1]]: i for i in np.flatnonzero(v.normal)}
    text = raw.decode()
    char = {}
    at = 0
    for c in text:
        for k in range(len(c.encode())):
            char[at + k] = c.encode() in table
        at += len(c.encode())

    def walk(i):
        if i == len(raw):
            yield (), 0.0
            return
        arcs = [(j, table[raw[i:j]]) for j in range(i + 1, len(raw) + 1) if raw[i:j] in table]
        if not char[i]:
            arcs.append((i + 1, int(v.byte_id[raw[i]])))
        for j, k in arcs:
            for rest, w in walk(j):
                yield (k, *rest), w + v.weight[k]

    return dict(walk(0))


@pytest.mark.parametrize("word", [" thing", "  and", "über", "a▁b", "日x", " \n the"])
def test_samples_follow_the_exact_distribution(sampler, vocabulary, word):
    raw = word.encode()
    want = segmentations(vocabulary, raw)
    top = max(want.values())
    mass = sum(np.exp(w - top) for w in want.values())
    n = 20_000
    buf, off = np.frombuffer(raw * n, np.uint8), np.arange(n + 1) * len(raw)
    ids, bounds = sampler.encode(buf, off, P.B.mix(np.arange(n).astype(U64)))
    got = Counter(tuple(ids[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True))
    assert set(got) <= set(want)
    for seg, w in want.items():
        p = np.exp(w - top) / mass
        assert abs(got[seg] / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-4


def test_lossless_and_reproducible(spark, vocabulary):
    texts = [None, "", " ", "   ", "\n\n", "a", "▁▁ ▁", "<s></s><0x41>", "tab\tand\r\nline", "日本語 \U0001F600 é", "x" * 3000,
             "The thing of\nÉtrement  was", "word " * 5000, "\x00\x01"]
    rows = [(i, t, [1], True) for i, t in enumerate(texts)] + [(None, "null key the thing", [1], True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, lossless boolean")
    got = {r.doc_id: r for r in P.encode(df, vocabulary).collect()}
    assert len(got) == len(rows) and all(r.lossless for r in got.values())
    assert got[0].ids is None and got[1].ids == [] and got[13].n_pieces == 2
    again = {r.doc_id: r.ids for r in P.encode(df.union(df).repartition(5), vocabulary).collect()}
    assert again == {k: r.ids for k, r in got.items()}
    other = {r.doc_id: r.ids for r in P.encode(df, vocabulary, P.PieceParams(seed=1)).collect()}
    assert other[12] != got[12].ids
    back = {r.doc_id: r.text for r in P.decode(P.encode(df, vocabulary), vocabulary).collect()}
    assert back == {r[0]: r[1] for r in rows}
    assert P.encode(df.limit(0), vocabulary).count() == 0 == P.decode(df.limit(0), vocabulary).count()


def test_all_documents_decode(spark, vocabulary):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    coded = P.encode(docs, vocabulary)
    assert coded.where("lossless").count() == docs.count()
    assert P.decode(coded, vocabulary).exceptAll(docs.select("doc_id", "text")).count() == 0
