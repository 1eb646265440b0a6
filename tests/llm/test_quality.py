import re
from collections import Counter

import numpy as np
import pytest

from overmark.llm import quality as Q

DOCS = "/root/testdata/sf0.01/documents.parquet"
LABELS = "/root/testdata/sf0.01/labels.parquet"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, window=8):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(tuple(words[i:i + window]) for i in range(len(words) - window + 1))
    covered = {j for i in range(len(words) - window + 1) if seen[tuple(words[i:i + window])] > 1
               for j in range(i, i + window)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(covered))


def test_counts_match_brute_force(spark):
    docs = spark.read.parquet(DOCS)
    got = Q.score(docs, Q.QualityModel(np.zeros(2048), 0.0, 0.0, 40.0, 10)).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert r.kept == (not r.base_failed)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t\x0b\x0c\r "), (4, "a b   c"), (5, "x y\nx y\n\n \n \n"),
            (6, "a " * 5000), (6, "a " * 5000), (None, "one two"), (7, "1 2 3 4 5 6 7 8 " * 2)]
    df = spark.createDataFrame([(*r, 5, "c") for r in rows], "doc_id long, text string, n_words int, kept string")
    m = Q.QualityModel(np.zeros(2048), 0.0, 0.0, 40.0, 10)
    got = [tuple(r)[:6] for r in Q.score(df, m).collect()]
    assert sorted(map(str, got)) == sorted(str((i, *brute(t))) for i, t in rows)
    assert Q.score(df.limit(0), m).count() == 0


def test_classifier_separates_and_is_calibrated(spark):
    docs, labels = spark.read.parquet(DOCS), spark.read.parquet(LABELS)
    fit = labels.where("doc_id % 2 = 0")
    model = Q.fit(docs, fit)
    rest = Q.score(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    right = np.mean([(r.probability >= 0.5) == (r.quality == 1) for r in rest])
    assert right > 0.95
    assert abs(np.mean([r.probability for r in rest]) - np.mean([r.quality for r in rest])) < 0.08


@pytest.mark.parametrize("label", [None, 0, 1])
def test_one_class_or_none_leaves_the_base_rules(spark, label):
    docs = spark.createDataFrame([(i, "w%d " % i * 30) for i in range(4)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, label, None) for i in range(4)], "doc_id long, quality int, toxic int")
    m = Q.fit(docs, labels)
    assert [r.probability for r in Q.score(docs, m).collect()] == [1.0] * 4 or label is not None
    Q.fit(docs, labels.limit(0))
