import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from overmark.llm import langid as L
from overmark.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def fold(text):
    b = bytearray(text.encode())
    for i, x in enumerate(b):
        if 65 <= x <= 90 or (i and b[i - 1] == 0xC3 and 0x80 <= x <= 0x9E and x != 0x97):
            b[i] += 32
    return bytes(b)


class Tree:
    """Context tree walked byte by byte."""

    def __init__(self, texts, order):
        self.order, self.next = order, defaultdict(Counter)
        for t in texts:
            b = bytes(order) + fold(t)
            for i in range(order, len(b)):
                for k in range(order + 1):
                    self.next[b[i - k:i]][b[i]] += 1

    def bits(self, text):
        b, out = bytes(self.order) + fold(text), 0.0
        for i in range(self.order, len(b)):
            for k in range(self.order, -1, -1):
                seen = self.next.get(b[i - k:i])
                if not seen:
                    continue
                n = sum(seen.values()) + len(seen)
                if b[i] in seen:
                    out -= math.log2(seen[b[i]] / n)
                    break
                out -= math.log2(len(seen) / n)
            else:
                out += 8
        return out


def test_code_lengths_match_tree_walk(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    p = L.PpmParams(docs_per_language=10_000, max_order=3)
    model = L.train(docs, p)
    rows = docs.collect()
    trees = [Tree([r.text for r in rows if r.lang == x], 3) for x in model.languages]
    texts = ["", "a", "Ünïcode ß", "the thing 日本", "\x00\x01", rows[3].text[:700], rows[5].text[:300], "ÑANDÚ ÇA"]
    raw = [t.encode() for t in texts]
    off = np.cumsum([0, *map(len, raw)])
    got = L.Coder(model).bits(np.frombuffer(b"".join(raw), np.uint8), off)
    want = [[t.bits(x) for t in trees] for x in texts]
    assert np.allclose(got, want)


def test_held_out_accuracy(spark):
    got = QUERIES["op4_language_id"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    held = got.where("held_out").join(docs, "doc_id").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).head()[0]
    assert held > 0.98 and got.count() == docs.count()


def test_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    model = L.train(docs)
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "the thing of that"), (4, "the thing of that"), (None, "le queue aux"),
            (5, "und der schen " * 4000), (6, "的")]
    df = spark.createDataFrame([(*r, "xx", 1.0) for r in rows], "doc_id long, text string, lang_pred string, score double")
    got = L.predict(df, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and by[1].score == 0
    assert by[4].lang_pred == "en" and by[None].lang_pred == "fr" and by[5].lang_pred == "de"
    assert by[6].lang_pred in model.languages and all(0 <= r.score <= 1 for r in got)
    assert L.predict(df.limit(0), model).count() == 0
    none = L.train(docs.limit(0))
    assert {r.lang_pred for r in L.predict(df, none).collect()} == {"und"}
    clash = df.withColumn("has_letter", F.lit(7))
    kept = L.keep_known(clash, model)
    assert kept.columns == clash.columns and kept.count() == 5 and {r.has_letter for r in kept.collect()} == {7}


def test_foreign_and_junk_texts_are_refused(spark):
    import random

    import corpus_pipeline as C
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    planted = ["Litwo ojczyzno moja ty jesteś jak zdrowie ile cię trzeba cenić ten tylko się dowie kto cię stracił " * 4,
               "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему. " * 4,
               "道可道，非常道。名可名，非常名。无名天地之始；有名万物之母。" * 6,
               "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura ché la diritta via era smarrita " * 4,
               " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 12))) for _ in range(80)),
               "".join(rng.choice(letters + letters.upper() + "0123456789+/") for _ in range(600))]
    first = docs.limit(1).drop("doc_id", "text").withColumn("lang", F.lit(None).cast("string"))
    rows = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(planted)], "doc_id long, text string").crossJoin(first)
    rows = rows.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType)).select(docs.columns)
    model = L.fit(docs.select("doc_id", "text", "lang"))
    said = L.predict(rows, model).collect()
    assert len(said) == len(planted) and all(r.refused and r.lang_pred in model.languages for r in said)
    kept = {r.doc_id for r in C.language(spark, docs.unionByName(rows), SF).select("doc_id").collect()}
    assert not any(i < 0 for i in kept)
    clean = {r.doc_id for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)}
    assert clean <= kept
