import itertools
import zlib
from collections import defaultdict

import numpy as np
import pytest

from overmark.llm import packing as K
from overmark.llm import queries as Q


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def checked(rows, length=2048):
    """Sequences used, after checking that places are gapless and fit."""
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for places in seqs.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= length
    return len(seqs)


def test_query_rebuilds_every_document(spark, tokenizer):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = Q.QUERIES["op13_best_fit_packing"](spark, "/root/testdata/sf0.01").collect()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    assert set(by_doc) == set(docs)
    total = 0
    for i, text in docs.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        mine = sorted(by_doc[i], key=lambda r: r.piece)
        want = K.cut(len(ids), 2048)
        assert [(r.piece, r.length) for r in mine] == list(enumerate(want))
        assert [r.start for r in mine] == [0, *itertools.accumulate(want)][:-1]
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())
    assert checked(rows) <= -(-total // 2048) + 1


def test_ids_are_those_of_the_tokenizers_file(tokenizer):
    e = K.encoder(*K.vocabulary())
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{x}b {x} {x}1{x}{x} \n{x}\n" for x in points[k:k + 200]) for k in range(0, len(points), 200)]
    rng = np.random.default_rng(1)
    parts = [*" \t\n\r 　éÀ×÷ÿaZ09'._-日́\x00\x85", " ", "word", "'ll", " <|endoftext|>", "\U0001F600", "x" * 40]
    texts += ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(4000)]
    texts += ["x" * 20_000, " " * 20_000, "1" * 20_000]
    for text, b in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert e.encode_to_numpy(text, allowed_special="all").tolist() == b.ids


def test_functions_are_dual_feasible_and_best_fit_is_best_fit():
    rng = np.random.default_rng(2)
    for length in (20, 97, 2048):
        num, den = K.family(length, 16)
        for _ in range(600):
            left, sizes = length, []
            while left and rng.random() < .9:
                sizes.append(int(rng.integers(1, left + 1)))
                left -= sizes[-1]
            if sizes:
                assert (num[:, sizes].sum(1) <= den).all()
    for _ in range(200):
        sizes = sorted(rng.integers(1, 21, rng.integers(1, 40)).tolist(), reverse=True)
        got, room = K.best_fit(sizes, 20), []
        for s, q in zip(sizes, got, strict=True):
            fits = [r for r in room if r >= s]
            assert (room[q] if q < len(room) else 20) == (min(fits) if fits else 20)
            if q == len(room):
                room.append(20)
            room[q] -= s
        num, den = K.family(20, 8)
        assert K.bound(num[:, sizes].sum(1), den) <= len(room)


def test_certificate_and_exchange(spark):
    p = K.PackParams(length=100, part_pieces=50)
    near_half = [(i, 51) for i in range(300)]              # no two fit: the bound must say so
    placed, c = K.assign(spark.createDataFrame(near_half, "key long, size long"), p)
    assert c == {"sequences": 300, "bound": 300, "rounds": 0} and placed.count() == 300
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 60, 1000).tolist() + [100] * 5
    items = spark.createDataFrame(list(enumerate(sizes)), "key long, size long")
    placed, c = K.assign(items, p)
    rows = placed.join(items.withColumnRenamed("size", "length"), "key").collect()
    assert len(rows) == len(sizes) and checked(rows, 100) == c["sequences"]
    _, apart = K.assign(items, K.PackParams(length=100, part_pieces=50, tries=0))
    assert apart["rounds"] == 0 and c["rounds"] > 0
    assert c["bound"] == apart["bound"] <= c["sequences"] < apart["sequences"]


def test_edges(spark, tokenizer):
    texts = [(1, None), (2, ""), (2, "twice"), (2, "twice"), (None, "no key"), (3, "long " * 30_000), (4, "x" * 9000)]
    df = spark.createDataFrame([(*t, 7, "s") for t in texts], "doc_id long, text string, key int, ids string")
    rows = K.pack(df).collect()
    checked(rows)
    assert sorted((r.doc_id or 0, r.length) for r in rows if r.piece == 0 and r.length < 9) == [(0, 3), (1, 1), (2, 1), (2, 3), (2, 3)]
    long = sorted((r for r in rows if r.doc_id == 3), key=lambda r: r.piece)
    want = tokenizer.encode("long " * 30_000, add_special_tokens=False).ids + [0]
    assert [x for r in long for x in r.ids] == want and [r.length for r in long] == K.cut(len(want), 2048)
    assert K.pack(df.limit(0)).count() == 0
