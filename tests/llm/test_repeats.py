import hashlib
import random

from overmark.llm import repeats as R
from overmark.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute(rows, span=50):
    least, out = {}, []
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        if i is not None:
            for k in range(len(b) - span + 1):
                w = b[k:k + span]
                least[w] = min(least.get(w, i), i)
    for i, b in texts:
        gone = bytearray(len(b))
        if i is not None:
            for k in range(len(b) - span + 1):
                if least[b[k:k + span]] < i:
                    gone[k:k + span] = b"\x01" * span
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_query_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    assert sum(r[2] > 0 for r in want) > 20
    assert sorted(map(tuple, QUERIES["op9_repeat_removal"](spark, SF).collect()), key=str) == want


def test_overlaps_borders_and_edges(spark):
    rng = random.Random(6)
    pool = ["".join(rng.choice("ab é\x00") for _ in range(rng.choice([49, 50, 51, 55, 80, 200]))) for _ in range(14)]
    rows = []
    for i in range(160):
        bits = [rng.choice(pool) if rng.random() < 0.6 else "".join(rng.choice("abcé ") for _ in range(rng.randrange(0, 40)))
                for _ in range(rng.randrange(1, 6))]
        rows.append((i, "".join(b[rng.randrange(0, 8):] if rng.random() < 0.4 else b for b in bits)))
    rows += [(200, None), (201, ""), (202, rows[3][1]), (202, rows[3][1]), (203, "z" * 400), (204, "z" * 120), (3, "z" * 70),
             (None, rows[3][1]), (205, pool[1] * 3), (205, pool[2] * 2), (206, "é" * 3000)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, mark string")
    assert sorted(map(tuple, R.remove_repeats(df).collect()), key=str) == brute(rows)
    assert R.remove_repeats(df.limit(0)).count() == 0


def test_merge_is_a_sort_with_shared_lengths():
    rng = random.Random(1)
    for k in (1, 2, 3, 7, 20):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 9))) for _ in range(rng.randrange(0, 30)))
                for _ in range(k)]
        coded = [R.front_code(r) for r in runs]
        who, share, out = R.merge([R._strings(s.tobytes(), bytes(map(len, x)), b"".join(x)) for s, x in coded])
        assert out == sorted(sum(runs, []))
        for a, b, n in zip(out, out[1:], share[1:]):
            m = 0
            while m < min(len(a), len(b)) and a[m] == b[m]:
                m += 1
            assert m == n
        for i, r in enumerate(runs):
            assert [s for s, w in zip(out, who) if w == i] == r
