import itertools
import random
import re

from overmark.llm import decontam as D

SF = "/root/testdata/sf0.01"
TOKEN = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")


def toks(t):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in TOKEN.findall(t or "")]


def brute(doc, item, p=D.DecontamParams()):
    a, b = toks(doc), toks(item)
    if len(b) < p.min_tokens:
        return False
    w = min(p.window, len(b))
    need = p.window - p.mismatches if len(b) >= p.window else len(b) - p.short_mismatches
    for shift in range(-len(b), len(a) + 1):
        same = [0 <= shift + j < len(a) and a[shift + j] == b[j] for j in range(len(b))]
        if any(sum(same[j:j + w]) >= need for j in range(len(b) - w + 1)):
            return True
        # a window may hang over either end of the item
        if len(b) >= p.window and (sum(same[:w]) >= need or sum(same[-w:]) >= need):
            return True
    return False


def test_masks_leave_no_window_without_a_seed():
    for n, mm in ((13, 2), (8, 1), (12, 1)):
        for bad in itertools.combinations(range(n), mm):
            assert any(not any(m[i] == "1" and s + i in bad for i in range(len(m)))
                       for m in D.MASKS for s in range(n - len(m) + 1)), bad


def test_against_all_windows(spark):
    rng = random.Random(5)
    vocab = ["the", "of", "and", "x1", "ça", "über", "Ton", "red"]
    items = [" ".join(rng.choice(vocab) for _ in range(n)) for n in (3, 8, 9, 12, 13, 14, 20, 40, 60)] + [None, ""]
    docs = []
    for _ in range(150):
        t = [rng.choice(vocab) for _ in range(rng.randrange(0, 40))]
        s = toks(rng.choice(items))
        if s:
            i = rng.randrange(len(s))
            s = s[i // 2:]
            for _ in range(rng.randrange(0, 5)):
                s[rng.randrange(len(s))] = "zz"
        docs.append(", ".join(t[:7]) + "\n" + " ".join(s) + "! " + " ".join(t[7:]))
    docs += [None, "", items[5] * 3, items[6].upper(), "the of " * 3000]
    d = spark.createDataFrame([(i, t, 0) for i, t in enumerate(docs)], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(i, t, "q") for i, t in enumerate(items)], "item_id long, text string, doc_id string")
    want = {(i, j) for i, t in enumerate(docs) for j, q in enumerate(items) if brute(t, q)}
    rows = D.overlaps(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want) > 40
    small = D.overlaps(d, b, D.DecontamParams(block_bytes=200)).collect()
    assert sorted(map(tuple, small)) == sorted(map(tuple, rows))
    left = D.remove_overlapping(d, b)
    assert left.columns == d.columns
    assert {r.doc_id for r in left.collect()} == set(range(len(docs))) - {i for i, _ in want}
    assert D.overlaps(d.limit(0), b).count() == 0 == D.overlaps(d, b.limit(0)).count()
    assert D.remove_overlapping(d, b.limit(0)).count() == len(docs)
    twice = D.overlaps(d.union(d), b.union(b)).count()
    assert twice == 4 * len(want)
