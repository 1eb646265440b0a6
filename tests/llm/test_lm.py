import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from overmark.llm import lm as M
from overmark.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def check(rows, texts, learn):
    c = Counter()
    for i, t in texts:
        if learn(i):
            c.update([*words(t), ""])
    n, v = sum(c.values()), len(c)
    want = {}
    for i, t in texts:
        toks = [*words(t), ""]
        want.setdefault(i, (not learn(i), len(toks), sum(c[w] > 0 for w in toks), n,
                            sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks)))
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r)[1:5] == want[r.doc_id][:4]
        assert abs(r.base_score - want[r.doc_id][4]) < 1e-6 * (1 + abs(r.base_score))


def test_base_exact_and_model_better_on_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = QUERIES["op6_lm_score"](spark, SF).collect()
    check(rows, [tuple(r) for r in docs.collect()], lambda i: zlib.crc32(str(i).encode()) % 7 != 2)
    held = [r for r in rows if r.held_out]
    base, own = (sum(x) / sum(r.n_tokens for r in held) for x in ([r.base_score for r in held], [r.score for r in held]))
    assert own > base + 0.02


def test_small_head_goes_through_the_join(spark):
    texts = [(i, f"the a{i % 7} b{i % 3} the z{i} {'q' * 80}") for i in range(60)] + [(90, None), (91, ""), (92, "new words"), (92, "new words")]
    df = spark.createDataFrame([(*t, 0.0) for t in texts], "doc_id long, text string, score double")
    p = M.LmParams(classes=8, width=4, head=4)
    rows = M.score(df, F.col("doc_id") % 5 != 2, p).collect()
    check(rows, texts, lambda i: i % 5 != 2)
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert M.score(df.limit(0), F.lit(True), p).count() == 0
    lone = M.score(df.where("doc_id = 90"), F.lit(False), p).collect()
    assert lone[0].n_tokens == 1 and lone[0].train_tokens == 0


def test_model_is_normalised(spark):
    p = M.LmParams(classes=16, width=4)
    m = M.Lbl.start(np.full(16, 1 / 16), p)
    z = M.normalisers(spark, m, p)
    h = m.r[3] @ m.c[0] + m.r[5] @ m.c[1]
    assert abs(np.exp(h @ m.q.T + m.b - z[3, 5]).sum() - 1) < 1e-5


def test_frequent_words_have_probabilities_of_their_own(spark):
    texts = [(i, " ".join(f"w{(i * 7 + j * j) % 90}" for j in range(60)) + f" once{i}") for i in range(80)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    p = M.LmParams(classes=16, width=4)
    c = M.head_of(M.count_words(docs), p)
    assert len(c.words) == len({w for _, t in texts for w in t.split()[:60]})      # all but those seen once
    m, voc = M.train(docs, c, p), M.Vocabulary(c, p)
    assert voc.classes <= 16 < len(m.own) == voc.words and len(m.r) == voc.words + 2
    z, every = M.normalisers(spark, m, p), np.arange(voc.words + 2)
    for u, v in [(0, 1), (voc.words - 1, 3), (voc.end, voc.end), (voc.open, 40)]:
        got = M.log_probabilities(m, voc, z, np.full(len(every), u), np.full(len(every), v), every)
        assert abs(np.exp(got.astype(float)).sum() - 1) < 1e-4
    last = voc.kind == voc.kind[voc.words - 1]
    one, two = (M.log_probabilities(m, voc, z, np.full(last.sum(), u), every[last] * 0, every[last]) for u in (60, 70))
    assert last.sum() > 1 and np.ptp(one - two) > 1e-4        # rare contexts and targets are told apart
    assert M.least_seen(4_000_000) == 2 and M.least_seen(8_000_000_000) == 89


def _trained(p, texts):
    """Trainer over ``texts`` (one batch), its numbers and contexts."""
    c = Counter(w for t in texts for w in t.split())
    words = sorted(c, key=lambda w: (-c[w], w))
    counts = M.Counts(pa.array(words, pa.large_string()), np.array([c[w] for w in words]), len(texts), sum(c.values()) + len(texts), len(c) + 1)
    reader = M.Reader(counts, p)
    data = "".join(texts).encode()
    off = np.cumsum([0, *(len(t.encode()) for t in texts)])
    *_, word, bounds = reader.read(np.frombuffer(data, np.uint8), off)
    return M.Trainer(reader.vocabulary, p), word, M.contexts(word, bounds, reader.vocabulary.end)


TEXTS = [" ".join(f"w{(i * 7 + j * j) % 90}" for j in range(i % 40)) for i in range(60)]


def test_context_rows_are_summed_per_token():
    """A token is the context of the two tokens after it: its row goes out once, with the gradients and touches of both,
    also at the starts of texts and for empty texts (two rows a token before)."""
    t, w, (u, v) = _trained(M.LmParams(classes=16, width=4), TEXTS)
    got = {}
    t._touch = lambda x, past, seen, at, rows, times=None: got.update({"r" if x is t.m.r else "own": (at, rows, times)})
    t.step(u, v, w)
    at, rows, times = got["r"]
    assert len(at) == len(rows) == len(times) < 1.2 * len(w) and times.sum() == 2 * len(w)
    touches = np.zeros(len(t.m.r))
    np.add.at(touches, at, times)
    assert (touches == np.bincount(np.append(u, v), minlength=len(t.m.r))).all()
    # C_2 = C_1 / 2 = I / 2 at the start: undo the sums, row i holds dh[i] and, where it is its context, half of dh[i + 1]
    dh = rows[:len(w)].astype(float)
    for i in range(len(w) - 2, -1, -1):
        if v[i + 1] == u[i]:
            dh[i] -= dh[i + 1] / 2
    sums, want = np.zeros(t.m.r.shape), np.zeros(t.m.r.shape)
    np.add.at(sums, at, rows)
    np.add.at(want, u, dh)
    np.add.at(want, v, dh / 2)
    assert np.abs(sums - want).max() < 1e-4


def test_touched_rows_move_by_their_summed_gradients():
    t, _, _ = _trained(M.LmParams(classes=16, width=4), TEXTS)
    rng = np.random.default_rng(2)
    for at in (np.array([5, 3, 5, 9, 5, 3]), np.array([7, 1, 2])):
        x, past, seen = rng.standard_normal((12, 4)).astype(np.float32), np.full((12, 4), 0.01, np.float32), np.zeros(12, np.float32)
        rows, times = rng.standard_normal((len(at), 4)).astype(np.float32), rng.integers(1, 3, len(at))
        g = np.zeros((12, 4))
        np.add.at(g, at, rows)
        want, touches = x + t.p.rate * g / np.sqrt(past + g * g), np.bincount(at, times, 12)
        t._touch(x, past, seen, at, rows, times)
        assert np.abs(x - want).max() < 1e-5 and (seen == touches).all() and np.abs(past - 0.01 - g * g).max() < 1e-5
        t._touch(x, past, seen, at, rows)
        assert (seen == touches + np.bincount(at, minlength=12)).all()


def test_sums_of_powers_near_and_far():
    rng = np.random.default_rng(1)
    for scale, near in ((1, True), (1, False), (60, False)):
        h, q = rng.standard_normal((300, 5), np.float32) * scale, rng.standard_normal((1024, 5), np.float32)
        s = h.astype(float) @ q.astype(float).T
        want = s.max(1) + np.log(np.exp(s - s.max(1)[:, None]).sum(1))
        assert np.abs(M._log_sums(h * M.TO_TWO, q, near) - want).max() < 1e-4 * max(1, np.abs(want).max())
    assert len(M._log_sums(h[:0], q, True)) == 0


def test_words_are_counted_once_a_batch(spark):
    """Rows before the shuffle: one a distinct word of a batch of 4 MB, not of each of its MBs."""
    texts = [(" ".join(f"w{j}" for j in range(20_000)),)] * 30
    docs = spark.createDataFrame(texts, "text string").coalesce(1)
    got = {}
    keep = M.map_arrow
    try:
        M.map_arrow = lambda df, fn, schema: got.setdefault("rows", keep(df, fn, schema))
        counts = M.count_words(docs)
    finally:
        M.map_arrow = keep
    assert {r.c for r in counts.where("word <> ''").collect()} == {30}
    assert got["rows"].count() < 2 * 20_000 + 10
