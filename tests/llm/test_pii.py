import hashlib
import random
import re

from overmark.llm import pii as P
from overmark.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        t += x - 9 * (x > 9)
    return t % 10 == 0


def brute(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text or "", re.ASCII):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                  "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_query_matches_rules(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op10_pii"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in RULES]
        assert set(want) <= set(filter(None, r.spans.split(",")))


def test_formats_on_random_strings(spark):
    rng = random.Random(8)
    alphabet = ["a", "B", "@", ".", ".", "-", "+", "%", " ", "  ", "(", ")", "1", "25", "300", "007", "é", "\U0001F600",
                "\n", "4111 1111 1111 1111", "4111-1111-1111-1111", "a@b.co", "10.0.0.1", "+1 (555) 010-9999", "..", "@.", "﷐"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    texts += [None, "", "1 " * 30000, "1" * 50000, "a@" + "b." * 30000, "9." * 20000, "4111111111111111" + "1" * 4]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, start string")
    got = P.find(df, P.Boosted((), 1.0, -30.0)).select("doc_id", P.spelled(P.F.col("base_spans")).alias("s")).collect()
    assert len(got) == len(texts)
    for r in got:
        want = ",".join(brute((texts[r.doc_id] or "").replace("﷐", "﷓")))
        assert r.s == want, (texts[r.doc_id] or "")[:200]


def test_trees_add_lookalikes_and_redaction(spark):
    rng = random.Random(4)
    rows = [(i, f"the number +1 (555) {rng.randrange(100, 999)}-{rng.randrange(1000, 9999)} and more of it {i}") for i in range(300)]
    rows += [(400 + i, f"totals 12 {i} 7 of 3.5 and 1{i} 2 3 x") for i in range(300)]
    rows += [(900, "call 1 (555) 010-7777 now"), (901, None), (902, "")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, all_spans string")
    m = P.fit(df)
    out = {r.doc_id: r for r in P.find(df.drop("all_spans"), m).collect()}
    assert not out[900].base_spans and [(x.kind, x.start) for x in out[900].all_spans] == [(3, 5)]
    assert not out[401].all_spans
    red = P.redact(df, m)
    assert red.columns == df.columns
    red = {r.doc_id: r.text for r in red.collect()}
    assert red[0].startswith("the number [phone] and more") and red[900] == "call [phone] now"
    assert red[901] is None and red[902] == ""
    assert P.find(df.limit(0).drop("all_spans"), P.fit(df.limit(0))).count() == 0
    plan = P.redact(df, m)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_numbers_side_by_side_are_found(spark):
    rng = random.Random(6)

    def card():
        d = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        return next(d + c for c in "0123456789" if luhn(d + c))

    rows = [(i, f"the number {card()} and more of it") for i in range(300)]
    rows += [(400 + i, f"totals 12 {i} 7 of 3.5 and 1{i} 2 3 x") for i in range(300)]
    one, two = card(), card()
    rows += [(900, f"the number {one} {two} and more"), (901, f"the 10.0.0.1 {one} and"), (902, f"of {one} {two} {one} it")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    m = P.fit(df)
    out = {r.doc_id: [(P.KINDS[x.kind], x.start, x.stop) for x in r.all_spans] for r in P.find(df, m).collect()}
    assert out[900] == [("card", 11, 27), ("card", 28, 44)]
    assert out[901] == [("ip", 4, 12), ("card", 13, 29)]
    assert [x[1:] for x in out[902]] == [(3, 19), (20, 36), (37, 53)]
    assert not out[401]
    assert P.redact(df, m).where("doc_id = 900").head().text == "the number [card] [card] and more"
