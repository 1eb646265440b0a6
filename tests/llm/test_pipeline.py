import corpus_pipeline as C
from overmark.llm import pieces
from overmark.llm.common import table

from test_decontam import brute as overlaps
from test_jaccard import brute as groups
from test_pii import brute as private

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    base = {r.doc_id: r.text for r in docs.collect()}
    state, seen = docs, dict(base)
    for name, stage in C.STAGES:
        out = stage(spark, state, SF).cache()
        rows = out.collect()
        assert len({r.doc_id for r in rows}) == len(rows)
        if name != "segment":
            assert out.schema == docs.schema
        if name == "language":
            want = {i for i, t in seen.items() if t and any(c.isalpha() for c in t)}
        elif name == "near_duplicates":
            want = {c for _, _, c in groups(sorted(seen.items()), 5, 80)}
        elif name == "benchmark_text":
            items = [r.text for r in table(spark, SF, "benchmark").collect()]
            want = {i for i, t in seen.items() if not any(overlaps(t, q) for q in items)}
            assert len(want) < len(seen)
        else:
            want = set(seen)
        assert {r.doc_id for r in rows} == want, name
        if name == "personal_data":
            for r in rows:
                found = private(seen[r.doc_id])
                assert not private(r.text) and (found or r.text == seen[r.doc_id] or "[" in r.text)
        if name == "segment":
            assert all(r.lossless for r in rows)
            back = {r.doc_id: r.text for r in pieces.decode(out, pieces.load()).collect()}
            assert back == seen
        else:
            seen = {r.doc_id: r.text for r in rows}
        state = out
    got = C.run(spark, SF)
    assert sorted(map(str, got.collect())) == sorted(map(str, state.collect()))


def test_empty_table(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in C.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
