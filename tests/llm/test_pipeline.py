import corpus_pipeline as cp
from helpers import clashing, docs, sample, stored
from test_exact_dedup import brute as exact_classes
from test_near_dedup import brute as near_classes


def test_stages_on_the_sample(spark):
    df = sample(spark, "documents")
    step = {}
    for name, stage in cp.STAGES[:-1]:
        out = stored(stage(spark, df, ""))
        assert out.columns == df.columns and set(out.collect()) <= set(df.collect())
        step[name] = (df.collect(), out.collect())
        df = out
    before, after = step["language id"]
    assert len(after) == sum(any(c.isalpha() for c in r.text or "") for r in before)
    before, after = step["exact dedup"]
    assert sorted(r.doc_id for r in after) == sorted({keep for _, keep, _, _ in exact_classes([(r.doc_id, r.text) for r in before])})
    before, after = step["near dedup"]
    assert sorted(r.doc_id for r in after) == sorted(set(near_classes([(r.doc_id, r.text) for r in before]).values()))
    pieces = cp.STAGES[-1][1](spark, df, "").collect()
    tokens = {(r.doc_id, r.start): r.length for r in pieces}
    assert {i for i, _ in tokens} == {r.doc_id for r in df.collect()}


def test_edges_and_run(spark):
    texts = ["the house is here today " * 3, None, "", "12345", "the house is here today " * 3, "un deux trois", "un deux trois", "x " * 30_000]
    df = clashing(docs(spark, texts, source=["a", None, "a", "b", "b", None, None, "a"], lang=["en"] * 5 + ["fr", "fr", None]))
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, df, "")
        assert out.columns == df.columns
        assert stage(spark, stored(df.limit(0)), "").count() == 0
        df = stored(out)
    assert {r.text for r in df.collect()} <= {texts[0], texts[5], texts[7]}
    assert cp.run(spark, "/root/testdata/sf0.001").count() > 0
