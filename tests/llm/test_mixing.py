import re

import numpy as np
from helpers import clashing, docs, sample, under_splits
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.mixing import mix, mixture, split_quotas


def targets(sizes):
    """Share, stop, share again, until no source is above its limit."""
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    left, open_, out = 1.5 * sum(sizes.values()), set(sizes), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def check(got, rows, slack):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    sums = {}
    for i, _, s in rows:
        sums[s] = sums.get(s, 0) + size[i]
    want, taken, source = targets(sums), dict.fromkeys(sums, 0), {i: s for i, _, s in rows}
    assert len(got) == len(rows)
    for r in got:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == sums[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    for s in sums:
        assert abs(taken[s] - want[s]) <= slack


def test_sample(spark):
    df = sample(spark, "documents")
    rows = [(r.doc_id, r.text, r.source) for r in df.collect()]
    first = mix(df).collect()
    check(first, rows, 2000)
    assert sorted(first) == sorted(mix(df).collect())


def test_many_short_texts_and_edges(spark):
    rng = np.random.default_rng(0)
    texts = ["w " * int(n) for n in rng.integers(1, 30, 600)] + [None, "", "  x"]
    sources = [("a", "b", "é", None, "Z")[i % 5] for i in range(len(texts))]
    df = clashing(docs(spark, texts, source=sources))
    check(mix(df).collect(), list(zip(range(len(texts)), texts, sources)), 15)
    assert mix(df.limit(0)).count() == 0
    blank = mix(docs(spark, [None, ""])).collect()
    assert [(r.size, r.target, r.taken) for r in blank] == [(0, 0.0, 0)] * 2
    out = mixture(df)
    assert out.columns == df.columns
    assert out.count() == sum(r.taken // r["size"] for r in mix(df).collect() if r["size"])


def test_repeated_rows(spark):
    got = mix(docs(spark, ["one two"] * 40, doc_id=[3] * 40, source=["a"] * 20 + ["b"] * 20)).collect()
    assert sum(r.taken for r in got) == 120 and all(r.taken <= 4 for r in got)


@given(st.lists(st.integers(0, 200), min_size=1, max_size=8), st.integers(1, 20), st.integers(0, 3))
@settings(max_examples=100, deadline=None)
def test_tree_splits_all_draws_evenly(quotas, shards, seed):
    split = split_quotas(np.array(quotas), shards, seed)
    assert split.min() >= 0 and split.sum(1).tolist() == quotas
    assert split.sum(0).max() - split.sum(0).min() <= int(np.ceil(np.log2(shards))) + 1


def test_the_mix_is_the_same_under_any_split(spark):
    df = sample(spark, "documents")
    df = df.unionByName(df.limit(20)).unionByName(df.limit(20))
    mixes = under_splits(spark, df, lambda rows: sorted((r.doc_id, r.size, r.taken) for r in mix(rows).collect()))
    assert mixes[0] == mixes[1] == mixes[2]
    drawn = under_splits(spark, df, lambda rows: [r.doc_id for r in mixture(rows, shards=1).collect()])
    assert drawn[0] == drawn[1] == drawn[2]


def test_many_sources_and_shards_stay_sparse():
    rng = np.random.default_rng(3)
    quotas = rng.integers(0, 4, 10_000)
    cells, sums = 0, np.zeros(len(quotas), np.int64)
    from tidemark.llm.mixing import split_leaves

    for _, who, have in split_leaves(quotas, 1000):
        cells += len(who)
        sums[who] += have
        assert have.min() > 0
    assert cells <= quotas.sum() and sums.tolist() == quotas.tolist()
