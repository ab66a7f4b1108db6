"""Chains that pass through several ranges of snapshots."""

import random

from tidemark.operators import evidence as E

DDL = "table_id BIGINT, snapshot_id BIGINT, parent_id BIGINT"


def test_chains_are_shortened_before_they_are_doubled(spark, monkeypatch):
    rows = [(1, i, i - 1 if i else None) for i in range(4000)]
    rounds, cut = [], E.cut_lineage
    monkeypatch.setattr(E, "NEAR_ROWS", 1000)
    monkeypatch.setattr(E, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    found = E.ancestry(spark.createDataFrame(rows, DDL), spark.createDataFrame([(1, 3999)], "table_id BIGINT, snapshot_id BIGINT"))
    assert len(rounds) <= 12
    assert sorted((r.snapshot_id, r.depth) for r in found.collect()) == [(i, 3999 - i) for i in range(4000)]


def test_pairs_in_ranges_that_chains_enter_again(spark, monkeypatch):
    rng = random.Random(5)
    ids = list(range(60))
    rng.shuffle(ids)
    parent = {s: rng.choice(ids[max(0, i - 3):i]) if i else None for i, s in enumerate(ids)}
    monkeypatch.setattr(E, "NEAR_ROWS", 15)

    def above(s):
        while s is not None:
            yield s
            s = parent[s]

    pairs = [(1, a, b) for a in ids for b in ids]
    found = E.ancestor_pairs(spark.createDataFrame([(1, s, p) for s, p in parent.items()], DDL),
                             spark.createDataFrame(pairs, "table_id BIGINT, snapshot_id BIGINT, head_id BIGINT"))
    assert {(r.snapshot_id, r.head_id) for r in found.collect()} == {(a, b) for b in ids for a in above(b)}
