import random
from collections import defaultdict

import numpy as np
import pytest
from helpers import clashing, docs, sample

from tidemark.llm import near_dedup as nd
from tidemark.llm.shingles import jaccards, shingle_hashes


def shingles(text):
    w = [x for x in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in text or "").split(" ") if x]
    return [tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def similar(a, b):
    if not a or not b:
        return False
    count = lambda s: {x: s.count(x) for x in set(s)}
    ca, cb = count(a), count(b)
    both = set(ca) & set(cb)
    multi = sum(min(ca[x], cb[x]) for x in both)
    return len(both) / len(set(ca) | set(cb)) >= 0.8 or multi / (len(a) + len(b) - multi) >= 0.8


def brute(rows):
    rows = sorted(rows)
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    posts = defaultdict(list)
    for i, s in enumerate(sets):
        for x in set(s):
            posts[x].append(i)
    for i, j in {(i, j) for p in posts.values() for k, j in enumerate(p) for i in p[:k]}:
        if root(i) != root(j) and similar(sets[i], sets[j]):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: rows[root(k)][0] for k, (i, _) in enumerate(rows)}


def test_shingles_and_signatures():
    texts = ["one two three four five six", "one  two\tthree\nfour five six", "a b", "a b c", "", " \n", "é ü ß ñ ç x é ü ß ñ ç x", "x " * 3000]
    h, n = shingle_hashes([t.encode() for t in texts])
    assert n.tolist() == [len(shingles(t)) for t in texts]
    parts = np.split(h, np.cumsum(n)[:-1])
    assert (parts[0] == parts[1]).all() and parts[2] != parts[3] and len(np.unique(parts[7])) == 1
    sig = nd.signatures(h, n, 64)
    assert (sig[0] == sig[1]).all() and (sig[4] == ~np.uint64(0)).all() and (sig[[0, 2, 7]] != ~np.uint64(0)).all()


def test_signatures_estimate_weighted_similarity():
    rng = random.Random(3)
    base = [f"w{rng.randrange(40)}" for _ in range(400)]
    texts = [" ".join(base[:400 - cut] + [f"v{cut}-{i}" for i in range(cut)]) for cut in (0, 20, 60, 150, 300)]
    h, n = shingle_hashes([t.encode() for t in texts])
    sig, lists = nd.signatures(h, n, 2000), np.split(h, np.cumsum(n)[:-1])
    for i in range(5):
        assert abs((sig[0] == sig[i]).mean() - jaccards(lists[0], lists[i])[1]) < 0.05


def test_sample_against_brute_force(spark):
    df = sample(spark, "documents")
    got = nd.near_dedup(df).collect()
    assert {r.doc_id: r.class_id for r in got} == brute([(r.doc_id, r.text) for r in df.collect()])
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def chain(rng, n, words=60):
    """Near copies of each other in a chain and around a hub, so that no single leader reaches all of them."""
    base = [f"{rng.randrange(10 ** 6)}" for _ in range(words)]
    out = [base]
    for _ in range(n - 1):
        w = list(rng.choice(out[-6:]))
        w[rng.randrange(words)] = f"{rng.randrange(10 ** 6)}"
        out.append(w)
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("tile", [4, 1024])
def test_large_groups(spark, monkeypatch, tile):
    monkeypatch.setattr(nd, "TILE", tile)
    rng = random.Random(11)
    texts = chain(rng, 60) + chain(rng, 40) + ["same words in every row of this one"] * 30 + [chain(rng, 1)[0] for _ in range(30)]
    got = nd.near_dedup(docs(spark, texts)).collect()
    assert {r.doc_id: r.class_id for r in got} == brute(list(enumerate(texts)))


def test_edges(spark):
    texts = [None, "", " \n", "a b", "a  b", "a b c", "x " * 40_000, "x " * 39_000, "ΑΒΓ δ ε ζ η θ", "ΑΒΓ δ ε ζ η θ"]
    df = clashing(docs(spark, texts))
    got = {r.doc_id: (r.class_id, r.class_size, r.kept) for r in nd.near_dedup(df).collect()}
    assert got == {0: (0, 1, True), 1: (1, 1, True), 2: (2, 1, True), 3: (3, 2, True), 4: (3, 2, False), 5: (5, 1, True), 6: (6, 2, True),
                   7: (6, 2, False), 8: (8, 2, True), 9: (8, 2, False)}
    kept = nd.drop_near_copies(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 5, 6, 8]
    assert nd.near_dedup(df.limit(0)).count() == 0
    twice = nd.near_dedup(docs(spark, ["a b c d e"] * 4, doc_id=[5, 5, None, 9])).collect()
    assert [r.class_id for r in twice] == [5] * 4 and sum(r.kept for r in twice) == 1


def passages(rng, n, words=60):
    """Passages of distinct words, each once and three times over: near as sets, far apart as multisets."""
    once = [" ".join(str(x) for x in rng.sample(range(10 ** 6), words)) for _ in range(n)]
    return once + [" ".join([t] * 3) for t in once]


@pytest.mark.parametrize("tile", [4, 1024])
def test_repeated_passages_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(nd, "TILE", tile)
    rng = random.Random(17)
    texts = passages(rng, 20) + chain(rng, 20) + [" ".join([t] * 3) for t in chain(rng, 20)] + ["x " * 9, "x " * 900]
    want = brute(list(enumerate(texts)))
    assert all(want[i] == want[20 + i] == i for i in range(20)) and want[80] == want[81]
    assert {r.doc_id: r.class_id for r in nd.near_dedup(docs(spark, texts)).collect()} == want


def test_tile_guess_sees_sets():
    once, thrice = (t.encode() for t in passages(random.Random(5), 1))
    h, n = shingle_hashes([once, thrice])
    sig, (some, sets) = nd.low_bytes(nd.signatures(h, n, 240)), nd.set_signatures(h, n, 240)
    assert some.tolist() == [1]
    lists = np.split(h, np.cumsum(n)[:-1])

    def tile(i, rest):
        return nd.pa.table({"node": [i], "comp": [i], "sig": [sig[i].tobytes()], "list": [lists[i].tobytes()], "rest": [rest], "probe": [True],
                            "sets": nd.pa.array([nd.low_bytes(sets)[0].tobytes() if i else None], nd.pa.binary())})

    assert nd.tile_links(tile(0, False), tile(1, True), 240, 0.8) == [(0, 1)]
    assert nd.tile_links(tile(0, False), tile(1, False), 240, 0.8) == nd.tile_links(tile(1, True), tile(0, False), 240, 0.8) == []


def below(rng, n, words=100, own=9):
    """Pages of one template with words of their own in one field: all pairs are of similarity 0.76."""
    core = [f"{rng.randrange(10 ** 6)}" for _ in range(words)]
    return [" ".join(core[:50] + [f"{rng.randrange(10 ** 9)}" for _ in range(own)] + core[50 + own:]) for _ in range(n)]


def test_texts_that_share_common_shingles_only_are_never_compared(spark):
    rng = random.Random(23)
    texts = below(rng, 40)
    pairs = [(i, len(texts) + j) for j, i in enumerate(range(0, 20, 2))]
    texts += [texts[i] + " and a tail" for i, _ in pairs]
    assert brute(list(enumerate(texts))) == {i: dict((b, a) for a, b in pairs).get(i, i) for i in range(50)}
    lists = nd.shingle_lists(spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "node long, body binary"))
    one_each = spark.createDataFrame([(i, i, i > 0) for i in range(50)], "node long, comp long, rest boolean")
    got = {}
    for r in nd.areas(one_each, lists, 0.8).collect():
        got.setdefault(r.area, set()).add(r.node)
        assert r.probe or r.node >= 40
    assert sorted(map(sorted, got.values())) == sorted(map(list, pairs))
    linked = spark.createDataFrame([(i, dict((b, a) for a, b in pairs).get(i, i), i > 0) for i in range(50)], one_each.schema)
    assert nd.areas(linked, lists, 0.8).count() == 0
    assert {r.doc_id: r.class_id for r in nd.near_dedup(docs(spark, texts)).collect()} == brute(list(enumerate(texts)))


@pytest.mark.parametrize("seed", [1, 2])
def test_areas_lose_no_pair(spark, seed):
    rng = random.Random(seed)
    texts = [" ".join(str(rng.randrange(3)) for _ in range(rng.randrange(5, 40))) for _ in range(60)]
    texts += [f"{t} {t}" for t in texts[:30]] + [t[:-2] for t in texts[:60]] + chain(rng, 30, 20) + ["x " * 9, "x " * 900, "a b"]
    n = len(texts)
    lists = nd.shingle_lists(spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "node long, body binary"))
    nodes = spark.createDataFrame([(i, i, True) for i in range(n)], "node long, comp long, rest boolean")
    got = nd.areas(nodes, lists, 0.8).collect()
    area, probe = {r.node: r.area for r in got}, {r.node: r.probe for r in got}
    sets = [shingles(t) for t in texts]
    near = [(i, j) for i in range(n) for j in range(i) if similar(sets[i], sets[j])]
    assert len(near) > 40 and all(i in area and area[i] == area.get(j) for i, j in near)
    assert all(probe[min(i, j, key=lambda k: len(sets[k]))] or len(sets[i]) != len(sets[j]) and (probe[i] or probe[j]) for i, j in near)
