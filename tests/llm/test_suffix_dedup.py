import hashlib
from collections import Counter

import numpy as np
from helpers import clashing, docs, sample
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.suffix_dedup import common_prefixes, remove_repeats, suffix_array, text_stretches


def expected(rows, length=200):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[p:p + length] for _, t in texts for p in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - length + 1):
            if seen[t[p:p + length]] > 1:
                gone[p:p + length] = True
        rest = bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])
        out.append((i, len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=repr)


def passages(seed, n, vocabulary=2000):
    """Texts that share whole passages, parts of them, and periodic stretches."""
    rng = np.random.default_rng(seed)
    words = [("".join(chr(97 + c) for c in rng.integers(0, 26, 5)) + ("é" if k % 7 == 0 else "")) for k in range(vocabulary)]

    def fresh(k):
        return " ".join(words[int(x)] for x in rng.integers(0, vocabulary, k))

    shared = [fresh(int(rng.integers(20, 120))) for _ in range(8)]
    texts = []
    for _ in range(n):
        parts = [fresh(int(rng.integers(0, 60)))]
        for s in rng.integers(0, 8, int(rng.integers(0, 3))):
            cut = sorted(rng.integers(0, len(shared[s]), 2).tolist()) if rng.random() < 0.5 else [0, len(shared[s])]
            parts += [shared[s][cut[0]:cut[1]], fresh(int(rng.integers(0, 40)))]
        texts.append(" ".join(parts))
    return texts


EDGES = [None, "", "x" * 199, "y" * 200, "z" * 201, "ab" * 300, "abc" * 2000, "q" * 9000, "w" * 150 + "é" * 40]


def got(df, **kw):
    return sorted((tuple(r) for r in remove_repeats(df, **kw).collect()), key=repr)


def test_shared_passages_and_edges(spark):
    texts = passages(0, 90) + EDGES + ["same " * 50] * 3
    assert got(clashing(docs(spark, texts))) == expected(list(enumerate(texts)))


def test_keys_cut_over_many_shards(spark):
    rng = np.random.default_rng(1)
    middle = " ".join(f"{int(x):06d}" for x in rng.integers(0, 10**6, 40))
    tails = [" ".join(f"{int(x):07d}" for x in rng.integers(0, 10**7, 30)) for _ in range(12)]
    # One passage everywhere; some of its surroundings occur twice, far apart.
    texts = [tails[i % 12][:60 + i] + middle + tails[(5 * i) % 11] for i in range(70)] + ["m" * 5000, "m" * 7000]
    want = expected(list(enumerate(texts)))
    assert got(docs(spark, texts), cut=4, shard=10) == want
    assert got(docs(spark, texts)) == want


def test_sample(spark):
    rows = [r for r in sample(spark, "documents").collect()]
    texts = [r.text for r in rows]
    assert got(docs(spark, texts)) == expected(list(enumerate(texts)))


def test_repeated_ids_empty_table_and_text(spark):
    texts = ["u " * 60 + "v" * 240, "v" * 240, None]
    df = docs(spark, texts, doc_id=[4, 4, None])
    assert got(df) == expected([(4, texts[0]), (4, texts[1]), (None, None)])
    assert remove_repeats(df.limit(0)).count() == 0
    kept = remove_repeats(df, with_text=True).collect()
    assert sorted(bytes(r.kept) for r in kept) == [b"", b"", b"u " * 60]
    assert [(s.lo, s.hi) for r in kept for s in r.removed_spans if r.n_bytes == 360] == [(120, 360)]


@given(st.lists(st.binary(max_size=30), min_size=1, max_size=8), st.sampled_from([b"\x00", b"ab", b"", b"\xff"]))
@settings(max_examples=150, deadline=None)
def test_suffix_array_and_prefixes(parts, more):
    data = b"".join(p + more * 3 for p in parts)
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return
    order = suffix_array(raw)
    want = sorted(range(len(data)), key=lambda i: data[i:])
    assert order.tolist() == want
    # Of every seven suffixes the first five are walked.
    begin = np.arange(0, len(data), 7)
    end = np.minimum(begin + 5, len(data))
    want = [i for i in want if i % 7 < 5]
    for cap in (3, 20):
        prefix = common_prefixes(raw, np.array(want), begin, end, cap)
        for k in range(1, len(want)):
            a, b = data[want[k - 1]:], data[want[k]:]
            same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert prefix[k] == min(cap, same)


def test_every_window_lies_in_one_stretch():
    texts = [t.encode() for t in passages(2, 20)] + [b"a" * 9000, b"", b"k" * 200, b"xy" * 3000]
    for scanned in (1 << 20, 1000):
        covered = [Counter() for _ in texts]
        key_of = {}
        for doc, start, n, key, alone in text_stretches(texts, 200, scanned):
            for d, s, k, h in zip(doc.tolist(), start.tolist(), n.tolist(), key.tolist()):
                for p in range(s, s + k):
                    covered[d][p] += 1
                    assert key_of.setdefault(texts[d][p:p + 200], h) == h
        assert covered == [Counter(range(max(len(t) - 199, 0))) for t in texts]
