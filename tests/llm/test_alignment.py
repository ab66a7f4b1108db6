import hashlib
from collections import Counter

import numpy as np
from helpers import clashing, docs, sample

from tidemark.llm.alignment import align, encoders, lockstep, piece_starts
from tidemark.llm.common import RANKS_FILE, tokenizer_path

ODD = [None, "", " ", "a", "  two  spaces ", "tab\tand\nline\r\n", "▁ marked ▁", "<|endoftext|> inside </s><s>", "שלום עולם", "🤦🏼‍♂️ ok", "ﬁ ½ Å",
       "x" * 3000, " " * 300, "é" * 500 + " é", "naïve café \u0000 nul", "12345 67.89", "漢字かな交じり文", "a▁b", "﻿bom", "<0x41> text"]


def paths():
    return tokenizer_path(), tokenizer_path(RANKS_FILE), tokenizer_path("piece_bpe_32k.model")


def brute(rows):
    """Every document's tokens by the libraries; links by comparing byte ranges."""
    a, b = encoders(*paths())
    out, links = {}, {}
    for i, text in rows:
        whole = (" " + (text or "")).encode()
        x, y = (a.tok.encode(" " + text, add_special_tokens=False).ids, b.model.encode(text)) if text else ([], [])
        if a.joined(np.array(x, int)) != whole or b.joined(np.array(y, int)) != whole:
            out[i], links[i] = (0, 0, 0, 0, ""), []
            continue
        spans = []
        for ids, tok in ((x, a), (y, b)):
            ends = np.cumsum([len(tok.bytes[t]) for t in ids]).tolist()
            spans.append(list(zip(ids, [0, *ends], ends)))
        both = {e for _, _, e in spans[0]} & {e for _, _, e in spans[1]}
        groups, start = [], 0
        for end in sorted(both):
            groups.append("|".join(",".join(str(t) for t, s, e in side if start <= s and e <= end) for side in spans))
            start = end
        links[i] = [(t, u) for t, s, e in spans[0] for u, v, w in spans[1] if s < w and v < e]
        out[i] = (len(x), len(y), len(both), len(links[i]), hashlib.sha256(";".join(groups).encode()).hexdigest())
    counts = Counter(p for ls in links.values() for p in ls)
    best = {}
    for (_, u), n in counts.items():
        best[u] = max(best.get(u, 0), n)
    return {(i, *f[:4], sum(counts[p] == best[p[1]] for p in links[i]), sum(counts[p] for p in links[i]), f[4]) for i, f in out.items()}


def test_sample_and_odd_texts(spark):
    texts = [r.text for r in sample(spark, "documents").collect() if len(r.text) < 4000][:60] + ODD
    got = align(clashing(docs(spark, texts)), chunk_bytes=20_000, piece_bytes=700).collect()
    want = brute(list(enumerate(texts)))
    assert {tuple(r) for r in got} == want and len(got) == len(texts)
    assert sum(r.n_links > 0 for r in got) > 70
    again = align(docs(spark, texts)).collect()
    assert {tuple(r) for r in again} == want


def test_repeated_ids_and_empty_table(spark):
    df = docs(spark, ["same text"] * 3 + [None], doc_id=[5, 5, None, None])
    got = align(df).collect()
    assert sorted((r.doc_id is None, r.n_links) for r in got) == [(False, 2), (False, 2), (True, 0), (True, 2)]
    assert {r.count_sum for r in got} == {0, 6}
    assert align(df.limit(0)).count() == 0


def test_pieces_join_to_the_same_links():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = (np.unique(np.append(rng.integers(1, 3000, 700), 3000)) for _ in range(2))
        whole = lockstep(a, b, *(np.array([v]) for v in (0, 0, len(a))))
        starts = piece_starts(a, b, 150)
        assert len(starts) > 5
        p, q = (np.array(c) for c in zip(*starts))
        parts = lockstep(a, b, p, q, np.append(p[1:], len(a)))
        for one, many in zip(whole, parts):
            assert all(np.array_equal(u, v) for u, v in zip(one[1:], many[1:]))
        lo_a, lo_b = np.append(0, a[:-1]), np.append(0, b[:-1])
        i, j = np.nonzero((lo_a[:, None] < b[None]) & (lo_b[None] < a[:, None]))
        assert np.array_equal(np.stack([i, j]), np.stack(whole[0][1:]))
