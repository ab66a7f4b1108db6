import hashlib
import re
import zlib

import numpy as np
import pytest
from helpers import clashing, stored

from tidemark.llm import prefix_trie as T
from tidemark.llm.prefix_trie import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()


def expected(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    convs = {c: [t[3:] for t in sorted(ts)] for c, ts in convs.items()}
    built = {}
    for c, own in convs.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - int(np.fmod(c, 20))
        built[c] = tuple(convs.get(base, [])[:h] + own[h:])
    nodes = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    parents = {p[:-1] for p in nodes if p}
    out = set()
    for p, members in nodes.items():
        below = [q for q in nodes if q[:len(p)] == p]
        ends = sorted(c for c in members if len(built[c]) == len(p))
        out.add((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members),
                 sum(len(q) == len(p) + 1 for q in below), sum(q not in parents for q in below),
                 sum((len(nodes[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q),
                 hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def check(spark, rows, **kw):
    df = clashing(stored(spark.createDataFrame(rows, SCHEMA)))
    got = [tuple(r) for r in conversation_trie(df, **kw).collect()]
    assert len(got) == len(set(got))
    assert set(got) == expected(rows)
    return got


def random_rows(seed, convs, longest, words=3):
    rng = np.random.default_rng(seed)
    rows = []
    for c in convs:
        for t in range(int(rng.integers(0, longest + 1))):
            text = " ".join(["a", "b c", "", "é\t d"][int(x)] for x in rng.integers(0, 4, int(rng.integers(0, words))))
            rows.append((c, t, ["user", "assistant", None][int(rng.integers(0, 3))], text if rng.random() > 0.1 else None))
    return rows


def test_random_conversations(spark):
    check(spark, random_rows(0, range(-25, 60), 6))


def test_blocks_of_two_columns(spark):
    rows = random_rows(1, range(0, 45), 23, 2)
    check(spark, rows, width=2)


@pytest.mark.parametrize("width", [2, 8])
def test_long_shared_beginnings(spark, width):
    rows = [(20 * c, t, "user", "x y" if t < 19 + c % 3 else f"z{c % 2}") for c in range(12) for t in range(24 + c)]
    check(spark, rows, width=width)


def test_large_conversations_ties_and_wide_nodes(spark, monkeypatch):
    monkeypatch.setattr(T, "CHUNK", 4)
    monkeypatch.setattr(T, "WIDE", 2)
    rows = [(7, t // 3 if t % 5 else None, "r", f"w {t % 4}") for t in range(60)] + random_rows(2, range(0, 40), 3)
    check(spark, rows, width=2, bins=10)


def test_edges(spark):
    check(spark, [(None, 1, "user", "a"), (3, None, None, None), (3, None, None, None), (23, 0, "user", "w " * 30000)])
    # crc32 asks for a turn of an absent base: a conversation without turns is a member of the root.
    lone = next(c for c in range(21, 200) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20)
    got = check(spark, [(lone, 0, "user", "a")])
    assert got == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
    assert conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert EMPTY not in {g[-1] for g in got}
