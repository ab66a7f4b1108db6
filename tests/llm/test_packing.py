import zlib
from collections import defaultdict

import numpy as np
from helpers import clashing, docs, sample

from tidemark.llm.common import SPECIAL, library, tokenizer_path
from tidemark.llm.packing import END, WINDOW, pack


def check(df, rows):
    got, ids = df.collect(), {i: [*library(tokenizer_path()).encode(t or "", add_special_tokens=False).ids, END] for i, t in rows}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        piece = ids[r.doc_id][r.start:r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.length > 0
            at += p.length
        assert at == len(ids[i])
    fill = []
    for s in sorted(by_seq):
        at = 0
        for p in sorted(by_seq[s], key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        fill.append(at)
    assert sorted(by_seq) == list(range(len(by_seq))) and all(n == WINDOW for n in fill[:-1])


def test_round_trip(spark):
    df = sample(spark, "documents")
    check(pack(df), [(r.doc_id, r.text) for r in df.collect()])


def test_edges(spark):
    texts = [None, "", " ", "a " * 40_000, "b" * 60_000, f"x{SPECIAL}y", "\n" * 30_000] + ["tiny"] * 50
    check(pack(clashing(docs(spark, texts))), list(enumerate(texts)))
    assert pack(docs(spark, ["x"]).limit(0)).count() == 0
    twice = pack(docs(spark, ["a b"] * 4, doc_id=[1, 1, None, None]), with_ids=True).collect()
    assert sum(r.length for r in twice) == 4 * twice[0].doc_tokens and all(len(r.ids) == 4 * r.length for r in twice)
