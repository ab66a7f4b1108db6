import hashlib
import re
from collections import Counter

from helpers import clashing, docs
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.exact_dedup import Patricia, drop_copies, exact_dedup, insert


@given(st.lists(st.text("ab", max_size=6).map(str.encode), max_size=60))
@settings(max_examples=200, deadline=None)
def test_trie_holds_each_text_once(keys):
    trie, want = Patricia(), {}
    for i, k in enumerate(keys):
        node = trie.terminal(k)
        node[1] = min(i, node[1]) if node[1] is not None else i
        want.setdefault(k, i)
    assert {k: at for k, at, _ in trie.texts()} == want


@given(st.lists(st.text("ab", max_size=9).map(str.encode), min_size=1, max_size=80), st.integers(1, 3000))
@settings(max_examples=300, deadline=None)
def test_spilled_subtrees_take_all_of_a_text(keys, most):
    """No text is both complete and spilled, no row is lost, one text at least is complete, the bytes held are right."""
    trie, out = Patricia(), []
    for i, k in enumerate(keys):
        insert(trie, k, (len(k), i, i), 1)
        if trie.held > most:
            out += trie.spill(most // 2)
            assert all(spilled for *_, spilled in out)
            assert trie.held == trie._weights()[id(trie.root)][0]
    ends = list(trie.texts())
    complete, moved = {k for k, _, spilled in ends if not spilled}, {k for k, _, spilled in out + ends if spilled}
    assert complete and not complete & moved and complete | moved == set(keys)
    counts = Counter()
    for k, (_, n), _ in out + ends:
        counts[k] += n
    assert counts == Counter(keys)


def brute(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), i is None, i, text))
    out = []
    for body, members in groups.items():
        keep = min(members)[2]
        out += [(i, keep, len(members), hashlib.sha256(body.encode()).hexdigest()) for _, _, i, _ in members]
    return sorted(out, key=str)


def test_against_brute_force(spark):
    texts = ["a b", "ab", "a  b", None, "", " \t\n", "é\u00a0x", "éx", "long " * 5000, "long" * 5000, "ab", "abc", "ab\x0bc", "x"]
    for trie_bytes in (1, 60_000, 1 << 20):
        got = exact_dedup(clashing(docs(spark, texts)), trie_bytes=trie_bytes).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(list(enumerate(texts)))
        assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_repeated_rows_null_ids_and_empty_table(spark):
    df = docs(spark, ["x y", "x y", "xy", "z"], doc_id=[7, 7, 7, None])
    got = exact_dedup(df).collect()
    assert sorted((r.doc_id or -1, r.group_size, r.kept) for r in got) == [(-1, 1, True), (7, 3, False), (7, 3, False), (7, 3, True)]
    assert exact_dedup(df.limit(0)).count() == 0
    kept = drop_copies(clashing(df))
    assert kept.columns == clashing(df).columns and sorted(r.text for r in kept.collect()) == ["x y", "z"]
