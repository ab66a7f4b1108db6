import sys

import regex
from helpers import clashing, docs
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.common import RANKS_FILE, SPECIAL, library, tokenizer_path
from tidemark.llm.packing import encoder
from tidemark.llm.token_counts import UNSURE, count_tokens, counter, whole_tokens

PATH = tokenizer_path()


def n_tokens(text):
    return len(library(PATH).encode(text or "", add_special_tokens=False).ids)


def test_code_points_agreed_on():
    import public_tokenizers

    pieces, pre = regex.compile(public_tokenizers.PATTERN), library(PATH).pre_tokenizer
    unsure = regex.compile(f"[{UNSURE}]")
    for c in map(chr, range(sys.maxunicode + 1)):
        if not unsure.match(c) and not 0xD800 <= ord(c) < 0xE000:
            text = f"a{c}a 1{c}1 !{c}! {c} x{c}{c} y  {c}{c}z"
            assert [len(p) for p in pieces.findall(text)] == [b - a for _, (a, b) in pre.pre_tokenize_str(text)], hex(ord(c))


def test_whole_tokens_are_one_token():
    whole = whole_tokens(PATH)
    assert len(whole) > 45_000 and " the" in whole and SPECIAL not in whole
    assert all(n_tokens(w) == 1 for w in whole[::97])


@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("ab  '\n\t1éשقहไ😀。"))), st.sampled_from(["", SPECIAL, "<|endoftext"]))
@settings(max_examples=300, deadline=None)
def test_counts_and_ids_are_the_librarys(text, special):
    text = text[:20] + special + text[20:]
    ids = library(PATH).encode(text, add_special_tokens=False).ids
    assert counter(PATH)(text) == len(ids)
    assert encoder(PATH, tokenizer_path(RANKS_FILE))(text).tolist() == ids


def test_table(spark):
    texts = ["Hello world", None, "", "   ", "x" * 100_000, "the " * 30_000, f"a{SPECIAL}b", "\U00033000 ٣ ²", "don't  stop\n\n now", " " * 50_000]
    got = {r.doc_id: r for r in count_tokens(clashing(docs(spark, texts))).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n_tokens(t), n_tokens(t) > 512)
    assert count_tokens(docs(spark, ["x"]).limit(0)).count() == 0
