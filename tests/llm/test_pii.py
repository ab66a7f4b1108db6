import hashlib
import re

from helpers import clashing, docs, sample
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.llm.pii import find_personal_data, sanitised


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def only_digits(m):
    return re.sub("[^0-9]", "", m)


KINDS = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 14 <= len(only_digits(m)) <= 19 and luhn(only_digits(m))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 10 <= len(only_digits(m)) <= 15)]


def brute(text):
    found = sorted((m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(KINDS) for m in p.finditer(text or "") if ok(m.group()))
    joined = ",".join(f"{name}:{a}:{b}" for a, _, name, b in found)
    return tuple(sum(f[1] == k for f in found) for k in range(4)), hashlib.sha256(joined.encode()).hexdigest()


def check(df):
    want = {r.doc_id: brute(r.text) for r in df.collect()}
    got = find_personal_data(df).collect()
    assert len(got) == len(want)
    for r in got:
        assert ((r.n_email, r.n_ip, r.n_card, r.n_phone), r.base_sha256) == want[r.doc_id], r.doc_id


def test_sample(spark):
    check(sample(spark, "documents"))


def test_edges(spark):
    texts = [None, "", "a@b.c_x@d.e", "x@y@z.com", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.1.1.001", "4111 1111 1111 1111", "4111-1111-1111-1111-", "4111111111111112",
             "+1 (607) 555-6433", "+1 (607) 555-6433 4111 1111 1111 1111", "é😀 a@b.co 😀 10.0.0.1", "9" * 60_000, "a" * 60_000 + "@b.co", "1." * 20_000,
             "+1" + " " * 30_000, "a@b." * 5_000, "5 " * 20_000, ".%@-.-", "a@-.-", "+1 23 4567890x+99999999999999"]
    check(clashing(docs(spark, texts)))
    assert find_personal_data(docs(spark, ["x"]).limit(0)).count() == 0
    assert find_personal_data(docs(spark, ["a@b.co", "a@b.co"], doc_id=[None, None])).count() == 2


@given(st.lists(st.text("a1.@+- (4)0é", max_size=40), min_size=20, max_size=40))
@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_random_texts(spark, texts):
    check(docs(spark, texts))


def test_telling_words_are_spans(spark):
    common = [f"some words about day {i} and nothing else at all in here" for i in range(40)]
    told = [f"on day {i} the Quizzlemaster, said to write to q.m@corp.example about some words" for i in range(3)]
    df = docs(spark, common + told + told[:1] * 5)
    got = {r.doc_id: r for r in find_personal_data(df).collect()}
    start = told[0].index("Quizzlemaster")
    assert f"term:{start}:{start + 13}" in got[40].spans and "email:" in got[40].spans
    assert all(got[i].spans == "" and got[i].n_term == 0 for i in range(40))
    assert "some" not in [told[0][int(a):int(b)] for k, a, b in (s.split(":") for s in got[40].spans.split(","))]
    clean = {r.doc_id: r.text for r in sanitised(df).collect()}
    assert clean[0] == common[0] and "Quizzlemaster" not in clean[41] and "q.m@corp" not in clean[41] and "[EMAIL]" in clean[41]
    assert sanitised(df).columns == df.columns


def test_telling_words_whole(spark):
    """Numbers beside an entity, brackets and quotes hide no word, and telling words are marked away from the entity too."""
    common = [f"some words about day {i} and nothing else at all in here" for i in range(60)]
    told = [f"card 4111 1111 1111 1111 exp 12/27 paid {1990 + i} by (Vexley), «Jo» O'Quill some day in {2000 + i}" for i in range(8)]
    away = "nothing about " + "some words " * 20 + "😀 vexley and x@y.org"
    got = {r.doc_id: r.spans.split(",") for r in find_personal_data(docs(spark, common + told + [away])).collect()}
    for i in range(60, 68):
        for word in ("Vexley", "Jo", "Quill"):
            at = told[i - 60].index(word)
            assert f"term:{at}:{at + len(word)}" in got[i], (word, got[i])
    at = away.index("vexley")
    assert got[68] == [f"term:{at}:{at + 6}", f"email:{at + 11}:{at + 18}"] and got[0] == [""]
