import itertools
import zlib

import numpy as np
from helpers import clashing, docs, sample, under_splits

from tidemark.llm import language_id as li

EN, FR = "the house and the garden with this thing", "le jardin de la maison avec une chose"


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(5)
    lengths, k = np.array([5, 3, 3, 1]), 3
    scores, moves = rng.normal(size=(lengths.sum(), k)), rng.normal(size=(k, k))
    pairs = np.zeros((k, k))
    got, at, want_pairs = li.marginals(scores, lengths, moves, pairs), 0, np.zeros((k, k))
    for n in lengths:
        s, p, m, total = scores[at:at + n], np.zeros((n, k)), np.zeros((k, k)), 0.0
        for path in itertools.product(range(k), repeat=int(n)):
            w = np.exp(sum(s[i, y] for i, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            total += w
            for i, y in enumerate(path):
                p[i, y] += w
            for a, b in zip(path, path[1:]):
                m[a, b] += w
        assert np.allclose(got[at:at + n], p / total)
        want_pairs += m / total
        at += n
    assert np.allclose(pairs, want_pairs)


def test_held_out_accuracy(spark):
    df = sample(spark, "documents")
    got = {r.doc_id: r for r in li.identify(df).collect()}
    rows = df.collect()
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    tested = [r for r in rows if got[r.doc_id].held_out]
    right = sum(got[r.doc_id].lang_pred == r.lang for r in tested)
    assert len(tested) > 20 and right / len(tested) >= 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_labels_and_place_do_not_enter_predictions(spark):
    texts = [EN, FR] * 30 + ["the garden and the house", "la maison et le jardin"]
    ids = [i * 7 for i in range(len(texts))]
    a = li.identify(docs(spark, texts, doc_id=ids, lang=["en", "fr"] * 31)).collect()
    field = li.train(docs(spark, texts, doc_id=ids, lang=["en", "fr"] * 31))
    b = li.predict(docs(spark, texts, doc_id=ids[::-1], lang=["fr", "en"] * 31), field).collect()
    assert {(ids.index(r.doc_id), r.lang_pred) for r in a} == {(len(ids) - 1 - ids.index(r.doc_id), r.lang_pred) for r in b}


def test_code_switched_words(spark):
    field = li.fit([("en", EN + "\n" + EN), ("fr", FR + "\n" + FR)] * 20)
    shares, _ = li.Labeller(field).label([f"{EN} {FR}", f"{EN} {EN} {EN} {FR}"])
    assert abs(shares[0, 0] - 0.5) < 0.1 and abs(shares[1, 0] - 0.75) < 0.1


def test_edges(spark):
    texts = [EN, FR, None, "", "123 !? ²", "é", "the " * 60_000, "e" * 30_000, "日本語"] + [EN, FR] * 10
    lang = ["en", "fr", "en", None, "fr", None, "en", None, "en"] + ["en", "fr"] * 10
    df = clashing(docs(spark, texts, lang=lang))
    got = {r.doc_id: (r.lang_pred, r.score) for r in li.identify(df).collect()}
    assert len(got) == len(texts) and all(got[i] == ("und", 0.0) for i in (2, 3, 4))
    assert got[0][0] == "en" and got[1][0] == "fr" and got[6][0] == "en" and all(got[i][0] in ("en", "fr") for i in (5, 7, 8))
    kept = li.keep_identified(df)
    assert kept.columns == df.columns and not {2, 3, 4} & {r.doc_id for r in kept.collect()}
    assert li.identify(df.limit(0)).count() == 0
    none = li.identify(docs(spark, ["some text"], lang=[None])).collect()
    assert [(r.lang_pred, r.score) for r in none] == [("und", 0.0)]
    repeated = li.identify(docs(spark, [EN] * 6 + [FR] * 6, doc_id=[None, 1, 1] * 4, lang=["en"] * 6 + ["fr"] * 6)).collect()
    assert len(repeated) == 12


def test_predictions_are_the_same_under_any_split(spark, monkeypatch):
    monkeypatch.setattr(li, "PER_LABEL", 10)
    df = sample(spark, "documents")
    got = under_splits(spark, df, lambda rows: sorted((r.doc_id, r.lang_pred, round(r.score, 6)) for r in li.identify(rows).collect()))
    assert got[0] == got[1] == got[2]


def test_short_rows_are_learned_before_long_ones(spark, monkeypatch):
    monkeypatch.setattr(li, "LONGEST_SAMPLE", 60)
    monkeypatch.setattr(li, "PER_LABEL", 8)
    texts = [f"{FR} {i} " * 20 for i in range(60)] + [f"{FR} {i}" for i in range(12)] + [EN] * 10
    rows = li.training_rows(docs(spark, texts, lang=["fr"] * 72 + ["en"] * 10), "doc_id", "text", "lang")
    assert sum(t == FR + " " + t.split()[-1] for label, t in rows if label == "fr") == 8
    # A label with long rows only is learned from their beginnings.
    rows = li.training_rows(docs(spark, texts[:60] + [EN] * 10, lang=["fr"] * 60 + ["en"] * 10), "doc_id", "text", "lang")
    assert [len(t) for label, t in rows if label == "fr"] == [60] * 8
    field = li.fit(rows)
    assert li.Labeller(field).label([FR])[0].argmax() == field.labels.index("fr")


def test_small_labels_keep_lines_beyond_the_bound(monkeypatch):
    monkeypatch.setattr(li, "MOST_CELLS", 400)
    rows = [("en", "\n".join([EN] * 500)), ("fr", FR), ("de", "der garten und das haus mit einer sache")]
    field = li.fit(rows)
    shares, _ = li.Labeller(field).label([FR, "das haus und der garten"])
    assert [field.labels[j] for j in shares.argmax(1)] == ["fr", "de"]


def test_an_unlabelled_corpus_passes(spark):
    df = docs(spark, [EN, FR, "12 34", None, ""], lang=[None] * 5)
    assert sorted(r.doc_id for r in li.keep_identified(df).collect()) == [0, 1]
