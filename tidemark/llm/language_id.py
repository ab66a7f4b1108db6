"""Language identification by a linear-chain conditional random field over words.

A word's score for a label is the sum of learned weights of its affixes, inner character n-grams and, if the
training sample held it, its lexicon entry; learned transitions tie neighbouring words. Forward-backward over
the whole text gives every word's label probabilities, so text that switches language is labelled word by word;
a document's language is the label with the largest expected share of words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ROW, text_or_empty, with_row
from tidemark.llm.shingles import mix

#: The training sample: rows per label and in all, longest text of a sampled row, labels (the most frequent), and
#: words times labels at most.
PER_LABEL, MOST_ROWS, LONGEST_SAMPLE, MOST_LABELS, MOST_CELLS = 100, 1000, 20_000, 200, 4_000_000
#: Hashed weights per label, n-gram lengths, words that a worker remembers, words labelled at once.
BUCKETS, ORDERS, REMEMBERED, CHUNK_WORDS = 1 << 16, (1, 2, 3, 4), 250_000, 150_000
UNKNOWN = "und"
word_runs = re.compile(r"[^\W\d_]+").findall


@dataclass
class Field:
    """Labels, n-gram weights (orders x buckets x labels), lexicon hashes and weights, transition scores."""

    labels: list[str]
    grams: np.ndarray
    lexicon: np.ndarray
    entries: np.ndarray
    moves: np.ndarray


def gram_buckets(words: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """For each order the (bucket, valid) of every character position, the words' first positions, and word hashes.

    Words are framed by start and end marks, so n-grams at the frame are affixes.
    """
    size = np.array([len(w) + 2 for w in words])
    chars = np.frombuffer("".join(f"\x01{w}\x02" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    first = np.cumsum(size) - size
    left = np.repeat(first + size, size) - np.arange(len(chars))
    out, rolled, padded = [], np.zeros(len(chars), np.uint64), np.append(chars, np.zeros(max(ORDERS), np.uint64))
    for n in range(1, max(ORDERS) + 1):
        rolled = mix(rolled + padded[n - 1:n - 1 + len(chars)] + np.uint64(n << 40))
        if n in ORDERS:
            out.append(((rolled & np.uint64(BUCKETS - 1)).astype(np.int64), left >= n))
    spot = (np.arange(len(chars)) - np.repeat(first, size)).astype(np.uint64)
    return out, first, np.add.reduceat(mix(chars + (spot << np.uint64(32))), first)


def emissions(field: Field, words: list[str]) -> np.ndarray:
    grams, first, whole = gram_buckets(words)
    out = np.zeros((len(words), len(field.labels)))
    for weights, (bucket, valid) in zip(field.grams, grams):
        out += np.add.reduceat(weights[bucket] * valid[:, None], first, axis=0)
    if len(field.lexicon):
        at = np.minimum(np.searchsorted(field.lexicon, whole), len(field.lexicon) - 1)
        known = field.lexicon[at] == whole
        out[known] += field.entries[at[known]]
    return out


def marginals(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Label probabilities of every word of several texts, by forward-backward over all texts in step.

    ``scores`` holds the texts one after another, the longest first. With ``pairs``, the expected transitions are added to it.
    """
    steps = int(lengths[0]) if len(lengths) else 0
    alive = np.searchsorted(-lengths, -np.arange(steps), side="left")  # texts that have a word at step t
    heads = np.cumsum(lengths) - lengths
    base = np.cumsum(alive) - alive
    t = np.arange(len(scores)) - np.repeat(heads, lengths)
    place = base[t] + np.repeat(np.arange(len(lengths)), lengths)
    e = np.empty_like(scores)
    e[place] = np.exp(scores - scores.max(1, keepdims=True))
    a, forward = np.exp(moves), np.empty_like(e)
    now = None
    for lo, n in zip(base.tolist(), alive.tolist()):
        now = e[lo:lo + n].copy() if now is None else (now[:n] @ a) * e[lo:lo + n]
        now /= now.sum(1, keepdims=True)
        forward[lo:lo + n] = now
    out, back = np.empty_like(e), np.ones((0, e.shape[1]))
    for lo, n in zip(base[::-1].tolist(), alive[::-1].tolist()):
        if n > len(back):
            back = np.concatenate([back, np.ones((n - len(back), e.shape[1]))])
        p = forward[lo:lo + n] * back
        p /= p.sum(1, keepdims=True)
        out[lo:lo + n] = p
        if lo:
            reach = e[lo:lo + n] * back
            if pairs is not None:
                before = forward[int(base[np.searchsorted(base, lo) - 1]):][:n]
                total = ((before @ a) * reach).sum(1, keepdims=True)
                pairs += a * ((before / total).T @ reach)
            back = reach @ a.T
            back /= back.sum(1, keepdims=True)
    return out[place]


def fit(rows: list[tuple[str, str]], rounds: int = 25, seed: int = 0) -> Field:
    """Train on (label, text) by Adam on the likelihood.

    Lines of different rows are strung together in random order, so that transitions also see changes of language.
    """
    labels = sorted({label for label, _ in rows})
    lines = [(labels.index(label), ws) for label, text in rows for line in text.lower().split("\n") if (ws := word_runs(line))]
    if not lines:
        return Field(labels, np.zeros((len(ORDERS), BUCKETS, len(labels)), np.float32), np.zeros(0, np.uint64),
                     np.zeros((0, len(labels)), np.float32), np.zeros((len(labels), len(labels))))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(lines))
    # Beyond the bound, labels keep lines in turn, so that none is left without.
    nth, seen = np.zeros(len(lines), np.int64), [0] * len(labels)
    for i in order.tolist():
        nth[i] = seen[lines[i][0]]
        seen[lines[i][0]] += 1
    turn = order[np.argsort(nth[order], kind="stable")]
    cells = np.cumsum([len(lines[i][1]) for i in turn]) * len(labels)
    last = max(len(labels), int(np.searchsorted(cells, MOST_CELLS)))
    order = order[np.isin(order, turn[:last])]
    texts = [[lines[i] for i in order[j:j + 6]] for j in range(0, len(order), 6)]
    texts.sort(key=lambda t: -sum(len(ws) for _, ws in t))
    lengths = np.array([sum(len(ws) for _, ws in t) for t in texts])
    gold = np.array([label for t in texts for label, ws in t for _ in ws])
    vocabulary: dict[str, int] = {}
    ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for t in texts for _, ws in t for w in ws])
    words, k = list(vocabulary), len(labels)
    grams, first, whole = gram_buckets(words)
    uses = np.bincount(ids)
    known = np.flatnonzero(uses > 1)
    known = known[np.unique(whole[known], return_index=True)[1]]
    spans = np.diff(np.append(first, len(grams[0][0])))
    params = [np.zeros((BUCKETS, k)) for _ in ORDERS] + [np.zeros((len(known), k)), np.zeros((k, k))]
    moment = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    target = np.zeros((len(words), k))
    np.add.at(target, (ids, gold), 1)
    inner = np.ones(len(ids), bool)
    inner[np.cumsum(lengths) - lengths] = False
    moved = np.zeros((k, k))
    np.add.at(moved, (gold[:-1][inner[1:]], gold[1:][inner[1:]]), 1)
    for step in range(1, rounds + 1):
        scores = sum(np.add.reduceat(p[b] * v[:, None], first, axis=0) for p, (b, v) in zip(params, grams))
        scores[known] += params[-2]
        pairs = np.zeros((k, k))
        p = marginals(scores[ids], lengths, params[-1], pairs)
        expected = np.stack([np.bincount(ids, p[:, j], len(words)) for j in range(k)], 1)
        slope = target - expected
        wide = np.repeat(slope, spans, axis=0)
        grads = [np.stack([np.bincount(b[v], wide[v, j], BUCKETS) for j in range(k)], 1) for b, v in grams]
        grads += [slope[known], moved - pairs]
        for q, g, (m, s) in zip(params, grads, moment):
            g = g / len(ids) - 1e-5 * q
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            q += 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-8)
    lex = np.argsort(whole[known])
    return Field(labels, np.stack(params[:len(ORDERS)]).astype(np.float32), whole[known][lex], params[-2][lex].astype(np.float32), params[-1])


class Labeller:
    """Labels texts with one field, remembering the emission scores of words."""

    def __init__(self, field: Field):
        self.field, self.ids = field, {}
        self.scores = np.zeros((0, len(field.labels)))

    def _rows(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.ids) > REMEMBERED:
            self.ids, self.scores = {}, self.scores[:0]
        new = list(dict.fromkeys(w for ws in texts for w in ws if w not in self.ids))
        real = [w for w in new if w.isalpha() or any(c.isalpha() for c in w)]
        self.ids.update((w, -1) for w in new)
        self.ids.update(zip(real, range(len(self.scores), len(self.scores) + len(real))))
        if real:
            added = [emissions(self.field, real[i:i + 20_000]) for i in range(0, len(real), 20_000)]
            self.scores = np.concatenate([self.scores, *added])
        rows = [np.fromiter(map(self.ids.__getitem__, ws), np.int64, len(ws)) for ws in texts]
        return [r[r >= 0] if len(r) and r.min() < 0 else r for r in rows]

    def label(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(expected share of each label, number of words) per text."""
        shares, sizes = np.zeros((len(texts), len(self.field.labels))), np.zeros(len(texts), np.int64)
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        lo, most = 0, 6 * CHUNK_WORDS * 4 // max(4, len(self.field.labels))
        while lo < len(order):
            hi, chars = lo + 1, len(texts[order[lo]])
            while hi < len(order) and chars + len(texts[order[hi]]) <= most:
                chars += len(texts[order[hi]])
                hi += 1
            rows = self._rows([word_runs(texts[i].lower()) for i in order[lo:hi]])
            pick = sorted((j for j in range(len(rows)) if len(rows[j])), key=lambda j: -len(rows[j]))
            if pick and self.field.labels:
                lengths = np.array([len(rows[j]) for j in pick])
                p = marginals(self.scores[np.concatenate([rows[j] for j in pick])], lengths, self.field.moves)
                at = [order[lo + j] for j in pick]
                shares[at] = np.add.reduceat(p, np.cumsum(lengths) - lengths, axis=0) / lengths[:, None]
                sizes[at] = lengths
            lo = hi
        return shares, sizes


_LABELLERS: list[Labeller] = []


def held_out(id_col: str):
    """Whether the row is kept from learning: crc32 of the id as text leaves 2 modulo 4 (a null id is not held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """The bounded sample: per label the rows with the smallest hash of id, label and text.

    Rows of at most ``LONGEST_SAMPLE`` code points come first; longer ones are learned from up to there. The sample is
    the same however the input is split.
    """
    rows = with_row(df.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("body")))
    usable = rows.where(~held_out("id") & F.col("lang").isNotNull() & F.col("id").isNotNull() & F.col("body").isNotNull())
    usable = usable.select(ROW, "lang", F.xxhash64("id", "lang", "body").alias("draw"), (F.length("body") > LONGEST_SAMPLE).alias("long"))
    order = Window.partitionBy("lang").orderBy("long", "draw", ROW)
    often = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LABELS).collect()
    each = min(PER_LABEL, MOST_ROWS // max(1, len(often)))
    some = usable.where(F.col("lang").isin([r["lang"] for r in often]))
    picked = some.withColumn("place", F.row_number().over(order)).where(F.col("place") <= each).select(ROW, "draw")
    sample = rows.join(F.broadcast(picked), ROW).select("draw", "lang", F.substring("body", 1, LONGEST_SAMPLE).alias("body"))
    return [(r["lang"], r["body"]) for r in sorted(sample.collect())]


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Field:
    return fit(training_rows(df, id_col, text_col, lang_col))


def predict(df: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", extra: list[str] | None = None) -> DataFrame:
    """(id, held_out, lang_pred, score[, extra]) per row; only the text is an input of the prediction."""
    rows = df.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), text_or_empty(text_col).alias("body"),
                     *([F.struct(*extra).alias("extra")] if extra else []))
    model = df.sparkSession.sparkContext.broadcast(field)
    kept = [c for c in rows.columns if c != "body"]

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _LABELLERS or _LABELLERS[0].field is not model.value:
            _LABELLERS[:] = [Labeller(model.value)]
        worker = _LABELLERS[0]
        for b in batches:
            shares, sizes = worker.label(b.column("body").to_pylist())
            best = shares.argmax(1) if shares.shape[1] else sizes
            names = [worker.field.labels[j] if n and shares.shape[1] else UNKNOWN for j, n in zip(best.tolist(), sizes.tolist())]
            score = shares.max(1).clip(0, 1) if shares.shape[1] else np.zeros(len(sizes))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(names, pa.string()), pa.array(score)],
                                             [*kept, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(kept).schema)
    return rows.mapInArrow(labelled, fields + ", lang_pred string, score double").withColumnRenamed("id", id_col)


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score) per row of ``df``, with a field trained on its own labelled rows.

    ``und`` with score 0 for a null text, a text without a letter, and where no labelled row exists. The sample
    is ``PER_LABEL`` rows per label (``MOST_ROWS`` in all) of at most ``LONGEST_SAMPLE`` code points; prediction covers all rows and whole
    texts. Ids may be null or repeat; an empty table gives an empty result; other columns are not read.
    """
    return predict(df, train(df, id_col, text_col, lang_col), id_col, text_col)


def keep_identified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.35) -> DataFrame:
    """Rows of ``df`` whose language is known with ``least`` expected share; the others go.

    Where no label is known, there is no language to reject, and every row with a letter stays.
    """
    field = train(df, id_col, text_col, lang_col)
    if not field.labels:
        return df.where(F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    out = predict(df, field, id_col, text_col, df.columns)
    return out.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("extra.*")
