"""Token counts by the whole-token shortcut.

Byte-pair encoding never merges across pre-tokens, so a text's count is the sum over its pre-tokens. Every
vocabulary string that the library itself encodes as exactly one token is put into a table before counting
(``whole_tokens``); pre-tokens found there count one without any merging, and only the others are merged by
the library, each distinct one once per worker.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPECIAL, library, text_or_empty, tokenizer_path

#: Fixed value: code points whose class (letter, number, space, other) may differ between the pre-tokenizer's regex
#: engine and the ``regex`` module, since their Unicode versions do; tests/llm proves that no others do. Texts with one of
#: these go through the library whole.
UNSURE = ("\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7f1\uab6c\uab6d\U000107bb-\U0001e6ff"
          "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U0010ffff")
#: Distinct merged pre-tokens that a worker remembers, and the longest of them; the rest is merged again.
REMEMBERED, LONGEST = 400_000, 64


def whole_tokens(path: str) -> list[str]:
    """Vocabulary strings that, encoded alone by the library, give one token and one pre-token."""
    tok = library(path)
    texts = [tok.decode([i], skip_special_tokens=False) for i in range(tok.get_vocab_size())]
    texts = [t for t in texts if t and t != SPECIAL and "\ufffd" not in t]
    return [t for t, e in zip(texts, tok.encode_batch(texts, add_special_tokens=False)) if len(e.ids) == 1]


class Counts(dict):
    """Tokens per pre-token; unknown ones are merged by the library and remembered."""

    def __init__(self, path: str):
        self.whole = dict.fromkeys(whole_tokens(path), 1)
        super().__init__(self.whole)
        self.tok = library(path)

    def __missing__(self, piece: str) -> int:
        n = len(self.tok.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= LONGEST:
            if len(self) > len(self.whole) + REMEMBERED:
                self.clear()
                self.update(self.whole)
            self[piece] = n
        return n


@functools.cache
def counter(path: str):
    """Function from a text to its number of tokens, one per worker process."""
    import public_tokenizers
    import regex

    counts, tok = Counts(path), library(path)
    pieces, odd = regex.compile(public_tokenizers.PATTERN).findall, regex.compile(f"[{UNSURE}]").search

    def count(text: str) -> int:
        if not text.isascii() and odd(text):
            return len(tok.encode(text, add_special_tokens=False).ids)
        parts = text.split(SPECIAL)
        return len(parts) - 1 + sum(sum(map(counts.__getitem__, pieces(p))) for p in parts)

    return count


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 512,
                 path: str | None = None) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) per row of ``df``.

    A null text counts as empty (0 tokens); ids may be null or repeat, since rows are never matched; an empty table
    gives an empty result; other columns are not read. Nothing is shuffled.
    """
    path = path or tokenizer_path()
    rows = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("body"))
    rows = rows.withColumn("n_bytes", F.octet_length("body").cast("long"))
    kind = df.schema[id_col].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for b in batches:
            n = pa.array([count(t) for t in b.column("body").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), n], ["id", "n_bytes", "n_tokens"])

    out = rows.mapInArrow(counted, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
