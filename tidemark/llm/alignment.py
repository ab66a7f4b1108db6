"""Cross-tokenizer alignment by lockstep vectorised merging.

Both tokenizations of a text cover the same bytes. A NumPy state vector holds one (A, B) pair of pointers for every
document of a batch and advances all of them at once: each step emits one link per document, moves the pointer whose
token ends first (both where they end together, which is a cut) and compacts finished documents away. Long
documents take several places of the vector, each from one common token border to another, so that a batch needs no
more steps than a piece of text has tokens.

Links of a batch are kept as numbers into the batch's own table of id pairs. Only those tables, one row per batch and
pair, are counted corpus-wide and joined; the answers return to their batch in one group, which is as small as the batch.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import RANKS_FILE, shared_table, text_or_empty, tokenizer_path
from tidemark.llm.packing import LONG_RUN

PIECES_FILE = "piece_bpe_32k.model"
#: Bytes of text in a batch (one longer text is a batch of its own), and between the cuts of long texts.
CHUNK_BYTES, PIECE_BYTES = 4 << 20, 8192
#: A tokens beside the place of a cut among which a common border is searched; without one the piece is longer.
SEARCHED = 64
FACTS = ["n_a", "n_b", "n_groups", "n_links"]


@functools.cache
def _byte_alphabet() -> dict[str, int]:
    """Characters of byte-level vocabularies: printable bytes are themselves, the others count up from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Texts to token ids, and the bytes and byte lengths of every id."""

    def __init__(self, token_bytes: list[bytes]):
        self.bytes = token_bytes
        self.lengths = np.array([len(b) for b in token_bytes], np.int64)

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


class ByteEncoder(Encoder):
    """The byte-level tokenizer without special tokens; usual texts go through the same vocabulary as ranks."""

    def __init__(self, path: str, ranks_path: str):
        import base64

        import public_tokenizers
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.odd = regex.compile(rf"\S{{{LONG_RUN}}}|\s{{{LONG_RUN}}}").search
        alphabet = _byte_alphabet()
        entries = [self.tok.id_to_token(i) or "" for i in range(self.tok.get_vocab_size())]
        super().__init__([bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t in entries])

    def encode(self, text: str) -> np.ndarray:
        if len(text) > LONG_RUN and self.odd(text):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.int64)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)


class PieceEncoder(Encoder):
    """The piece tokenizer; byte pieces stand for their byte."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        super().__init__([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                          for i, p in ((i, self.model.id_to_piece(i)) for i in range(n))])

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, num_threads=1), np.int64)


@functools.cache
def encoders(path: str, ranks_path: str, pieces_path: str) -> tuple[ByteEncoder, PieceEncoder]:
    """Both tokenizers, once per worker process."""
    return ByteEncoder(path, ranks_path), PieceEncoder(pieces_path)


@functools.cache
def _written(n_a: int, n_b: int) -> np.ndarray:
    """Ids as they stand in the text of groups: A ids before a comma, before a bar, B ids before a comma, a semicolon."""
    return np.array([f"{i}{end}" for n, ends in ((n_a, ",|"), (n_b, ",;")) for end in ends for i in range(n)], dtype=object)


def piece_starts(ends_a: np.ndarray, ends_b: np.ndarray, piece_bytes: int) -> list[tuple[int, int]]:
    """First A and B tokens of the pieces of one document: places where tokens of both sides begin."""
    starts = [(0, 0)]
    for target in range(piece_bytes, int(ends_a[-1]) - piece_bytes // 2, piece_bytes):
        first = max(int(np.searchsorted(ends_a, target)), starts[-1][0])
        near = ends_a[first:first + SEARCHED]
        at = np.searchsorted(ends_b, near)
        common = np.flatnonzero(ends_b[np.minimum(at, len(ends_b) - 1)] == near)
        if len(common) and first + common[0] + 1 < len(ends_a):
            starts.append((first + int(common[0]) + 1, int(at[common[0]]) + 1))
    return starts


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, start_a: np.ndarray, start_b: np.ndarray, stop_a: np.ndarray):
    """((place, A, B) of every link, (place, A end, B end) of every group), both ordered by place and step.

    ``ends_*`` are byte offsets of token ends; place k merges A tokens start_a[k]:stop_a[k] with the B tokens from
    start_b[k] on that cover the same bytes.
    """
    place, i, j, stop = np.arange(len(start_a), dtype=np.int32), start_a.copy(), start_b.copy(), stop_a
    links, cuts = [], []
    while len(place):
        links.append((place, i, j))
        a, b = ends_a[i], ends_b[j]
        i, j = i + (a <= b), j + (b <= a)
        cut = a == b
        if cut.any():
            at = np.flatnonzero(cut)
            cuts.append((place[at], i[at], j[at]))
            live = i < stop
            if not live.all():
                place, i, j, stop = place[live], i[live], j[live], stop[live]
    out = []
    for steps in (links, cuts):
        columns = [np.concatenate(c) if steps else np.zeros(0, np.int64) for c in (zip(*steps) if steps else ((), (), ()))]
        order = np.argsort(columns[0], kind="stable")
        out.append(tuple(c[order] for c in columns))
    return out


class Aligned:
    """One batch: facts per text, its id pairs with their links, and the pair numbers of each text."""

    def __init__(self, texts: list[str | None], a: Encoder, b: Encoder, piece_bytes: int = PIECE_BYTES):
        n = len(texts)
        self.facts = np.zeros((4, n), np.int64)
        self.digests = [""] * n
        self.pairs, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.own_docs, self.own_pairs, self.own_counts = (np.zeros(0, np.int64) for _ in range(3))
        docs, ids_a, ids_b, ends_a, ends_b, starts = [], [], [], [], [], []
        at_a = at_b = at = 0
        for doc, text in enumerate(texts):
            if not text:
                continue
            x, y, whole = a.encode(" " + text), b.encode(text), (" " + text).encode()
            if a.joined(x) != whole or b.joined(y) != whole:
                continue
            ex, ey = np.cumsum(a.lengths[x]), np.cumsum(b.lengths[y])
            for p, q in piece_starts(ex, ey, piece_bytes):
                starts.append((len(docs), at_a + p, at_b + q))
            docs.append(doc)
            ids_a.append(x)
            ids_b.append(y)
            ends_a.append(ex + at)
            ends_b.append(ey + at)
            at_a, at_b, at = at_a + len(x), at_b + len(y), at + len(whole)
        if not docs:
            return
        sizes_a, sizes_b = ([len(x) for x in ids] for ids in (ids_a, ids_b))
        docs, ids_a, ids_b = np.array(docs), np.concatenate(ids_a), np.concatenate(ids_b)
        ends_a, ends_b = np.concatenate(ends_a), np.concatenate(ends_b)
        owner, start_a, start_b = (np.array(c, np.int64) for c in zip(*starts))
        links, cuts = lockstep(ends_a, ends_b, start_a, start_b, np.append(start_a[1:], at_a))
        link_doc, cut_doc = owner[links[0]], owner[cuts[0]]
        per_doc = [sizes_a, sizes_b, np.bincount(cut_doc, minlength=len(docs)), np.bincount(link_doc, minlength=len(docs))]
        self.facts[:, docs] = per_doc
        for doc, digest in zip(docs.tolist(), self._digests(ids_a, ids_b, cuts[1], cuts[2], cut_doc, len(a.bytes), len(b.bytes))):
            self.digests[doc] = digest
        pair = ids_a[links[1]] << 32 | ids_b[links[2]]
        self.pairs, number, self.counts = np.unique(pair, return_inverse=True, return_counts=True)
        own, self.own_counts = np.unique(docs[link_doc] * len(self.pairs) + number, return_counts=True)
        self.own_docs, self.own_pairs = np.divmod(own, len(self.pairs))

    @staticmethod
    def _digests(ids_a, ids_b, cut_a, cut_b, cut_doc, n_a, n_b) -> Iterator[str]:
        """SHA-256 of each document's groups. A group's A ids stand before its B ids, so every token's place is known."""
        last_a, last_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
        last_a[cut_a - 1] = last_b[cut_b - 1] = True
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        order = np.empty(len(ids_a) + len(ids_b), np.int64)
        order[np.arange(len(ids_a)) + np.concatenate(([0], cut_b))[group_a]] = ids_a + n_a * last_a
        order[np.arange(len(ids_b)) + cut_a[group_b]] = 2 * n_a + ids_b + n_b * last_b
        text = _written(n_a, n_b)
        stops = np.flatnonzero(np.diff(cut_doc, append=-1))
        begin = 0
        for end in (cut_a[stops] + cut_b[stops]).tolist():
            yield hashlib.sha256("".join(text[order[begin:end]].tolist())[:-1].encode()).hexdigest()
            begin = end


def align(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, ranks_path: str | None = None,
          pieces_path: str | None = None, chunk_bytes: int = CHUNK_BYTES, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row.

    Tokenizer A reads a space and the text, B the text (it adds the space itself). Null and empty texts, and texts whose
    tokens do not spell exactly a space and the text, have no tokens: zeros and an empty digest. ids may be null
    or repeat, since rows never meet; an empty table gives an empty result; other columns are not read.
    """
    path, ranks_path, pieces_path = path or tokenizer_path(), ranks_path or tokenizer_path(RANKS_FILE), pieces_path or tokenizer_path(PIECES_FILE)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("body"))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = encoders(path, ranks_path, pieces_path)
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            size = np.cumsum(pa.compute.binary_length(batch.column("body")).to_numpy(zero_copy_only=False))
            begin = 0
            while begin < batch.num_rows:
                done = size[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(size, done + chunk_bytes, "right")))
                part = batch.slice(begin, end - begin)
                got = Aligned(part.column("body").to_pylist(), a, b, piece_bytes)
                n, begin, chunk = part.num_rows, end, chunk + 1
                offsets = np.searchsorted(got.own_docs, np.arange(n + 1))
                lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(v, pa.int32())) for v in (got.own_pairs, got.own_counts)]
                blank = pa.nulls(n, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, chunk)), part.column("id"), *map(pa.array, got.facts), pa.array(got.digests, pa.string()), *lists, blank, blank],
                    ["chunk", "id", *FACTS, "groups_sha256", "nos", "ns", "pairs", "counts"])
                if len(got.pairs):
                    kinds = [part.schema.field("id").type, *[pa.int64()] * 4, pa.string(), *[pa.list_(pa.int32())] * 2]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([chunk]), *(pa.nulls(1, k) for k in kinds), pa.array([got.pairs], pa.list_(pa.int64())),
                         pa.array([got.counts], pa.list_(pa.int64()))],
                        ["chunk", "id", *FACTS, "groups_sha256", "nos", "ns", "pairs", "counts"])

    facts = ", ".join(f"{c} long" for c in FACTS)
    schema = f"chunk long, id {kind}, {facts}, groups_sha256 string, nos array<int>, ns array<int>, pairs array<long>, counts array<long>"
    kept = shared_table(rows.mapInArrow(merged, schema), "alignment")
    tables = kept.where("pairs IS NOT NULL").select("chunk", F.posexplode(F.arrays_zip("pairs", "counts")).alias("no", "x"))
    tables = tables.select("chunk", "no", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    # A B id meets at most as many A ids as the vocabulary has, which bounds the window.
    total = tables.groupBy("pair").agg(F.sum("n").alias("total"))
    highest = F.max("total").over(Window.partitionBy(F.col("pair").bitwiseAND(0xFFFFFFFF)))
    total = total.select("pair", "total", (F.col("total") == highest).cast("long").alias("best"))
    answers = tables.join(total, "pair").select(F.col("chunk").alias("of"), "no", "total", "best")

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        size = len(right)
        total, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        no = right.column("no").to_numpy()
        total[no], best[no] = right.column("total").to_numpy(), right.column("best").to_numpy()
        nos, ns = (np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in left.column(name).chunks] or [np.zeros(0, np.int64)])
                   for name in ("nos", "ns"))
        length = pa.compute.list_value_length(left.column("nos")).to_numpy()
        end = np.cumsum(length)
        sums = []
        for v in (best, total):
            run = np.concatenate(([0], np.cumsum(v[nos] * ns.astype(np.int64))))
            sums.append(pa.array(run[end] - run[end - length], pa.int64()))
        return pa.table([left.column("id"), *(left.column(c) for c in FACTS), *sums, left.column("groups_sha256")],
                        [id_col, *FACTS, "n_best", "count_sum", "groups_sha256"])

    texts = kept.where("pairs IS NULL").drop("pairs", "counts")
    return texts.groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(
        summed, f"`{id_col}` {kind}, {facts}, n_best long, count_sum long, groups_sha256 string")
