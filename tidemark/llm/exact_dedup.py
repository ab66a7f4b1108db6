"""Exact deduplication by Patricia-trie owners.

Texts are compared as whole byte strings in compressed radix tries; a terminal node holds the owner of its text
and the number of rows. Each input task first builds tries of its own rows, so a text with very many copies
leaves a task as one row. Those rows are dealt by (length, content hash), in any order. A trie above ``trie_bytes``
spills its heaviest subtrees: their texts leave the task as rows of a table in the shared folder, and a mark in the
trie sends later texts below the same prefix after them. Spilled texts are dealt over more tries until none spills;
every trie completes one text at least. A lost executor only repeats its partitions.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BATCH_BYTES, ROW, shared_table, text_or_empty, with_row

#: Fixed value: the ASCII white space that the comparison leaves out.
BLANK = b" \t\n\x0b\x0c\r"
TRIE_BYTES = 48 << 20
#: What a node weighs beside the label of its edge.
NODE = 200


class Patricia:
    """Compressed radix trie over byte strings. A node is [edges by first byte, terminal, whether texts below it were spilled]."""

    def __init__(self):
        self.root: list = [{}, None, False]
        self.held = 0

    @staticmethod
    def _shared(label: bytes, key: bytes, at: int) -> int:
        low, high = 1, min(len(label), len(key) - at)
        while low < high:
            mid = (low + high + 1) // 2
            if label[:mid] == key[at:at + mid]:
                low = mid
            else:
                high = mid - 1
        return low

    def terminal(self, key: bytes) -> list:
        """The node of ``key``, made if absent."""
        node, at = self.root, 0
        while at < len(key):
            edge = node[0].get(key[at])
            if edge is None:
                leaf = [{}, None, False]
                node[0][key[at]] = (key[at:], leaf)
                self.held += len(key) - at + NODE
                return leaf
            label, below = edge
            if key.startswith(label, at):
                node, at = below, at + len(label)
                continue
            k = self._shared(label, key, at)
            fork = [{label[k]: (label[k:], below)}, None, False]
            node[0][label[0]] = (label[:k], fork)
            self.held += NODE
            node, at = fork, at + k
        return node

    @staticmethod
    def _below(prefix: bytes, node: list, spilled: bool) -> Iterator[tuple[bytes, list, bool]]:
        stack = [(prefix, node, spilled)]
        while stack:
            prefix, node, spilled = stack.pop()
            spilled = spilled or node[2]
            if node[1] is not None:
                yield prefix, node[1], spilled
            stack.extend((prefix + label, below, spilled) for label, below in node[0].values())

    def texts(self) -> Iterator[tuple[bytes, list, bool]]:
        """(text, terminal, whether the text may have been spilled before)."""
        return self._below(b"", self.root, False)

    def _weights(self) -> dict[int, tuple[int, int, int]]:
        """Per node: bytes of its subtree without its own edge, texts, and texts that no mark covers."""
        order, stack = [], [(self.root, False)]
        while stack:
            node, spilled = stack.pop()
            spilled = spilled or node[2]
            order.append((node, spilled))
            stack.extend((below, spilled) for _, below in node[0].values())
        out: dict[int, tuple[int, int, int]] = {}
        for node, spilled in reversed(order):
            size, n, free = 0, int(node[1] is not None), int(node[1] is not None and not spilled)
            for label, below in node[0].values():
                weight = out[id(below)]
                size, n, free = size + len(label) + NODE + weight[0], n + weight[1], free + weight[2]
            out[id(node)] = size, n, free
        return out

    def spill(self, most: int) -> Iterator[tuple[bytes, list, bool]]:
        """Take the heaviest subtrees out until ``most`` bytes are held, but for one text that no mark covers."""
        weights = self._weights()
        free, ties, heap = weights[id(self.root)][2], 0, []

        def offer(node: list, prefix: bytes):
            nonlocal ties
            for first, (label, below) in node[0].items():
                if weights[id(below)][1]:
                    ties += 1
                    heapq.heappush(heap, (-weights[id(below)][0] - len(label), ties, node, first, prefix))

        offer(self.root, b"")
        while heap and self.held > most:
            _, _, node, first, prefix = heapq.heappop(heap)
            label, below = node[0][first]
            size, n, own = weights[id(below)]
            # A subtree that is most of the trie is opened, so that its larger parts go first.
            if not below[2] and n > 1 and (size > most or own == free):
                offer(below, prefix + label)
                continue
            if own and own == free:
                continue
            free -= own
            yield from self._below(prefix + label, below, True)
            node[0][first] = (label[:1], [{}, None, True])
            self.held -= size + len(label) - 1


def better(a: tuple, b: tuple) -> bool:
    """Whether owner a = (points, id, row) goes before b: more code points, then smaller id (null last), then row."""
    return (-a[0], a[1] is None, a[1] if a[1] is not None else 0, a[2]) < (
        -b[0], b[1] is None, b[1] if b[1] is not None else 0, b[2])


def insert(trie: Patricia, key: bytes, owner: tuple, n: int) -> None:
    node = trie.terminal(key)
    if node[1] is None:
        node[1] = [owner, n]
    else:
        node[1][1] += n
        if better(owner, node[1][0]):
            node[1][0] = owner


def owners(df: DataFrame, id_kind: str, trie_bytes: int) -> DataFrame:
    """(sha, keep_id, keep_row, n) per distinct text of (id, __row, points, body)."""
    entry = f"n_bytes long, h long, body binary, points long, id {id_kind}, {ROW} long, n long"
    kinds = df.schema["id"].dataType

    def batches_of(texts: Iterator[tuple], to_batch) -> Iterator[pa.RecordBatch]:
        """Batches of at most 2,000 texts and some megabytes."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text[0])
            if len(held) == 2000 or size > BATCH_BYTES:
                yield to_batch(held)
                held, size = [], 0
        if held:
            yield to_batch(held)

    def id_array(values):
        from pyspark.sql.pandas.types import to_arrow_type

        return pa.array(values, to_arrow_type(kinds))

    def entries(texts: list[tuple]) -> pa.RecordBatch:
        keys = [key for key, *_ in texts]
        p, i, r = zip(*(owner for _, (owner, _), _ in texts))
        return pa.RecordBatch.from_arrays(
            [pa.array(map(len, keys), pa.int64()), pa.array([xxhash.xxh3_64_intdigest(k) - (1 << 63) for k in keys], pa.int64()),
             pa.array(keys, pa.binary()), pa.array(p, pa.int64()), id_array(i), pa.array(r, pa.int64()),
             pa.array([n for _, (_, n), _ in texts], pa.int64())], ["n_bytes", "h", "body", "points", "id", ROW, "n"])

    def results(texts: list[tuple]) -> pa.RecordBatch:
        """Entries with the digest of complete texts; of spilled ones the text itself goes on."""
        batch = entries(texts)
        sha = pa.array([None if spilled else hashlib.sha256(key).digest() for key, _, spilled in texts], pa.binary())
        body = pa.array([key if spilled else None for key, _, spilled in texts], pa.binary())
        return pa.RecordBatch.from_arrays([sha, *(body if c == "body" else batch.column(c) for c in batch.schema.names)],
                                          ["sha", *batch.schema.names])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Patricia()
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("body", "points", "id", ROW)]
            for body, points, i, row in zip(*cols):
                insert(trie, body.translate(None, BLANK), (points, i, row), 1)
                if trie.held > trie_bytes:
                    yield from batches_of(trie.texts(), entries)
                    trie = Patricia()
        yield from batches_of(trie.texts(), entries)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, limit = Patricia(), trie_bytes
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("body", "points", "id", ROW, "n")]
            for body, points, i, row, n in zip(*cols):
                insert(trie, body, (points, i, row), n)
                if trie.held > limit:
                    yield from batches_of(trie.spill(trie_bytes // 2), results)
                    limit = max(trie_bytes, trie.held + trie_bytes // 2)
        yield from batches_of(trie.texts(), results)

    dealt, done, turn = df.mapInArrow(local, entry).repartition("n_bytes", "h"), [], 0
    while True:
        found = shared_table(dealt.mapInArrow(merged, f"sha binary, {entry}"), "tries")
        done.append(found.where("sha IS NOT NULL").select("sha", F.col("id").alias("keep_id"), F.col(ROW).alias("keep_row"), "n"))
        spilled = found.where("sha IS NULL").drop("sha")
        texts, size = spilled.agg(F.count("*"), F.sum(F.col("n_bytes") + NODE)).first()
        if not texts:
            return functools.reduce(DataFrame.union, done)
        turn += 1
        tries = min(texts, size // max(1, trie_bytes // 2)) + 1
        dealt = spilled.repartition(tries, F.xxhash64("n_bytes", "h", F.lit(turn)))


def decisions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES,
              extra: list[str] | None = None) -> DataFrame:
    """Columns of ``exact_dedup`` with the row key; ``df`` has it already. ``extra`` columns are carried along."""
    kind = df.schema[id_col].dataType.simpleString()
    body = text_or_empty(text_col)
    own = owners(df.select(F.col(id_col).alias("id"), ROW, F.length(body).cast("long").alias("points"),
                           body.cast("binary").alias("body")), kind, trie_bytes)
    digest = F.unhex(F.sha2(F.regexp_replace(body, r"[\x20\x09-\x0D]+", ""), 256))
    rows = df.select(F.col(id_col).alias("id"), ROW, digest.alias("sha"), *([F.struct(*extra).alias("extra")] if extra else []))
    return rows.join(own, "sha").select(
        F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), (F.col(ROW) == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), ROW, *(["extra"] if extra else []))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) per row.

    Texts are equal when identical without ASCII white space; null counts as empty, so null, empty and blank
    texts are one group. The row with the most code points stays, then the smallest id (null last), then the
    first row: of repeated rows exactly one is kept. An empty table gives an empty result; other columns are
    not read.
    """
    return decisions(with_row(df.select(id_col, text_col)), id_col, text_col, trie_bytes).drop(ROW)


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept rows of ``df`` with all their columns."""
    out = decisions(with_row(df), id_col, text_col, extra=df.columns)
    return out.where("kept").select("extra.*")
