"""Near-duplicates by DartMinHash.

A text is the multiset of its five-word shingles: one region of weight per shingle, as wide as it occurs often.
Darts are thrown by hashing: every unit of weight and of rank holds one dart, with a rank and a coordinate given by
its hash, so two texts that share a region share its darts. The earliest dart of each coordinate is the signature;
texts agree in a coordinate with the probability of their weighted Jaccard similarity. A text with much weight
needs few ranks and a short one few regions, so the work grows with the words, not with words times coordinates.
A text that repeats shingles has a second signature, of its first occurrences alone: there texts agree with the
probability of the similarity of their sets. Without repeats, both signatures are the same.

Bands of the signatures file texts in buckets. Large groups are never expanded into pairs: equal multisets are
folded first, and each bucket compares its members with one leader (the member that meets most others). Where the
buckets of a leader still hold several components, the rarest shingles of their members say who can be linked at all:
two texts of the asked similarity share one of them. Only members that share some across components go on and are
compared tile by tile. Every link is checked on the whole shingle lists.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ROW, shared_table, text_or_empty, with_row
from tidemark.llm.graph import components
from tidemark.llm.shingles import jaccards, mix, occurrence, shingle_hashes
from tidemark.session import cut_lineage

SIMILARITY = 0.8
#: 40 bands of 6: a pair of similarity 0.8, as sets or as multisets, meets in a bucket with probability 1 - 6e-6.
BANDS, BAND_ROWS = 40, 6
#: Bytes of text and darts handled at once.
CHUNK_BYTES, CHUNK_DARTS = 1 << 20, 1 << 19
#: Members of a tile; shingle lists are compared from the similarity less this on, five deviations of the estimate.
TILE, MARGIN = 1024, 0.13


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK_BYTES:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if texts:
        yield lo, len(texts)


def signatures(hashes: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Signature (texts x k) of 64-bit dart ranks; texts without shingles keep the largest value everywhere."""
    texts = len(counts)
    sig = np.full(texts * k, ~np.uint64(0))
    region = mix(hashes + occurrence(hashes, counts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    heads = np.cumsum(counts) - counts
    wanted = k * math.log(k) + 2 * k
    open_ = np.flatnonzero(counts > 0)
    done = np.zeros(texts, np.int64)  # ranks thrown so far
    more = np.ceil(wanted / np.maximum(counts, 1)).astype(np.int64)
    while len(open_):
        darts = np.cumsum(counts[open_] * more[open_])
        cuts = np.unique(np.append(np.searchsorted(darts, np.arange(CHUNK_DARTS, darts[-1], CHUNK_DARTS)), [0, len(open_)]))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            some = open_[lo:hi]
            n = counts[some] * more[some]
            owner = np.repeat(some, n)
            i = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            rank = done[owner] + i // counts[owner]
            dart = mix(region[heads[owner] + i % counts[owner]] + rank.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))
            coordinate = ((dart >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
            value = rank.astype(np.uint64) << np.uint64(32) | dart & np.uint64(0xFFFFFFFF)
            first = (counts[owner] < 2 * wanted) | (value < np.uint64(2 ** 32) * (2 * wanted / counts[owner])) | (rank > 0)
            np.minimum.at(sig, owner[first] * k + coordinate[first], value[first])
        done[open_] += more[open_]
        empty = (sig.reshape(texts, k)[open_] == ~np.uint64(0)).any(1)
        open_ = open_[empty]
        more = np.maximum(1, done // 2)
    return sig.reshape(texts, k)


def set_signatures(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(texts, signatures) over the distinct shingles of the texts that repeat some; elsewhere it is the signature."""
    again, owner = occurrence(hashes, counts) > 0, np.repeat(np.arange(len(counts)), counts)
    some = np.unique(owner[again])
    once = ~again & np.isin(owner, some)
    return some, signatures(hashes[once], np.bincount(owner[once], minlength=len(counts))[some], k)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(sig), bands)).copy()
    for r in range(rows):
        keys = mix(keys + sig[:, r::rows][:, :bands])
    return keys


def low_bytes(sig: np.ndarray) -> np.ndarray:
    return (sig & np.uint64(0xFF)).astype(np.uint8)


def prints(df: DataFrame, id_kind: str, bands: int, rows: int) -> DataFrame:
    """(id, __row, p1, p2, bands, sig, sets) per row of (id, __row, body); null prints where a text has no words.

    ``bands`` are those of both signatures; ``sets`` is null where the signature of the set is the same.
    """

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("body").to_pylist()
            for lo, hi in chunks(texts):
                h, n = shingle_hashes(texts[lo:hi])
                sig = signatures(h, n, bands * rows)
                keys = list(band_keys(sig, bands, rows).view(np.int64))
                some, set_sig = set_signatures(h, n, bands * rows)
                sets: list[bytes | None] = [None] * len(n)
                for i, s, more in zip(some.tolist(), low_bytes(set_sig), band_keys(set_sig, bands, rows).view(np.int64)):
                    sets[i], keys[i] = s.tobytes(), np.unique(np.append(keys[i], more))
                heads, none = np.cumsum(n) - n, n == 0
                sums = [np.zeros(len(n), np.uint64) for _ in range(2)]
                for s, salt in zip(sums, (0x1234567, 0x89ABCDEF)):
                    if len(h):
                        s[~none] = np.add.reduceat(mix(h ^ np.uint64(salt)), heads[~none])
                small = low_bytes(sig)
                cut = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [cut.column("id"), cut.column(ROW), *(pa.array(s.view(np.int64), mask=none) for s in sums),
                     pa.array([None if z else k for z, k in zip(none, keys)], pa.list_(pa.int64())),
                     pa.array([None if z else s.tobytes() for z, s in zip(none, small)], pa.binary()), pa.array(sets, pa.binary())],
                    ["id", ROW, "p1", "p2", "bands", "sig", "sets"])

    return df.mapInArrow(sketched, f"id {id_kind}, {ROW} long, p1 long, p2 long, bands array<long>, sig binary, sets binary")


def shingle_lists(df: DataFrame) -> DataFrame:
    """(node, list): the sorted shingle hashes of (node, body)."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("body").to_pylist()
            for lo, hi in chunks(texts):
                h, n = shingle_hashes(texts[lo:hi])
                stop = np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [b.column("node").slice(lo, hi - lo),
                     pa.array([h[s - c:s].tobytes() for s, c in zip(stop.tolist(), n.tolist())], pa.binary())], ["node", "list"])

    return df.mapInArrow(listed, "node long, list binary")


def checked(pairs: DataFrame, lists: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets or multisets reach the similarity."""

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [max(jaccards(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))) >= least
                  for x, y in zip(b.column("la").to_pylist(), b.column("lb").to_pylist())]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    a = lists.select(F.col("node").alias("a"), F.col("list").alias("la"))
    b = lists.select(F.col("node").alias("b"), F.col("list").alias("lb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "la", "lb").mapInArrow(close, "a long, b long")


def tile_links(a: pa.Table, b: pa.Table, width: int, least: float) -> list[tuple[int, int]]:
    """Links between the components of the probes ``a`` and of the members ``b`` of a tile, at most one for any two: the
    likeliest pairs are checked first. Pairs of two probes are checked on one side."""

    def both(t: pa.Table) -> list[list[bytes]]:
        sigs = t["sig"].to_pylist()
        return [sigs, [m if s is None else s for m, s in zip(sigs, t["sets"].to_pylist())]]

    # Shares of equal coordinates, of the multisets and of the sets; the larger one counts.
    kinds = [np.frombuffer(b"".join(s), np.uint8).reshape(-1, width) for s in both(b)]
    nb, cb, rest, probe = (b[c].to_numpy() for c in ("node", "comp", "rest", "probe"))
    lists = {n: np.frombuffer(x, np.uint64) for t in (a, b) for n, x in zip(t["node"].to_pylist(), t["list"].to_pylist())}
    same: dict[int, int] = {}

    def root(c: int) -> int:
        while c in same:
            c = same[c]
        return c

    out = []
    for node, comp, outside, *sigs in zip(*(a[c].to_pylist() for c in ("node", "comp", "rest")), *both(a)):
        same_at = np.maximum(*[(k == np.frombuffer(s, np.uint8)).mean(1) for k, s in zip(kinds, sigs)])
        guess = (same_at - 1 / 256) * (256 / 255)
        near = np.flatnonzero((guess >= least - MARGIN) & (cb != comp) & (rest | outside) & (~probe | (nb > node)))
        for j in near[np.argsort(-guess[near], kind="stable")].tolist():
            other = root(int(cb[j]))
            if other != root(comp) and max(jaccards(lists[node], lists[int(nb[j])])) >= least:
                same[other] = root(comp)
                out.append((comp, int(cb[j])))
    return out


def list_tokens(lists: DataFrame) -> DataFrame:
    """(node, token, first, size, set_size) per shingle occurrence: equal texts as multisets have equal tokens, and those
    marked ``first`` are the tokens of the set."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("list").to_pylist()
            for lo, hi in chunks(texts):
                counts = np.array([len(t) // 8 for t in texts[lo:hi]], np.int64)
                hashes = np.frombuffer(b"".join(texts[lo:hi]), np.uint64)
                nth, owner = occurrence(hashes, counts), np.repeat(np.arange(len(counts)), counts)
                token = mix(hashes + nth.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)).view(np.int64)
                once = np.bincount(owner[nth == 0], minlength=len(counts))
                nodes = b.column("node").slice(lo, hi - lo).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes[owner]), pa.array(token), pa.array((nth == 0).astype(np.int32)),
                     pa.array(counts[owner].astype(np.int32)), pa.array(once[owner].astype(np.int32))],
                    ["node", "token", "first", "size", "set_size"])

    return lists.mapInArrow(told, "node long, token long, first int, size int, set_size int")


def areas(open_nodes: DataFrame, lists: DataFrame, least: float) -> DataFrame:
    """(node, area, probe) of the ``open_nodes`` (node, comp, rest) that may be linked across components; no row for others.

    Tokens are put in one order, those that occur in most of the ``rest`` nodes first. Texts of x <= y tokens and the asked
    similarity s share s / (1 + s) * (x + y) of them or more, so the last one they share stands at that place or later
    in both: at 2s / (1 + s) * x or later in the smaller text, which makes it a ``probe``, and at s * y or later in the larger.
    Nodes that share such a token lie in one area, unless all with it are of one component or none is its probe. So texts
    that agree in common tokens only, and each has enough of its own, are left out.
    """
    lists = lists.select("node", "list")
    used = list_tokens(lists.join(open_nodes.where("rest"), "node", "left_semi")).groupBy("token").agg(F.count("*").alias("n"))
    common_first = Window.partitionBy("node").orderBy(F.desc("n"), "token")
    at = list_tokens(lists.join(open_nodes, "node", "left_semi")).join(used, "token").select(
        "node", "token", "first", "size", "set_size", F.row_number().over(common_first).alias("at"),
        F.sum("first").over(common_first.rowsBetween(Window.unboundedPreceding, 0)).alias("set_at"))

    def reaches(share: float) -> Column:
        share = F.lit(share - 1e-9)
        return (F.col("at") >= share * F.col("size")) | ((F.col("first") == 1) & (F.col("set_at") >= share * F.col("set_size")))

    rare = at.where(reaches(least)).select("node", "token", reaches(2 * least / (1 + least)).alias("probe")).join(open_nodes, "node")
    rare = shared_table(rare, "near-rare")
    hubs = rare.groupBy("token").agg(F.min("node").alias("hub"), F.min("comp").alias("one"), F.max("comp").alias("other"),
                                     F.max("rest").alias("rest"), F.max("probe").alias("probed"))
    hubs = hubs.where("one <> other AND rest AND probed").select("token", "hub")
    near = cut_lineage(rare.join(hubs, "token").groupBy("node", "hub").agg(F.max("probe").alias("probe")))
    probes = near.groupBy("node").agg(F.max("probe").alias("probe"))
    links = near.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    return components(links).withColumnRenamed("comp", "area").join(probes, "node")


def rest_links(groups: DataFrame, labels: DataFrame, sigs: DataFrame, lists: DataFrame, width: int, least: float) -> DataFrame:
    """Links (a, b) from component to component that the leaders left apart.

    Two texts that meet in a bucket meet in the group of its leader. In groups with several components, members are
    told apart by their areas; in each area, probes are compared with all members, tile by tile, where one of the two
    lies outside the area's largest component; only links that hold leave a tile.
    """
    named = groups.join(labels, "node", "left").select("leader", "node", F.coalesce("comp", "node").alias("comp"))
    named = cut_lineage(named)

    def several(rows: DataFrame, *keys: str) -> DataFrame:
        by_comp = rows.groupBy(*keys, "comp").agg(F.count("*").alias("n"))
        of = by_comp.groupBy(*keys).agg(
            F.count("*").alias("comps"), F.sum("n").alias("members"), F.max_by("comp", F.struct("n", -F.col("comp"))).alias("most"))
        return of.where("comps > 1").select(*keys, "most", F.ceil(F.col("members") / TILE).cast("int").alias("tiles"))

    mixed = cut_lineage(named.join(several(named, "leader"), "leader").select("leader", "node", "comp", "most"))
    open_nodes = cut_lineage(mixed.groupBy("node", "comp").agg(F.max(F.col("comp") != F.col("most")).alias("rest")))
    live = cut_lineage(mixed.select("leader", "node", "comp").join(areas(open_nodes, lists, least), "node"))
    members = live.join(several(live, "leader", "area"), ["leader", "area"])
    members = shared_table(members.join(sigs, "node").join(lists, "node"), "near-groups")
    tile = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    members = members.withColumn("rest", F.col("comp") != F.col("most"))
    names = ["node", "comp", "sig", "sets", "list", "rest", "probe"]
    left = members.where("probe").select("leader", "area", tile.alias("i"), other.alias("j"), *names)
    fresh = [F.col(c).alias(c) for c in names]  # the two sides of a cogroup must not share columns
    right = members.select(F.col("leader").alias("leader"), F.col("area").alias("area"), tile.alias("j"), other.alias("i"), *fresh)
    kinds = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compared(key, a: pa.Table, b: pa.Table) -> pa.Table:
        out = tile_links(a, b, width, least) if len(a) and len(b) else []
        return pa.Table.from_arrays([pa.array([p[s] for p in out], pa.int64()) for s in (0, 1)], schema=kinds)

    keys = ["leader", "area", "i", "j"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compared, "a long, b long")


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY,
            bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """(id, class_id, class_size, kept, row key) per row of ``df``, which has the row key."""
    kind = df.schema[id_col].dataType.simpleString()
    texts = df.select(F.col(id_col).alias("id"), ROW, text_or_empty(text_col).cast("binary").alias("body"))
    all_prints = shared_table(prints(texts, kind, bands, rows), "near-prints")
    folded = all_prints.where("p1 IS NOT NULL").groupBy("p1", "p2").agg(F.min(ROW).alias("node"))
    folded = cut_lineage(folded)
    nodes = all_prints.join(folded.select(F.col("node").alias(ROW)), ROW, "left_semi").select(
        F.col(ROW).alias("node"), "bands", "sig", "sets")
    members = nodes.select("node", F.explode("bands").alias("key"))
    many = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = shared_table(members.join(many, "key").select("key", "node", "n"), "near-buckets")
    meets = shared.groupBy("node").agg(F.sum("n").alias("meets"))
    leaders = shared.join(meets, "node").groupBy("key").agg(F.max_by("node", F.struct("meets", -F.col("node"))).alias("leader"))
    groups = cut_lineage(shared.join(leaders, "key").select("leader", "node").distinct())
    pairs = groups.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b"))
    bodies = texts.select(F.col(ROW).alias("node"), "body").join(shared.select("node").distinct(), "node", "left_semi")
    lists = shared_table(shingle_lists(bodies), "near-lists")
    links = cut_lineage(checked(pairs, lists, least))
    labels = components(links)
    more = cut_lineage(rest_links(groups, labels, nodes.select("node", "sig", "sets"), lists, bands * rows, least).distinct())
    named = folded.join(labels, "node", "left").select("p1", "p2", F.coalesce("comp", "node").alias("comp"))
    joined = components(more).select(F.col("node").alias("comp"), F.col("comp").alias("class"))
    named = named.join(joined, "comp", "left").select("p1", "p2", F.coalesce("class", "comp").alias("class"))
    members = all_prints.select("id", ROW, "p1", "p2").join(named, ["p1", "p2"], "left").select(
        "id", ROW, F.coalesce("class", ROW).alias("class"))
    members = cut_lineage(members)
    order = F.struct(F.col("id").isNull().alias("none"), "id", F.col(ROW).alias("row"))
    owners = members.groupBy("class").agg(F.min(order).alias("own"), F.count("*").alias("class_size"))
    out = members.join(owners, "class").select(
        F.col("id").alias(id_col), F.col("own.id").alias("class_id"), "class_size", (F.col(ROW) == F.col("own.row")).alias("kept"), ROW)
    return out


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(id, class_id, class_size, kept) per row.

    Rows are linked when their five-word shingles, as sets or as multisets, have a Jaccard similarity of ``least``
    or more; words are runs without ASCII white space, compared as they are. A class is a connected component, its
    id the smallest id in it (null last), and the first row with that id is kept. A text of fewer than five words
    is one shingle. Null, empty and blank texts have no shingles: each is a class of its own. Ids may be null or
    repeat; repeated rows are one class with one kept row. Other columns are not read.
    """
    return classes(with_row(df.select(id_col, text_col)), id_col, text_col, least).drop(ROW)


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept rows of ``df`` with all their columns."""
    rows = with_row(df)
    kept = classes(rows, id_col, text_col).where("kept").select(ROW)
    return rows.join(kept, ROW, "left_semi").drop(ROW)
