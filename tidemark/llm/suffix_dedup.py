"""Removal of repeated passages by suffix arrays.

A byte is removed if a string of ``length`` bytes that covers it also starts anywhere else. Every window of ``length``
bytes has a key that only its bytes decide: the smallest hash of its 48-byte strings. Consecutive windows with one
key form a stretch (about 77 windows). Stretches whose key occurs once in the corpus cannot repeat; the others are
dealt by key, so windows that are equal always meet.

A shard of stretches gets a suffix array by Larsson-Sadakane refinement: suffixes are ranked by their first eight
bytes, and groups that still tie are refined by the rank of the suffix behind, which doubles the compared length each
round. Kasai's walk gives the common prefixes of neighbours, for all stretches of the shard in step. Neighbours that
share ``length`` bytes form a class, and a class of two or more windows is repeated. A key with too many stretches for
one shard is cut into several; their sorted class digests are dealt by range and merged by binary search, where a
class that lies in two shards is repeated as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ROW, shared_table, text_or_empty, with_row

LENGTH, GRAM = 200, 48
#: Windows of a piece of text that is scanned at once, and of a stretch at most.
SCANNED, STRETCH = 1 << 20, 4096
#: Stretches of a shard on average, and of one key before it is cut.
SHARD, CUT = 2048, 4096
#: Bytes of distinct stretches that a task holds before it sends them on.
HELD = 8 << 20
#: Fixed values of the hash: odd multipliers of 64 bits.
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of every run of ``gram`` bytes, by doubling: a run's hash joins the hashes of its halves."""
    out, have, power, level, base = None, 0, 1, data.astype(np.uint64) + np.uint64(1), MIX[0]
    mask = (1 << 64) - 1
    while power <= gram:
        if gram & power:
            if out is None:
                out = level
            else:  # the run so far, then this level's run behind it
                n = len(data) - have - power + 1
                out = out[:n] * np.uint64(base) + level[have:have + n]
            have += power
        if 2 * power <= gram:
            n = len(data) - 2 * power + 1
            level = level[:n] * np.uint64(base) + level[power:power + n]
        base = base * base & mask
        power *= 2
    for m, shift in ((MIX[1], 30), (MIX[2], 27)):
        out = (out ^ (out >> np.uint64(shift))) * np.uint64(m)
    return out ^ (out >> np.uint64(31))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    return np.minimum(values[:len(values) - (width - step)], values[width - step:]) if width > step else values


def stretches(data: np.ndarray, valid: np.ndarray, length: int = LENGTH, gram: int = GRAM, longest: int = STRETCH):
    """(start, windows, key, alone) of all stretches. ``valid`` marks the windows (by start) that lie in one text.

    Windows of one stretch cannot repeat each other where ``alone``: the smallest hash then has one place only, so
    equal windows would have it at different distances.
    """
    hashes = gram_hashes(data, gram)
    at = np.arange(len(hashes), dtype=np.uint64)
    high, low = ~np.uint64(0xFFFFFF), np.uint64(0xFFFFFF)
    width = length - gram + 1
    first = (sliding_min(hashes & high | at, width) & low).astype(np.int64)
    last = (low - (sliding_min(hashes & high | (low - at), width) & low)).astype(np.int64)
    key = hashes[first]
    n = len(key)
    border = np.empty(n, bool)
    border[0], border[1:] = True, (key[1:] != key[:-1]) | (valid[1:] != valid[:-1])
    # Borders between texts are invalid windows, so a change of text is a change of ``valid``.
    start = np.flatnonzero(border)
    size = np.diff(start, append=n)
    keep = valid[start]
    start, size = start[keep], size[keep]
    parts = -(-size // longest)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start, size = np.repeat(start, parts) + nth * longest, np.minimum(np.repeat(size, parts) - nth * longest, longest)
    alone = (first[start] == last[start + size - 1]) & (np.repeat(parts, parts) == 1)
    return start, size, key[start].view(np.int64), alone


def scan(text: bytes, length: int, scanned: int = SCANNED):
    """Pieces of a text for ``stretches``: (offset, bytes); every window lies in exactly one."""
    for lo in range(0, max(len(text) - length + 1, 0), scanned):
        yield lo, text[lo:lo + scanned + length - 1]


def text_stretches(texts: list[bytes], length: int, scanned: int = SCANNED):
    """(text, start, windows, key, alone) of the stretches of several texts, scanned together as far as they are short."""
    waiting, total = [], 0

    def flush():
        data = np.frombuffer(b"".join(p for _, _, p in waiting), np.uint8)
        if len(data) < length:
            return
        sizes = np.array([len(p) for _, _, p in waiting])
        begin = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(sizes)), sizes)
        valid = (owner[:len(data) - length + 1] == owner[length - 1:])
        start, n, key, alone = stretches(data, valid, length)
        who = owner[start]
        doc, offset = (np.array([w[i] for w in waiting]) for i in (0, 1))
        yield doc[who], start - begin[who] + offset[who], n, key, alone

    for doc, text in enumerate(texts):
        for offset, piece in scan(text, length, scanned):
            waiting.append((doc, offset, piece))
            total += len(piece)
            if total >= scanned:
                yield from flush()
                waiting, total = [], 0
    yield from flush()


def _group_ends(first: np.ndarray) -> np.ndarray:
    """Place of the last member of each place's group; ``first`` marks the first members."""
    starts = np.flatnonzero(first)
    return np.repeat(np.append(starts[1:], len(first)) - 1, np.diff(np.append(starts, len(first))))


def packed(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros behind the end."""
    padded, out = np.concatenate([data, np.zeros(8, data.dtype)]), np.zeros(len(data), np.uint64)
    for i in range(8):
        out = out << np.uint64(8) | padded[i:i + len(data)]
    return out


def _argsort_pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Order by two numbers. Where both and the place fit into 63 bits, values are sorted instead of places, which is faster."""
    low, place = int(second.max()).bit_length(), len(first).bit_length()
    key = first.astype(np.int64) << low | second
    if int(first.max()).bit_length() + low + place > 63:
        return np.argsort(key)
    key = key << place | np.arange(len(key))
    key.sort()
    return key & ((1 << place) - 1)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffix array by Larsson-Sadakane refinement.

    A suffix's rank is the place of its group's last member. Groups of one stay as they are; only suffixes that
    still tie are sorted again, by the rank of the suffix that begins where their compared bytes end.
    """
    n = len(data)
    head = packed(data)
    order = np.argsort(head)
    head = head[order]
    first = np.ones(n, bool)
    first[1:] = head[1:] != head[:-1]
    rank = np.empty(n, np.int32 if n < 1 << 31 else np.int64)
    rank[order] = _group_ends(first)
    places, done = np.flatnonzero(~(first & np.append(first[1:], True))), 8
    while len(places):
        suffix = order[places]
        behind = suffix + done
        # Behind the end of the data comes before every rank, and the further behind, the shorter the suffix.
        group, second = rank[suffix], np.where(behind < n, rank[np.minimum(behind, n - 1)], n - 1 - behind)
        by = _argsort_pairs(group, second + done)
        suffix, group, second = suffix[by], group[by], second[by]
        order[places] = suffix
        first = np.ones(len(places), bool)
        first[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        rank[suffix] = places[_group_ends(first)]
        places, done = places[~(first & np.append(first[1:], True))], 2 * done
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, begin: np.ndarray, end: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix, up to ``cap``, of each listed suffix with the one before it in ``order`` (by place; 0 for the first).

    Kasai's walk along each range begin:end, for all ranges in step: the next suffix shares at most one byte less
    with its neighbour. ``order`` lists the suffixes of these ranges only; where the neighbour's successor is not
    among them, the comparison starts anew. Each step compares eight bytes.
    """
    n, words = len(data), packed(data)
    place = np.full(n + 1, -1)
    place[order] = np.arange(len(order))
    out = np.zeros(len(order), np.int64)
    i, stop, h = begin.copy(), end, np.zeros(len(begin), np.int64)
    at = place[i]
    other = order[at - 1]
    while len(i):
        differ = words[np.minimum(i + h, n - 1)] ^ words[np.minimum(other + h, n - 1)]
        # Whole bytes that agree: the position of the highest differing bit. Without its neighbours no rounding moves it.
        bits = np.frexp((differ & ~(differ >> np.uint64(1))).astype(np.float64))[1]
        same = h + np.where(differ == 0, 8, (64 - bits) >> 3)
        h = np.minimum(np.minimum(same, cap), n - np.maximum(i, other))
        h[at == 0] = 0
        done = (differ != 0) | (h < same) | (h >= cap)
        moved = np.flatnonzero(done)
        if len(moved):
            out[at[moved]] = h[moved]
            follows = place[other[moved] + 1] >= 0
            h[moved] = np.where(follows, np.maximum(h[moved] - 1, 0), 0)
            i[moved] += 1
            live = i < stop
            if not live.all():
                i, stop, h, at, other, done = (v[live] for v in (i, stop, h, at, other, done))
                moved = np.flatnonzero(done)
            at[moved] = place[i[moved]]
            other[moved] = order[at[moved] - 1]
    return out


class Shard:
    """Classes of equal windows among distinct stretches: ``klass`` numbers each window's class, ``size`` counts it."""

    def __init__(self, bodies: list[bytes], length: int = LENGTH):
        self.data = np.frombuffer(b"".join(bodies), np.uint8)
        sizes = np.array([len(b) for b in bodies])
        end = np.cumsum(sizes)
        begin, self.windows = end - sizes, sizes - length + 1
        full = suffix_array(self.data)
        is_window = np.zeros(len(self.data), bool)
        self.starts = np.repeat(begin - np.cumsum(self.windows) + self.windows, self.windows) + np.arange(self.windows.sum())
        is_window[self.starts] = True
        order = full[is_window[full]]
        differs = common_prefixes(self.data, order, begin, begin + self.windows, length) < length
        numbers = np.cumsum(differs) - 1
        klass = np.empty(len(self.data), np.int64)
        klass[order] = numbers
        self.klass, self.size = klass[self.starts], np.bincount(numbers)
        self.first = order[differs]

    def runs(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(runs of each stretch, first, behind the last): runs of repeated windows; ``repeated`` is by class."""
        flags = repeated[self.klass]
        stretch = np.repeat(np.arange(len(self.windows)), self.windows)
        at = np.arange(len(flags)) - np.repeat(np.cumsum(self.windows) - self.windows, self.windows)
        fresh = at == 0
        first = np.flatnonzero(flags & (fresh | ~np.append(False, flags[:-1])))
        last = np.flatnonzero(flags & np.append(fresh[1:] | ~flags[1:], True))
        return np.bincount(stretch[first], minlength=len(self.windows)), at[first], at[last] + 1


def _lists(rows: list, kind: pa.DataType) -> pa.Array:
    return pa.array(rows, pa.list_(kind))


OCC = "array<struct<row:long,at:long>>"
OCC_ARROW = pa.struct([("row", pa.int64()), ("at", pa.int64())])
RUN_ARROW = pa.struct([("a", pa.int32()), ("b", pa.int32())])


def repeated_runs(df: DataFrame, length: int, shard: int, cut: int) -> DataFrame:
    """(row key, lo, hi): byte ranges of ``df`` (row key, body) that repeated windows cover."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(ROW).to_numpy()
            for doc, start, n, key, alone in text_stretches([t.encode() for t in b.column("body").to_pylist()], length):
                # One row per key and batch: a key that is everywhere leaves the task once.
                by = np.argsort(key, kind="stable")
                key = key[by]
                heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                occ = pa.StructArray.from_arrays(
                    [pa.array(rows[doc[by]]), pa.array(start[by]), pa.array(n[by].astype(np.int32))], ["row", "at", "n"])
                lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(key)), pa.int32()), occ)
                count = np.diff(np.append(heads, len(key)))
                twice = np.maximum.reduceat((~alone[by]).astype(np.int64), heads) if len(heads) else heads
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[heads]), pa.array(count + twice), lists], ["key", "n", "occ"])

    keys = shared_table(df.mapInArrow(keyed, "key long, n long, occ array<struct<row:long,at:long,n:int>>"), "stretch-keys")
    again = keys.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")
    total = again.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    cuts = F.when(F.col("n") > cut, F.ceil(F.col("n") / cut)).otherwise(0).cast("int")
    found = keys.drop("n").join(again.select("key", cuts.alias("cuts")), "key").select("key", "cuts", F.explode("occ").alias("o"))
    places = found.groupBy(F.col("o.row").alias(ROW)).agg(F.collect_list(F.struct("key", "cuts", "o.at", "o.n")).alias("places"))

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size = 0

        def out():
            yield pa.RecordBatch.from_arrays(
                [pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], pa.int32()),
                 pa.array(list(held), pa.binary()), pa.array([v[2] for v in held.values()], pa.binary()),
                 _lists([v[3] for v in held.values()], OCC_ARROW)],
                ["key", "cuts", "digest", "body", "occ"])

        for b in batches:
            for row, body, where in zip(b.column(ROW).to_pylist(), b.column("body").to_pylist(), b.column("places").to_pylist()):
                text = body.encode()
                for p in where:
                    piece = text[p["at"]:p["at"] + p["n"] + length - 1]
                    digest = hashlib.blake2b(piece, digest_size=16).digest()
                    entry = held.get(digest)
                    if entry is None:
                        held[digest] = entry = [p["key"], p["cuts"], piece, []]
                        size += len(piece) + 300
                    entry[3].append({"row": row, "at": p["at"]})
                    size += 60
                    if size > HELD:
                        yield from out()
                        held.clear()
                        size = 0
        if held:
            yield from out()

    bodies = df.join(places, ROW).select(ROW, "body", "places").mapInArrow(
        sliced, f"key long, cuts int, digest binary, body binary, occ {OCC}")
    bodies = shared_table(bodies, "stretches")
    # A shard is a range of keys, or one of the cuts of a large key. Copies meet in one row before that.
    few = max(1, -(-total // shard))
    copies = F.sum(F.size("occ")).alias("copies")
    small = bodies.where("cuts = 0").select(
        F.pmod("key", F.lit(few)).alias("shard"), F.lit(0).alias("part"), "digest", "body", F.size("occ").cast("long").alias("copies"))
    part = 1 + F.pmod(F.xxhash64("digest"), F.col("cuts")).cast("int")
    large = bodies.where("cuts > 0").groupBy(F.col("key").alias("shard"), part.alias("part"), "digest").agg(
        F.first("body").alias("body"), copies)

    def classed(table: pa.Table) -> pa.Table:
        seen: dict[bytes, list] = {}
        for digest, body, n in zip(*(table.column(c).to_pylist() for c in ("digest", "body", "copies"))):
            seen.setdefault(digest, [body, 0])[1] += n
        found = Shard([v[0] for v in seen.values()], length)
        repeated = found.size > 1
        many = np.repeat([v[1] > 1 for v in seen.values()], found.windows)
        repeated[found.klass[many]] = True
        each, lo, hi = found.runs(repeated)
        spans = pa.StructArray.from_arrays([pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["a", "b"])
        runs = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(each)), pa.int32()), spans)
        out = pa.table([pa.array(list(seen), pa.binary()), runs, pa.nulls(len(seen), pa.list_(pa.int32())),
                        pa.nulls(len(seen), pa.binary()), pa.nulls(len(seen), pa.int64()), pa.nulls(len(seen), pa.int32()), pa.nulls(len(seen), pa.int32())],
                       ["digest", "runs", "classes", "window", "shard", "part", "class"])
        part = table.column("part")[0].as_py()
        if not part:
            return out
        # Undecided windows of a cut key: their classes wait for the other cuts.
        text, key = found.data.tobytes(), table.column("shard")[0].as_py()
        open_ = np.flatnonzero(~repeated)
        first = found.first[open_].tolist()
        windows = [hashlib.blake2b(text[i:i + length], digest_size=16).digest() for i in first]
        classes = pa.ListArray.from_arrays(
            pa.array(np.append(0, np.cumsum(found.windows)), pa.int32()), pa.array(np.where(repeated[found.klass], -1, found.klass), pa.int32()))
        out = out.set_column(2, "classes", classes)
        out = out.set_column(4, "shard", pa.array([key] * len(seen), pa.int64())).set_column(5, "part", pa.array([part] * len(seen), pa.int32()))
        # Classes known to repeat here are told to the other cuts too.
        known = np.flatnonzero(repeated)
        windows += [hashlib.blake2b(text[i:i + length], digest_size=16).digest() for i in found.first[known].tolist()]
        number = np.concatenate([open_, known]).astype(np.int32)
        n = len(number)
        return pa.concat_tables([out, pa.table(
            [pa.nulls(n, pa.binary()), pa.nulls(n, pa.list_(RUN_ARROW)), pa.nulls(n, pa.list_(pa.int32())), pa.array(windows, pa.binary()),
             pa.array([key] * n, pa.int64()), pa.array([part] * n, pa.int32()), pa.array(number)], out.schema.names)])

    schema = "digest binary, runs array<struct<a:int,b:int>>, classes array<int>, window binary, shard long, part int, class int"
    judged = small.groupBy("shard", "part").applyInArrow(classed, schema).unionAll(large.groupBy("shard", "part").applyInArrow(classed, schema))
    judged = shared_table(judged, "suffix-classes")
    runs = judged.where("digest IS NOT NULL").select("digest", "runs")
    more = merged_cuts(judged)
    runs = runs.unionAll(more).where(F.size("runs") > 0)
    spots = runs.join(bodies.select("digest", "occ"), "digest").select(F.explode("occ").alias("o"), "runs")
    return spots.select(F.col("o.row").alias(ROW), F.explode("runs").alias("r"), F.col("o.at").alias("at")).select(
        ROW, (F.col("at") + F.col("r.a")).alias("lo"), (F.col("at") + F.col("r.b") + F.lit(length - 1)).alias("hi"))


def merged_cuts(judged: DataFrame) -> DataFrame:
    """(digest, runs) of windows that repeat only across the cuts of a large key."""

    def looked_up(table: pa.Table) -> pa.Table:
        """Each cut's sorted classes are looked up in those of all cuts of this range by binary search."""
        part, number = table.column("part").to_numpy(), table.column("class").to_numpy()
        key = table.column("shard").to_numpy()
        window = np.frombuffer(b"".join(table.column("window").to_pylist()), "S16")
        every = np.sort(window)
        hit = np.zeros(len(part), bool)
        for p in np.unique(part):
            mine = np.flatnonzero(part == p)
            hit[mine] = np.searchsorted(every, window[mine], "right") - np.searchsorted(every, window[mine], "left") > 1
        return pa.table([pa.array(key[hit]), pa.array(part[hit], pa.int32()), pa.array(number[hit], pa.int32())], ["shard", "part", "class"])

    classes = judged.where("window IS NOT NULL").select("shard", "part", "class", "window")
    # Ranges of digests: even, since digests are, and no group grows with a key.
    n = classes.count()
    if not n:
        return judged.where("digest IS NOT NULL").select("digest", "runs").limit(0)
    ranges = max(1, n // (1 << 18))
    place = F.conv(F.hex(F.substring("window", 1, 6)), 16, 10).cast("double") / F.lit(float(1 << 48))
    hits = classes.withColumn("range", F.floor(place * ranges)).groupBy("range").applyInArrow(looked_up, "shard long, part int, class int")
    open_ = judged.where("classes IS NOT NULL").select("digest", "shard", "part", F.posexplode("classes").alias("at", "class"))
    found = open_.where("class >= 0").join(hits, ["shard", "part", "class"])
    return found.groupBy("digest").agg(F.collect_list(F.struct(F.col("at").cast("int").alias("a"), (F.col("at") + 1).cast("int").alias("b"))).alias("runs"))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, shard: int = SHARD, cut: int = CUT,
                   with_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept, spans]) per row.

    A text's bytes are its UTF-8 (null: empty). Bytes covered by a string of ``length`` bytes that also starts elsewhere, in
    the same row or another one, are removed; rows are told apart by their place, so ids may be null or repeat, and
    of repeated rows no copy is left. ``with_text`` adds the remaining bytes and the removed spans. An
    empty table gives an empty result; other columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = with_row(df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("body")))
    found = repeated_runs(rows.select(ROW, "body"), length, shard, cut)
    found = found.groupBy(ROW).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        for b in batches:
            out, kept_texts, kept_spans = [], [], []
            for body, spans in zip(b.column("body").to_pylist(), b.column("spans").to_pylist()):
                text, kept, at, removed, runs = body.encode(), [], 0, 0, []
                for s in sorted(spans or [], key=lambda s: s["lo"]):
                    if runs and s["lo"] <= runs[-1]["hi"]:
                        runs[-1]["hi"] = max(runs[-1]["hi"], s["hi"])
                    else:
                        runs.append(s)
                for r in runs:
                    kept.append(text[at:r["lo"]])
                    at = r["hi"]
                    removed += r["hi"] - r["lo"]
                rest = b"".join([*kept, text[at:]])
                out.append((len(text), removed, len(runs), hashlib.sha256(rest).hexdigest()))
                if with_text:
                    kept_texts.append(rest)
                    kept_spans.append(runs)
            cols = [pa.array([r[i] for r in out], t) for i, t in enumerate([pa.int64()] * 3 + [pa.string()])]
            if with_text:
                cols += [pa.array(kept_texts, pa.binary()), pa.array(kept_spans, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))]
            yield pa.RecordBatch.from_arrays([b.column("id"), *cols], names + ["kept", "removed_spans"] * with_text)

    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema += ", kept binary, removed_spans array<struct<lo:long,hi:long>>" * with_text
    return rows.join(found, ROW, "left").select("id", "body", "spans").mapInArrow(cleaned, schema).withColumnRenamed("id", id_col)
