"""Chat formatting: roles and turn borders recovered by a hidden Markov model, then canonical turns.

Observations are the lines of the texts: their speaker marker, and what follows up to the next one (length, question mark,
lines). A state is a role and whether a turn begins in this line or goes on. Role starts, role moves and line features are counted over all labelled
rows; what a marker says about a border is a table of fixed values. Rows are sorted by (conversation, order) in range
partitions, so one conversation may fill many partitions. Each partition sums up the runs at its two borders as max-plus
matrices; stitching those few matrices gives the best state at every border, and each partition then runs Viterbi
over its own lines between known border states and cuts its texts where turns begin.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ROW, text_or_empty, with_row
from tidemark.session import cut_lineage

#: States and the names that stand for them in role columns and speaker markers.
ROLES = ("system", "user", "assistant", "tool")
NAMES = {"system": 0, "instruction": 0, "user": 1, "human": 1, "customer": 1, "q": 1, "assistant": 2, "ai": 2, "bot": 2,
         "gpt": 2, "model": 2, "a": 2, "tool": 3, "function": 3, "observation": 3}
HEAD, TAIL = "<|im_start|>", "<|im_end|>"
#: A line that starts with a known speaker (opening mark, name, closing mark, end), and one that starts with any name.
KNOWN = re.compile(r"[ \t]*(<\|im_start\|>|<\|?|\[|#{1,6} ?|\*\*)?(" + "|".join(NAMES) + r")(\|?>|\]|:\*\*|\*\*)?"
                   r"[ \t]*(:|(?=\r?$)|(?<=[>\]])|(?<=:\*\*))[ \t\r]*", re.I)
OPEN = re.compile(r"[ \t]*(?:\*\*)?([^\W\d_][\w.'-]{1,30}(?: [\w.'-]{1,30}){0,2})(?:\*\*)?:(?:\*\*)?(?:[ \t\r]+|$)")
#: Features of a line: marker; length in powers of two, question mark at the end, lines up to the next marker; first line of its text.
SIZES = (8, 21, 2, 4, 2)
#: Marker values beyond the roles: none, a first or second open speaker, a name without support in its text.
NONE, SPEAKER, WEAK = 4, 5, 7
#: How likely a turn begins in a line inside a text, and a marker given that the line begins or continues
#: a turn: own role, another role, none, an open speaker that suits the role or not, a name without support.
#: EVEN is the share of an even spread in the features of a role, so that rare values do not outweigh a marker.
INSIDE, EVEN = 1e-3, 0.05
BEGINS = {"own": 0.3, "other": 1e-8, "none": 0.5, "suits": 0.12, "open": 1e-4, "weak": 0.02}
GOES_ON = {"role": 1e-16, "none": 0.95, "open": 1e-10, "weak": 0.04}
NEVER = -1e9


def role_number(name):
    lower = F.lower(F.trim(name))
    out = F.lit(None).cast("int")
    for alias, number in NAMES.items():
        out = F.when(lower == alias, number).otherwise(out)
    return out


def markers(lines: list[str]) -> dict[int, tuple[int, int]]:
    """Line -> (marker value, end of the marker) for the lines of one text that start with a name.

    A known name with a colon or in brackets is a marker. Other forms of it, and names of one letter (with a colon only),
    need a second known name in the text. Any other name, of words without a small first letter, is a speaker if two names
    start lines of the text and this one does so repeatedly, or the two share half of all lines that are not blank.
    """
    found = []
    for i, line in enumerate(lines):
        colon = ":" in line
        m = KNOWN.match(line) if colon or len(line) < 60 or line[:60].lstrip()[:1] in ("<", "[") else None
        if m:
            name, colon = m[2].lower(), ":" in (m[4] + (m[3] or ""))
            if len(name) == 1 and not colon:
                continue
            clear = colon or (m[1] or "")[:1] in ("<", "[") or (i == 0 and m[1])
            found.append((i, m.end(), name, len(name) > 1 and bool(clear)))
        elif colon and (m := OPEN.match(line)) and not any(word[0].islower() for word in m[1].split()):
            found.append((i, m.end(), m[1].casefold(), False))
    if not found:
        return {}
    counts = Counter(name for _, _, name, _ in found)
    known = sum(name in NAMES for name in counts)
    pair = len(counts) == 2 and 2 * len(found) >= sum(not line.isspace() and line != "" for line in lines)
    out, order = {}, {}
    for i, end, name, clear in found:
        if name in NAMES:
            out[i] = (NAMES[name] if clear or known > 1 else WEAK), end
        elif len(counts) > 1 and (counts[name] > 1 or pair):
            out[i] = SPEAKER + order.setdefault(name, len(order)) % 2, end
        else:
            out[i] = WEAK, end
    return out


def observed(text: str) -> tuple[list[int], list[int], bool]:
    """(feature code per line, marker end per line, whether a marker stands inside the text).

    A line where a turn may begin is described by its marker and the lines from it to the next supported marker.
    """
    lines = text.split("\n")
    marks, n = markers(lines), len(lines)
    codes, ends, inside = [0] * n, [0] * n, False
    length, count, asks = -1, 0, None
    for i in reversed(range(n)):
        line = lines[i]
        mark, end = marks.get(i, (NONE, 0))
        length, count = length + len(line) + 1, count + 1
        if asks is None and line and not line.isspace():
            asks = line.endswith("?") or line.rstrip().endswith("?")
        about = 0
        if i == 0 or mark != NONE:
            ends[i] = 0 if mark == WEAK else end
            size = min(SIZES[1] - 1, (length - ends[i] + 1).bit_length() - 1)
            about = (size * SIZES[2] + bool(asks)) * SIZES[3] + min(SIZES[3], count) - 1
        codes[i] = (mark * SIZES[1] * SIZES[2] * SIZES[3] + about) * SIZES[4] + (i == 0)
        if mark not in (NONE, WEAK):
            inside |= i > 0
            length, count, asks = -1, 0, None
    return codes, ends, inside


def held_out(conv):
    return F.coalesce(F.crc32(conv.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def observations(df: DataFrame, conv_col: str, order_col: str, text_col: str, role_col: str | None) -> DataFrame:
    """Sorted (conv, at, role, label, codes, ends, body), one row per text; its lines never leave its partition.

    ``label`` is the role of a row to learn from: not held out, and without a marker inside its text.
    """
    role = role_number(F.col(role_col).cast("string")) if role_col else F.lit(None).cast("int")
    rows = with_row(df.select(F.col(conv_col).alias("conv"), F.col(order_col).alias("at"), role.alias("role"),
                              text_or_empty(text_col).alias("body")))
    rows = rows.withColumn("label", F.when(~held_out(F.col("conv")), F.col("role")))
    keys = ["conv", "at", ROW]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv", "at", "role", "label", "body")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [observed(t) for t in b.column("body").to_pylist()]
            label = [None if inside else r for r, (_, _, inside) in zip(b.column("label").to_pylist(), found)]
            yield pa.RecordBatch.from_arrays(
                [b.column("conv"), b.column("at"), b.column("role"), pa.array(label, pa.int32()),
                 pa.array([c for c, _, _ in found], pa.list_(pa.int32())), pa.array([e for _, e, _ in found], pa.list_(pa.int32())),
                 b.column("body")], ["conv", "at", "role", "label", "codes", "ends", "body"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return cut_lineage(rows.mapInArrow(seen, f"conv {kinds['conv']}, at {kinds['at']}, role int, label int, codes array<int>, "
                                             "ends array<int>, body string"))


def _columns(b: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(b.column(n).to_pylist() for n in names))


def counted(rows: DataFrame) -> Counter:
    """Counts (kind, a, b) of starts, moves and (role, code of the first line) over all labelled rows; as many numbers as codes at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, last, part = Counter(), None, TaskContext.get().partitionId()
        edge: list[tuple] = []
        for b in batches:
            for conv, label, codes in _columns(b, "conv", "label", "codes"):
                if last is None:
                    edge.append((conv, label))
                elif label is not None and last[0] != conv:
                    n["start", -1, label] += 1
                elif label is not None and last[1] is not None:
                    n["move", last[1], label] += 1
                if label is not None:
                    n["line", label, codes[0]] += 1
                last = (conv, label)
        rows_ = [(k, a, b_, m, None) for (k, a, b_), m in n.items()]
        if last is not None:
            rows_ += [("first", part, e[1], 1, e[0]) for e in edge] + [("last", part, last[1], 1, last[0])]
        cols = list(zip(*rows_)) if rows_ else [()] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:4]),
             pa.array([None if c is None else str(c) for c in cols[4]], pa.string())], ["kind", "a", "b", "n", "conv"])

    found = rows.select("conv", "label", "codes").mapInArrow(count, "kind string, a long, b long, n long, conv string")
    # Codes and roles are bucketed, borders are two rows per partition: the result does not grow with the rows.
    out, borders = Counter(), []
    for kind, a, b, conv, n in found.groupBy("kind", "a", "b", "conv").agg(F.sum("n").alias("n")).collect():
        if kind in ("first", "last"):
            borders.append((a, kind == "last", conv, b))
        else:
            out[kind, a, b] += n
    last = None
    for _, is_last, conv, label in sorted(borders, key=lambda x: x[:2]):
        if not is_last and label is not None:
            if last is None or last[0] != conv:
                out["start", -1, label] += 1
            elif last[1] is not None:
                out["move", last[1], label] += 1
        last = (conv, label)
    return out


def marker_table() -> np.ndarray:
    """Log probability of each marker value in each state (roles that begin, then roles that go on)."""
    k = len(ROLES)
    table = np.empty((2 * k, SIZES[0]))
    table[:k, :k] = BEGINS["other"]
    table[range(k), range(k)] = BEGINS["own"]
    table[:k, NONE], table[:k, SPEAKER:WEAK], table[:k, WEAK] = BEGINS["none"], BEGINS["open"], BEGINS["weak"]
    table[1, SPEAKER] = table[2, SPEAKER + 1] = BEGINS["suits"]
    table[k:, :k], table[k:, NONE], table[k:, SPEAKER:WEAK], table[k:, WEAK] = (
        GOES_ON["role"], GOES_ON["none"], GOES_ON["open"], GOES_ON["weak"])
    return np.log(table)


def model_of(counts: Counter) -> tuple[np.ndarray, np.ndarray]:
    """(moves between states with the start as last row, emissions by code and state) as log probabilities.

    Roles and the features length, question mark and lines are counted, for lines that begin a turn, and smoothed by one. The first line of a text
    begins a turn, inside it only a line with a name may; a turn goes on in its own role only.
    """
    k = len(ROLES)
    roles = np.ones((k + 1, k))
    tables = [np.ones((k, size)) for size in SIZES]
    codes = np.unravel_index(np.arange(np.prod(SIZES)), SIZES)
    for (kind, a, b), n in counts.items():
        if kind == "line":
            for table, code in zip(tables, codes):
                table[a, code[b]] += n
        else:
            roles[a if kind == "move" else k, b] += n
    roles = np.log(roles / roles.sum(1, keepdims=True))
    moves = np.full((2 * k + 1, 2 * k), NEVER)
    moves[:k, :k] = moves[k:2 * k, :k] = roles[:k]
    moves[2 * k, :k] = roles[k]
    moves[range(k), range(k, 2 * k)] = moves[range(k, 2 * k), range(k, 2 * k)] = 0
    emit = marker_table()[:, codes[0]].T.copy()
    first = codes[4] == 1
    named = first | (codes[0] != NONE)
    for j in (1, 2, 3):
        known = (1 - EVEN) * tables[j] / tables[j].sum(1, keepdims=True) + EVEN / SIZES[j]
        emit[:, :k] += np.log(known)[:, codes[j]].T
        emit[named, k:] -= np.log(SIZES[j])
    emit[first, k:] = NEVER
    emit[np.ix_(~named, range(k))] = NEVER
    emit[~first, :k] += np.log(INSIDE)
    emit[~first, k:] += np.log(1 - INSIDE)
    return moves, emit


def _through(matrix: np.ndarray | None, score: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Max-plus product: best score from each entry state (last: the start) to each state of one more line."""
    if matrix is None:
        return moves + score
    return (matrix[:, :, None] + moves[None, :-1]).max(1) + score


def borders(rows: DataFrame, moves: np.ndarray, emit: np.ndarray) -> list[tuple]:
    """(partition, is first run, is last run, conversation, matrix) of the runs at the partition borders."""
    most = 10_000

    def folded(run: list) -> list:
        for code in run[2]:
            run[1] = _through(run[1], emit[code], moves)
        run[2] = []
        return run

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, now = TaskContext.get().partitionId(), None, None
        for b in batches:
            for conv, codes in _columns(b, "conv", "codes"):
                if now is None or now[0] != conv:
                    # Runs inside the partition need no matrix.
                    if now is not None and first is None:
                        first = folded(now)
                    now = [conv, None, []]
                now[2] += codes
                if len(now[2]) > most:
                    folded(now)
        ends = [] if now is None else [(True, True, folded(now))] if first is None else [(True, False, first), (False, True, folded(now))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * len(ends), pa.int64()), pa.array([e[0] for e in ends], pa.bool_()), pa.array([e[1] for e in ends], pa.bool_()),
             pa.array([None if e[2][0] is None else str(e[2][0]) for e in ends], pa.string()),
             pa.array([e[2][1].ravel().tolist() for e in ends], pa.list_(pa.float64()))], ["part", "first", "last", "conv", "matrix"])

    found = rows.select("conv", "codes").mapInArrow(summed, "part long, first boolean, last boolean, conv string, matrix array<double>")
    return sorted(((r.part, r.first, r.last, r.conv, np.array(r.matrix).reshape(moves.shape)) for r in found.collect()),
                  key=lambda x: (x[0], not x[1]))


def stitched(runs: list[tuple], k: int) -> dict[int, tuple[int, int]]:
    """Per partition: the state before its first run (k: the run starts a conversation) and the state that ends its last run (-1: free)."""
    entry, exit_ = {r[0]: k for r in runs}, {r[0]: -1 for r in runs}
    chain: list[tuple] = []

    def close():
        if len(chain) > 1:
            best, backs = chain[0][4][k], []
            for run in chain[1:]:
                way = best[:, None] + run[4][:k]
                backs.append(way.argmax(0))
                best = way.max(0)
            state = int(best.argmax())
            for run, back in zip(chain[:0:-1], backs[::-1]):
                if run is not chain[-1]:
                    exit_[run[0]] = state
                state = int(back[state])
                entry[run[0]] = state
            exit_[chain[0][0]] = state
        chain.clear()

    for run in runs:
        # A run goes on from the one before if that ended its partition with the same conversation.
        if chain and not (run[1] and chain[-1][2] and chain[-1][3] == run[3]):
            close()
        chain.append(run)
    close()
    return {p: (entry[p], exit_[p]) for p in entry}


def viterbi(scores: np.ndarray, moves: np.ndarray, entry: int, exit_: int) -> list[int]:
    best, backs = moves[entry] + scores[0], []
    for s in scores[1:]:
        way = best[:, None] + moves[:-1]
        backs.append(way.argmax(0))
        best = way.max(0) + s
    state = int(best.argmax()) if exit_ < 0 else exit_
    path = [state]
    for back in reversed(backs):
        path.append(state := int(back[state]))
    return path[::-1]


def turns_of(text: str, codes: list[int], ends: list[int], states: list[int]) -> list[tuple[int, str]]:
    """(role, text of the turn) per turn: cut where a turn begins, markers, frames and closing blank lines taken off."""
    lines, k = text.split("\n"), len(ROLES)
    starts = [i for i, s in enumerate(states) if s < k or i == 0] + [len(lines)]
    out = []
    for lo, hi in zip(starts[:-1], starts[1:]):
        body = "\n".join(lines[lo:hi])
        framed = ends[lo] and body.lstrip(" \t").startswith(HEAD)
        if ends[lo]:
            body = body[ends[lo]:].lstrip()
        if hi < len(lines):
            body = body.rstrip()
        if framed and (whole := body.rstrip()).endswith(TAIL):
            body = whole.removesuffix(TAIL).rstrip()
        out.append((states[lo] % k, body))
    return out


def format_chats(df: DataFrame, conv_col: str = "conv_id", order_col: str = "turn", text_col: str = "text",
                 role_col: str | None = "role") -> DataFrame:
    """(conv, order, piece, role, held_out, role_pred, continues, rendered), one row per turn of a text.

    ``role`` is the given one in canonical form (null if unknown) and only ever learned from, in conversations that
    are not held out (crc32 of the id as text is not 2 modulo 4); predictions see texts and their order. A text begins
    a turn; inside it turns begin where Viterbi says so, of the lines that start with a name: at known roles, and at names
    that the text itself shows to be speakers (``markers``). Their markers are taken off; a name without such support stays in the text.
    ``rendered`` is one canonical turn: head, role, text, tail; "<|" inside a text becomes "< |". ``continues``: same role as the turn
    before. Rows with equal order keep their input order; null conversations are one conversation, null orders come
    first; null or empty texts are empty turns; an empty table gives an empty result. Other columns are not read.
    """
    rows = observations(df, conv_col, order_col, text_col, role_col)
    moves, emit = model_of(counted(rows))
    roles, k = len(ROLES), 2 * len(ROLES)
    known = df.sparkSession.sparkContext.broadcast(stitched(borders(rows, moves, emit), k))  # two numbers a partition
    conv_kind, at_kind = (df.schema[c].dataType.simpleString() for c in (conv_col, order_col))
    rows = rows.select("conv", "at", "role", "codes", "ends", "body")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry, exit_ = known.value.get(TaskContext.get().partitionId(), (k, -1))
        held: list[pa.RecordBatch] = []

        def out(parts, last: bool, state: int):
            """Decode whole runs. Without ``last``, the final run ends its conversation."""
            table = pa.Table.from_batches(parts).combine_chunks()
            convs, codes, ends = (table[c].to_pylist() for c in ("conv", "codes", "ends"))
            starts = [i for i in range(len(convs)) if i == 0 or convs[i] != convs[i - 1]] + [len(convs)]
            source, piece, pred, cont, text = [], [], [], [], []
            bodies = table["body"].to_pylist()
            for n, (lo, hi) in enumerate(zip(starts[:-1], starts[1:])):
                before = state if n == 0 else k
                flat = [c for row in codes[lo:hi] for c in row]
                states = viterbi(emit[flat], moves, before, exit_ if last and hi == len(convs) else -1)
                role, at = (before % roles if before < k else -1), 0
                for i in range(lo, hi):
                    own = states[at:at + len(codes[i])]
                    at += len(own)
                    for number, (now, body) in enumerate(turns_of(bodies[i], codes[i], ends[i], own)):
                        source.append(i)
                        piece.append(number)
                        pred.append(ROLES[now])
                        cont.append(now == role)
                        text.append(f"{HEAD}{ROLES[now]}\n{body.replace('<|', '< |')}{TAIL}\n")
                        role = now
            kept = table.select(["conv", "at", "role"]).take(pa.array(source, pa.int64())).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays(
                [kept.column("conv"), kept.column("at"), pa.array(piece, pa.int32()), kept.column("role"), pa.array(pred),
                 pa.array(cont, pa.bool_()), pa.array(text)],
                ["conv", "at", "piece", "role", "role_pred", "continues", "rendered"])

        for b in batches:
            if not b.num_rows:
                continue
            convs = b.column("conv").to_pylist()
            # Flush what is finished: everything before the last change of conversation.
            cut = next((i for i in range(len(convs) - 1, 0, -1) if convs[i] != convs[i - 1]), 0)
            if not cut and held and held[-1].column("conv")[-1].as_py() != convs[0]:
                yield out(held, False, entry)
                held, entry = [], k
            if cut:
                head = b.slice(0, cut)
                yield out([*held, head], False, entry)
                held, entry = [], k
                b = b.slice(cut)
            held.append(b)
        if held:
            yield out(held, True, entry)

    out = rows.mapInArrow(decoded, f"conv {conv_kind}, at {at_kind}, piece int, role int, role_pred string, continues boolean, rendered string")
    names = F.array(*map(F.lit, ROLES))
    return out.select(F.col("conv").alias(conv_col), F.col("at").alias(order_col), "piece", F.get(names, F.col("role")).alias("role"),
                      held_out(F.col("conv")).alias("held_out"), "role_pred", "continues", "rendered")
