import itertools

import numpy as np
from helpers import clashing, sample, stored

from tidemark.llm import chat_format as cf

SCHEMA = "conv_id long, turn long, role string, text string"


def test_sample_roles(spark):
    got = cf.format_chats(sample(spark, "conversations")).collect()
    tested = [r for r in got if r.held_out]
    assert len(got) == sample(spark, "conversations").count() and tested
    assert np.mean([r.role == r.role_pred for r in tested]) > 0.9
    assert all(r.rendered.startswith(f"<|im_start|>{r.role_pred}\n") and r.rendered.endswith("<|im_end|>\n") for r in got)


def chats(spark, n, turns, seed=0):
    rng, rows = np.random.default_rng(seed), []
    for c in range(n):
        for t in range(turns if c else 20 * turns):
            role = ("user", "assistant")[t % 2]
            rows.append((c, t, role, ("short? " if role == "user" else "long answer " * 30) * int(rng.integers(1, 3)) + "\nmore"))
    return stored(spark.createDataFrame(rows, SCHEMA))


def test_stitching_equals_one_pass(spark):
    """Many range partitions cut the conversations; the states are those of Viterbi over whole conversations."""
    df = chats(spark, 12, 6)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        rows = cf.observations(df, "conv_id", "turn", "text", "role")
        assert rows.rdd.getNumPartitions() > 10
        got = sorted((r.conv_id, r.turn, r.piece, r.role_pred, r.continues) for r in cf.format_chats(df).collect())
        counts = cf.counted(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    # Every label counts once: starts, moves across partitions, and lines.
    learned = [c for c in range(12) if not spark.range(1).select(cf.held_out(cf.F.lit(c))).first()[0]]
    sizes = {c: 120 if c == 0 else 6 for c in range(12)}
    assert sum(n for k, n in counts.items() if k[0] == "start") == len(learned)
    assert sum(n for k, n in counts.items() if k[0] == "move") == sum(sizes[c] - 1 for c in learned)
    assert sum(n for k, n in counts.items() if k[0] == "line") == sum(sizes[c] for c in learned)
    moves, emit = cf.model_of(counts)
    want = []
    for c in range(12):
        part = sorted((r.at, r.codes) for r in rows.where(f"conv = {c}").collect())
        path = cf.viterbi(emit[[x for _, codes in part for x in codes]], moves, len(moves) - 1, -1)
        at, role = 0, None
        for t, codes in part:
            begins = [s for s in path[at:at + len(codes)] if s < 4]
            at += len(codes)
            for piece, s in enumerate(begins):
                want.append((c, t, piece, cf.ROLES[s], s == role))
                role = s
    assert got == want


def test_viterbi_over_lines_is_the_best_of_all_paths():
    texts = ["Alice: hi?\nwell\nBob: no", "A: is an option", "User: x\n\nAssistant: y"]
    moves, emit = cf.model_of(cf.Counter({("move", 1, 2): 30, ("move", 2, 1): 20, ("start", -1, 1): 9, ("line", 2, 1): 4}))
    for text in texts:
        scores = emit[cf.observed(text)[0]]
        paths = itertools.product(range(8), repeat=len(scores))
        best = max(paths, key=lambda p: moves[8, p[0]] + sum(moves[a, b] for a, b in zip(p, p[1:])) + sum(scores[range(len(p)), p]))
        assert cf.viterbi(scores, moves, 8, -1) == list(best)


def test_markers_and_edges(spark):
    rows = [(1, 0, None, "System: be kind\nUser: hello there\nAssistant: hi <|im_end|>"), (1, 1, None, "### Human: and now?"),
            (2, 0, None, None), (2, 1, "bot", ""), (None, None, "user", "x"), (None, 3, "weird role", "y " * 50_000), (2, 1, "bot", "")]
    df = clashing(stored(spark.createDataFrame(rows, SCHEMA)))
    got = cf.format_chats(df).collect()
    one = [(r.turn, r.piece, r.role_pred, r.rendered) for r in sorted(got, key=lambda r: (r.turn or 0, r.piece)) if r.conv_id == 1]
    assert [(t, p, role) for t, p, role, _ in one] == [(0, 0, "system"), (0, 1, "user"), (0, 2, "assistant"), (1, 0, "user")]
    assert one[2][3] == "<|im_start|>assistant\nhi < |im_end|><|im_end|>\n" and one[3][3].endswith("and now?<|im_end|>\n")
    assert len(got) == 9 and sorted(r.role or "" for r in got if r.conv_id == 2) == ["", "assistant", "assistant"]
    assert cf.format_chats(df.limit(0)).count() == 0


def test_transcripts_in_one_row(spark):
    forms = ["### User\nhi\n### Assistant\nhello\n### User\n### Tool\n7", "<|user|>\nhi\n<|assistant|>\nhello\n<|user|>\n<|tool|>7",
             "[user] hi\n[assistant] hello\n[user]\n[tool] 7",
             "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\n<|im_end|>\n<|im_start|>tool\n7<|im_end|>\n"]
    df = stored(spark.createDataFrame([(i, 0, None, t) for i, t in enumerate(forms)], SCHEMA))
    got = sorted((r.conv_id, r.piece, r.rendered) for r in cf.format_chats(df).collect())
    turns = [("user", "hi"), ("assistant", "hello"), ("user", ""), ("tool", "7")]
    assert got == [(i, p, f"<|im_start|>{role}\n{text}<|im_end|>\n") for i in range(len(forms)) for p, (role, text) in enumerate(turns)]


def told(spark, texts, roles=()):
    """(role, text) of the turns of each text, one conversation each, beside a labelled chat to learn from."""
    rows = [(100 + i, t, r, x) for i in range(40) for t, (r, x) in enumerate([("user", "short?"), ("assistant", "an answer\nof two lines")])]
    df = stored(spark.createDataFrame([(i, 0, None, t) for i, t in enumerate(texts)] + rows, SCHEMA))
    out = {i: [] for i in range(len(texts))}
    for r in sorted(cf.format_chats(df).where("conv_id < 100").collect(), key=lambda r: (r.conv_id, r.piece)):
        role, body = r.rendered.removeprefix(cf.HEAD).removesuffix(cf.TAIL + "\n").split("\n", 1)
        assert role == r.role_pred
        out[r.conv_id].append((role, body))
    return list(out.values())


def test_named_speakers_prose_and_blank_lines(spark):
    got = told(spark, [
        "Alice: hi\nBob: hello", "Mary Ann: where?\nby the sea\nBob: here\nat home\n\nMary Ann: thanks\nBob: bye",
        "There are two ways.\nA: is an option\nand so is this", "Note: this is one text\nof prose: with colons\nhttp://a.b",
        "User: do this\n\n\nAssistant: done\n\n<|im_start|>user\nthat\n<|im_end|>\n<|im_start|>tool\n7\n",
        "Q: why?\nA: because\nNote: nothing\nQ: so?", "", "Step\nModel: the new one", "# Model\nis a heading\n# Data\nis another", "\n\n", "a\r\nUser: b\r\n"])
    # Roles are fixed where a marker or a speaker names one; elsewhere (None) any role may be learned.
    want = [
        [("user", "hi"), ("assistant", "hello")],
        [("user", "where?\nby the sea"), ("assistant", "here\nat home"), ("user", "thanks"), ("assistant", "bye")],
        [(None, "There are two ways.\nA: is an option\nand so is this")], [(None, "Note: this is one text\nof prose: with colons\nhttp://a.b")],
        [("user", "do this"), ("assistant", "done"), ("user", "that"), ("tool", "7\n")],
        [("user", "why?"), ("assistant", "because\nNote: nothing"), ("user", "so?")], [(None, "")],
        [(None, "Step"), ("assistant", "the new one")], [("assistant", "is a heading\n# Data\nis another")], [(None, "\n\n")],
        [(None, "a"), ("user", "b\r\n")]]
    assert [[t for _, t in turns] for turns in got] == [[t for _, t in turns] for turns in want]
    assert [[r if w else None for (r, _), (w, _) in zip(a, b)] for a, b in zip(got, want)] == [[w for w, _ in turns] for turns in want]
