"""Equalities and required inequalities of the canonical hash, checked against real text.

Every vector is built around a text column, so a check runs over a whole table instead of a handful
of literals. V-01 (baseline) is the row hash itself; V-02 needs a non-UTF-8 source and is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import canon as K


def _framed_hash(*columns: Column) -> Column:
    """Row hash of already framed columns (at most one group)."""
    group = K._digest(F.concat(
        F.unhex(F.lit(K.GROUP_MARK)), K._count_bytes(len(columns)), *[K._digest(c) for c in columns]))
    return F.sha2(F.concat(F.unhex(F.lit(K.ROW_MARK)), K._count_bytes(len(columns)), group), 256)


def _number(value: Column, scale: int) -> Column:
    return K.frame(F.encode(K.canon_number(value, 38, scale), "UTF-8"), K.TAG_NUMBER)


def _instant(value: Column) -> Column:
    return K.frame(F.encode(K.canon_timestamp(value), "UTF-8"), K.TAG_TIMESTAMP)


def _raw(value: Column) -> Column:
    return K.frame(K.canon_binary(value), K.TAG_BINARY)


class Steps:
    """Columns that later expressions use more than once, by level: Spark computes each of them once per row.

    A canonical text is used many times in its own frame, and a conditional or non-deterministic expression is evaluated
    anew wherever it is written.
    """

    LEVELS = RAW, CANONICAL, HASH = range(3)

    def __init__(self):
        self.columns = [{} for _ in self.LEVELS]

    def keep(self, level: int, column: Column) -> Column:
        name = f"_step{level}_{len(self.columns[level])}"
        self.columns[level][name] = column
        return F.col(name)

    def added_to(self, df: DataFrame) -> DataFrame:
        for level in self.LEVELS:
            # A few at a time: the JVM does not compile methods as long as all of them would make.
            names = list(self.columns[level])
            for i in range(0, len(names), 4):
                df = df.withColumns({n: self.columns[level][n] for n in names[i:i + 4]})
        return df


def vector_table(base: Column, one: Column, steps: Steps) -> dict[str, Column]:
    """Vector id -> condition that must hold, built around the text ``base`` and its column digest ``one``.

    The conditions refer to columns that ``steps`` adds.
    """
    lit = F.lit
    raw = lambda c: steps.keep(steps.RAW, c)
    string = lambda c: steps.keep(steps.CANONICAL, K.canon_string(c))
    _hash = lambda *cs: steps.keep(steps.HASH, _framed_hash(*cs))
    _text = lambda c: K.frame(string(c), K.TAG_STRING)
    same = lambda a, b: _hash(a) == _hash(b)
    differ = lambda a, b: _hash(a) != _hash(b)
    nfd = raw(F.concat(base, lit("\u1112\u1161\u11ab e\u0301")))
    nfc = raw(F.concat(base, lit("\ud55c \u00e9")))
    marks = [raw(F.concat(base, lit("a" + m))) for m in ("\u0323\u0307", "\u0307\u0323")]
    emoji = raw(F.concat(base, lit("\U0001F600")))
    # The same column n times, hashed, against the groups written out by hand; and no two widths agree.
    group = lambda n: F.unhex(F.sha2(F.unhex(F.concat(lit(f"FE{n:08X}"), F.repeat(F.hex(one), lit(n)))), 256))
    by_hand = {
        32: [group(32)], 33: [group(32), group(1)], 64: [group(32), group(32)], 65: [group(32), group(32), group(1)]}
    rows = {n: steps.keep(steps.HASH, F.sha2(F.concat(F.unhex(lit(f"FF{n:08X}")), *g), 256)) for n, g in by_hand.items()}
    wide_ok = F.size(F.array_distinct(F.array(*rows.values()))) == 4
    for n, row in rows.items():
        wide_ok = wide_ok & (K.combine([one] * n) == row)
    ts = lambda text: F.lit(text).cast("timestamp_ntz")
    long_text = string(raw(F.rpad(F.concat(base, lit("x")), 2001, "x")))
    limit_text = string(raw(F.rpad(F.concat(base, lit("x")), 2000, "x")))
    base_text = string(base)
    lob = lambda v: K.frame(K.canon_lob(v), K.TAG_LOB)
    guarded = lambda v: F.when(
        F.octet_length(v) > K.DEFAULT_STRING_BYTES, lob(v)).otherwise(K.frame(v, K.TAG_STRING))
    content = F.encode(base, "UTF-8")
    return {
        "V-03/04": same(_text(nfd), _text(nfc)),
        "V-05": same(_text(marks[0]), _text(marks[1])),
        "V-06": F.octet_length(string(emoji)) == F.octet_length(base) + 4,
        "V-07a": same(_text(F.when(base.isNull(), base)), _text(lit(""))),
        "V-07b": differ(_text(F.when(base.isNull(), base)), _text(lit("<<NULL>>"))),
        "V-08": (_hash(_text(F.concat(base, lit("|b"))), _text(lit("c")))
                 != _hash(_text(base), _text(lit("b|c"))))
        & (_hash(_text(F.concat(base, lit("\\|b"))), _text(lit("c")))
           != _hash(_text(F.concat(base, lit("|b"))), _text(lit("c")))),
        "V-09": (_hash(K.frame(steps.keep(steps.CANONICAL, K.canon_char(F.concat(base, lit("A ")))), K.TAG_STRING))
                 == _hash(_text(F.concat(base, lit("A")))))
        & differ(_text(F.concat(base, lit("A "))), _text(F.concat(base, lit("A")))),
        "V-10a": same(_number(lit(0), 2), _number(-F.lit(0.0), 2))
        & (K.canon_number(lit(0), 38, 2) == "0.00"),
        "V-10b": (K.canon_number(lit("0.1").cast("decimal(38,10)"), 38, 2) == "0.10")
        & (K.canon_number(lit("1E2").cast("decimal(38,10)"), 38, 2) == "100.00")
        & (K.canon_number(lit("1234").cast("decimal(38,10)"), 38, -2) == "1200")
        & (K.canon_number(lit("2.5").cast("decimal(38,10)"), 38, 0) == "3")
        & (K.canon_number(lit("-2.5").cast("decimal(38,10)"), 38, 0) == "-3"),
        "V-11a": same(_instant(ts("2024-03-10 00:00:00")), _instant(lit("2024-03-10T09:00:00+09:00").cast("timestamp")))
        & same(_instant(ts("2024-03-10 00:00:00")), _instant(lit("2024-03-10").cast("date")))
        # The repeated hour of a clock change: one wall clock, two instants.
        & same(_instant(ts("2024-11-03 05:30:00")), _instant(lit("2024-11-03T01:30:00-04:00").cast("timestamp")))
        & differ(_instant(lit("2024-11-03T01:30:00-04:00").cast("timestamp")), _instant(lit("2024-11-03T01:30:00-05:00").cast("timestamp"))),
        "V-11b": K.canon_timestamp(ts("2024-12-31 23:59:59.9999999")) == "2024-12-31T23:59:59.999999Z",
        "V-12": differ(_raw(F.concat(F.unhex(lit("00FF00")), content)), _raw(F.concat(F.unhex(lit("FF00")), content)))
        & (F.octet_length(K.canon_binary(F.concat(F.unhex(lit("00FF00")), content))) == F.octet_length(base) + 3),
        "V-13": wide_ok,
        "V-14": same(guarded(long_text), lob(long_text)) & same(guarded(limit_text), K.frame(limit_text, K.TAG_STRING)),
        "V-15": differ(lob(base_text), _raw(content)) & differ(_raw(content), K.frame(base_text, K.TAG_STRING))
        & differ(lob(base_text), K.frame(base_text, K.TAG_STRING)),
        "V-16": differ(_text(F.concat(base, lit("a"))), _text(F.concat(base, lit("b")))),
    }


def vector_checks(df: DataFrame, text_column: str) -> DataFrame:
    """Per vector, how many rows were checked and how many behaved as required."""
    steps = Steps()
    checks = vector_table(F.col("_base"), F.col("_one"), steps)
    # A short text costs far more to check than to move, and a small file would be a single task.
    texts = df.select(F.col(text_column).alias("_base")).repartition(4 * df.sparkSession.sparkContext.defaultParallelism)
    one = texts.withColumn("_canonical", K.canon_string("_base")).withColumn("_one", K._digest(K.frame(F.col("_canonical"), K.TAG_STRING)))
    flags = steps.added_to(one).select(*[c.alias(name) for name, c in checks.items()])
    counted = flags.agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(f"`{name}`")).alias(name) for name in checks])
    rows = F.array(*[
        F.struct(F.lit(name).alias("vector_id"), F.col("_n").alias("rows_checked"),
                 F.col(f"`{name}`").alias("rows_as_expected")) for name in checks])
    return counted.select(F.explode(rows).alias("_r")).select("_r.*")
