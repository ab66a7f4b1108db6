"""Personal data: patterns, and information-theoretic sanitisation of the words that give it away.

Base spans come from patterns. For the rest, every value found is a protected entity. The words within a window of
characters around its occurrences are compared with the same words over the whole corpus: with p the share of word
positions, a word t reveals an entity c to the degree PMI(c; t) / IC(c), which is 1 if t only occurs around c and 0
if t is independent of c. Words above the disclosure threshold, seen with the entity in several different contexts,
are spans too, wherever they occur: the strongest are removed, the others generalised. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ROW, shared_table, text_or_empty, with_row

#: Kinds in the order of the contract, then the method's own.
KINDS = ("email", "ip", "card", "phone")
TERM = "term"
LETTERS = r"\p{L}++"
#: The contract's patterns. Repeats are possessive and starts are bound to the front of a run (or the end of the
#: match before), which finds the same matches in linear time and without recursion on long runs.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Characters around an occurrence that count as its context; degree from which a word discloses and from which it
#: is removed instead of generalised; different contexts that must show it.
CONTEXT, DISCLOSES, REMOVED, CONTEXTS = 80, 0.9, 0.98, 2


def may_hold(kind: str, text: Column) -> Column:
    """A cheap test that every text with a match passes."""
    if kind == "email":
        return text.contains("@")
    if kind == "phone":
        return text.contains("+")
    return text.rlike(r"[0-9]\.[0-9]" if kind == "ip" else r"[0-9][\x20-]?[0-9]")


def valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    octet = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return (F.when(kind == 0, True).when(kind == 1, match.rlike(rf"^{octet}(?:\.{octet}){{3}}$"))
            .when(kind == 2, F.length(digits).between(14, 19) & F.coalesce(F.call_function("luhn_check", digits), F.lit(False)))
            .otherwise(F.length(digits).between(10, 15)))


def base_spans(rows: DataFrame) -> DataFrame:
    """(__row, kind, start, len, match) of the valid matches in (__row, body); offsets are code points."""
    body = F.col("body")
    found = rows.select(ROW, *[
        F.when(may_hold(kind, body), F.split(body, PATTERNS[kind], -1)).alias(f"gaps_{kind}") for kind in KINDS], *[
        F.when(may_hold(kind, body), F.regexp_extract_all(body, F.lit(PATTERNS[kind]), 0)).alias(f"hits_{kind}") for kind in KINDS])

    def listed(no: int, kind: str) -> Column:
        gaps, hits = F.col(f"gaps_{kind}"), F.col(f"hits_{kind}")
        each = F.transform(F.sequence(F.lit(1), F.size(hits)), lambda i: F.struct(
            F.lit(no).alias("kind"), i.alias("nth"), F.length(F.get(gaps, i - 1)).cast("long").alias("gap"), F.get(hits, i - 1).alias("match")))
        return F.when(F.size(hits) > 0, each).otherwise(F.array().cast(
            "array<struct<kind:int,nth:int,gap:bigint,match:string>>"))

    some = F.greatest(*[F.size(F.coalesce(f"hits_{k}", F.array().cast("array<string>"))) for k in KINDS]) > 0
    hits = found.where(some).select(ROW, F.explode(F.concat(*[listed(i, k) for i, k in enumerate(KINDS)])).alias("hit")).select(ROW, "hit.*")
    # A match starts after all gaps and matches of its kind before it.
    order = Window.partitionBy(ROW, "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("match").cast("long")
    placed = hits.withColumn("start", F.sum(F.col("gap") + size).over(order) - size)
    return placed.where(valid(F.col("kind"), F.col("match"))).select(ROW, "kind", "start", size.alias("len"), "match")


def masked(body: Column) -> Column:
    """The text with blanks in place of e-mail addresses, the only base spans with letters; offsets stay."""
    p = PATTERNS["email"]
    out = F.zip_with(F.split(body, p, -1), F.regexp_extract_all(body, F.lit(p), 0),
                     lambda gap, hit: F.concat(gap, F.coalesce(F.repeat(F.lit(" "), F.length(hit)), F.lit(""))))
    return F.when(may_hold("email", body), F.array_join(out, "")).otherwise(body)


def _runs(text: Column) -> Column:
    """(gap, word) of the runs of letters in a text, gap being the number of code points since the run before."""
    return F.zip_with(F.split(text, LETTERS, -1), F.regexp_extract_all(text, F.lit(LETTERS), 0),
                      lambda gap, word: F.struct(F.length(gap).cast("long").alias("gap"), word.alias("word")))


def _words(context: Column, start: Column) -> Column:
    """(at, term) of the words of a short context that starts at ``start``."""
    kind = "array<struct<at:bigint,term:string>>"
    words = F.aggregate(
        F.filter(_runs(context), lambda r: r["word"].isNotNull()), F.struct(start.cast("long").alias("end"), F.array().cast(kind).alias("out")),
        lambda acc, r: F.struct((acc["end"] + r["gap"] + F.length(r["word"])).cast("long").alias("end"), F.concat(acc["out"], F.array(F.struct(
            (acc["end"] + r["gap"]).cast("long").alias("at"), F.lower(r["word"]).alias("term")))).alias("out")))
    return words["out"]


def context_words(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """(__row, entity, at, term, context) of the words around each span, once per occurrence and entity.

    A window ends at its size only: other matches, valid or not, do not cut it.
    """
    entity = F.concat_ws(":", "kind", F.when(F.col("kind") == 0, F.lower("match")).when(F.col("kind") == 1, F.col("match")).otherwise(
        F.regexp_replace("match", "[^0-9]", "")))
    held = spans.groupBy(ROW).agg(F.collect_list(F.struct(entity.alias("entity"), "start", (F.col("start") + F.col("len")).alias("end"))).alias("held"))
    text = F.col("text")

    def around(s: Column) -> Column:
        low = F.greatest(s["start"] - CONTEXT - 1, F.lit(0))
        return F.struct(s["entity"].alias("entity"), s["start"].alias("start"), s["end"].alias("end"),
                        F.substring(text, (low + 1).cast("int"), (s["start"] - low).cast("int")).alias("before"),
                        F.substring(text, (s["end"] + 1).cast("int"), F.lit(CONTEXT + 1)).alias("after"))

    near = rows.join(held, ROW).select(ROW, "held", masked(F.col("body")).alias("text"))
    near = near.select(ROW, F.explode(F.transform("held", around)).alias("s")).select(ROW, "s.*")
    # Words that the window cuts are not in it.
    near = near.withColumns({
        "before": F.when(F.length("before") > CONTEXT, F.regexp_replace("before", r"^\p{L}*", "")).otherwise(F.col("before")),
        "after": F.when(F.length("after") > CONTEXT, F.regexp_replace("after", r"\p{L}*$", "")).otherwise(F.col("after"))})
    words = near.select(ROW, "entity", F.xxhash64("before", "after").alias("context"), F.explode(F.concat(
        _words(F.col("before"), F.col("start") - F.length("before")), _words(F.col("after"), F.col("end")))).alias("w"))
    return words.groupBy(ROW, "entity", F.col("w.at").alias("at"), F.col("w.term").alias("term")).agg(F.min("context").alias("context"))


def word_counts(rows: DataFrame) -> DataFrame:
    """(term, n) over all texts: runs of letters outside e-mail addresses, lower-cased."""
    words = rows.select(F.explode(F.split(masked(F.col("body")), r"[^\p{L}]+")).alias("word")).where("word <> ''")
    return words.groupBy(F.lower("word").alias("term")).agg(F.count("*").alias("n"))


def told_words(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(__row, at, len, degree) of all occurrences of (term, degree) in all texts; only texts with one are placed word by word."""
    words = rows.select(ROW, F.explode(F.array_distinct(F.split(masked(F.col("body")), r"[^\p{L}]+"))).alias("word"))
    some = words.select(ROW, F.lower("word").alias("term")).join(terms.select("term"), "term", "left_semi").select(ROW).distinct()
    runs = rows.join(some, ROW, "left_semi").select(ROW, F.posexplode(_runs(masked(F.col("body")))).alias("nth", "run"))
    runs = runs.select(ROW, "nth", "run.*").where("word IS NOT NULL")
    size = F.length("word").cast("long")
    order = Window.partitionBy(ROW).orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    placed = runs.select(ROW, (F.sum(F.col("gap") + size).over(order) - size).alias("at"), size.alias("len"), F.lower("word").alias("term"))
    return placed.join(terms, "term").select(ROW, "at", "len", "degree")


def disclosures(near: DataFrame, counts: DataFrame, discloses: float = DISCLOSES, contexts: int = CONTEXTS) -> DataFrame:
    """(entity, term, degree) of the words whose disclosure degree reaches the threshold."""
    together = near.groupBy("entity", "term", "context").agg(F.count("*").alias("n")).groupBy("entity", "term").agg(
        F.sum("n").alias("both"), F.count("*").alias("contexts")).where(F.col("contexts") >= contexts)
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    around = near.groupBy("entity").agg(F.count("*").alias("around"))
    known = together.join(around, "entity").join(counts, "term")
    ic = -F.log2(F.col("around") / F.lit(float(max(1, total))))
    degree = F.when(ic > 0, 1 + F.log2(F.least(F.lit(1.0), F.col("both") / F.col("n"))) / ic).otherwise(0.0)
    return known.select("entity", "term", degree.alias("degree")).where(F.col("degree") >= discloses)


def findings(rows: DataFrame, discloses: float = DISCLOSES, removed: float = REMOVED, contexts: int = CONTEXTS) -> DataFrame:
    """(__row, kind, start, end, action) of all spans in (__row, body); kind is a number, 4 for the method's terms."""
    spans = shared_table(base_spans(rows), "pii-spans")
    near = shared_table(context_words(rows, spans), "pii-context")
    counts = shared_table(word_counts(rows), "pii-words")
    telling = disclosures(near, counts, discloses, contexts).groupBy("term").agg(F.max("degree").alias("degree"))
    terms = told_words(rows, shared_table(telling, "pii-telling"))
    base = spans.select(ROW, "kind", "start", (F.col("start") + F.col("len")).alias("end"), F.lit("generalise").alias("action"))
    own = terms.select(ROW, F.lit(len(KINDS)).alias("kind"), F.col("at").alias("start"), (F.col("at") + F.col("len")).alias("end"),
                       F.when(F.col("degree") >= removed, "remove").otherwise("generalise").alias("action"))
    return base.unionAll(own)


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, (*KINDS, TERM)))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def with_findings(df: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """(id, __row, spans): sorted (start, kind, end, action) of each row of ``df``, which has the row key."""
    rows = df.select(ROW, text_or_empty(text_col).alias("body"))
    per_row = findings(rows, **options).groupBy(ROW).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "action"))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,action:string>>")
    return df.select(F.col(id_col).alias("id"), ROW).join(per_row, ROW, "left").select("id", ROW, F.coalesce("spans", none).alias("spans"))


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term) per row of ``df``.

    Base spans are leftmost and do not overlap within a kind; matches that fail their check are dropped. ``spans``
    and the digest list kind:start:end by start, then kind; offsets are code points, the end exclusive. A null text
    counts as empty; ids may be null or repeat, since rows are told apart by their place; an empty table gives an
    empty result; other columns are not read. A word that gives an entity away is marked in all texts.
    """
    out = with_findings(with_row(df.select(id_col, text_col)), id_col, text_col, **options)
    base = F.filter("spans", lambda s: s["kind"] < len(KINDS))

    def count(no: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == no)).cast("long")

    return out.select(F.col("id").alias(id_col), *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
                      F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), count(len(KINDS)).alias("n_term"))


def sanitised(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` with their text rewritten: [EMAIL] and so on for spans, [TERM] for generalised words.

    A span inside an earlier one is covered by it; of overlapping spans the first gives the name.
    """
    rows = with_row(df)
    out = with_findings(rows, id_col, text_col, **options).where(F.size("spans") > 0).select(ROW, "spans")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in (*KINDS, TERM)])
    text = F.col(text_col)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        mark = F.when(s["action"] == "remove", "").otherwise(F.get(names, s["kind"]))
        piece = F.array(F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), mark)
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("spans", start, step, lambda acc: F.concat(
        F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2 ** 31 - 1))))
    return rows.join(out, ROW, "left").withColumn(text_col, F.when(F.col("spans").isNull(), text).otherwise(clean)).select(*df.columns)
