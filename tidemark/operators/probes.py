"""Capability probes: classification, capability axes, floors, and completeness of probe runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.windows import as_col

# Source error codes by what they prove.
UNSUPPORTED_CODES = (900, 923, 933, 2003, 30491)
DENIED_CODES = (1031, 1039)
WRONG_TARGET_CODES = (942, 4043, 1435, 1918)
PROBE_BUG_CODES = (909, 932, 936, 1722, 1789, 1790, 1858, 6502)
AMBIGUOUS_CODES = (904, 6550)
TRANSIENT_CODES = (1013, 60, 3113, 3114, 3135, 12170, 12541, 12545, 12571, 1555, 28)
DELAY_ENFORCED_CODE = 3172

# What a probe must return. (probe, needs row, needs value, value pattern, codes that
# mean absence for this probe alone)
PROBE_RULES = (
    ("dbms_flashback.get_scn", True, True, r"^\d+$", ()),
    ("as_of_timestamp.target", True, False, None, ()),
    ("v$dataguard_stats", True, True, None, ()),
    ("alter.STANDBY_MAX_DATA_DELAY.D", False, False, None, (2248,)),
    ("alter.STANDBY_MAX_DATA_DELAY.zero", False, False, None, (2248,)),
    ("max_delay_zero.touch_target", False, False, None, ()),
    ("feat.standard_hash_sha256", False, True, None, (904,)),
    ("feat.fetch_first", False, False, None, (900, 923, 933)),
    ("nls.characterset", True, True, r"^[A-Z0-9_]+$", ()),
    ("nls.nchar_characterset", False, True, r"^[A-Z0-9_]+$", ()),
    ("feat.rowdependencies_target", False, True, r"^(ENABLED|DISABLED)$", ()),
    ("feat.ora_rowscn_target", True, False, None, ()),
    ("timestamp_to_scn", False, False, None, ()),
    ("scn_to_timestamp.roundtrip", False, False, None, ()),
    ("wm_column.type_facts", False, True, r"^[A-Z][A-Z0-9_ ]*(\(\d+(\s*,\s*-?\d+)?\))?\|", ()),
    ("v$parameter.max_string", False, True, None, ()),
)

# Axis -> (scope, values from strongest to weakest or None, floor).
AXES: dict[str, tuple[str, tuple[str, ...] | None, str]] = {
    "snapshot_anchor": ("ACCOUNT", ("SCN", "TIMESTAMP", "NONE", "UNDETERMINED"), "NONE"),
    "lag_observation": ("DB", ("DG_STATS", "NONE", "UNDETERMINED"), "NONE"),
    "lag_admission": ("CONNECTION", ("MAX_DELAY_ENFORCED", "NONE", "UNDETERMINED"), "NONE"),
    "hash_function": ("DB", ("SHA256", "NONE", "UNDETERMINED"), "NONE"),
    "sql_dialect": ("DB", ("12C_PLUS", "11G", "UNDETERMINED"), "11G"),
    "db_charset": ("DB", None, "UNDETERMINED"),
    "snapshot_object_coverage": ("TABLE", ("ALL", "PARTIAL", "NONE", "UNDETERMINED"), "NONE"),
    "row_change_scn": ("TABLE", ("ROW_LEVEL", "BLOCK_LEVEL", "NONE", "UNDETERMINED"), "NONE"),
    "watermark_commit_bound": ("COLUMN", ("ENFORCED", "OBSERVED", "NONE", "UNDETERMINED"), "NONE"),
    "wm_successor": ("COLUMN", None, "UNDEFINED"),
    "snapshot_scope": ("RUNTIME", ("JOB", "CONNECTION", "STATEMENT", "NONE", "UNDETERMINED"), "STATEMENT"),
    "canonical_row_compare": ("RUNTIME", ("VECTORS_PROVEN", "PARTIAL", "NONE", "UNDETERMINED"), "NONE"),
    "cross_source_comparable": ("RUNTIME", ("YES", "NO", "UNDETERMINED"), "NO"),
}
COMPOSITE_INPUTS = {
    "snapshot_scope": ("snapshot_anchor", "snapshot_object_coverage"),
    "canonical_row_compare": ("hash_function",),
    "cross_source_comparable": ("db_charset",),
}
BOUND_SCOPES = ("TABLE", "COLUMN")
ATOMIC_AXES = tuple(a for a in AXES if a not in COMPOSITE_INPUTS)


def probe_rules(spark: SparkSession) -> DataFrame:
    """The rule table as a DataFrame: one row per known probe."""
    schema = T.StructType([
        T.StructField("probe", T.StringType()), T.StructField("requires_row", T.BooleanType()),
        T.StructField("requires_value", T.BooleanType()), T.StructField("grammar", T.StringType()),
        T.StructField("absent_codes", T.ArrayType(T.IntegerType()))])
    return spark.createDataFrame([(p, r, v, g, list(c)) for p, r, v, g, c in PROBE_RULES], schema)


def error_code(ora: Column | str = "ora", msg: Column | str = "msg") -> Column:
    """Absolute error code, read from the message text when the number is missing."""
    o = F.col(ora) if isinstance(ora, str) else ora
    m = F.col(msg) if isinstance(msg, str) else msg
    return F.coalesce(
        F.abs(o).cast("int"), F.nullif(F.regexp_extract(m, r"ORA-(\d+)", 1), F.lit("")).cast("int"))


def classify_probes(probes: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``error_code`` and ``kind``, the typed outcome of each probe.

    ``probes``: probe, query_ok, row_present, has_value, value, value_interpretable, ora, msg.
    Only UNSUPPORTED speaks for absence; everything else that is not OK means "not known".
    The rule table has one row per contracted probe, so it is broadcast.
    """
    joined = probes.join(F.broadcast(rules), "probe", "left").withColumn("error_code", error_code())
    code = F.col("error_code")
    in_ = lambda codes: code.isin(*codes)
    needs_value = F.coalesce(F.col("requires_value"), F.lit(False))
    value = F.col("value")
    answered = (
        F.when(~F.coalesce(F.col("row_present"), F.lit(True)), "EMPTY")
        .when(value.isNull() & (F.col("has_value") | needs_value), "EMPTY")
        .when(needs_value & (F.trim(value) == ""), "EMPTY")
        .when(~F.coalesce(F.col("value_interpretable"), F.lit(True)), "NOT_INTERPRETABLE")
        .when(F.col("grammar").isNotNull() & value.isNotNull() & ~F.expr("value RLIKE grammar"), "GRAMMAR")
        .otherwise("OK"))
    refused = (
        F.when(code.isNull(), "UNKNOWN").when(in_(TRANSIENT_CODES), "TRANSIENT")
        .when(F.array_contains("absent_codes", code), "UNSUPPORTED")
        .when(in_(UNSUPPORTED_CODES), "UNSUPPORTED").when(in_(DENIED_CODES), "DENIED")
        .when(in_(WRONG_TARGET_CODES), "WRONG_TARGET").when(in_(PROBE_BUG_CODES), "PROBE_BUG")
        .when(in_(AMBIGUOUS_CODES), "AMBIGUOUS").otherwise("UNKNOWN"))
    kind = F.when(F.coalesce(F.col("query_ok"), F.lit(False)), answered).otherwise(refused)
    return joined.withColumn("kind", kind).select(*probes.columns, "error_code", "kind")


def _axis_rows(wide: DataFrame, key: str, axes: Sequence[str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("value")) for a in axes])
    return wide.select(key, F.explode(rows).alias("_a")).select(key, "_a.*")


def derive_axes(classified: DataFrame, key: str = "source_id") -> DataFrame:
    """Atomic capability axes per source, as rows (key, axis, value)."""
    return _axis_rows(_wide_axes(classified, key), key, ATOMIC_AXES)


def derive_all_axes(classified: DataFrame, key: str = "source_id") -> DataFrame:
    """Atomic and composite axes in one aggregation."""
    wide = _wide_axes(classified, key)
    values = _composites(F.col("snapshot_anchor"), F.col("snapshot_object_coverage"), F.col("hash_function"))
    return _axis_rows(wide.withColumns(values), key, tuple(AXES))


def _wide_axes(classified: DataFrame, key: str) -> DataFrame:
    """One row per source, one column per atomic axis."""

    def pick(probe: str, column: str) -> Column:
        return F.max(F.when(F.col("probe") == probe, F.col(column)))

    wanted = {
        "scn": "dbms_flashback.get_scn", "asof": "as_of_timestamp.target", "lag": "v$dataguard_stats",
        "delay": "alter.STANDBY_MAX_DATA_DELAY.D", "hash": "feat.standard_hash_sha256",
        "fetch": "feat.fetch_first", "charset": "nls.characterset", "dep": "feat.rowdependencies_target",
        "rowscn": "feat.ora_rowscn_target", "t2s": "timestamp_to_scn", "s2t": "scn_to_timestamp.roundtrip",
        "wm": "wm_column.type_facts",
    }
    wide = classified.groupBy(key).agg(
        *[F.coalesce(pick(p, "kind"), F.lit("ABSENT")).alias(n) for n, p in wanted.items()],
        pick("max_delay_zero.touch_target", "error_code").alias("touch_code"),
        pick(wanted["hash"], "value_interpretable").alias("hash_checked"),
        pick(wanted["charset"], "value").alias("charset_value"),
        pick(wanted["dep"], "value").alias("dep_value"),
        pick(wanted["wm"], "value").alias("wm_value"))
    ok = lambda n: F.col(n) == "OK"
    gone = lambda n: F.col(n) == "UNSUPPORTED"
    known = lambda n: ok(n) | gone(n)
    unknown = F.lit("UNDETERMINED")
    base = F.upper(F.split_part(F.col("wm_value"), F.lit("|"), F.lit(1)))
    scale = F.nullif(F.regexp_extract("wm_value", r"scale=(-?\d+)", 1), F.lit("")).cast("int")
    successor_kind = (
        F.when(~ok("wm"), unknown)
        .when(base.startswith("TIMESTAMP"),
              F.when(scale.between(0, 9), F.concat(F.lit("TIMESTAMP("), scale.cast("string"), F.lit(")"))).otherwise(unknown))
        .when(base == "DATE", "DATE")
        .when(base == "NUMBER",
              F.when(scale.isNotNull(), F.concat(F.lit("NUMBER(scale="), scale.cast("string"), F.lit(")"))).otherwise(unknown))
        .otherwise("UNDEFINED"))
    values = {
        "snapshot_anchor": F.when(ok("scn"), "SCN").when(ok("asof"), "TIMESTAMP")
        .when(gone("scn") & gone("asof"), "NONE").otherwise(unknown),
        "lag_observation": F.when(ok("lag"), "DG_STATS").when(gone("lag"), "NONE").otherwise(unknown),
        "lag_admission": F.when(F.col("touch_code") == DELAY_ENFORCED_CODE, "MAX_DELAY_ENFORCED")
        .when(gone("delay"), "NONE").otherwise(unknown),
        "hash_function": F.when(ok("hash") & F.coalesce(F.col("hash_checked"), F.lit(False)), "SHA256")
        .when(gone("hash") | (F.col("hash") == "NOT_INTERPRETABLE"), "NONE").otherwise(unknown),
        "sql_dialect": F.when(ok("fetch"), "12C_PLUS").when(gone("fetch"), "11G").otherwise(unknown),
        "db_charset": F.when(ok("charset"), F.upper("charset_value")).otherwise(unknown),
        "snapshot_object_coverage": F.when(ok("asof"), "PARTIAL").when(gone("asof"), "NONE").otherwise(unknown),
        "row_change_scn": F.when(gone("rowscn"), "NONE").when(~ok("rowscn") | ~ok("dep"), unknown)
        .when(F.upper("dep_value") == "ENABLED", "ROW_LEVEL").otherwise("BLOCK_LEVEL"),
        "watermark_commit_bound": F.when(~(known("t2s") & known("s2t") & known("rowscn")), unknown)
        .when(ok("rowscn") & ok("s2t"), "OBSERVED").otherwise("NONE"),
        "wm_successor": successor_kind,
    }
    return wide.select(key, *[v.alias(a) for a, v in values.items()])


def _composites(anchor: Column, coverage: Column, hashing: Column) -> dict[str, Column]:
    unknown = F.lit("UNDETERMINED")
    return {
        "snapshot_scope": F.when((anchor == unknown) | (coverage == unknown), unknown)
        .when(anchor == "NONE", "STATEMENT").when(coverage != "ALL", "CONNECTION").otherwise("JOB"),
        "canonical_row_compare": F.when(hashing == unknown, unknown).when(hashing == "NONE", "NONE").otherwise("PARTIAL"),
        "cross_source_comparable": unknown,
    }


def compose_axes(axes: DataFrame, key: str = "source_id") -> DataFrame:
    """Composite axes. Any undetermined input leaves the result undetermined.

    JOB needs full object coverage, which probing one table cannot show; VECTORS_PROVEN and a
    cross-source claim likewise need evidence that a single source's probes do not hold.
    """
    take = lambda a: F.coalesce(F.max(F.when(F.col("axis") == a, F.col("value"))), F.lit("UNDETERMINED"))
    inputs = ("snapshot_anchor", "snapshot_object_coverage", "hash_function")
    wide = axes.groupBy(key).agg(*[take(a).alias(a) for a in inputs])
    values = _composites(*[F.col(a) for a in inputs])
    return _axis_rows(wide.withColumns(values), key, tuple(values))


def _lookup(pairs: Mapping[str, object], column: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), column)


def floored(axis: Column, value: Column) -> Column:
    """Lower a value to its axis's floor. Never raises: UNDETERMINED and weaker values stay."""
    ranks = {f"{a}={v}": i for a, (_, values, _) in AXES.items() for i, v in enumerate(values or ())}
    floors = {a: f for a, (_, _, f) in AXES.items()}
    floor_ranks = {a: values.index(f) for a, (_, values, f) in AXES.items() if values}
    floor = _lookup(floors, axis)
    rank = F.try_element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), F.concat_ws("=", axis, value))
    limit = F.try_element_at(F.create_map(*[F.lit(x) for kv in floor_ranks.items() for x in kv]), axis)
    return F.when(value == "UNDETERMINED", value).when(rank.isNull() | limit.isNull(), floor).when(
        rank >= limit, value).otherwise(floor)


def apply_floors(axes: DataFrame, now, ttl: timedelta | None, key: str = "source_id",
                 reasons_all: Sequence[str] = ()) -> DataFrame:
    """Add expiry, freshness basis, floor reasons and ``effective_value``.

    ``axes``: key, axis, value, measured_at, is_bound, extra_reasons (array, may be NULL). A
    composite follows its inputs down. A source has one row per axis, so its window is small.
    """
    value, measured = F.col("value"), F.col("measured_at")
    expires = measured + F.lit(ttl) if ttl else F.lit(None).cast("timestamp_ntz")
    basis = F.when(measured.isNull(), "NO_MEASUREMENT").otherwise(
        F.lit("OPERATOR_DECLARED_TTL" if ttl else "NO_TTL_DECLARED"))
    stale = F.coalesce(expires < as_col(now), F.lit(False))
    claims = value != "UNDETERMINED"
    bound_axes = [a for a, (scope, _, _) in AXES.items() if scope in BOUND_SCOPES]
    reasons = F.array_compact(F.concat(
        F.array(*[F.lit(r) for r in reasons_all]).cast("array<string>"),
        F.coalesce(F.col("extra_reasons"), F.array().cast("array<string>")),
        F.array(
            F.when(F.col("stale"), "STALE"),
            F.when(claims & (F.col("freshness_basis") != "OPERATOR_DECLARED_TTL"), "NO_FRESHNESS_BASIS"),
            F.when(claims & F.col("axis").isin(*bound_axes) & ~F.col("is_bound"), "UNBOUND"))))
    first = (
        axes.withColumn("expires_at", expires).withColumn("freshness_basis", basis).withColumn("stale", stale)
        .withColumn("_reasons", F.array_distinct(reasons)))
    w = Window.partitionBy(key)
    lowered = F.lit(False)
    for composite, inputs in COMPOSITE_INPUTS.items():
        hit = F.max(F.when(F.col("axis").isin(*inputs) & (F.size("_reasons") > 0), True)).over(w)
        lowered = lowered | ((F.col("axis") == composite) & F.coalesce(hit, F.lit(False)))
    second = first.withColumn("_low", lowered).withColumn(
        "floor_reasons",
        F.when(F.col("_low"), F.array_union("_reasons", F.array(F.lit("COMPOSITE_INPUT_FLOORED")))).otherwise(F.col("_reasons")))
    return second.withColumn(
        "effective_value",
        F.when(F.size("floor_reasons") > 0, floored(F.col("axis"), value)).otherwise(value)).drop("_reasons", "_low")


def probe_set_audit(probes: DataFrame, contract: Sequence[str], summaries: DataFrame, key: str = "source_id") -> DataFrame:
    """Missing, unknown and duplicate probe ids, and wrong self-reported counts, per run.

    ``summaries``: key, expected, emitted. Arrays hold at most the contract's ids.
    """
    ids = F.array(*[F.lit(c) for c in contract])
    counted = probes.groupBy(key, "probe").agg(F.count(F.lit(1)).alias("_n"))
    known = F.array_contains(ids, F.col("probe"))
    per = counted.groupBy(key).agg(
        F.collect_set(F.when(known, F.col("probe"))).alias("_have"), F.sum("_n").cast("bigint").alias("_parsed"))
    lost = per.select(key, F.explode(F.array_except(ids, F.col("_have"))).alias("probe"), F.lit("MISSING").alias("finding"))
    extra = counted.where(~known).select(key, "probe", F.lit("UNKNOWN").alias("finding"))
    twice = counted.where("_n > 1").select(key, "probe", F.lit("DUPLICATE").alias("finding"))
    wrong = summaries.join(per, key, "left").select(
        key, F.lit("(summary)").alias("probe"),
        F.when(F.col("expected") != len(contract), "EXPECTED_COUNT_WRONG").when(
            F.col("emitted") != F.coalesce("_parsed", F.lit(0)), "EMITTED_COUNT_WRONG").alias("finding"),
    ).where(F.col("finding").isNotNull())
    return lost.unionByName(extra).unionByName(twice).unionByName(wrong)


def coverage_status(roster: DataFrame, records: DataFrame, expected: Sequence[str], key: str = "child_id") -> DataFrame:
    """NOT_RUN, FAILED, PARTIAL or MEASURED per child run, with the reason.

    ``records``: key, record_kind (PROBE, SUMMARY, END, UNPARSABLE), probe, manifest_ok, skipped.
    """
    is_ = lambda k: F.col("record_kind") == k
    ids = F.array(*[F.lit(e) for e in expected])
    per = records.groupBy(key).agg(
        F.count_if(~is_("UNPARSABLE")).alias("parsed"),
        F.count_if(is_("SUMMARY")).alias("_sums"), F.count_if(is_("END")).alias("_ends"),
        F.count_if(is_("SUMMARY") & ~F.coalesce(F.col("manifest_ok"), F.lit(True))).alias("_bad"),
        F.count_if(is_("PROBE") & F.coalesce(F.col("skipped"), F.lit(False))).alias("skipped"),
        F.collect_set(F.when(is_("PROBE") & F.array_contains(ids, F.col("probe")), F.col("probe"))).alias("_have"),
        F.lit(True).alias("_seen"))
    miss = F.size(F.array_except(ids, F.col("_have")))
    joined = roster.select(key).join(per, key, "left")
    reason = (
        F.when(F.col("_seen").isNull(), "NOT_RUN:").when(F.col("parsed") == 0, "FAILED:NOTHING_PARSABLE")
        .when(F.col("_sums") == 0, "PARTIAL:NO_SUMMARY").when(F.col("_bad") > 0, "FAILED:MANIFEST_BROKEN")
        .when(F.col("_ends") == 0, "PARTIAL:NO_END_SENTINEL").when(miss > 0, "PARTIAL:PROBES_MISSING")
        .when(F.col("skipped") > 0, "PARTIAL:PROBES_SKIPPED").otherwise("MEASURED:"))
    return joined.select(
        key, F.split_part(reason, F.lit(":"), F.lit(1)).alias("status"),
        F.split_part(reason, F.lit(":"), F.lit(2)).alias("reason"),
        F.when(F.col("_seen").isNotNull(), miss).cast("bigint").alias("missing_probes"))


def run_set_conflicts(manifests: DataFrame, children: Sequence[str]) -> DataFrame:
    """Run sets whose children do not belong together.

    ``manifests``: set_id, child, scope, run_id, source_id, versions_digest, harness_digest.
    """
    real = lambda c: F.when(~F.col(c).isin("", "MISSING"), F.col(c))
    rules = {
        "run_id": "MIXED_RUN", "versions_digest": "MIXED_VERSIONS", "harness_digest": "MIXED_HARNESS"}
    per = manifests.groupBy("set_id").agg(*[F.count_distinct(real(c)).alias(c) for c in rules])
    found = F.array_compact(F.array(*[F.when(F.col(c) > 1, n) for c, n in rules.items()]))
    mixed = per.select("set_id", F.explode(found).alias("finding"), F.lit("").alias("detail"))
    scoped = manifests.groupBy("set_id", "scope").agg(F.count_distinct(real("source_id")).alias("_n")).where("_n > 1").select(
        "set_id", F.lit("MIXED_SOURCE_IN_SCOPE").alias("finding"), F.col("scope").alias("detail"))
    unknown = manifests.where(~F.col("child").isin(*children)).select(
        "set_id", F.lit("UNKNOWN_CHILD").alias("finding"), F.col("child").alias("detail")).distinct()
    names = lambda s: manifests.where((F.col("scope") == s) & real("source_id").isNotNull()).select(
        "set_id", F.upper("source_id").alias("detail"))
    shared = names("SOURCE").intersect(names("COUNTEREXAMPLE")).select(
        "set_id", F.lit("SCOPES_SHARE_DATABASE").alias("finding"), "detail")
    return mixed.unionByName(scoped).unionByName(unknown).unionByName(shared)


def axis_distribution(axes: DataFrame) -> DataFrame:
    """Sources per axis value, and the value's share of its axis."""
    counts = axes.groupBy("axis", "value").agg(F.count(F.lit(1)).alias("source_count"))
    totals = counts.groupBy("axis").agg(F.sum("source_count").alias("_all"))
    return counts.join(totals, "axis").select(
        "axis", "value", "source_count", F.round(F.col("source_count") / F.col("_all"), 6).alias("share"))


def suite_verdict(results: DataFrame, required: Sequence[str], key: str = "suite_id") -> DataFrame:
    """Did every required scenario run with its injection seen, and did the mitigation hold?

    ``results``: key, scenario_id, outcome, leftover_objects, cleanup_attempted, cleanup_succeeded,
    has_error. The two answers are separate: a reproduced counterexample is a complete execution.
    """
    ids = F.array(*[F.lit(r) for r in required])
    n = lambda o: F.count_if(F.col("outcome") == o)
    per = results.groupBy(key).agg(
        F.collect_set(F.when(F.array_contains(ids, F.col("scenario_id")), F.col("scenario_id"))).alias("_ran"),
        F.count(F.lit(1)).alias("scenario_count"),
        n("INJECTION_NOT_OBSERVED").alias("not_observed"), n("INCONCLUSIVE").alias("inconclusive"),
        n("COUNTEREXAMPLE_REPRODUCED").alias("reproduced"), n("MITIGATION_FAIL").alias("mitigation_failed"),
        F.count_if((F.col("leftover_objects") > 0) | ~F.col("cleanup_attempted") | ~F.col("cleanup_succeeded")).alias("unclean"),
        F.count_if("has_error").alias("errored"))
    missing = F.size(F.array_except(ids, F.col("_ran"))).cast("bigint")
    rated = per.withColumn("missing", missing)
    complete = (
        (F.col("missing") == 0) & (F.col("not_observed") == 0) & (F.col("inconclusive") == 0)
        & (F.col("unclean") == 0) & (F.col("errored") == 0) & F.lit(len(required) > 0))
    holds = (
        (F.col("missing") == 0) & (F.col("not_observed") == 0) & (F.col("inconclusive") == 0)
        & (F.col("reproduced") == 0) & (F.col("mitigation_failed") == 0))
    return rated.withColumn("execution_complete", complete).withColumn("mitigation_holds", holds).drop("_ran")
