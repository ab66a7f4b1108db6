"""Canonical text, row hashes and two-sided comparison over the sample tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.functions import canon as K
from tidemark.functions.vectors import vector_checks
from tidemark.operators import compare as P
from tidemark.plans.canon_sql import column_sql, row_hash_sql
from tidemark.plans.registry import query

ORDER_RULES = [
    ("o_orderkey", "NUMBER", 0), ("o_custkey", "NUMBER", 0), ("o_orderstatus", "STRING", None),
    ("o_totalprice", "NUMBER", 2), ("o_orderdate", "TIMESTAMP", None), ("o_orderpriority", "STRING", None),
]
_ORDER_HASH = row_hash_sql(ORDER_RULES)
ORDER_COLS = [c for c, _, _ in ORDER_RULES]


def _rules(t):
    return K.rules_from_schema(t.orders.schema, ORDER_COLS, {"o_totalprice": 2})



@query("canonical_number", """
SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS price_2,
       CAST(CAST(l_extendedprice AS DECIMAL(18,4)) AS VARCHAR) AS price_4,
       CAST(CAST(round(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) / 100, 0) * 100 AS BIGINT) AS VARCHAR) AS price_hundreds,
       CAST(l_partkey - 1000 AS VARCHAR) AS signed_int,
       CAST(CAST(l_discount - 0.05 AS DECIMAL(18,2)) AS VARCHAR) AS signed_2
FROM lineitem
""")
def _(t):
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        K.canon_number(price, 18, 2).alias("price_2"), K.canon_number(price, 18, 4).alias("price_4"),
        K.canon_number(price, 18, -2).alias("price_hundreds"),
        K.canon_number(F.col("l_partkey") - 1000).alias("signed_int"),
        K.canon_number(F.col("l_discount") - 0.05, 38, 2).alias("signed_2"))


@query("canonical_timestamp", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS text, 27 AS text_bytes FROM events
""")
def _(t):
    text = K.canon_timestamp("ts")
    return t.events.select("event_id", text.alias("text"), F.octet_length(text).cast("bigint").alias("text_bytes"))


@query("canonical_string", """
SELECT doc_id, sha256(encode(nfc_normalize(text))) AS digest, octet_length(encode(nfc_normalize(text))) AS n_bytes,
       sha256(encode(nfc_normalize(replace(text, 'e', 'e' || chr(769))))) AS recomposed
FROM documents
""")
def _(t):
    text = K.canon_string("text")
    marked = K.canon_string(F.replace("text", F.lit("e"), F.lit("e\u0301")))
    return t.documents.select(
        "doc_id", F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("bigint").alias("n_bytes"),
        F.sha2(marked, 256).alias("recomposed"))


@query("canonical_lob", f"""
SELECT doc_id, lower(hex({column_sql('text', 'LOB', None)})) AS lob_frame,
       lower(hex({column_sql('source', 'STRING', None)})) AS source_frame,
       sha256({column_sql('text', 'STRING', None)}) AS guarded_digest,
       lower(hex({column_sql('encode(lang)', 'BINARY', None)})) AS binary_frame
FROM (SELECT doc_id, text, lang, CASE WHEN doc_id % 5 = 0 THEN '' ELSE source END AS source FROM documents)
""")
def _(t):
    docs = t.documents.withColumn("source", F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("source"))).withColumn(
        "lang_raw", F.encode("lang", "UTF-8"))
    frame = K.column_bytes
    return docs.select(
        "doc_id",
        F.lower(F.hex(frame(K.ColumnRule("text", "LOB")))).alias("lob_frame"),
        F.lower(F.hex(frame(K.ColumnRule("source", "STRING")))).alias("source_frame"),
        F.sha2(frame(K.ColumnRule("text", "STRING")), 256).alias("guarded_digest"),
        F.lower(F.hex(frame(K.ColumnRule("lang_raw", "BINARY")))).alias("binary_frame"))


@query("row_hash", f"SELECT o_orderkey, {_ORDER_HASH} AS row_hash FROM orders")
def _(t):
    return P.hashed(t.orders, ["o_orderkey"], _rules(t))


_WIDE = [(f"c{i}", "NUMBER", 0) for i in range(65)]
_WIDE_COLS = ", ".join(f"o_custkey + {i} AS c{i}" for i in range(65))


@query("row_hash_wide", f"""
SELECT o_orderkey, {row_hash_sql(_WIDE[:32])} AS h32, {row_hash_sql(_WIDE[:33])} AS h33,
       {row_hash_sql(_WIDE[:64])} AS h64, {row_hash_sql(_WIDE)} AS h65
FROM (SELECT o_orderkey, {_WIDE_COLS} FROM orders)
""")
def _(t):
    wide = t.orders.select("o_orderkey", *[(F.col("o_custkey") + i).alias(f"c{i}") for i in range(65)])
    rules = [K.ColumnRule(f"c{i}", "NUMBER", 38, 0) for i in range(65)]
    return wide.select("o_orderkey", *[K.row_hash(rules[:n]).alias(f"h{n}") for n in (32, 33, 64, 65)])


@query("hash_vectors", """
SELECT vector_id, COUNT(*) AS rows_checked, COUNT(*) AS rows_as_expected FROM customer,
  (VALUES ('V-03/04'), ('V-05'), ('V-06'), ('V-07a'), ('V-07b'), ('V-08'), ('V-09'), ('V-10a'), ('V-10b'), ('V-11a'), ('V-11b'),
          ('V-12'), ('V-13'), ('V-14'), ('V-15'), ('V-16')) v(vector_id)
GROUP BY vector_id
""")
def _(t):
    return vector_checks(t.customer, "c_name")


_EXACT_SQL = f"""
WITH s AS (SELECT *, {_ORDER_HASH} AS h FROM orders), g AS (SELECT *, {_ORDER_HASH} AS h FROM fx_tgt_orders)
SELECT COALESCE(s.o_orderkey, g.o_orderkey) AS o_orderkey, s.h AS source_hash, g.h AS target_hash, CAST(s.h IS NOT NULL AS BIGINT) AS source_rows, CAST(g.h IS NOT NULL AS BIGINT) AS target_rows,
       CASE WHEN g.h IS NULL THEN 'MISSING' WHEN s.h IS NULL THEN 'EXTRA' ELSE 'HASH_MISMATCH' END AS difference
FROM s FULL JOIN g ON s.o_orderkey = g.o_orderkey WHERE s.h IS DISTINCT FROM g.h
"""


@query("compare_exact", _EXACT_SQL)
def _(t):
    return P.compare_exact(t.orders, t.fx_tgt_orders, ["o_orderkey"], _rules(t))


@query("compare_exact_bucketed", _EXACT_SQL)
def _(t):
    return P.compare_exact(t.orders, t.fx_tgt_orders, ["o_orderkey"], _rules(t), buckets=512)


@query("compare_tree", _EXACT_SQL)
def _(t):
    return P.compare_tree(t.orders, t.fx_tgt_orders, ["o_orderkey"], _rules(t), bits=6, leaf_rows=20)


@query("compare_tree_few", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'MISSING' ELSE 'HASH_MISMATCH' END AS difference, TRUE AS few_read FROM orders WHERE o_orderkey % 1500 = 7
""")
def _(t):
    # One row in 1,500 differs: of the rows, only those of its leaves are compared by key.
    target = t.orders.where("NOT (o_orderkey % 1500 = 7 AND o_orderkey % 3 = 0)").withColumn(
        "o_totalprice", F.expr("CASE WHEN o_orderkey % 1500 = 7 THEN o_totalprice + 1 ELSE o_totalprice END"))
    leaves, _ = P.differing_leaves(t.orders, target, ["o_orderkey"], _rules(t), 5, 20)
    read, rows = leaves.agg(F.sum("n")).first()[0], t.orders.count()
    found = P.compare_tree(t.orders, target, ["o_orderkey"], _rules(t), bits=5, leaf_rows=20)
    return found.select("o_orderkey", "difference", F.lit(20 * read < rows).alias("few_read"))


@query("compare_uncomparable", """
SELECT o_orderkey, CASE WHEN o_orderkey % 400 = 3 THEN 'MISSING' WHEN o_orderkey % 100 = 3 THEN 'UNCOMPARED' ELSE 'HASH_MISMATCH' END AS difference
FROM orders WHERE o_orderkey % 100 = 3 OR o_orderkey % 89 = 0
""")
def _(t):
    # 1e30 has too many digits at scale 10 in the source; other rows differ, and the bucketed form must find them all.
    rules = K.rules_from_schema(t.orders.schema, scales={"o_totalprice": 10})
    price = lambda expr: F.expr(f"CASE WHEN {expr} ELSE o_totalprice END")
    source = t.orders.withColumn("o_totalprice", price("o_orderkey % 100 = 3 THEN 1e30D"))
    target = source.where("o_orderkey % 400 <> 3").withColumn("o_totalprice", price("o_orderkey % 89 = 0 AND o_orderkey % 100 <> 3 THEN o_totalprice + 1"))
    return P.compare_exact(source, target, ["o_orderkey"], rules, buckets=256).select("o_orderkey", "difference")


# Planted: a third decimal, NaN against NULL, infinity against NaN, repeated keys and keys that are NULL.
_PLANTED = """
WITH s AS (SELECT o_orderkey AS k, CASE o_orderkey % 11 WHEN 1 THEN 1.001 WHEN 2 THEN CAST('NaN' AS DOUBLE) WHEN 3 THEN CAST('Infinity' AS DOUBLE) ELSE 5.0 END AS v FROM orders),
g AS (SELECT CASE WHEN k % 13 = 0 THEN NULL ELSE k END AS k,
             CASE k % 11 WHEN 1 THEN 1.004 WHEN 2 THEN NULL WHEN 3 THEN CASE WHEN k % 2 = 0 THEN CAST('NaN' AS DOUBLE) ELSE v END ELSE v END AS v FROM s
      UNION ALL SELECT k, v FROM s WHERE k % 17 = 0 AND k % 13 <> 0)
"""


@query("compare_exact_planted", f"""{_PLANTED},
a AS (SELECT k, COUNT(*) AS n FROM s GROUP BY k), b AS (SELECT k, COUNT(*) AS n FROM g GROUP BY k)
SELECT COALESCE(a.k, b.k) AS k, COALESCE(a.n, 0) AS source_rows, COALESCE(b.n, 0) AS target_rows,
  CASE WHEN COALESCE(a.k, b.k) IS NULL THEN 'NULL_KEY' WHEN a.n > 1 OR b.n > 1 THEN 'DUPLICATE_KEY' WHEN b.n IS NULL THEN 'MISSING' ELSE 'HASH_MISMATCH' END AS difference
FROM a FULL JOIN b ON a.k = b.k
WHERE b.k IS NULL OR a.k IS NULL OR a.n > 1 OR b.n > 1 OR a.k % 11 IN (1, 2) OR (a.k % 11 = 3 AND a.k % 2 = 0)
""")
def _(t):
    s = t.orders.selectExpr("o_orderkey AS k", """CASE o_orderkey % 11 WHEN 1 THEN 1.001D WHEN 2 THEN double('NaN')
        WHEN 3 THEN double('Infinity') ELSE 5.0D END AS v""")
    g = s.selectExpr("CASE WHEN k % 13 = 0 THEN NULL ELSE k END AS k", """CASE k % 11 WHEN 1 THEN 1.004D WHEN 2 THEN NULL
        WHEN 3 THEN CASE WHEN k % 2 = 0 THEN double('NaN') ELSE v END ELSE v END AS v""").unionAll(s.where("k % 17 = 0 AND k % 13 <> 0"))
    found = P.compare_exact(s, g, ["k"], K.rules_from_schema(s.schema, scales={"v": 3}))
    return found.select("k", "source_rows", "target_rows", "difference")


@query("cell_differences", """
SELECT s.o_orderkey, 'o_totalprice' AS column_name, CAST(s.o_totalprice AS VARCHAR) AS source_value, CAST(g.o_totalprice AS VARCHAR) AS target_value
FROM orders s JOIN fx_tgt_orders g USING (o_orderkey) WHERE s.o_totalprice <> g.o_totalprice
""")
def _(t):
    return P.cell_diff(t.orders, t.fx_tgt_orders, ["o_orderkey"], ORDER_COLS[1:])


@query("compare_settled", f"""
WITH s AS (SELECT *, {_ORDER_HASH} AS h FROM orders WHERE o_orderdate < TIMESTAMP '2001-07-01'),
g AS (SELECT *, {_ORDER_HASH} AS h FROM fx_tgt_orders WHERE o_orderdate < TIMESTAMP '2001-07-01')
SELECT COALESCE(s.o_orderkey, g.o_orderkey) AS o_orderkey, s.h AS source_hash, g.h AS target_hash, CAST(s.h IS NOT NULL AS BIGINT) AS source_rows, CAST(g.h IS NOT NULL AS BIGINT) AS target_rows,
       CASE WHEN g.h IS NULL THEN 'MISSING' WHEN s.h IS NULL THEN 'EXTRA' ELSE 'HASH_MISMATCH' END AS difference,
       s.h IS NULL AND g.o_orderdate >= TIMESTAMP '2001-08-02' - INTERVAL 200 DAY AS is_explained
FROM s FULL JOIN g ON s.o_orderkey = g.o_orderkey WHERE s.h IS DISTINCT FROM g.h
""")
def _(t):
    return P.compare_settled(
        t.orders, t.fx_tgt_orders, ["o_orderkey"], "o_orderdate", datetime(2001, 7, 1), datetime(2001, 8, 2),
        timedelta(days=200), _rules(t))


@query("classified_differences", f"""
WITH d AS (SELECT o_orderkey FROM ({_EXACT_SQL})),
u AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 445 = 0),
e AS (SELECT o_orderkey + 10000000 AS o_orderkey, 'DELETE' AS reason FROM orders WHERE o_orderkey % 202 = 0
      UNION ALL SELECT o_orderkey, 'PRE_AUDIT_GAP' FROM orders WHERE o_orderkey % 291 = 0)
SELECT CASE WHEN e.reason IS NULL THEN 'UNEXPLAINED' ELSE 'EXPLAINED' END AS class, COALESCE(e.reason, 'NONE') AS reason, COUNT(*) AS key_count
FROM d LEFT JOIN e USING (o_orderkey) WHERE o_orderkey NOT IN (SELECT o_orderkey FROM u) GROUP BY 1, 2
UNION ALL SELECT 'UNCOMPARED', 'LOB_RETENTION', COUNT(*) FROM u
""")
def _(t):
    diffs = P.compare_exact(t.orders, t.fx_tgt_orders, ["o_orderkey"], _rules(t))
    explained = t.orders.where("o_orderkey % 202 = 0").selectExpr(
        "o_orderkey + 10000000 AS o_orderkey", "'DELETE' AS reason").unionByName(
        t.orders.where("o_orderkey % 291 = 0").selectExpr("o_orderkey", "'PRE_AUDIT_GAP' AS reason"))
    skipped = t.orders.where("o_orderkey % 445 = 0").selectExpr("o_orderkey", "'LOB_RETENTION' AS reason")
    return P.classify_differences(diffs, explained, skipped, ["o_orderkey"])


def _participation(t):
    return t.orders.selectExpr(
        "o_custkey AS job_id", "concat('C', o_orderkey) AS column_name",
        "CASE WHEN o_orderkey % 23 = 0 THEN 'EXCLUDED' ELSE 'INCLUDED' END AS hash_participation")


@query("uncompared_jobs", """
SELECT o_custkey AS job_id, COUNT(*) AS column_count, COUNT(*) FILTER (o_orderkey % 23 = 0) AS excluded_count,
       MIN('C' || o_orderkey) FILTER (o_orderkey % 23 = 0) AS first_excluded,
       COUNT(*) FILTER (o_orderkey % 23 = 0) = 0 AS in_strict_sample
FROM orders GROUP BY o_custkey
""")
def _(t):
    return P.uncompared_jobs(_participation(t))


@query("excluded_columns", "SELECT DISTINCT o_custkey AS job_id, 'C' || o_orderkey AS column_name FROM orders WHERE o_orderkey % 23 = 0")
def _(t):
    return P.excluded_columns(_participation(t))


_CENSUS_SQL = f"""
WITH c1 AS (SELECT o_orderkey AS pk, {_ORDER_HASH} AS h FROM orders), c2 AS (SELECT o_orderkey AS pk, {_ORDER_HASH} AS h FROM fx_tgt_orders)
"""


def _censuses(t):
    make = lambda df: P.hashed(df, ["o_orderkey"], _rules(t)).withColumnsRenamed({"o_orderkey": "pk", "row_hash": "h"})
    return make(t.orders), make(t.fx_tgt_orders)


@query("census_by_key", """
SELECT o_orderkey AS pk, 'GONE' AS change FROM (SELECT o_orderkey FROM orders EXCEPT SELECT o_orderkey FROM fx_tgt_orders)
UNION ALL SELECT o_orderkey, 'NEW' FROM (SELECT o_orderkey FROM fx_tgt_orders EXCEPT SELECT o_orderkey FROM orders)
""")
def _(t):
    return P.census_diff(*_censuses(t), ["pk"], "PK_ONLY")


@query("census_by_sample", _CENSUS_SQL + """
SELECT c1.pk, 'REUSED_OR_CHANGED' AS change FROM c1 JOIN c2 USING (pk) WHERE c1.pk % 5 = 0 AND c1.h <> c2.h
""")
def _(t):
    return P.census_diff(*_censuses(t), ["pk"], "SAMPLE_HASH", 5)


@query("census_by_hash", _CENSUS_SQL + """
SELECT COALESCE(c1.pk, c2.pk) AS pk, CASE WHEN c2.h IS NULL THEN 'GONE' WHEN c1.h IS NULL THEN 'NEW' ELSE 'REUSED_OR_CHANGED' END AS change
FROM c1 FULL JOIN c2 ON c1.pk = c2.pk WHERE c1.h IS DISTINCT FROM c2.h
""")
def _(t):
    return P.census_diff(*_censuses(t), ["pk"], "FULL_HASH")


# Rows move between partitions while they are read: some are seen by two readers, some by none.
_READS = """(SELECT CASE WHEN o_custkey % 50 = 0 THEN o_orderkey + 1 ELSE o_orderkey END AS pk FROM orders)"""


@query("partition_skew", f"""
SELECT pk, COUNT(*) AS read_count, 'READ_TWICE' AS finding FROM {_READS} GROUP BY pk HAVING COUNT(*) > 1
UNION ALL SELECT o_orderkey, 0, 'NEVER_READ' FROM orders WHERE o_orderkey NOT IN (SELECT pk FROM {_READS})
""")
def _(t):
    reads = t.orders.selectExpr("CASE WHEN o_custkey % 50 = 0 THEN o_orderkey + 1 ELSE o_orderkey END AS pk")
    return P.partition_skew(reads, t.orders.selectExpr("o_orderkey AS pk"), ["pk"])


@query("staging_residue", """
SELECT s.part, s.n AS source_rows, COALESCE(g.n, 0) AS staged_rows, m.status, m.rows_written,
       CASE WHEN m.status IS NULL THEN 'NOT_STAGED' WHEN m.status <> 'SEALED' THEN 'UNSEALED'
            WHEN m.rows_written <> COALESCE(g.n, 0) THEN 'MANIFEST_MISMATCH' WHEN COALESCE(g.n, 0) < s.n THEN 'SHORT' ELSE 'COMPLETE' END AS stage_state
FROM (SELECT part, COUNT(*) AS n FROM fx_stage_src GROUP BY part) s
LEFT JOIN (SELECT part, COUNT(*) AS n FROM fx_staged GROUP BY part) g ON s.part = g.part LEFT JOIN fx_manifest m ON s.part = m.part
""")
def _(t):
    return P.staging_residue(t.fx_stage_src, t.fx_staged, t.fx_manifest, "part").select(
        "part", "source_rows", "staged_rows", "status", "rows_written", "stage_state")


@query("staging_lost", """
SELECT part, event_id FROM fx_stage_src WHERE part IN (SELECT part FROM fx_manifest)
AND event_id NOT IN (SELECT event_id FROM fx_staged) AND event_id NOT IN (SELECT event_id FROM fx_published)
""")
def _(t):
    return P.staging_lost(
        t.fx_stage_src, t.fx_staged, t.fx_manifest, t.fx_published, "part", ["event_id"]).select("part", "event_id")


@query("compare_overlap_slice", f"""
SELECT o_orderkey, source_hash, target_hash, source_rows, target_rows, difference FROM (
WITH s AS (SELECT *, {_ORDER_HASH} AS h FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1998-07-01'),
g AS (SELECT *, {_ORDER_HASH} AS h FROM fx_tgt_orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1998-07-01')
SELECT COALESCE(s.o_orderkey, g.o_orderkey) AS o_orderkey, s.h AS source_hash, g.h AS target_hash, CAST(s.h IS NOT NULL AS BIGINT) AS source_rows, CAST(g.h IS NOT NULL AS BIGINT) AS target_rows,
       CASE WHEN g.h IS NULL THEN 'MISSING' WHEN s.h IS NULL THEN 'EXTRA' ELSE 'HASH_MISMATCH' END AS difference
FROM s FULL JOIN g ON s.o_orderkey = g.o_orderkey WHERE s.h IS DISTINCT FROM g.h)
""")
def _(t):
    return P.compare_overlap(
        t.orders, t.fx_tgt_orders, ["o_orderkey"], "o_orderdate", datetime(1998, 1, 1), datetime(1998, 7, 1), _rules(t))


@query("incremental_merge_proof", """
SELECT COUNT(*) FILTER (ts < TIMESTAMP '2024-01-10' AND event_id % 3 = 0) AS hash_mismatch, 0 AS missing, 0 AS extra
FROM events WHERE ts < TIMESTAMP '2024-01-20'
""")
def _(t):
    from tidemark.plans.registry import _QUERIES

    merged = _QUERIES["incremental_merge"](t)
    source = t.events.select(*merged.columns).where("ts < timestamp_ntz'2024-01-20'")
    found = P.compare_exact(source, merged, ["event_id"], K.rules_from_schema(source.schema, scales={"value": 6}))
    return found.agg(
        *[F.count_if(F.col("difference") == k).alias(k.lower()) for k in ("HASH_MISMATCH", "MISSING", "EXTRA")])
