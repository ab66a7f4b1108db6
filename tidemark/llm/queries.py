"""Queries of the operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.alignment import align
from tidemark.llm.chat_format import format_chats
from tidemark.llm.common import table
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.language_id import identify
from tidemark.llm.mixing import mix
from tidemark.llm.near_dedup import near_dedup
from tidemark.llm.packing import pack
from tidemark.llm.pii import find_personal_data
from tidemark.llm.prefix_trie import conversation_trie
from tidemark.llm.suffix_dedup import remove_repeats
from tidemark.llm.token_counts import count_tokens
from tidemark.llm.topk import top_k
from tidemark.llm.url_filters import judge_urls


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS place FROM s)
SELECT query_id, place::INTEGER AS rank, vec_id, score FROM t WHERE place <= 5
"""


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents),
ranked AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY body) AS n
  FROM t WINDOW w AS (PARTITION BY body ORDER BY points DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, n AS group_size, place = 1 AS kept, sha256(body) AS text_sha256 FROM ranked
"""


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


OP8_SQL = r"""
WITH p AS (
  SELECT page_id, row_number() OVER () AS r,
         translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
h(host, path, verdict) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m(no, pattern, name) AS (VALUES
  (1, '^[^/]*\bcasino\b', 'casino'), (2, '^[^/]*\bfree-bets\b', 'betting'),
  (3, '^[^/]*\bcheap-pills\b', 'pharmacy'), (4, '^[^/]*\badult\b', 'adult'),
  (5, '^[^/]*\bspam\b', 'spam host'), (6, '^[^/]*\bads-track\b', 'ad tracker')),
fit AS (
  SELECT r, arg_max(h.host || h.path, length(h.host || h.path)) AS rule, arg_max(h.verdict, length(h.host || h.path)) AS verdict
  FROM p JOIN h ON (p.host = h.host OR p.host LIKE '%.' || h.host) AND starts_with(p.path, h.path) GROUP BY r),
own AS (
  SELECT r, arg_min(name, no) AS name FROM p JOIN m ON regexp_matches(p.host || p.path, m.pattern)
  WHERE r NOT IN (SELECT r FROM fit) GROUP BY r)
SELECT page_id, host, path, rule, CASE WHEN fit.r IS NOT NULL THEN fit.verdict WHEN own.r IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       own.name AS pattern
FROM p LEFT JOIN fit USING (r) LEFT JOIN own USING (r)
"""


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


OP13_SQL = r"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
           PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT c, list({'role': role, 'text': text} ORDER BY pos) AS seq,
         -- CRC-32 of the decimal digits: each byte is xored in (b >= 0), then eight single-bit steps (b < 0) follow.
         xor(4294967295::BIGINT, list_reduce(
           [4294967295::BIGINT] || flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
           lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) % 4 AS h
  FROM turns GROUP BY c),
built AS (
  SELECT o.c, coalesce(b.seq[1:o.h], []) || o.seq[o.h + 1:] AS seq FROM own o LEFT JOIN own b ON b.c = o.c - o.c % 20),
members AS (SELECT c, len(seq) AS n, d, seq[1:d] AS p FROM (SELECT *, unnest(range(len(seq) + 1)) AS d FROM built)),
nodes AS (
  SELECT d, p, min(c) AS c, count(*) AS n_convs,
         CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(p[d].text, '[^\x20\x09-\x0D]+')) END AS own,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256
  FROM members GROUP BY d, p),
children AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
sized AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN children k USING (d, p)),
sums AS (
  SELECT a AS d, p[1:a] AS p, sum(own) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(d + 1)) AS a FROM sized) GROUP BY 1, 2)
SELECT s.c AS conv_id, s.d AS depth, u.c AS parent_conv_id, s.n_convs, s.n_children, t.n_leaves,
       t.saved_tokens::BIGINT AS saved_tokens, s.ends_sha256
FROM sized s JOIN sums t USING (d, p) LEFT JOIN nodes u ON u.d = s.d - 1 AND u.p = s.p[1:s.d - 1]
"""


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, fn in globals().items() if name.startswith("op") and callable(fn)}


def llm_oracles() -> dict[str, str]:
    return {"op3_top_k": OP3_SQL, "op7_exact_dedup": OP7_SQL, "op8_url_filters": OP8_SQL, "op13_prefix_trie": OP13_SQL}
