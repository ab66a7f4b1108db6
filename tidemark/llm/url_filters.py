"""URL filters: pattern rules indexed by their rarest literal token.

Each rule names literal tokens that every matching URL holds. A pass over the URL column counts only those
tokens; each rule is filed under the one that occurs least, tokens of a URL fetch their rules by a join, and only
fetched rules run their regular expression.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ROW, with_row

class HostRule(NamedTuple):
    host: str
    path: str
    verdict: str


class PatternRule(NamedTuple):
    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str


#: The rules of the contract.
HOST_RULES = (
    HostRule("org", "/", "allow"),
    HostRule("example.org", "/es/", "block"),
    HostRule("example.org", "/en/1", "block"),
    HostRule("com", "/fr/", "allow"),
    HostRule("com", "/de/", "block"),
)
#: The method's own rules, used where no host rule fits. A token is a run of letters and digits.
PATTERN_RULES = (
    PatternRule("casino", r"^[^/]*\bcasino\b", ("casino",), "block"),
    PatternRule("betting", r"^[^/]*\bfree-bets\b", ("free", "bets"), "block"),
    PatternRule("pharmacy", r"^[^/]*\bcheap-pills\b", ("cheap", "pills"), "block"),
    PatternRule("adult", r"^[^/]*\badult\b", ("adult",), "block"),
    PatternRule("spam host", r"^[^/]*\bspam\b", ("spam",), "block"),
    PatternRule("ad tracker", r"^[^/]*\bads-track\b", ("ads", "track"), "block"),
)


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, host_rules, pattern_rules) -> DataFrame:
    """(no, rule, pattern, weight, verdict, tokens). A host rule weighs its length, a pattern rule nothing."""
    rows = []
    for r in host_rules:
        tokens = re.findall(r"[a-z0-9]+", r.host)
        # Whole path segments are sure to be tokens of the URL; the last one may go on there.
        tokens += [t for s in r.path.split("/")[1:-1] for t in re.findall(r"[a-z0-9]+", s.lower())]
        rows.append((r.host + r.path, rf"^(?:[^/]*\.)?\Q{r.host}{r.path}\E", len(r.host + r.path), r.verdict, tokens))
    for r in pattern_rules:
        rows.append((r.name, r.pattern, 0, r.verdict, list(r.tokens)))
    if not all(r[4] for r in rows):
        raise ValueError("every rule needs a literal token")
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                                 "no int, rule string, pattern string, weight long, verdict string, tokens array<string>")


def judge_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", host_rules=HOST_RULES,
               pattern_rules=PATTERN_RULES, rules: DataFrame | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, pattern) per row.

    A host rule fits its host and subdomains if the path starts with the rule's path; the longest rule wins.
    Else the first fitting pattern rule by table order judges (its name in ``pattern``), and all other URLs are
    allowed. A null URL or one without :// has an empty host and path and is allowed. Ids may be null or repeat; an
    empty table gives an empty result; extra columns are not read. ``rules`` takes the rules as a table of any size, with the
    columns of ``rule_table``; Spark broadcasts its index if its size allows that.
    """
    spark = df.sparkSession
    url = F.coalesce(F.col(url_col), F.lit(""))
    pages = with_row(df.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path")))
    # A path never starts without a slash unless it is empty.
    pages = pages.withColumn("target", F.concat("host", "path"))
    tokens = pages.select(ROW, "target", F.explode(F.array_distinct(F.split(F.lower("target"), "[^a-z0-9]+"))).alias("token"))
    rules = rule_table(spark, host_rules, pattern_rules) if rules is None else rules
    wanted = rules.select("no", F.explode("tokens").alias("token"))
    seen = tokens.join(wanted.select("token").distinct(), "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = Window.partitionBy("no").orderBy(F.coalesce("n", F.lit(0)), F.desc(F.length("token")), "token")
    index = (wanted.join(seen, "token", "left").withColumn("place", F.row_number().over(rarest))
             .where("place = 1").select("no", "token").join(rules.drop("tokens"), "no"))
    fitting = tokens.join(index, "token").where(F.expr("target RLIKE pattern"))
    best = fitting.groupBy(ROW).agg(
        F.max_by(F.struct("rule", "verdict"), F.struct("weight", -F.col("no"))).alias("best"),
        F.max("weight").alias("weight"))
    out = pages.join(best, ROW, "left")
    hit = F.col("weight") > 0
    return out.select(
        F.col("id").alias(id_col), "host", "path", F.when(hit, F.col("best.rule")).alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit("allow")).alias("verdict"),
        F.when(~hit, F.col("best.rule")).alias("pattern"))
