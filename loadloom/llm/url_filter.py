r"""URL rules by hashed host-suffix and path-prefix expressions.

A rule (host, path, verdict) fits its host and all subdomains, for paths that start with the rule's; the longest
rule wins, of equally long ones that with the longer host, then the first verdict by name.  Each distinct URL is
expanded into one expression for every shape (number of host labels, path length) that some rule has; expressions
meet the rules on a 32-bit hash prefix, and only equal full digests count.

Scale: URLs are made distinct first, with partial counts before the shuffle, so that a URL or host with a third of
all rows costs no more than any other.  The rules are broadcast if there are at most ``BROADCAST_RULES``; beyond
that they are joined in ``SALTS`` copies, so that a common expression is spread as well.  The shapes are collected:
they are distinct pairs of small numbers, not rules.

Edge cases: a null URL, or one without ``://``, has an empty host and path and fits only a rule with an empty
host; repeated rows stay rows of their own; no rules, or none that fits: ``rule`` null and the default verdict.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, table

BROADCAST_RULES = 200_000
SALTS = 16
MADE = ("host", "path", "rule", "verdict")
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def _prefix(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _labels(host: Column) -> Column:
    return F.when(host == "", 0).otherwise(F.size(F.split(host, r"\.")))


def filter_urls(df: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """All rows and columns of ``df`` with host, path, rule and verdict; ``rules`` has host, path, verdict."""
    spark = df.sparkSession
    df = df.drop(*[c for c in MADE if c != url_col])
    rules = rules.select(F.coalesce("host", F.lit("")).alias("_rh"), F.coalesce("path", F.lit("")).alias("_rp"), F.col("verdict").alias("_rv"))
    rules = rules.groupBy("_rh", "_rp").agg(F.min("_rv").alias("_rv"))
    rules = rules.withColumn("_digest", _digest(F.concat_ws("\n", "_rh", "_rp"))).withColumn("_prefix", _prefix(F.col("_digest")))
    shapes = rules.select(_labels(F.col("_rh")).alias("labels"), F.length("_rp").alias("length")).distinct().collect()

    host, path = host_and_path(F.col("_url"))
    urls = df.select(F.coalesce(F.col(url_col), F.lit("")).alias("_url")).distinct()
    urls = urls.withColumn("host", host).withColumn("path", path).withColumn("_n", _labels(F.col("host")))
    made = [
        F.when(
            (F.col("_n") >= s.labels) & (F.length("path") >= s.length),
            F.concat_ws("\n", F.substring_index("host", ".", -s.labels) if s.labels else F.lit(""), F.substring("path", 1, s.length)),
        )
        for s in shapes
    ]
    empty = F.array().cast("array<string>")
    expressions = F.filter(F.array(*made), lambda x: x.isNotNull()) if made else empty
    keyed = urls.select("_url", "host", "path", F.explode_outer(expressions).alias("_expression"))
    keyed = keyed.withColumn("_digest", _digest(F.col("_expression"))).withColumn("_prefix", _prefix(F.col("_digest")))
    if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        side, on = F.broadcast(rules), ["_prefix"]
    else:
        side, on = rules.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["_prefix", "_salt"]
        keyed = keyed.withColumn("_salt", F.pmod(F.xxhash64("_url"), F.lit(SALTS)).cast("int"))
    met = keyed.join(side.withColumnRenamed("_digest", "_rule_digest"), on, "left")
    fits = F.col("_digest") == F.col("_rule_digest")
    text = F.concat("_rh", "_rp")
    rank = F.when(fits, F.struct(F.length(text).alias("l"), F.length("_rh").alias("h"), text.alias("rule"), F.col("_rv").alias("verdict")))
    judged = met.groupBy("_url", "host", "path").agg(F.max(rank).alias("_best"))
    judged = judged.select(F.col("_url").alias("_key"), "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
    return df.withColumn("_key", F.coalesce(F.col(url_col), F.lit(""))).join(judged, "_key").select(*df.columns, *MADE)


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame([*rules], "host string, path string, verdict string")


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, rule_table(spark)).select("page_id", *MADE)


SQL = r"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path,
    row_number() OVER () AS n
  FROM cut),
rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fit AS (
  SELECT n, arg_max(h || rules.p, length(h || rules.p)) AS rule, arg_max(v, length(h || rules.p)) AS verdict
  FROM p JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, rules.p) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN fit USING (n)
"""
