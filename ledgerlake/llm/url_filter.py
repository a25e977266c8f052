"""URL filters (operator 3): rules for hosts and paths, matched by hashed expressions.

A URL's host is expanded into its suffixes, as many labels as the rules have; those for which there are rules are expanded
with the path's prefixes, of the lengths that this host's rules have. Suffixes meet the hosts of rules, and expressions of suffix
and prefix meet the rules, in equi-joins on the first four bytes of their SHA-256 digests; the whole digests then confirm a
match, and the longest matching rule gives the verdict (allow, where no rule fits). Everything is built-in functions.

Scale: the expansion works on distinct (host, path start) pairs, which are pre-aggregated before they are shuffled; the path
start is as long as the longest rule's path. Pages meet the verdicts of these pairs in an equi-join that adaptive execution
splits where one host holds many pages. What a URL is expanded into grows with the rules of its own host only; there is no
limit to rules, and their hosts and lengths are joined with, never collected.

Defined results: a null URL, or one without `://`, has an empty host and path, no rule and the verdict allow; a URL whose path is
empty fits no rule that has a path; equal rules with both verdicts count as block; repeated pages each get their own row;
empty tables give empty results; null rules don't count; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import pick, table

#: Fixed values of the query: host, path, verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict for every page. rules: host, path, verdict."""
    rules = pick(rules, "host", "path", "verdict").where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
    rules = rules.withColumn("rule", F.concat("host", "path")).groupBy("host", "path", "rule").agg(F.max("verdict").alias("verdict"))  # block > allow
    most = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("labels"), F.max(F.length("path")).alias("chars")).head()  # one row
    labels, chars = most.labels or 1, max(1, most.chars or 0)
    pages = pick(pages, "page_id", "url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    pages = pages.withColumn("start", F.expr(f"substring(path, 1, {chars})"))

    starts = pages.groupBy("host", "start").agg(F.lit(1).alias("one")).where("host <> ''").select("host", "start")
    suffixes = starts.withColumn("n", F.explode(F.sequence(F.lit(1), F.least(F.size(F.split("host", r"\.")), F.lit(labels)))))
    suffixes = suffixes.withColumn("suffix", F.expr("substring_index(host, '.', -n)")).drop("n")
    hosts = rules.groupBy(F.col("host").alias("known")).agg(F.collect_set(F.length("path")).alias("lengths"))  # at most `chars` + 1 a host
    named = _confirmed(suffixes, "suffix", hosts, "known").drop("known")

    prefixes = named.withColumn("n", F.explode(F.filter("lengths", lambda n: n <= F.length("start")))).drop("lengths")
    prefixes = prefixes.select("host", "start", F.concat("suffix", F.lit("\0"), F.expr("substring(start, 1, n)")).alias("expression"))
    known = rules.select("rule", "verdict", F.concat("host", F.lit("\0"), "path").alias("known"))
    found = _confirmed(prefixes, "expression", known, "known")
    best = found.groupBy("host", "start").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("best"))
    out = pages.join(best, ["host", "start"], "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


def _confirmed(rows: DataFrame, expression: str, known: DataFrame, name: str) -> DataFrame:
    """rows with the row of known of the same text: joined on the digests' first four bytes, then confirmed by whole digests."""
    digested = lambda df, c, out: df.withColumn(out, F.sha2(c, 256)).withColumn("short", F.substring(out, 1, 8))
    met = digested(rows, expression, "digest").join(digested(known, name, "known_digest"), "short")
    return met.where(F.col("digest") == F.col("known_digest")).drop("digest", "known_digest", "short")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rules_frame(spark, RULES))


SQL = r"""
WITH rules(host, path, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), p AS (
  SELECT row_number() OVER () AS rid, page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), m AS (
  SELECT rid, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY rid
)
SELECT page_id, host, path, m.rule AS rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (rid)
"""
