"""URL allow and block rules by hashed host-suffix and path-prefix expressions, in DataFrame functions only.

Each url expands into (host suffix) x (path prefix) expressions of the shapes that the rules have:
suffixes that start at a label, with as many labels as some rule's host; prefixes as long as some
rule's path. An expression meets rules by an equi-join on the first 32 bits of its SHA-256; the whole
digest confirms. The longest rule wins. The path is taken as written: a url without one has the
empty path, which the rule path ``/`` does not fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import BROADCAST_BYTES

#: (verdict, host, path) of the rules that the query applies.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def host_of(url: Column) -> Column:
    """What is between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages (page_id, url).

    rules: verdict, host, path. Of the rules that fit, the longest (host and path together) wins, then
    the longer host, then block. Rows without a fitting rule get default and a null rule; null urls
    have empty host and path. Repeated rows stay. A label is any text between dots, so the empty host
    has one (empty) label. Rules with a null are left out.
    """
    rules = rules.select("verdict", F.lower("host").alias("host"), "path").dropna().distinct()
    rules = rules.withColumn("expression", F.concat("host", "path")).withColumn("digest", F.sha2(F.concat_ws("\n", "host", "path"), 256))
    shape = rules.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("expression") + 200), F.lit(0)).alias("bytes"),
        F.sort_array(F.collect_set(F.size(F.split("host", r"\.")))).alias("labels"), F.sort_array(F.collect_set(F.length("path"))).alias("lengths"),
    ).first()
    rules = rules.withColumn("prefix", F.substring("digest", 1, 8))
    urls = pages.select(F.monotonically_increasing_id().alias("_row"), "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts = F.split("host", r"\.")
    count = F.size(parts)
    labels = F.filter(F.array(*[F.lit(n) for n in shape["labels"]]).cast("array<int>"), lambda n: n <= count)
    lengths = F.filter(F.array(*[F.lit(n) for n in shape["lengths"]]).cast("array<int>"), lambda n: n <= F.length("path"))
    suffix = lambda n: F.array_join(F.slice(parts, count - n + 1, n), ".")
    every = F.flatten(F.transform(labels, lambda n: F.transform(lengths, lambda m: F.concat_ws("\n", suffix(n), F.substring(F.col("path"), F.lit(1), m)))))
    tried = urls.withColumn("_d", F.explode_outer(F.transform(every, lambda e: F.sha2(e, 256)))).withColumn("_p", F.substring("_d", 1, 8))
    side = rules.select(F.col("prefix").alias("_p"), F.col("digest").alias("_digest"), F.struct(F.length("expression").alias("size"), F.length("host").alias("host_size"), F.when(F.col("verdict") == "block", 1).otherwise(0).alias("blocks"), "expression", "verdict").alias("_rule"))
    side = F.broadcast(side) if shape["bytes"] <= BROADCAST_BYTES else side.hint("merge")
    met = tried.join(side, "_p", "left").withColumn("_rule", F.when(F.col("_d") == F.col("_digest"), F.col("_rule")))
    best = met.groupBy("_row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max("_rule").alias("_rule"))
    return best.select("page_id", "host", "path", F.col("_rule.expression").alias("rule"), F.coalesce("_rule.verdict", F.lit(default)).alias("verdict"))


ORACLE_SQL = r"""
with u as (
  select page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
f as (
  select *,
    (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') as r1,
    (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') as r2,
    (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') as r3,
    (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') as r4,
    (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') as r5
  from u)
select page_id, host, path,
  case when r3 then 'www.example.com/en/' when r2 then 'example.com/en/' when r4 then 'net/es/' when r5 then 'net/fr/' when r1 then 'com/' end as rule,
  case when r3 then 'allow' when r2 then 'block' when r4 or r5 then 'block' else 'allow' end as verdict
from f
"""
