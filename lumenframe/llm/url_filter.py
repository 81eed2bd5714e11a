"""URL filters by host-suffix and path-prefix expressions.

Every URL is expanded into expressions of a host suffix and a path prefix: of all that there are, those whose number of host
labels, number of slashes, and characters after the last slash occur together in some rule. They meet the rules in an
equi-join on a short prefix of their digests, and a candidate counts only after the full digests and the
strings agree. The longest rule wins; at equal length the longer host, then block.

Edge cases: a null url or one without ``://`` has empty host and path and takes the default
verdict; very long urls have no more expressions than there are kinds of rules; repeated rows come back as often as they
went in; an empty table gives an empty result, and no rules the default verdict; extra columns of either input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.shared import ascii_lower, only, small

#: Hex digits of the digest prefix that the join uses.
PREFIX = 8


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3)))
    host = F.coalesce(ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def count_of(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def suffix_of(host: Column, labels: Column) -> Column:
    """The last so many labels of a host."""
    return F.call_function("substring_index", host, F.lit("."), -labels)


def prefix_of(path: Column, slashes: Column, tail: Column) -> Column:
    """The path up to so many slashes, and so many characters after that."""
    upto = F.length(F.call_function("substring_index", path, F.lit("/"), slashes)) + F.when(slashes > 0, 1).otherwise(0)
    return F.substring(path, F.lit(1), upto + tail)


def prepare_rules(rules: DataFrame) -> DataFrame:
    """One row for each host and path (block wins over allow), with its kind and digest."""
    host, path = ascii_lower(F.coalesce("host", F.lit(""))), F.coalesce("path", F.lit(""))
    one = rules.select(host.alias("r_host"), path.alias("r_path"), F.col("verdict")).groupBy("r_host", "r_path")
    one = one.agg(F.max("verdict").alias("r_verdict"))  # "block" sorts after "allow"
    digest = F.sha2(F.concat("r_host", "r_path"), 256)
    return one.select(
        "*",
        (count_of(F.col("r_host"), ".") + 1).alias("labels"), count_of(F.col("r_path"), "/").alias("slashes"),
        F.length(F.regexp_extract("r_path", "[^/]*$", 0)).alias("tail"),
        digest.alias("r_digest"), F.substring(digest, 1, PREFIX).alias("short"),
    )


def filter_urls(urls: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """Judge every url: (key, host, path, rule, verdict).

    rules has host, path and verdict (allow or block). Rows are told apart by their place in urls, whose scan must give the
    same rows in the same order again, as files do; their expressions are merged before the shuffle.
    """
    ready = prepare_rules(rules)
    kinds = [tuple(r) for r in ready.select("labels", "slashes", "tail").distinct().collect()]  # as many as there are shapes of rules
    ready = small(ready.drop("labels", "slashes", "tail"))
    host, path = url_parts(F.col(url))
    rows = only(urls, key, url).select(F.monotonically_increasing_id().alias("at"), key, host.alias("host"), path.alias("path"))
    given = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("labels", "slashes", "tail"), k, strict=True)]) for k in kinds])
    if not kinds:
        return rows.select(key, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    dots, slashes = count_of(F.col("host"), "."), count_of(F.col("path"), "/")
    rows = rows.select("*", dots.alias("dots"), slashes.alias("slashes"))
    made = F.transform(
        F.filter(given, lambda k: (F.col("dots") + 1 >= k.labels) & (F.col("slashes") >= k.slashes)),
        lambda k: F.struct(suffix_of(F.col("host"), k.labels).alias("suffix"), prefix_of(F.col("path"), k.slashes, k.tail).alias("prefix")),
    )
    every = rows.select("at", key, "host", "path", F.explode_outer(F.array_distinct(made)).alias("x")).select("at", key, "host", "path", "x.suffix", "x.prefix")
    every = every.withColumn("digest", F.sha2(F.concat("suffix", "prefix"), 256)).withColumn("short", F.substring("digest", 1, PREFIX))
    hit = every.join(ready, "short", "left")
    sure = (F.col("digest") == F.col("r_digest")) & (F.col("suffix") == F.col("r_host")) & (F.col("prefix") == F.col("r_path"))
    rule = F.struct(
        (F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"), F.col("r_verdict").alias("verdict"), F.concat("r_host", "r_path").alias("rule"),
    )
    best = hit.groupBy("at", key, "host", "path").agg(F.max(F.when(sure, rule)).alias("best"))
    return best.select(key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


#: The rules of the registered query: (host, path, verdict).
QUERY_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def rules_table(spark: SparkSession, rules=QUERY_RULES) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules) + " AS t(host, path, verdict)")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules_table(spark))


SQL = """
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (
  SELECT row_number() OVER () AS n, page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(r_host, r_path, r_verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
hit AS (
  SELECT q.n, r_host || r_path AS rule, r_verdict,
         row_number() OVER (PARTITION BY q.n ORDER BY length(r_host || r_path) DESC, length(r_host) DESC) AS k
  FROM q JOIN r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT q.page_id, q.host, q.path, hit.rule, coalesce(hit.r_verdict, 'allow') AS verdict
FROM q LEFT JOIN hit ON hit.n = q.n AND hit.k = 1
"""
