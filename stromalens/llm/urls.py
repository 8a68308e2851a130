"""Allow and block rules for URLs by hashed host-suffix and path-prefix expressions.

A rule's key is its host and path. A URL is expanded into the expressions that could be such
keys: each suffix of its host at a dot, with each prefix of its path that is as long as some
rule's path. Expressions and rules meet in an equi-join on the first bytes of their digests;
the full digest then confirms, and the longest confirmed rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW = "allow"
#: Hex digits of the digest that the join uses.
PREFIX_DIGITS = 8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    # a host holds no slash, so the first one parts the two; an empty path differs from none
    return F.sha2(F.concat(host, F.lit("\n"), path).cast("binary"), 256)


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule (host and path of the winning rule, else null) and verdict of every row.

    ``rules`` has host, path and verdict. A rule fits its host and all hosts below it if the
    path starts with the rule's. The longest fitting rule wins: the longer host first, then the
    longer path; of equal rules with two verdicts, the smaller text (allow before block). What no
    rule fits is allowed. Null or malformed URLs have an empty host and path, which only a rule
    for an empty host could fit. Repeated rows are judged once and returned as often as they
    came. Only the two named columns are read.

    Rules enter through a join without a hint: Spark broadcasts a rule table that it measures
    as small, and splits skewed prefixes of a large one at run time. The lengths of rule paths,
    which the expansion needs, are a list no longer than the longest path.
    """
    known = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).dropna()
    known = known.groupBy("r_host", "r_path").agg(F.min("r_verdict").alias("r_verdict"))
    known = known.withColumn("r_digest", _digest(F.col("r_host"), F.col("r_path"))).withColumn("prefix", F.substring("r_digest", 1, PREFIX_DIGITS))
    lengths = sorted(r[0] for r in known.select(F.length("r_path")).distinct().collect())
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url")).groupBy("key", "url").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.select("key", "url", "copies", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    labels = F.split(F.col("host"), "\\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    spread = (rows.withColumn("x_host", F.explode_outer(suffixes)).withColumn("n", F.explode_outer(prefixes))
              .withColumn("x_path", F.col("path").substr(F.lit(1), F.col("n"))))
    spread = spread.withColumn("digest", _digest(F.col("x_host"), F.col("x_path"))).withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    met = spread.join(known, "prefix", "left").withColumn("fits", F.col("digest") == F.col("r_digest"))
    rank = F.when(F.col("fits"), F.struct(F.length("r_host").alias("h"), F.length("r_path").alias("p"), "r_host", "r_path", "r_verdict"))
    best = met.groupBy("key", "url").agg(F.first("copies").alias("copies"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(rank).alias("best"))
    out = best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select(F.col("key").alias(key), "host", "path", F.concat("best.r_host", "best.r_path").alias("rule"), F.coalesce("best.r_verdict", F.lit(ALLOW)).alias("verdict"))
