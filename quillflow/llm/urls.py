"""Operator 5: block and allow lists of hosts and paths for URLs.

A rule is a host and the start of a path; it holds for its host and all hosts below it. Each URL is expanded into its host's suffixes at dots
times the starts of its path (of the lengths that rules have); an expression's key is the start of its SHA-256, by which it meets the rules in
an equi-join; the whole digest then confirms it. Of the rules that fit the longest wins, and of equally long ones the one with the longer
host, then the one that blocks.

Only DataFrame functions are used. The join's side is Spark's choice by size: a short rule list is broadcast below its threshold, a long one is
shuffled on the key. The verdicts of one URL meet by a row number of its own, so a host with most of the pages is no hot key.

Defined results: a null URL or one without :// has an empty host and path; a URL that no rule fits has a null rule and the default verdict; rows
that repeat are judged each on its own; an empty table gives no rows. A rule with a null host or path is an error of the list and is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of the digest that the join uses.
SHORT = 8
#: Parts into which the URLs of one expression are dealt.
SALT = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after(url: str) -> Column:
    """What follows the first ://; null where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url)))


def split_url(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    rest = _after(url)
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (host and path of the winning rule), verdict for each row of pages (page_id, url).

    rules: host, path, verdict ('allow' or 'block'). The lengths of rule paths and the numbers of labels of rule hosts are read on the driver: they are at most
    as many as a path has characters and a host has dots. Only such starts and suffixes are tried, whatever a URL is made of.
    """
    rules = rules.select("host", "path", "verdict").na.drop(subset=["host", "path"])
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    depths = sorted(r[0] for r in rules.select(F.size(F.split("host", r"\."))).distinct().collect())
    digest = lambda host, path: F.sha2(F.concat(host, F.lit("\n"), path), 256)  # noqa: E731  a line feed ends the host in both
    listed = rules.withColumn("digest", digest(F.col("host"), F.col("path")))
    rank = Window.partitionBy("digest").orderBy(F.col("verdict").desc())  # the same rule twice: block wins
    listed = listed.withColumn("n", F.row_number().over(rank)).filter("n = 1").select(F.col("digest").alias("rule_digest"), F.substring("digest", 1, SHORT).alias("short"), F.concat("host", "path").alias("rule"), F.length("host").alias("rule_host"), "verdict")

    host, path = split_url("url")
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row"))
    labels = F.split("host", r"\.")
    suffixes = F.array_compact(F.array(*[F.when(F.size(labels) >= d, F.array_join(F.slice(labels, -d, d), ".")) for d in depths])) if depths else F.array().cast("array<string>")
    starts = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]), lambda x: x.isNotNull()) if lengths else F.array().cast("array<string>")
    digests = F.flatten(F.transform(suffixes, lambda h: F.transform(starts, lambda p: digest(h, p))))
    tried = rows.select("*", F.explode_outer(digests).alias("digest")).withColumn("short", F.substring("digest", 1, SHORT))
    # an expression that many URLs share meets the rules in parts of its own
    salted = tried.withColumn("salt", F.pmod("row", F.lit(SALT)))
    listed = listed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)).cast("array<bigint>")))
    met = salted.join(listed, ["short", "salt"], "left")
    fits = F.col("digest") == F.col("rule_digest")
    found = F.when(fits, F.struct(F.length("rule").alias("long"), "rule_host", "verdict", "rule"))
    best = met.groupBy("row", "page_id", "host", "path").agg(F.max(found).alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
