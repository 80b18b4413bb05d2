"""URL filters: host-suffix and path-prefix expressions, joined to rules by short hash prefixes.

Every URL is expanded into the host suffixes and path prefixes that a rule could have; each
expression is hashed, joined to the rules on the first bytes of the digest, and confirmed by the
full digest and by the strings. Of the rules that fit, the longest expression decides. Only lengths
that occur among the rules are expanded, so a URL of any length costs at most (distinct label counts
of rule hosts) x (distinct lengths of rule paths) expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import whole

#: (verdict, host, path)
Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark, rules: Sequence[Rule]) -> DataFrame:
    """verdict, host, path of literal rules."""
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", prefix_bytes: int = 4) -> DataFrame:
    """The verdict on every row of ``pages`` (page_id, url).

    Returns page_id, host, path, rule (the deciding rule's host and path; null if none fits) and
    verdict (the rule's, else ``default``). A rule fits its host and all subdomains if the path
    starts with the rule's path; the longest rule wins, between equal lengths the longer host, then
    ``block`` before ``allow``. Null urls and urls without ``://`` have an empty host and path and
    fit no rule with a host. Repeated rows come back as often as they are there; rules with a null
    part are ignored; an empty rule table leaves the default. Other columns are ignored.
    """
    lowered = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    known = rules.dropna(subset=["host", "path", "verdict"]).select("verdict", lowered.alias("rule_host"), F.col("path").alias("rule_path"))
    keyed = known.withColumn("text", F.concat("rule_host", "rule_path")).withColumn("digest", F.sha2(F.concat_ws("\n", "rule_host", "rule_path"), 256))
    keyed = keyed.withColumn("short", F.substring("digest", 1, 2 * prefix_bytes)).withColumn("labels", F.size(F.split("rule_host", r"\."))).withColumn("chars", F.length("rule_path"))
    shape = keyed.agg(F.sort_array(F.collect_set("labels")).alias("labels"), F.sort_array(F.collect_set("chars")).alias("chars")).first()
    split = pages.select(whole(pages, "page_id", "long").alias("page_id"), whole(pages, "url", "string").alias("url")).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not shape["labels"]:
        return split.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    # one expansion for each distinct (host, path): a hot page costs as much as any other
    parts = F.split("host", r"\.")
    labels, chars = (F.array(*[F.lit(n) for n in shape[k]]) for k in ("labels", "chars"))
    suffixes = F.transform(F.filter(labels, lambda n: n <= F.size(parts)), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    prefixes = F.transform(F.filter(chars, lambda n: n <= F.length("path")), lambda n: F.substr("path", F.lit(1), n))
    distinct = split.select("host", "path").distinct()
    each = distinct.select("host", "path", F.explode(suffixes).alias("suffix")).select("host", "path", "suffix", F.explode(prefixes).alias("prefix"))
    digests = each.withColumn("digest", F.sha2(F.concat_ws("\n", "suffix", "prefix"), 256)).withColumn("short", F.substring("digest", 1, 2 * prefix_bytes))
    r = keyed.select("short", F.col("digest").alias("full"), "verdict", "rule_host", "rule_path", "text")
    fits = digests.join(r, "short").where("digest = full and suffix = rule_host and prefix = rule_path")
    order = F.struct(F.length("text").alias("n"), F.length("rule_host").alias("h"), F.when(F.col("verdict") == "block", 1).otherwise(0).alias("b"), F.col("text").alias("t"), F.col("verdict").alias("v"))
    best = fits.groupBy("host", "path").agg(F.max(order).alias("m")).select("host", "path", F.col("m.t").alias("rule"), F.col("m.v").alias("verdict"))
    return split.join(best, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
