"""URL filters (operator 6), in DataFrame functions only.

Each distinct host is expanded into its suffixes of as many labels as rules' hosts have, each path into its prefixes of
the lengths that the rules' paths have. Expressions and rules meet in an equi-join on a short prefix of their digest; the full digest then decides,
and of a URL's rules the longest wins. Only distinct (host, path) pairs are expanded, so a host that many pages share
is expanded once for each of its paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.tables import written

PREFIX_HEX = 8
#: Rules that come to at most this many bytes are broadcast; beyond it Spark chooses the join.
BROADCAST_BYTES = 8_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.substring_index(F.substring_index(F.substring_index(after_scheme(url), "/", 1), "?", 1), "#", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    own = F.substring_index(F.substring_index(after_scheme(url), "?", 1), "#", 1)
    at = F.instr(own, "/")
    return F.when(at > 0, F.substr(own, at)).otherwise(F.lit(""))


def after_scheme(url: Column) -> Column:
    """What follows the first ://; empty for null or without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def rules_frame(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) rows as a table."""
    rows = [F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules]
    kind = "array<struct<verdict:string,host:string,path:string>>"
    return spark.range(1).select(F.inline(F.array(*rows).cast(kind)))


def judge(df: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row: id_col, host, path, rule, verdict.

    A null URL or one without :// has an empty host and path, fits no rule and gets the default. A rule fits its host
    and all subdomains of it if the path starts with the rule's; the longest (host and path together, then path, then
    block before allow) wins. Rules with a null are left out; of equal rules block stays. Rows of one id are judged one
    by one. Other columns are left out. An empty table, or no rules, is no special case.
    """
    known = rules.where("verdict is not null and host is not null and path is not null").select("verdict", F.translate("host", UPPER, LOWER).alias("host"), "path")
    known = known.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block after allow
    shape = known.agg(F.collect_set(F.char_length("path")).alias("lengths"), F.collect_set(F.size(F.split("host", r"\."))).alias("labels"), F.sum(F.octet_length("host") + F.octet_length("path") + 200).alias("bytes")).first()  # lengths: no more than a path can have
    lengths = sorted(shape["lengths"]) or [0]
    table = known.select("verdict", F.col("host").alias("r_host"), F.col("path").alias("r_path"), digest(F.col("host"), F.col("path")).alias("r_digest")).withColumn("short", F.substring("r_digest", 1, PREFIX_HEX))
    if (shape["bytes"] or 0) <= BROADCAST_BYTES:
        table = F.broadcast(table)
    source = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    parsed = source.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    sizes = F.filter(F.array(*[F.lit(n) for n in sorted(shape["labels"]) or [1]]), lambda n: n <= F.size(labels))
    suffixes = F.transform(sizes, lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.char_length("path"))
    hosts = parsed.where("host <> ''").select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("suffix"))
    expressions = hosts.select("host", "path", "suffix", F.explode(fitting).alias("n")).select("host", "path", digest(F.col("suffix"), F.substr(F.col("path"), F.lit(1), F.col("n"))).alias("digest")).withColumn("short", F.substring("digest", 1, PREFIX_HEX))
    hits = expressions.join(table, "short").where("digest = r_digest")
    rank = F.struct((F.char_length("r_host") + F.char_length("r_path")).alias("size"), F.char_length("r_path").alias("deep"), "verdict", "r_host", "r_path")
    best = written(hits.groupBy("host", "path").agg(F.max(rank).alias("best")))  # as a table, so that a pair that many rows have can be split in the join
    out = parsed.join(best.hint("merge"), ["host", "path"], "left")  # best grows with the input: never broadcast
    return out.select(F.col("id").alias(id_col), "host", "path", F.concat("best.r_host", "best.r_path").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
