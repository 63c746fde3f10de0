"""URL filters by a sort-merge range join.

A url's canonical key is its host with the labels reversed, then its path; a rule on a host and a path prefix then covers
an interval of keys. As a rule also holds for all subdomains of its host, a url is entered under each host suffix that has
as many labels as some rule's host. Rules open and close their intervals among those keys, and one sorted sweep keeps the
stack of open rules: a running count gives the stack's depth at each key, and the rule on top is the last one opened at
that depth (rules on one host are nested or apart, as prefixes are). Of a url's entries the longest rule wins.

All of it is sorting and windows, dealt by (host suffix, salt): each salt gets the rules of its host, so that a hot host
is spread over many tasks. Rules are repeated at most as often as there are urls.

Defined cases: null urls and those without ``://`` have empty host and path and fit no rule; an empty path fits no rule
whose path is ``/``; of rules with the same host and path the first one given holds; equally long rules that both fit go
to the longer host; where no rule fits the verdict is the default; repeated rows get the same answer each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Rule = tuple[str, str, str]  # verdict, host, path
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to one of ``/?#``, A-Z lower-cased, and from there up to one of ``?#``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, "^[^/?#]*(/[^?#]*)", 1), F.lit(""))
    return host, path


def canonical(host: Column, path: Column) -> Column:
    """Reversed labels, each closed by a blank, then the path; as bytes, which no 255 is among."""
    return F.concat(F.array_join(F.transform(F.reverse(F.split(host, "\\.")), lambda x: F.concat(x, F.lit(" "))), ""), path).cast("binary")


def judge(pages: DataFrame, rules: DataFrame, *, key: str = "page_id", url: str = "url", default: str = "allow", rows_per_sweep: int = 2_000) -> DataFrame:
    """(key, host, path, rule, verdict) for each row of pages; rules: verdict, host, path, place (order given)."""
    first = F.row_number().over(Window.partitionBy("host", "path").orderBy("place"))
    rules = rules.withColumn("__n", first).where("__n = 1").drop("__n", "place")
    rules = rules.select("host", "path", "verdict", F.size(F.split("host", "\\.")).alias("labels"), canonical(F.col("host"), F.col("path")).alias("open"))
    facts = rules.agg(F.count("*").alias("n"), F.max("labels").alias("labels")).first()
    host, path = split_url(F.col(url))
    # rows have no key of their own: page ids may repeat, so equal (id, url) rows are swept once and counted
    urls = pages.select(F.col(key).alias("key"), F.col(url).alias("url")).groupBy("key", "url").agg(F.count("*").alias("times"))
    rows = pages.count()
    salts = max(1, min(-(-rows // rows_per_sweep), rows // max(1, facts["n"])))
    urls = urls.select("key", "url", "times", host.alias("host"), path.alias("path"))
    labels = F.split("host", "\\.")
    depth = F.least(F.size(labels), F.lit(facts["labels"] or 1))
    suffixes = F.transform(F.sequence(F.lit(1), depth), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    salt = F.pmod(F.xxhash64("key", "url"), F.lit(salts)).cast("int")
    # each url also stands once under no host at all, so that urls without a rule stay
    entries = urls.select(
        "key", "url", "times", "host", "path", salt.alias("salt"), F.explode(F.array_distinct(F.concat(F.array(F.lit(None).cast("string")), suffixes))).alias("suffix")
    ).withColumn("at", canonical(F.coalesce("suffix", F.lit("")), F.col("path")))
    spread = rules.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    opens = spread.select(F.col("host").alias("suffix"), "salt", F.col("open").alias("at"), F.lit(0).alias("kind"), F.lit(1).alias("step"), "verdict", F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"))
    closes = opens.withColumn("at", F.concat("at", F.unhex(F.lit("FF")))).withColumn("kind", F.lit(2)).withColumn("step", F.lit(-1))
    events = entries.withColumn("kind", F.lit(1)).withColumn("step", F.lit(0)).unionByName(opens, allowMissingColumns=True).unionByName(closes, allowMissingColumns=True)

    order = [F.col("at"), F.col("kind")]
    sweep = Window.partitionBy("suffix", "salt").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a rule is open up to its close, which the count takes off only after it
    stacked = events.withColumn("depth", F.sum("step").over(sweep))
    level = Window.partitionBy("suffix", "salt", "depth").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = F.when(F.col("kind") == 0, F.struct(F.length("rule").alias("length"), "host_length", "rule", "verdict"))
    topped = stacked.withColumn("top", F.when((F.col("depth") > 0) & F.col("suffix").isNotNull(), F.last(opened, ignorenulls=True).over(level))).where("kind = 1")
    best = topped.groupBy("key", "url").agg(F.max("top").alias("top"), F.first("host").alias("host"), F.first("path").alias("path"), F.first("times").alias("times"))
    judged = best.select(F.col("key").alias(key), "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict"), "times")
    return judged.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("__copy", "times")
