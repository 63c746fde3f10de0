"""A trigram index of short texts: postings by (trigram, row), searched by the rarest trigram of the words.

A row holds the words only if it holds each of their trigrams; the rows of the rarest one are fetched and the substring is
verified on them, so that a search reads texts in proportion to its hits. Words of fewer than three characters have no
trigram: they fall back to the scan of all texts. Postings are ids, not texts; case is folded as in the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweetframe.operators import scans
from sweetframe.scratch import written

FIELDS = ("notes", "event_type", "entered_by")


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters of the lower-cased text."""
    low = F.lower(text)
    places = F.sequence(F.lit(1), F.length(low) - 2)
    return F.when(F.length(low) >= 3, F.array_distinct(F.transform(places, lambda i: F.substring(low, i, F.lit(3)))))


def build(rows: DataFrame, key: str = "id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(gram, key) postings of the fields, written by range of gram, so that a lookup reads few files' row groups.

    The gram of one field never spans into another.
    """
    grams = F.flatten(F.array_compact(F.array(*[trigrams(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in fields])))
    postings = rows.select(F.explode(F.array_distinct(grams)).alias("gram"), F.col(key)).distinct()
    return written(postings.repartitionByRange("gram"), "gram")


def search(rows: DataFrame, postings: DataFrame, words: str, key: str = "id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """rows with the words in one of the fields, whatever the case, as ``scans.search`` gives them."""
    words = words.lower()
    if len(words) < 3:
        return scans.search(rows, words)
    grams = sorted({words[i : i + 3] for i in range(len(words) - 2)})
    counts = {r["gram"]: r["n"] for r in postings.where(F.col("gram").isin(grams)).groupBy("gram").agg(F.count("*").alias("n")).collect()}  # a row a trigram
    if len(counts) < len(grams):
        return rows.limit(0)
    rarest = min(grams, key=lambda g: (counts[g], g))
    found = postings.where(F.col("gram") == rarest).select(key)
    hit = F.lit(False)
    for c in fields:
        hit = hit | F.lower(F.coalesce(c, F.lit(""))).contains(words)
    return rows.join(found, key, "left_semi").where(hit)
