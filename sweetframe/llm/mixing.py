"""Mixing sources to target weights.

Sizes are summed by source; sources share a total by weight, but none takes more than ``most`` times its size, and what
exceeds that is shared anew by weight among the others (water filling). A source's repetition rate is its target over its
size; each document is emitted floor(rate) times, and once more with the rate's fraction as probability, drawn from a hash
of seed and key, so that reruns agree.

The level of the water filling comes in closed form: sources sorted by cap over weight fill up in that order, so a window
of running sums over one row per source finds the level without iteration.

Defined cases: null and empty texts have size 0 and are emitted as often as others of their source; a null source is a
source, last in order; a source of size 0 has target 0 and rate 0; repeated rows of one key are drawn alike; a null key
is drawn like an empty one; an empty table gives no rows; very long texts are counted whole; a tie of caps is broken by the
source's name. There must be few sources: windows over one row per source run in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sweetframe.llm._common import NOT_SPACE, cut, spare


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """(source, source_size, target) of one row per source; sizes: source, source_size.

    weights go round the sources in the order of their names' code points, nulls last; all targets sum to share (a
    fraction) of all sizes.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.array(*map(F.lit, weights))
    caps = sizes.withColumn("w", F.element_at(weight, (place - 1) % len(weights) + 1)).withColumn("cap", F.col("source_size") * most)
    ahead = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    whole = F.sum("source_size").over(everything) * share[0] / share[1]
    full = F.coalesce(F.sum("cap").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = (whole - full) / F.sum("w").over(ahead.rowsBetween(0, Window.unboundedFollowing))
    leveled = caps.withColumn("level", level).withColumn("free", F.col("cap") > F.col("w") * F.col("level")).withColumn("nth", F.row_number().over(ahead))
    # the first source that isn't filled up sets the level for all
    final = F.min(F.when(F.col("free"), F.struct("nth", "level"))).over(everything)["level"]
    target = F.when(final.isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("w") * final))
    return leveled.select("source", "source_size", target.alias("target"))


def draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the key and seed, the same in each run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def rates(docs: DataFrame, *, text: str = "text", source: str = "source", key: str = "doc_id", seed: int = 20240229, **shares) -> DataFrame:
    """(key, source, size, source_size, target, copies) for each row of docs."""
    sized = cut(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")))
    return _copies(sized, targets(_totals(sized), **shares), seed)


def _totals(sized: DataFrame) -> DataFrame:
    return sized.groupBy("source").agg(F.sum("size").alias("source_size"))


def _copies(sized: DataFrame, goals: DataFrame, seed: int) -> DataFrame:
    goals = goals.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    goals = goals.withColumnRenamed("source", "goal_source")
    joined = sized.join(goals, sized["source"].eqNullSafe(goals["goal_source"])).drop("goal_source")
    whole = F.floor("rate")
    copies = whole + (draw(F.col("key"), seed) < F.col("rate") - whole).cast("long")
    return joined.withColumn("copies", copies.cast("long"))


def mix(docs: DataFrame, *, text: str = "text", source: str = "source", key: str = "doc_id", seed: int = 20240229, **shares) -> DataFrame:
    """docs, each row as often as the mix takes it; the columns of docs and the number of the copy, from 0.

    The number's column is ``__copy``, with as many ``_`` appended as it takes to differ from docs' own columns.
    """
    sized = cut(docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size")))
    goals = targets(sized, **shares)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source).alias("source"), F.col(key).alias("key"))
    taken = _copies(keyed, goals, seed).where("copies > 0")
    return taken.select("row.*", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)).alias(spare(docs.columns, "__copy")))
