"""Joins in time, partitioned by patient: as-of, interval and nearest joins without nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sweetframe.functions.scalars import micros
from sweetframe.operators import trace

HOUR = 3_600_000_000
MINUTE = 60_000_000


def asof_join(left: DataFrame, right: DataFrame, *, name: str, columns: list[str], by: str = "patient_id", ts: str = "ts", tie: str = "id", tolerance_min: float | None = None, allow_exact: bool = True, width: int = trace.WEEK) -> DataFrame:
    """left with a struct column ``name``: the last right row at or before (or strictly before) the left row's time.

    Both sides are put in one stream by time and the last right row is carried forward: no blow-up of rows. Right rows of
    one time are taken in the order of ``tie``. The stream is cut into chunks of a week (``width``); into a chunk go the last
    right row of earlier ones or, with a tolerance, the right rows that lie so shortly before it. Left rows without a time match nothing.
    """
    far = 0 if allow_exact else 2  # right rows of the same time come before or after the left row
    order = [F.col(ts), F.col("__side"), F.col("__tie")]
    reach = None if tolerance_min is None else int(tolerance_min * MINUTE)
    got = right.where(F.col(ts).isNotNull()).select(by, ts, F.lit(far).alias("__side"), F.col(tie).cast("string").alias("__tie"), F.struct(F.col(ts).alias("ts"), *columns).alias("__right"))
    own = left.withColumn("__side", F.lit(1)).withColumn("__row", F.struct(*left.columns)).select(by, ts, "__side", "__row")
    chunk = trace.chunk(F.col(ts), width)
    if reach is not None:
        to = F.sequence(chunk, F.floor((micros(F.col(ts)) + reach) / width))
        both = own.withColumn("__chunk", chunk).unionByName(got.withColumn("__chunk", F.explode(to)), allowMissingColumns=True)
        inside = Window.partitionBy(by, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        match = F.last("__right", ignorenulls=True).over(inside)
        found = both.withColumn("__m", match).where("__side = 1")
        near = F.when(micros(F.col(ts)) - micros(F.col("__m.ts")) <= reach, F.col("__m"))
        return found.select("__row.*", near.alias(name))
    both = own.unionByName(got, allowMissingColumns=True)
    found = trace.last_so_far(both.where(F.col(ts).isNotNull()), F.col("__right"), name, by=by, order=(ts, "__side", "__tie"), ts=ts, width=width).where("__side = 1").select("__row.*", name)
    unplaced = left.where(F.col(ts).isNull())
    return found.unionByName(unplaced, allowMissingColumns=True)


def _pairs(left: DataFrame, right: DataFrame, lo: Column, hi: Column, columns: list[str], by: str, ts: str, lo_open: bool, hi_open: bool, bucket: int, how: str) -> DataFrame:
    """left with its rows' pairs in right, as interval_join gives them; how is inner or left."""
    touched = left.withColumn("__lo", lo.cast("long")).withColumn("__hi", hi.cast("long"))
    touched = touched.withColumn("__bucket", F.explode_outer(F.sequence(F.floor(F.col("__lo") / bucket), F.floor(F.col("__hi") / bucket))))
    other = right.select(F.col(by).alias("__by"), micros(F.col(ts)).alias("__at"), *[F.col(c).alias(f"r_{c}") for c in columns])
    other = other.withColumn("__rb", F.floor(F.col("__at") / bucket))
    at = F.col("__at")
    inside = (at > F.col("__lo") if lo_open else at >= F.col("__lo")) & (at < F.col("__hi") if hi_open else at <= F.col("__hi"))
    return touched.join(other, (F.col(by) == F.col("__by")) & (F.col("__bucket") == F.col("__rb")) & inside, how)


def interval_join(left: DataFrame, right: DataFrame, *, lo: Column, hi: Column, columns: list[str], by: str = "patient_id", ts: str = "ts", lo_open: bool = False, hi_open: bool = False, bucket: int = 6 * HOUR) -> DataFrame:
    """Pairs of left rows and right rows whose time lies between lo and hi (microseconds, over left's columns).

    Left rows are entered in each time bucket that their interval touches, so that the join is an equality on patient and
    bucket; right's columns come with the prefix ``r_``.
    """
    pairs = _pairs(left, right, lo, hi, columns, by, ts, lo_open, hi_open, bucket, "inner")
    return pairs.drop("__lo", "__hi", "__bucket", "__by", "__at", "__rb")


def interval_agg(left: DataFrame, right: DataFrame, *, lo: Column, hi: Column, columns: list[str], aggregates: dict[str, Column], by: str = "patient_id", ts: str = "ts", lo_open: bool = False, hi_open: bool = False, bucket: int = 6 * HOUR) -> DataFrame:
    """left with aggregates over the right rows in each row's interval (columns ``r_...``, and ``r_hit``, null where there is none).

    left is read once: its rows are numbered, and carried through the join as what the aggregates of a number have first.
    Equal rows stay apart, and columns may be of any type.
    """
    row = left.select(F.monotonically_increasing_id().alias("__n"), F.struct(*left.columns).alias("__row"), by, lo.cast("long").alias("__from"), hi.cast("long").alias("__to"))
    pairs = _pairs(row, right.withColumn("hit", F.lit(1)), F.col("__from"), F.col("__to"), [*columns, "hit"], by, ts, lo_open, hi_open, bucket, "left")
    found = pairs.groupBy("__n").agg(F.first("__row").alias("__row"), *[c.alias(f"__{name}") for name, c in aggregates.items()])
    return found.select("__row.*", *[F.col(f"__{name}").alias(name) for name in aggregates])


def interval_anti(left: DataFrame, right: DataFrame, **bounds) -> DataFrame:
    """Left rows without a right row in their interval."""
    return interval_flag(left, right, "__in", **bounds).where("not __in").drop("__in")


def interval_flag(left: DataFrame, right: DataFrame, name: str, **bounds) -> DataFrame:
    """left with a boolean column: is there a right row in its interval?"""
    return interval_agg(left, right, columns=[], aggregates={name: F.count("r_hit") > 0}, **bounds)


def nearest(left: DataFrame, right: DataFrame, *, at: Column, within: int, columns: list[str], hi_open: bool = False) -> DataFrame:
    """left with r_ columns of the right row nearest to ``at`` (microseconds); the earlier one on ties, then the least."""
    probes = left.withColumn("__at0", at.cast("long"))
    got = [F.col(f"r_{c}") for c in ["ts", *columns]]
    near = F.when(F.col("r_hit").isNotNull(), F.struct(F.abs(micros(F.col("r_ts")) - F.col("__row.__at0")).alias("far"), *got))
    found = interval_agg(probes, right, lo=F.col("__at0") - within, hi=F.col("__at0") + within, columns=["ts", *columns], aggregates={"__near": F.min(near)}, hi_open=hi_open)
    return found.select(*left.columns, *[F.col(f"__near.r_{c}") for c in ["ts", *columns]])
