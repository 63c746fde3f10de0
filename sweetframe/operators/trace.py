"""Functions over the order of a patient's rows that need not see all of a patient's rows in one task.

They are scans of two levels. Rows are cut into chunks of a week; windows are partitioned by patient and chunk. What passes
from one chunk to others is a small carry, one row a chunk: its first and last row, its number of rows that count, or the
last row of a kind. A scan over those rows, of which a patient has one a week, gives each chunk what comes before or after
it, and an equality join on (patient, chunk) brings that back. So a patient with most of the rows is spread like all others.

Rows without a time can't be placed and are left out. Equal places in the order are taken in any order, as by a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sweetframe.functions.scalars import micros

WEEK = 7 * 24 * 3_600_000_000
ORDER = ("ts", "id")


def chunk(ts: Column, width: int = WEEK) -> Column:
    return F.floor(micros(ts) / width)


def beside(rows: DataFrame, columns: list[str], *, by: str = "patient_id", order: tuple[str, ...] = ORDER, width: int = WEEK) -> DataFrame:
    """rows with ``before`` and ``after``, structs of the columns of the row before and after in the patient's order."""
    own = rows.where(F.col(order[0]).isNotNull()).withColumn("__chunk", chunk(F.col(order[0]), width))
    inside, row = Window.partitionBy(by, "__chunk").orderBy(*order), F.struct(*columns)
    got = own.withColumns({"before": F.lag(row).over(inside), "after": F.lead(row).over(inside)})
    place = F.struct(*order)
    ends = own.groupBy(by, "__chunk").agg(F.min_by(row, place).alias("__first"), F.max_by(row, place).alias("__last"))
    chunks = Window.partitionBy(by).orderBy("__chunk")
    carry = ends.select(by, "__chunk", F.lag("__last").over(chunks).alias("__before"), F.lead("__first").over(chunks).alias("__after"))
    out = got.join(carry, [by, "__chunk"], "left")
    return out.withColumns({"before": F.coalesce("before", "__before"), "after": F.coalesce("after", "__after")}).drop("__chunk", "__before", "__after")


def last_so_far(rows: DataFrame, value: Column, name: str, *, by: str = "patient_id", order: tuple[str | Column, ...] = ORDER, ts: str = "ts", width: int = WEEK) -> DataFrame:
    """rows with the last non-null value at or before each in the patient's order."""
    own = rows.where(F.col(ts).isNotNull()).withColumn("__chunk", chunk(F.col(ts), width)).withColumn("__value", value)
    inside = Window.partitionBy(by, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = own.withColumn(name, F.last("__value", ignorenulls=True).over(inside))
    ends = own.groupBy(by, "__chunk").agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.struct(*order))).alias("__end"))
    earlier = Window.partitionBy(by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(by, "__chunk", F.last("__end", ignorenulls=True).over(earlier).alias("__carry"))
    return got.join(carry, [by, "__chunk"], "left").withColumn(name, F.coalesce(name, "__carry")).drop("__chunk", "__value", "__carry")


def numbered(rows: DataFrame, sums: dict[str, Column] | None = None, *, name: str = "place", by: str = "patient_id", order: tuple[str, ...] = ORDER, width: int = WEEK) -> DataFrame:
    """rows with their place in the patient's order, from 1, and running sums up to and with each row."""
    sums = {name: F.lit(1).cast("long")} | (sums or {})
    own = rows.where(F.col(order[0]).isNotNull()).withColumn("__chunk", chunk(F.col(order[0]), width))
    inside = Window.partitionBy(by, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = own.withColumns({k: F.sum(c).over(inside) for k, c in sums.items()})
    totals = own.groupBy(by, "__chunk").agg(*[F.sum(c).alias(f"__{k}") for k, c in sums.items()])
    earlier = Window.partitionBy(by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(by, "__chunk", *[F.coalesce(F.sum(f"__{k}").over(earlier), F.lit(0)).alias(f"__{k}") for k in sums])
    out = got.join(carry, [by, "__chunk"], "left")
    return out.withColumns({k: F.col(k) + F.col(f"__{k}") for k in sums}).drop("__chunk", *[f"__{k}" for k in sums])


def steps(rows: DataFrame, aggregates: dict[str, Column], *, by: str = "patient_id", order: tuple[str, ...] = ORDER, columns: tuple[str, ...] = ("ts",), width: int = WEEK) -> DataFrame:
    """Sums and maxima over a patient's steps from one row to the next, of which ``aggregates`` names sums and maxima.

    In the aggregates' columns, ``a.x`` is column x of the row before and ``b.x`` that of the row itself. Each must be a sum
    or a maximum under an alias that begins with ``sum_`` or ``max_``. The rows are read once: steps within a chunk are
    aggregated with it, those between two chunks are made of their last and first row.
    """
    own = rows.where(F.col(order[0]).isNotNull()).withColumn("__chunk", chunk(F.col(order[0]), width))
    row, place = F.struct(*columns), F.struct(*order)
    inside = Window.partitionBy(by, "__chunk").orderBy(*order)
    got = own.select(by, "__chunk", row.alias("b"), F.lag(row).over(inside).alias("a"), place.alias("__place"))
    of = {"sum": F.sum, "max": F.max}
    made = [of[k[:3]](c).alias(k) for k, c in aggregates.items()]
    chunks = got.groupBy(by, "__chunk").agg(*made, F.min_by("b", "__place").alias("first"), F.max_by("b", "__place").alias("last"))
    between = chunks.withColumn("a", F.lag("last").over(Window.partitionBy(by).orderBy("__chunk"))).withColumn("b", F.col("first"))
    whole = {k: F.sum(F.coalesce(F.col(k), F.lit(0)) + F.coalesce(c, F.lit(0))) if k[:3] == "sum" else F.max(F.greatest(F.col(k), c)) for k, c in aggregates.items()}
    return between.groupBy(by).agg(*[c.alias(k) for k, c in whole.items()])
