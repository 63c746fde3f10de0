"""Scans with pushed filters: windows, newest rows, text search, source status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sweetframe.functions.scalars import micros


def between(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of [start, end)."""
    return rows.where((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp")))


def latest(rows: DataFrame, n: int) -> DataFrame:
    """Each patient's newest n rows (a report, so a limit is its point)."""
    w = Window.partitionBy("patient_id").orderBy(F.desc("ts"), F.desc("id"))
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def last_hours(rows: DataFrame, hours: float) -> DataFrame:
    """Rows of the last hours before each patient's newest one."""
    newest = F.max(micros(F.col("ts"))).over(Window.partitionBy("patient_id"))
    return rows.withColumn("__new", newest).where(micros(F.col("ts")) >= F.col("__new") - int(hours * 3_600_000_000)).drop("__new")


def search(treatments: DataFrame, words: str, event_type: str | None = None) -> DataFrame:
    """Treatments with the words in notes, type or author, whatever the case."""
    hit = F.lit(False)
    for c in ("notes", "event_type", "entered_by"):
        hit = hit | F.lower(F.coalesce(c, F.lit(""))).contains(words.lower())
    return treatments.where(hit if event_type is None else hit & (F.col("event_type") == event_type))


def source_status(**tables: DataFrame) -> DataFrame:
    """Rows, first and last time and patients of each table."""
    out = None
    for name, rows in tables.items():
        got = rows.agg(F.count("*").alias("rows"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.count_distinct("patient_id").alias("patients")).select(F.lit(name).alias("source"), "*")
        out = got if out is None else out.unionByName(got)
    return out


def as_json(rows: DataFrame, key: str = "patient_id") -> DataFrame:
    """Each row as one JSON document."""
    return rows.select(key, F.to_json(F.struct(*rows.columns)).alias("json"))
