"""What queries share: registration, rounding on both sides, and the SQL of the adapter tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweetframe.operators.metrics import valid
from sweetframe.sources import cohort

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The adapter tables as common table expressions.
TABLES = """
e AS (SELECT event_id, ts, CAST(floor(user_id / 75) AS BIGINT) AS patient_id, event_type, value, props, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
r AS (SELECT patient_id, CAST(event_id AS VARCHAR) AS id, ts, CAST(floor(40 + value * 1.2) AS INT) AS sgv,
             CASE event_type WHEN 'view' THEN 'Flat' WHEN 'click' THEN 'FortyFiveUp' ELSE 'DoubleDown' END AS direction
      FROM e WHERE event_type IN ('view', 'click', 'signup')),
t AS (SELECT patient_id, event_id AS id, ts, k,
             CASE WHEN k < 40 THEN 'Correction Bolus' WHEN k < 60 THEN 'Meal Bolus' WHEN k < 80 THEN 'Carb Correction' WHEN k < 98 THEN 'Bolus' ELSE 'Profile Switch' END AS event_type,
             CASE WHEN k < 60 OR k BETWEEN 80 AND 97 THEN 0.5::DOUBLE + floor(value / 20) END AS insulin,
             CASE WHEN k BETWEEN 40 AND 79 THEN 5 + floor(value / 4) END AS carbs,
             CASE k % 10 WHEN 7 THEN 'auto SMB' WHEN 3 THEN 'felt low' END AS notes, CASE k % 2 WHEN 0 THEN 'pump' ELSE 'app' END AS entered_by
      FROM e WHERE event_type = 'purchase'),
ds AS (SELECT patient_id, event_id AS id, ts, k, floor(value) AS v, floor(value / 10) AS v10, k % 7 > 0 AS has_suggested FROM e WHERE event_type = 'error'),
bolus_left AS (SELECT *, CASE WHEN has_suggested AND k % 5 < 4 THEN round((40 + v) / 18.0, 1) WHEN has_suggested THEN 2.5::DOUBLE END AS sens_mmol FROM ds)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, dates as text."""
    show = {"double": lambda c: F.round(c, digits), "date": lambda c: c.cast("string")}
    return df.select(*[(show[kind](F.col(c)) if kind in show else F.col(c)).alias(c) for c, kind in df.dtypes])


def query(name: str, sql: str | None = None, doubles: str = ""):
    """Registers f(spark, sf_dir); sql selects from the adapter tables, with the columns named in doubles to be rounded."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            fixed = ", ".join(f"round({c}, 6) AS {c}" for c in doubles.split())
            ORACLE_SQL[name] = f"WITH RECURSIVE {TABLES}\nSELECT *{f' REPLACE ({fixed})' if fixed else ''} FROM ({sql.strip()}) AS found"
        return f

    return put


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid(cohort.readings(spark, sf_dir))
