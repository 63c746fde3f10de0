"""A store of cohort rows, partitioned by day: reads prune by time, loads are idempotent.

A load is an upsert by (patient, id): a row that is there already changes nothing, a changed one replaces its former self,
also where its time moved to another day. Only days with a change are written, each whole, by dynamic partition overwrite;
they are written to the shared folder first, so that a day is never read while it is overwritten and a load that fails
half-way can be repeated. Rows without a time lie in a day of their own; of rows of one key in a load the last by the
columns' order stays.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sweetframe.scratch import written

KEY = ("patient_id", "id")


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The store's rows with their ``day``; none where nothing was ever loaded."""
    try:
        return spark.read.schema(f"{schema}, day DATE").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, day DATE")


def _same(a: DataFrame, b: DataFrame, columns: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & a[c].eqNullSafe(b[c])
    return out


def upsert(rows: DataFrame, path: str) -> int:
    """Loads rows (patient_id, id, ts, others) into the store; the number of days written."""
    spark, columns = rows.sparkSession, rows.columns
    schema = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes)
    one = rows.groupBy(*KEY).agg(F.max(F.struct(*columns)).alias("r")).select("r.*")
    new = written(one.withColumn("day", F.to_date("ts")))
    stored = read(spark, path, schema)
    changed = written(new.join(stored, _same(new, stored, (*columns, "day")), "left_anti"))
    # days of changed rows, and those where they stood before
    before = stored.select(*KEY, F.col("day").alias("old_day"))
    moved = before.join(changed, _same(before, changed, KEY), "left_semi").select(F.col("old_day").alias("day"))
    days = written(changed.select("day").union(moved).distinct())
    n = days.count()
    if n:
        touched = stored.join(days, stored["day"].eqNullSafe(days["day"]), "left_semi")
        whole = touched.join(changed, _same(touched, changed, KEY), "left_anti").unionByName(changed)
        ready = written(whole.repartition("day"))
        # a day whose last row moved away has nothing to overwrite it with: it is left without rows, not with old ones
        emptied = [r["day"] for r in days.join(ready, days["day"].eqNullSafe(ready["day"]), "left_anti").collect()]  # days, not rows
        ready.sortWithinPartitions("patient_id", "ts").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
        for day in emptied:
            where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/day={day or '__HIVE_DEFAULT_PARTITION__'}")
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return n


def between(stored: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of [start, end): whole days are pruned, the edges compared by time."""
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    return stored.where((F.col("day") >= F.to_date(lo)) & (F.col("day") <= F.to_date(hi)) & (F.col("ts") >= lo) & (F.col("ts") < hi))


def of_edges(stored: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows of each patient's [lo, hi). edges: (patient_id, lo, hi), one row a patient.

    Edges are entered for each day that they touch, so that the join is an equality on patient and day and Spark prunes
    days by the edges at run time.
    """
    days = F.sequence(F.to_date("lo"), F.to_date("hi"))
    touched = edges.select("patient_id", "lo", "hi", F.explode(days).alias("day"))
    return stored.join(touched, ["patient_id", "day"]).where((F.col("ts") >= F.col("lo")) & (F.col("ts") < F.col("hi"))).select(*stored.columns)
