"""Settings snapshots, change events and log entries."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sweetframe.functions.scalars import micros


def latest_snapshots(snapshots: DataFrame, n: int = 30) -> DataFrame:
    """The newest n (a report, so a limit is its point)."""
    return snapshots.orderBy(F.desc("captured_at"), F.desc("id")).limit(n)


def snapshot_status(snapshots: DataFrame) -> DataFrame:
    last = F.max(F.struct("captured_at", "id", "version"))["version"]
    return snapshots.agg(F.count("*").alias("n"), F.min("captured_at").alias("earliest"), F.max("captured_at").alias("latest"), last.alias("latest_version"), F.when(F.count("*") == 0, "no snapshots").otherwise("").alias("note"))


def _ranges(times: DataFrame, ts: str, parts: int) -> list[float]:
    """Cut points, in microseconds, that part the times into about equally many rows each."""
    shares = [i / parts for i in range(1, parts)]
    cuts = times.select(micros(F.col(ts)).cast("double").alias("at")).approxQuantile("at", shares, 0.2 / parts) if shares else []
    return [-float("inf"), *sorted(set(cuts)), float("inf")]


def setting_at(requests: DataFrame, snapshots: DataFrame, parts: int | None = None) -> DataFrame:
    """requests (id, key, ts) with the snapshot at or before ts, whether it has the key, and its value.

    Requests and snapshots are merged by time within ranges of about equally many rows, as many as shuffle partitions or
    ``parts``, whatever their spread over time; the last snapshot of each range is carried on to the next ones by a table
    of one row a range. Only ids travel; each document is fetched once for all requests that found it.
    """
    parts = parts or int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = snapshots.where("captured_at is not null").select(F.col("captured_at").alias("ts"), F.lit(0).alias("side"), F.struct("captured_at", F.col("id").alias("snapshot_id")).alias("s"))
    asks = requests.select("ts", F.lit(1).alias("side"), F.struct(*requests.columns).alias("row"))
    both = docs.unionByName(asks, allowMissingColumns=True).withColumn("at", micros(F.col("ts")).cast("double"))
    ranges = _ranges(both, "ts", parts)
    dealt = Bucketizer(splits=ranges, inputCol="at", outputCol="range", handleInvalid="keep").transform(both) if len(ranges) > 2 else both.withColumn("range", F.lit(0.0))
    inside = Window.partitionBy("range").orderBy("ts", "side", "s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = dealt.withColumn("m", F.last("s", ignorenulls=True).over(inside)).where("side = 1 and ts is not null")
    ends = dealt.groupBy("range").agg(F.max("s").alias("end"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    carried = ends.select("range", F.last("end", ignorenulls=True).over(earlier).alias("carried"))
    told = found.join(F.broadcast(carried), "range").select("row", F.coalesce("m", "carried")["snapshot_id"].alias("snapshot_id"))
    told = told.unionByName(requests.where("ts is null").select(F.struct(*requests.columns).alias("row")), allowMissingColumns=True)
    values = snapshots.select(F.col("id").alias("own_id"), F.from_json("full_json", "map<string, string>").alias("values"))
    whole = told.join(values, F.col("snapshot_id") == F.col("own_id"), "left")
    return whole.select("row.*", "snapshot_id", F.coalesce(F.map_contains_key("values", F.col("row.key")), F.lit(False)).alias("found"), F.try_element_at("values", F.col("row.key")).alias("value"))


def setting_history(events: DataFrame, snapshots: DataFrame, key: str) -> DataFrame:
    """The key's changes with the version of the snapshot that showed them."""
    own = events.where(F.col("key") == key)
    return own.join(snapshots.select(F.col("id").alias("snapshot_id"), "captured_at", "version"), "snapshot_id")


def settings_diff(events: DataFrame, snapshots: DataFrame, start: str, end: str) -> DataFrame:
    """All changes detected in [start, end)."""
    inside = events.where((F.col("detected_at") >= F.lit(start).cast("timestamp")) & (F.col("detected_at") < F.lit(end).cast("timestamp")))
    return inside.join(snapshots.select(F.col("id").alias("snapshot_id"), "version"), "snapshot_id").orderBy("detected_at", "key")


def changed_keys(events: DataFrame) -> DataFrame:
    """The distinct keys in order, the first ten listed."""
    keys = events.select("key").where("key is not null").distinct()
    first = keys.orderBy("key").limit(10).agg(F.lit(None).cast("long").alias("n_keys"), F.array_join(F.array_sort(F.collect_list("key")), ",").alias("first_keys"))
    number = keys.agg(F.count("*").alias("n_keys"), F.lit(None).cast("string").alias("first_keys"))
    return number.unionByName(first).agg(F.max("n_keys").alias("n_keys"), F.max("first_keys").alias("first_keys"))


def log_entries(log: DataFrame, start: str | None = None, end: str | None = None, kinds: tuple[str, ...] = ()) -> DataFrame:
    """Entries of [start, end) and of the given kinds, in order, with the JSON values kept as text where they don't parse."""
    if start:
        log = log.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end:
        log = log.where(F.col("ts") < F.lit(end).cast("timestamp"))
    if kinds:
        log = log.where(F.col("event_type").isin(*kinds))
    return log.orderBy("ts", "id")


def log_values(log: DataFrame) -> DataFrame:
    """(id, ts, event_type, key, value, kind): a row for each value of an entry's JSON object, decoded with its type's name.

    Entries that hold other JSON, or text that isn't JSON, are one row with a null key; those without values give none.
    """
    doc = F.try_parse_json("values_json")
    members = F.try_variant_get("doc", "$", "map<string, variant>")
    whole = F.map_from_arrays(F.array(F.lit("")), F.array(F.coalesce("doc", F.to_variant_object(F.array("values_json")))))
    is_object = F.coalesce(F.schema_of_variant("doc").startswith("OBJECT<"), F.lit(False))
    rows = log.where("values_json is not null").select("id", "ts", "event_type", "values_json", doc.alias("doc"))
    each = rows.select("id", "ts", "event_type", "values_json", F.col("doc").isNotNull().alias("is_json"), is_object.alias("is_object"), F.explode(F.when(is_object, members).otherwise(whole)).alias("key", "v"))
    value = F.when(F.col("is_json"), F.coalesce(F.try_variant_get("v", "$", "string"), F.to_json("v"))).otherwise(F.col("values_json"))
    kind = F.when(F.col("is_json"), F.regexp_extract(F.lower(F.schema_of_variant("v")), "^[a-z]+", 0)).otherwise("text")
    return each.select("id", "ts", "event_type", F.when(F.col("is_object"), F.col("key")).alias("key"), value.alias("value"), kind.alias("kind"))
