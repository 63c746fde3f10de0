"""Domain tables of a cohort: readers with fixed schemas, projections, and an adapter from the event tables.

Every table has a patient key and a timestamp; operators are partitioned by patient.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sweetframe.operators import devices
from sweetframe.scratch import written

READINGS_JSON = "_id STRING, sgv INT, date LONG, dateString STRING, direction STRING, type STRING, device STRING, patient_id LONG"
TREATMENTS_JSON = (
    "_id STRING, eventType STRING, created_at STRING, insulin DOUBLE, carbs DOUBLE, duration DOUBLE, absolute DOUBLE, percent DOUBLE, "
    "notes STRING, enteredBy STRING, glucose DOUBLE, glucoseType STRING, patient_id LONG"
)

SNAPSHOTS = "id LONG, captured_at TIMESTAMP, version STRING, full_json STRING"
CHANGES = "snapshot_id LONG, line LONG, key STRING, new_value STRING, detected_at TIMESTAMP"
LOG = "id LONG, ts TIMESTAMP, event_type STRING, values_json STRING"

# Trend arrows by direction.
ARROWS = {
    "DoubleUp": "↑↑", "SingleUp": "↑", "FortyFiveUp": "↗", "Flat": "→", "FortyFiveDown": "↘", "SingleDown": "↓", "DoubleDown": "↓↓",
    "NONE": "?", "NOT COMPUTABLE": "?", "RATE OUT OF RANGE": "?",
}


def read_readings(spark: SparkSession, path: str) -> DataFrame:
    return project_readings(spark.read.schema(READINGS_JSON).json(path))


def read_treatments(spark: SparkSession, path: str) -> DataFrame:
    return project_treatments(spark.read.schema(TREATMENTS_JSON).json(path))


def read_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of settings or log entries as Parquet; one without rows where nothing was ever stored."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def project_readings(raw: DataFrame) -> DataFrame:
    """Reading documents as readings: names, timestamps (from the text, else from epoch milliseconds), derived columns."""
    ts = F.coalesce(F.try_to_timestamp("dateString"), F.timestamp_millis("date"))
    return raw.select("patient_id", F.col("_id").alias("id"), ts.alias("ts"), F.col("sgv"), "type", "direction", "device").transform(with_derived)


def project_treatments(raw: DataFrame) -> DataFrame:
    """Treatment documents as treatments; rows whose time can't be read have a null ts."""
    names = {"_id": "id", "eventType": "event_type", "enteredBy": "entered_by", "glucoseType": "glucose_type"}
    return raw.withColumnsRenamed(names).withColumn("ts", F.try_to_timestamp("created_at"))


def with_derived(readings: DataFrame) -> DataFrame:
    return readings.withColumn("sgv_mmol", F.round(F.col("sgv") / 18.0, 1)).withColumn("arrow", arrow(F.col("direction")))


def arrow(direction: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in ARROWS.items() for x in pair])
    return F.coalesce(pairs[direction], F.lit("?"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.floor(F.col("user_id") / 75).cast("long").alias("patient_id"), "event_type", "value", "props")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).where("event_type in ('view', 'click', 'signup')")
    kinds = F.create_map(*map(F.lit, ("view", "Flat", "click", "FortyFiveUp", "signup", "DoubleDown")))
    return e.select(
        "patient_id", F.col("event_id").cast("string").alias("id"), "ts", F.floor(40 + F.col("value") * 1.2).cast("int").alias("sgv"),
        F.lit("sgv").alias("type"), kinds[F.col("event_type")].alias("direction"),
    )


def treatments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k of the event's properties tells what kind of treatment it stands for."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = _events(spark, sf_dir).where("event_type = 'purchase'").withColumn("k", k)
    kind = F.when(F.col("k") < 40, "Correction Bolus").when(F.col("k") < 60, "Meal Bolus").when(F.col("k") < 80, "Carb Correction").when(F.col("k") < 98, "Bolus").otherwise("Profile Switch")
    return e.select(
        "patient_id", F.col("event_id").alias("id"), "ts", kind.alias("event_type"),
        F.when((F.col("k") < 60) | F.col("k").between(80, 97), 0.5 + F.floor(F.col("value") / 20)).alias("insulin"),
        F.when(F.col("k").between(40, 79), (5 + F.floor(F.col("value") / 4)).cast("double")).alias("carbs"),
        F.when(F.col("k") % 10 == 7, "auto SMB").when(F.col("k") % 10 == 3, "felt low").alias("notes"),
        F.when(F.col("k") % 2 == 0, "pump").otherwise("app").alias("entered_by"),
    )


def devicestatus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Controller documents, nested and as JSON text, as uploaders send them."""
    e = _events(spark, sf_dir).where("event_type = 'error'").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    v = F.floor("value")
    predictions = F.struct(F.array((v + 60).cast("int"), (v + 50).cast("int"), (v + 40).cast("int")).alias("IOB"))
    suggested = F.struct(
        F.when(F.col("k") % 5 < 4, 40 + v).alias("variable_sens"), F.when(F.col("k") % 5 == 4, 2.5).alias("sens"), F.floor(F.col("value") / 10).alias("COB"), (v + 50).alias("eventualBG"),
        F.lit(100).alias("targetBG"), F.when(v > 190, 12).alias("carbsReq"), F.lit("a reason").alias("reason"), (F.col("k") % 2 == 0).alias("runningDynamicIsf"), predictions.alias("predBGs"),
    )
    openaps = F.struct(F.when(F.col("k") % 3 > 0, F.struct((v / 8).alias("iob"))).alias("iob"), F.when(F.col("k") % 7 > 0, suggested).alias("suggested"))
    pump = F.when(F.col("k") % 2 == 0, F.struct(F.struct(F.col("k").alias("percent")).alias("battery"), (v * 2).alias("reservoir"), F.when(F.col("k") % 3 == 0, v / 4).alias("iob")))
    doc = F.to_json(F.struct(openaps.alias("openaps"), pump.alias("pump"), F.struct(F.col("k").alias("battery")).alias("uploader"), (F.col("k") % 2 == 1).alias("isCharging")))
    return e.select("patient_id", F.col("event_id").alias("id"), "ts", doc.alias("doc"))


def documents(spark: SparkSession, sf_dir: str, **named: tuple[str, ...]) -> DataFrame:
    """Controller documents as ingestion stores them: parsed once, typed columns as Parquet; of those named, no others."""
    return written(devices.typed(devicestatus(spark, sf_dir), **named))


def devicestatus_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A controller document of one of eight shapes for each 'error' event, by k % 8, as different uploaders send them.

    0: all fields; 1: a loop's; 2: nothing decided, only done; 3: decided with two rare fields, done with more; 4: blobs and
    texts of wrong types; 5: an empty blob before the pump's; 6: no JSON; 7: an empty document.
    """
    e = _events(spark, sf_dir).where("event_type = 'error'").withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn("v", F.floor("value"))
    shapes = (
        """{"device":"pod-%k","isCharging":true,"uploaderBattery":%k,"uploader":{"battery":3},"openaps":{"iob":{"iob":%v.25,"basaliob":-0.5,"activity":0.0125},"suggested":{"bg":%v.9,"eventualBG":-%v.5,"targetBG":110,"tick":"+%k","COB":%k.5,"variable_sens":%v,"isfMgdlForCarbs":61,"sensitivityRatio":1.5,"insulinReq":0.75,"carbsReq":%k,"units":0.4,"reason":"because %k","runningDynamicIsf":false,"algorithm":"A%k","sens":2.25,"predBGs":{"IOB":[%v,91,92],"ZT":[93]}},"enacted":{"rate":1.25,"duration":45,"minutesRemaining":15,"bg":1,"predBGs":{"COB":[1]}}},"pump":{"battery":{"percent":%k,"voltage":1.5},"reservoir":%v.75,"status":{"status":"normal %k"},"extended":{"ActiveProfile":"P%k","BaseBasalRate":0.55,"LastBolus":"t%k","LastBolusAmount":1.15,"TempBasalAbsoluteRate":0.65,"TempBasalStart":"s%k","Version":"v%k"},"iob":77}}""",
        """{"loop":{"iob":{"iob":%v.5},"cob":{"cob":%k},"recommended":{"eventualBG":%v,"predBGs":{"UAM":[5,%k]}},"enacted":{"rate":0.35}},"uploader":{"battery":%k}}""",
        """{"openaps":{"iob":%v,"suggested":{},"enacted":{"insulinReq":%k.5,"reason":null,"COB":9,"predBGs":{"COB":[7,8,%v]}}},"pump":{"reservoir":4}}""",
        """{"openaps":{"suggested":{"sensitivityRatio":0.85,"tick":-2,"sens":3.5},"enacted":{"bg":%v,"variable_sens":90,"rate":0.15}},"pump":{"iob":{"iob":%k,"activity":0.25}}}""",
        """{"device":5,"isCharging":"yes","uploaderBattery":"88","openaps":{"iob":{"basaliob":%k,"iob":"1.5"},"suggested":{"COB":"4","eventualBG":true,"reason":12}},"pump":{"iob":%v,"battery":90,"status":"fine"}}""",
        """{"openaps":{"iob":{},"suggested":[]},"loop":{"iob":0},"pump":{"iob":{"iob":%v.125,"basaliob":0.5},"battery":{"percent":%k}}}""",
        "{no json %k",
        "{}",
    )
    doc = F.get(F.array(*map(F.lit, shapes)), F.col("k") % 8)
    filled = F.replace(F.replace(doc, F.lit("%k"), F.col("k").cast("string")), F.lit("%v"), F.col("v").cast("string"))
    return e.select("patient_id", F.col("event_id").alias("id"), "ts", filled.alias("doc"))


def profiles(patients: DataFrame) -> DataFrame:
    """One constant profile document for each patient."""
    schedule = lambda value: F.array(F.struct(F.lit("00:00").alias("time"), F.lit(value).alias("value")))
    sub = F.struct(F.lit(5.0).alias("dia"), F.lit("mmol").alias("units"), F.lit("UTC").alias("timezone"), schedule(0.8).alias("basal"), schedule(2.8).alias("sens"), schedule(10.0).alias("carbratio"), schedule(4.4).alias("target_low"), schedule(7.8).alias("target_high"))
    return patients.select("patient_id").distinct().select("patient_id", F.lit("Default").alias("default_profile"), F.create_map(F.lit("Default"), sub).alias("store"))


def profile_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile document for each customer, of six shapes by the key.

    0: mmol/L; 1: mg/dL in a zone of its own; 2: the named profile is absent; 3: nothing named, zeros, no zone;
    4: no entries, an unknown zone; 5: no profiles.
    """
    key = F.col("c_custkey")
    k, sens, cr = key % 6, (40 + key % 50).cast("double"), (5 + key % 9).cast("double")
    entry = lambda start, value: F.struct(F.lit(start).alias("time"), value.cast("double").alias("value"))
    listed = lambda *entries: F.filter(F.array(*entries), lambda e: k != 4)
    none = lambda value: F.when(k == 3, F.lit(0.0)).otherwise(value)
    sub = F.struct(
        none(F.lit(4.0)).alias("dia"), F.when(k == 1, "mg/dl").when(k == 2, "MGDL").when(k != 3, "mmol").alias("units"), F.when(k == 1, "America/New_York").when(k == 4, "Not/AZone").when(k != 3, "UTC").alias("timezone"),
        listed(entry("00:00", F.lit(0.8)), entry("06:30", F.lit(1.1))).alias("basal"), listed(entry("00:00", none(F.when(k == 0, sens / 10).otherwise(sens)))).alias("sens"), listed(entry("00:00", none(cr))).alias("carbratio"),
        F.filter(listed(entry("00:00", cr)), lambda e: F.lit(False)).alias("target_low"), F.filter(listed(entry("00:00", cr)), lambda e: F.lit(False)).alias("target_high"),
    )
    store = F.map_filter(F.create_map(F.when(k == 2, "Night").otherwise("Default"), sub), lambda name, of: k != 5)
    named = F.when(k == 2, "Day").when(k != 3, "Default")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(key.cast("long").alias("patient_id"), named.alias("default_profile"), store.alias("store"))


def profile_settings(profiles: DataFrame) -> DataFrame:
    """(patient_id, dia_hours, isf_mmol, cr, units, tz) of the active sub-profile: its first entries; zero means none.

    A document without the profile that it names tells nothing: an action time of 5 hours and UTC stand in.
    """
    active = profiles.withColumn("sub", F.try_element_at("store", F.coalesce("default_profile", F.lit("Default"))))
    first = lambda name: F.nullif(F.try_element_at(F.col(f"sub.{name}"), F.lit(1))["value"], F.lit(0.0))
    in_mgdl = F.lower("sub.units").isin("mg/dl", "mgdl")
    return active.select(
        "patient_id", F.coalesce(F.nullif(F.col("sub.dia"), F.lit(0.0)), F.lit(5.0)).alias("dia_hours"),
        F.when(in_mgdl, F.round(first("sens") / 18.0, 1)).otherwise(first("sens")).alias("isf_mmol"), first("carbratio").alias("cr"),
        F.when(in_mgdl, "mg/dL").otherwise("mmol/L").alias("units"), F.coalesce("sub.timezone", F.lit("UTC")).alias("tz"),
    )


def profile_schedules(profiles: DataFrame) -> DataFrame:
    """One row for each entry of each schedule of the active sub-profile, or of the first one where it is absent."""
    sub = F.coalesce(F.try_element_at("store", F.coalesce("default_profile", F.lit("Default"))), F.try_element_at(F.map_values("store"), F.lit(1)))
    active = profiles.select("patient_id", sub.alias("sub"))
    names = ("basal", "sens", "carbratio", "target_low", "target_high")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("schedule"), F.col(f"sub.{n}").alias("entries")) for n in names]))
    return active.select("patient_id", each.alias("s")).select("patient_id", "s.schedule", F.explode("s.entries").alias("e")).select("patient_id", "schedule", F.col("e.time").alias("start"), F.col("e.value").alias("value"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    doc = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer")))
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("captured_at"), F.col("o_orderpriority").alias("version"), doc.alias("full_json"))


def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return i.select(
        F.col("l_orderkey").alias("snapshot_id"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_returnflag").alias("key"), F.col("l_linestatus").alias("new_value"), F.col("l_shipdate").cast("timestamp").alias("detected_at")
    )


def log_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(F.col("event_id").alias("id"), "ts", "event_type", F.col("props").alias("values_json"))
