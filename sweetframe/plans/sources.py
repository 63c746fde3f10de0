"""Queries on sources, projections and controller documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sweetframe.operators import devices, metrics, scans, textindex
from sweetframe.plans._base import query, readings
from sweetframe.scratch import folder, written
from sweetframe.sources import cohort, ingest, store

SPAN = "'2024-01-05'", "'2024-01-20'"
INSIDE = f"ts >= TIMESTAMP {SPAN[0]} AND ts < TIMESTAMP {SPAN[1]}"
R_COLUMNS = "patient_id, id, ts, sgv, 'sgv' AS type, direction"
T_COLUMNS = "patient_id, id, ts, event_type, insulin, carbs, notes, entered_by"


@query("scan_readings", f"SELECT {R_COLUMNS} FROM r WHERE {INSIDE}")
def scan_readings(spark, d):
    return metrics.dedup(scans.between(cohort.readings(spark, d), "2024-01-05", "2024-01-20"))


@query("scan_treatments", f"SELECT {T_COLUMNS} FROM t WHERE {INSIDE}", "insulin carbs")
def scan_treatments(spark, d):
    return scans.between(cohort.treatments(spark, d), "2024-01-05", "2024-01-20").dropDuplicates(["patient_id", "id"])


@query("scan_devicestatus", f"SELECT patient_id, id, ts, k AS battery FROM ds WHERE {INSIDE}")
def scan_devicestatus(spark, d):
    got = scans.between(cohort.devicestatus(spark, d), "2024-01-05", "2024-01-20").dropDuplicates(["patient_id", "id"])
    return got.select("patient_id", "id", "ts", F.try_variant_get(F.parse_json("doc"), "$.uploader.battery", "int").alias("battery"))


NTH = "row_number() OVER (PARTITION BY patient_id ORDER BY ts DESC, id DESC)"


@query("latest_n_readings", f"SELECT {R_COLUMNS} FROM (SELECT *, {NTH} AS n FROM r) WHERE n <= 10")
def latest_n_readings(spark, d):
    return scans.latest(readings(spark, d), 10)


@query("dedup_readings", f"SELECT {R_COLUMNS} FROM r")
def dedup_readings(spark, d):
    """Each page is read twice, as overlapping pages are."""
    r = cohort.readings(spark, d)
    return metrics.dedup(r.unionByName(r))


@query("profile_schedules", "SELECT patient_id, schedule, '00:00' AS start, v AS value FROM (SELECT DISTINCT patient_id FROM r) p CROSS JOIN (VALUES ('basal', 0.8::DOUBLE), ('sens', 2.8), ('carbratio', 10.0), ('target_low', 4.4), ('target_high', 7.8)) s(schedule, v)", "value")
def profile_schedules(spark, d):
    return cohort.profile_schedules(cohort.profiles(cohort.readings(spark, d)))


@query("profile_settings", "SELECT DISTINCT patient_id, 5.0::DOUBLE AS dia_hours, 2.8::DOUBLE AS isf_mmol, 10.0::DOUBLE AS cr, 'mmol/L' AS units, 'UTC' AS tz FROM r", "dia_hours isf_mmol cr")
def profile_settings(spark, d):
    return cohort.profile_settings(cohort.profiles(cohort.readings(spark, d)))


STATUS = "count(*) AS \"rows\", min(ts) AS first, max(ts) AS last, count(DISTINCT patient_id) AS patients"


@query("source_status", f"SELECT 'readings' AS source, {STATUS} FROM r UNION ALL SELECT 'treatments', {STATUS} FROM t UNION ALL SELECT 'devicestatus', {STATUS} FROM ds")
def source_status(spark, d):
    return scans.source_status(readings=cohort.readings(spark, d), treatments=cohort.treatments(spark, d), devicestatus=cohort.devicestatus(spark, d))


@query("readings_projected", "SELECT patient_id, id, ts, sgv, 'sgv' AS type, direction, 'sensor' AS device, round(sgv / 18.0, 1) AS sgv_mmol, CASE direction WHEN 'Flat' THEN '→' WHEN 'FortyFiveUp' THEN '↗' WHEN 'DoubleDown' THEN '↓↓' END AS arrow FROM r", "sgv_mmol")
def readings_projected(spark, d):
    """The readings as documents, some with a time as text and some with milliseconds only, and projected back."""
    r = cohort.readings(spark, d)
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    raw = r.select("patient_id", F.col("id").alias("_id"), "sgv", F.unix_millis("ts").alias("date"), stamp.alias("dateString"), "direction", "type", F.lit("sensor").alias("device"))
    return cohort.project_readings(raw)


@query("treatments_projected", f"SELECT {T_COLUMNS}, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS created_at FROM t", "insulin carbs")
def treatments_projected(spark, d):
    t = cohort.treatments(spark, d)
    raw = t.withColumnsRenamed({"id": "_id", "event_type": "eventType", "entered_by": "enteredBy"}).withColumn("created_at", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")).drop("ts")
    return cohort.project_treatments(raw)


@query("readings_valid", f"SELECT {R_COLUMNS} FROM r WHERE sgv > 0")
def readings_valid(spark, d):
    return readings(spark, d)


def last_hours(rows: str, hours: int) -> str:
    return f"SELECT * FROM (SELECT *, max(epoch_us(ts)) OVER (PARTITION BY patient_id) AS newest FROM {rows}) WHERE epoch_us(ts) >= newest - {hours * 3_600_000_000}"


@query("glucose_history", f"SELECT {R_COLUMNS} FROM ({last_hours('r', 24)})")
def glucose_history(spark, d):
    return scans.last_hours(readings(spark, d), 24)


@query("treatments_window", f"SELECT {T_COLUMNS} FROM ({last_hours('t', 48)}) WHERE event_type = 'Bolus'", "insulin carbs")
def treatments_window(spark, d):
    return scans.last_hours(cohort.treatments(spark, d), 48).where("event_type = 'Bolus'")


@query("search_treatments", f"SELECT {T_COLUMNS} FROM t WHERE lower(coalesce(notes, '')) LIKE '%smb%' OR lower(event_type) LIKE '%smb%' OR lower(entered_by) LIKE '%smb%'", "insulin carbs")
def search_treatments(spark, d):
    return scans.search(cohort.treatments(spark, d), "SMB")


@query("search_treatments_indexed", f"SELECT {T_COLUMNS} FROM t WHERE lower(coalesce(notes, '')) LIKE '%felt low%' OR lower(event_type) LIKE '%felt low%' OR lower(entered_by) LIKE '%felt low%'", "insulin carbs")
def search_treatments_indexed(spark, d):
    """The search by a trigram index of the treatments' texts."""
    t = cohort.treatments(spark, d)
    return textindex.search(t, textindex.build(t), "felt LOW").select(*T_COLUMNS.split(", "))


STORED = "patient_id LONG, id STRING, ts TIMESTAMP, sgv INT, direction STRING"


def _store(spark, d) -> str:
    """A store of the readings after three loads: a first one with wrong values, a second one of all rows, and that again."""
    path = f"{folder(spark)}/store-{uuid.uuid4().hex}"
    r = readings(spark, d).select("patient_id", "id", "ts", "sgv", "direction")
    store.upsert(r.where("ts < timestamp '2024-01-12'").withColumn("sgv", F.col("sgv") + 1), path)
    store.upsert(r, path)
    store.upsert(r, path)
    return path


@query("store_window", f"SELECT patient_id, id, ts, sgv, direction FROM r WHERE {INSIDE}")
def store_window(spark, d):
    """Readings of a window from the store by day."""
    return store.between(store.read(spark, _store(spark, d), STORED), "2024-01-05", "2024-01-20").drop("day")


@query("store_last_days", f"SELECT patient_id, id, ts, sgv, direction FROM ({last_hours('r', 60)})")
def store_last_days(spark, d):
    """The last 60 hours of each patient from the store by day; days are pruned by the patients' edges."""
    stored = store.read(spark, _store(spark, d), STORED)
    edges = stored.groupBy("patient_id").agg(F.max("ts").alias("newest"))
    edges = edges.select("patient_id", F.expr("newest - INTERVAL 60 HOURS").alias("lo"), F.expr("newest + INTERVAL 1 SECOND").alias("hi")).where("patient_id is not null")
    return store.of_edges(stored, edges).drop("day")


@query("sensor_gaps", 'SELECT patient_id, ts AS last, following AS "next", (epoch_us(following) - epoch_us(ts)) // 60000000 AS minutes FROM (SELECT *, lead(ts) OVER (PARTITION BY patient_id ORDER BY ts, id) AS following FROM r) WHERE following IS NULL OR epoch_us(following) - epoch_us(ts) > 900000000')
def sensor_gaps(spark, d):
    return metrics.sensor_gaps(readings(spark, d))


@query("search_documents", "SELECT doc_id, lang FROM documents WHERE lower(coalesce(text, '')) LIKE '%license%' OR lower(coalesce(lang, '')) LIKE '%license%' OR lower(coalesce(source, '')) LIKE '%license%'")
def search_documents(spark, d):
    """The same search over free text."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("text").alias("notes"), F.col("lang").alias("event_type"), F.col("source").alias("entered_by"))
    return scans.search(docs, "license").select("doc_id", F.col("event_type").alias("lang"))


@query("profile_switches", "SELECT patient_id, id, ts FROM t WHERE event_type = 'Profile Switch'")
def profile_switches(spark, d):
    return cohort.treatments(spark, d).where("event_type = 'Profile Switch' and ts is not null").select("patient_id", "id", "ts")


IOB = "CASE WHEN k % 3 > 0 THEN v / 8 WHEN k % 2 = 0 THEN v / 4 END"


@query("devicestatus_flat", f"SELECT patient_id, id, ts, {IOB} AS iob, CASE WHEN has_suggested THEN v10 END AS cob, CASE WHEN has_suggested THEN v + 50 END AS eventual_bg, CASE WHEN has_suggested THEN 100.0 END::DOUBLE AS target_bg, CASE WHEN has_suggested THEN 'a reason' END AS reason, NULL::DOUBLE AS enacted_rate, CASE WHEN k % 2 = 0 THEN k END::DOUBLE AS pump_battery, CASE WHEN k % 2 = 0 THEN v * 2 END AS reservoir, k::DOUBLE AS uploader_battery, k % 2 = 1 AS is_charging FROM ds", "iob cob eventual_bg target_bg pump_battery reservoir uploader_battery")
def devicestatus_flat(spark, d):
    return devices.devicestatus_flat(cohort.documents(spark, d))


@query("algorithm_state", "SELECT patient_id, id, ts, CASE WHEN k % 5 < 4 THEN 40 + v END AS variable_sens, CASE WHEN k % 5 = 4 THEN 2.5::DOUBLE END AS sens, v + 50 AS eventual_bg, 100.0::DOUBLE AS target_bg, CASE WHEN v > 190 THEN 12.0::DOUBLE END AS carbs_required, NULL::DOUBLE AS insulin_required, k % 2 = 0 AS dynamic_isf, NULL::VARCHAR AS algorithm, NULL::DOUBLE AS current_bg, NULL::DOUBLE AS isf_for_carbs, NULL::DOUBLE AS sensitivity_ratio, NULL::DOUBLE AS smb_units, NULL::VARCHAR AS tick, 'a reason' AS reason, round(CASE WHEN k % 5 < 4 THEN 40 + v END / 18.0, 1) AS effective_isf_mmol, round((v + 50) / 18.0, 1) AS eventual_mmol FROM ds WHERE has_suggested", "variable_sens sens eventual_bg target_bg carbs_required effective_isf_mmol eventual_mmol")
def algorithm_state(spark, d):
    return devices.algorithm_state(cohort.documents(spark, d))


SHAPES = "SELECT patient_id, event_id AS id, ts, k, k % 8 AS s, floor(value) AS v FROM e WHERE event_type = 'error'"


def _by_shape(kind: str, **of_shapes: str) -> str:
    """CASE over the shapes: s0='...' gives the value of shape 0; null for others."""
    cases = " ".join(f"WHEN {shape[1:]} THEN {value}" for shape, value in of_shapes.items())
    return f"CAST(CASE s {cases} END AS {kind})"


ALL_COLUMNS = {
    "device": _by_shape("VARCHAR", s0="'pod-' || k"), "iob": _by_shape("DOUBLE", s0="v + 0.25", s1="v + 0.5", s2="CASE WHEN v <> 0 THEN v END", s3="k", s5="v + 0.125"),
    "basal_iob": _by_shape("DOUBLE", s0="-0.5", s4="k", s5="0.5"), "insulin_activity": _by_shape("DOUBLE", s0="0.0125", s3="0.25"), "cob": _by_shape("DOUBLE", s0="k + 0.5", s1="k"),
    "eventual_bg": _by_shape("DOUBLE", s0="-(v + 0.5)", s1="v"), "target_bg": _by_shape("DOUBLE", s0="110"), "reason": _by_shape("VARCHAR", s0="'because ' || k"),
    "enacted_rate": _by_shape("DOUBLE", s0="1.25", s1="0.35", s3="0.15"), "enacted_minutes": _by_shape("DOUBLE", s0="45"), "enacted_minutes_left": _by_shape("DOUBLE", s0="15"),
    "pump_battery": _by_shape("DOUBLE", s0="k", s5="k"), "pump_voltage": _by_shape("DOUBLE", s0="1.5"), "reservoir": _by_shape("DOUBLE", s0="v + 0.75", s2="4"),
    "pump_status": _by_shape("VARCHAR", s0="'normal ' || k"), "active_profile": _by_shape("VARCHAR", s0="'P' || k"), "base_basal": _by_shape("DOUBLE", s0="0.55"), "last_bolus_at": _by_shape("VARCHAR", s0="'t' || k"),
    "last_bolus": _by_shape("DOUBLE", s0="1.15"), "temp_basal": _by_shape("DOUBLE", s0="0.65"), "temp_basal_start": _by_shape("VARCHAR", s0="'s' || k"), "version": _by_shape("VARCHAR", s0="'v' || k"),
    "uploader_battery": _by_shape("DOUBLE", s0="k", s1="k"), "is_charging": _by_shape("BOOLEAN", s0="true"),
}


@query("devicestatus_all_columns", f"SELECT patient_id, id, ts, {', '.join(f'{sql} AS {c}' for c, sql in ALL_COLUMNS.items())} FROM ({SHAPES})", " ".join(c for c, sql in ALL_COLUMNS.items() if "DOUBLE" in sql))
def devicestatus_all_columns(spark, d):
    return devices.devicestatus_summary(written(devices.typed(cohort.devicestatus_shapes(spark, d))))


STATES = {
    "current_bg": _by_shape("DOUBLE", s0="v"), "eventual_bg": _by_shape("DOUBLE", s0="-v", s1="v"), "target_bg": _by_shape("DOUBLE", s0="110"), "variable_sens": _by_shape("DOUBLE", s0="v"),
    "isf_for_carbs": _by_shape("DOUBLE", s0="61"), "sensitivity_ratio": _by_shape("DOUBLE", s0="1.5", s3="0.85"), "insulin_required": _by_shape("DOUBLE", s0="0.75", s2="k + 0.5"), "carbs_required": _by_shape("DOUBLE", s0="k"),
    "smb_units": _by_shape("DOUBLE", s0="0.4"), "algorithm": _by_shape("VARCHAR", s0="'A' || k"), "tick": _by_shape("VARCHAR", s0="'+' || k"), "reason": _by_shape("VARCHAR", s0="'because ' || k"),
    "dynamic_isf": _by_shape("BOOLEAN", s0="false"), "sens": _by_shape("DOUBLE", s0="2.25", s3="3.5"), "effective_isf_mmol": _by_shape("DOUBLE", s0="round(v / 18.0, 1)"), "eventual_mmol": _by_shape("DOUBLE", s0="round(-v / 18.0, 1)", s1="round(v / 18.0, 1)"),
}


@query("algorithm_state_shapes", f"SELECT patient_id, id, ts, {', '.join(f'{sql} AS {c}' for c, sql in STATES.items())} FROM ({SHAPES}) WHERE s < 5", " ".join(c for c, sql in STATES.items() if "DOUBLE" in sql))
def algorithm_state_shapes(spark, d):
    return devices.algorithm_state(written(devices.typed(cohort.devicestatus_shapes(spark, d))))


@query("bg_predictions", "SELECT patient_id, id, ts, 'IOB' AS trajectory, CAST(15 AS INT) AS minutes, CAST(v + 40 AS INT) AS last_bg FROM ds WHERE has_suggested")
def bg_predictions(spark, d):
    return devices.bg_predictions(cohort.documents(spark, d))


@query(
    "iob_cob_latest",
    f"SELECT p.patient_id, ts, iob, cob, coalesce(source, 'unavailable') AS source FROM (SELECT DISTINCT patient_id FROM ds) p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY n) AS m FROM (SELECT patient_id, ts, {IOB} AS iob, CASE WHEN has_suggested THEN v10 END AS cob, CASE WHEN k % 3 > 0 OR has_suggested THEN 'openaps' ELSE 'pump' END AS source, {NTH} AS n FROM ds) WHERE n <= 5 AND (iob IS NOT NULL OR cob IS NOT NULL)) b ON b.patient_id = p.patient_id AND m = 1",
    "iob cob",
)
def iob_cob_latest(spark, d):
    return devices.iob_cob_latest(cohort.documents(spark, d))


@query("device_status_best", f"SELECT patient_id, id, ts, tier FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY tier, n) AS m FROM (SELECT *, CAST(CASE WHEN has_suggested OR k % 3 > 0 THEN 0 WHEN k % 2 = 0 THEN 1 ELSE 2 END AS INT) AS tier, {NTH} AS n FROM ds) WHERE n <= 10) WHERE m = 1")
def device_status_best(spark, d):
    return devices.device_status_best(cohort.documents(spark, d))


@query("ingest_classify", "SELECT collection, count(*) AS n FROM (SELECT CASE event_type WHEN 'purchase' THEN 'treatments' WHEN 'error' THEN 'devicestatus' ELSE 'entries' END AS collection FROM events) GROUP BY 1")
def ingest_classify(spark, d):
    """All cohort rows as documents of one upload without telling names, sorted into collections by content."""
    r = cohort.readings(spark, d).select(F.to_json(F.struct("sgv", "direction")).alias("doc"))
    t = cohort.treatments(spark, d).select(F.to_json(F.struct(F.col("event_type").alias("eventType"), "insulin", "carbs")).alias("doc"))
    s = cohort.devicestatus(spark, d).select("doc")
    docs = r.unionByName(t).unionByName(s).select(F.lit("upload.json").alias("file"), F.lit("data").alias("part"), "doc")
    return ingest.classify(docs).groupBy("collection").agg(F.count("*").alias("n"))


@query("report_json")
def report_json(spark, d):
    return scans.as_json(metrics.glycemia_risk_index(readings(spark, d)))
