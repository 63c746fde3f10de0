import io
import json
import zipfile

from sweetframe.sources import cohort, ingest


def collections(spark, tmp_path, files):
    for name, content in files.items():
        (tmp_path / name).write_bytes(content if isinstance(content, bytes) else content.encode())
    got = ingest.classify(ingest.read_files(spark, str(tmp_path))).groupBy("collection").count().collect()
    return {r["collection"]: r["count"] for r in got}


ENTRY, TREATMENT, STATUS = {"sgv": 100, "date": 1}, {"eventType": "Bolus", "insulin": 1}, {"openaps": {"iob": 1}}


def test_separate_files_and_lines(spark, tmp_path):
    lines = "\n".join(map(json.dumps, [TREATMENT, TREATMENT])) + "\nbroken{"
    assert collections(spark, tmp_path, {"entries.json": json.dumps([ENTRY] * 3), "any.ndjson": lines, "profile.json": json.dumps({"store": {}})}) == {"entries": 3, "treatments": 2, "profile": 1}


def test_combined_and_zipped(spark, tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("inner/all.json", json.dumps({"entries": [ENTRY], "devicestatus": [STATUS, STATUS], "profile": {"store": {}}}))
    assert collections(spark, tmp_path, {"up.zip": out.getvalue()}) == {"entries": 1, "devicestatus": 2, "profile": 1}


def test_first_file_wins(spark, tmp_path):
    assert collections(spark, tmp_path, {"a.json": json.dumps([ENTRY]), "b.json": json.dumps([ENTRY] * 5)}) == {"entries": 1}


def test_uploads_of_patients_are_kept_apart_and_get_a_status(spark):
    docs = [(1, "a.json", "entries", json.dumps(ENTRY)), (1, "b.json", "entries", json.dumps(ENTRY)), (2, "b.json", "entries", json.dumps(ENTRY)), (2, "c.json", "profile", json.dumps({"store": {}, "units": "mmol"})), (None, "z.json", "entries", json.dumps(ENTRY))]
    got = ingest.classify(spark.createDataFrame(docs, "patient_id long, file string, part string, doc string"), upload="patient_id")
    assert sorted((r["patient_id"] or 0, r["file"]) for r in got.collect()) == [(0, "z.json"), (1, "a.json"), (2, "b.json"), (2, "c.json")]
    made = ingest.with_status(got).where("collection = 'status'").collect()
    assert [(r["patient_id"], json.loads(r["doc"])["settings"]["units"]) for r in made] == [(2, "mmol")]


def test_projection_without_text_time_and_sink(spark, tmp_path):
    (tmp_path / "r.json").write_text("\n".join(json.dumps(x) for x in ({"_id": "1", "sgv": 90, "date": 1704067200000, "type": "sgv", "direction": "Flat", "patient_id": 1}, {"_id": "2", "sgv": 126, "dateString": "2024-01-01T01:00:00+01:00", "type": "sgv", "direction": "odd", "patient_id": 2})))
    got = cohort.read_readings(spark, str(tmp_path / "r.json")).orderBy("id").collect()
    assert [(str(r["ts"]), r["sgv_mmol"], r["arrow"]) for r in got] == [("2024-01-01 00:00:00", 5.0, "→"), ("2024-01-01 00:00:00", 7.0, "?")]
    ingest.write_dataset(cohort.read_readings(spark, str(tmp_path / "r.json")), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("patient_id = 2").count() == 1


def test_log_values_are_decoded_and_what_is_no_json_stays_text(spark):
    from sweetframe.operators import settings

    rows = [(1, '{"a": 1, "b": "x", "c": null, "d": [1, 2], "e": {"f": true}, "g": 1.5}'), (2, "plain text"), (3, "[1]"), (4, None), (5, '"quoted"'), (6, "{}")]
    log = spark.createDataFrame(rows, "id long, values_json string").selectExpr("id", "timestamp '2024-01-01' as ts", "'x' as event_type", "values_json")
    got = sorted((r["id"], r["key"] or "", r["value"], r["kind"]) for r in settings.log_values(log).collect())
    assert got == [
        (1, "a", "1", "bigint"), (1, "b", "x", "string"), (1, "c", "null", "void"), (1, "d", "[1,2]", "array"), (1, "e", '{"f":true}', "object"), (1, "g", "1.5", "decimal"),
        (2, "", "plain text", "text"), (3, "", "[1]", "array"), (5, "", "quoted", "string"),
    ]
