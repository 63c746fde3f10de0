"""Controller documents: typed columns of documents that this test makes itself, field by field."""

import json

import pytest

from sweetframe.operators import devices

#: A value for each field of what the controller decided or did.
FIELDS = {"bg": 141, "eventualBG": 117.8, "targetBG": 95.2, "tick": "-6", "variable_sens": 54, "isfMgdlForCarbs": 49.5, "sensitivityRatio": 1.21, "insulinReq": 0.37, "carbsReq": 21, "units": 0.15, "reason": "minimum reached", "runningDynamicIsf": False, "algorithm": "auto"}
COLUMNS = dict(zip(FIELDS, ("current_bg", "eventual_bg", "target_bg", "tick", "variable_sens", "isf_for_carbs", "sensitivity_ratio", "insulin_required", "carbs_required", "smb_units", "reason", "dynamic_isf", "algorithm"), strict=True))


def table(spark, docs):
    rows = [(1, name, doc if doc is None or isinstance(doc, str) else json.dumps(doc)) for name, doc in docs.items()]
    return devices.typed(spark.createDataFrame(rows, "patient_id long, id string, doc string").selectExpr("*", "timestamp '2024-07-09' as ts"))


def states(spark, docs):
    return {r["id"]: r.asDict() for r in devices.algorithm_state(table(spark, docs)).collect()}


def summaries(spark, docs):
    return {r["id"]: r.asDict() for r in devices.devicestatus_summary(table(spark, docs)).collect()}


@pytest.mark.parametrize("place", [("openaps", "suggested"), ("loop", "recommended"), ("openaps", "enacted"), ("loop", "enacted")])
def test_each_field_alone_makes_a_state(spark, place):
    docs = {field: {place[0]: {place[1]: {field: value}}} for field, value in FIELDS.items()}
    got = states(spark, docs)
    assert set(got) == set(FIELDS)
    for field, value in FIELDS.items():
        want = int(value) if field in ("bg", "eventualBG", "targetBG") else value
        assert {k: v for k, v in got[field].items() if k in COLUMNS.values() and v is not None} == {COLUMNS[field]: want}


def test_state_is_of_one_struct_and_null_fields_count_as_fields(spark):
    got = states(spark, {
        "only a reason": {"openaps": {"suggested": {"reason": "wait"}, "enacted": {"variable_sens": 63, "bg": 99}}},
        "a null field": {"openaps": {"suggested": {"tick": None}, "enacted": {"bg": 88}}},
        "other fields": {"openaps": {"suggested": {"COB": 3, "sens": 2.1}, "enacted": {"bg": 77, "sens": 1.7}}},
        "empty": {"openaps": {"suggested": {}, "enacted": {}}, "loop": {"recommended": {"carbsReq": 30}}},
        "wrong types": {"openaps": {"suggested": {"bg": "120", "tick": 4, "runningDynamicIsf": 1, "algorithm": True}}},
        "not an object": {"openaps": {"suggested": "text", "enacted": [1]}},
        "nothing": {"pump": {"reservoir": 9}},
    })
    of = lambda name: {k: v for k, v in got[name].items() if v is not None and k not in ("patient_id", "id", "ts", "effective_isf_mmol", "eventual_mmol")}
    assert set(got) == {"only a reason", "a null field", "other fields", "empty", "wrong types"}
    assert of("only a reason") == {"reason": "wait"} and of("a null field") == {} and of("wrong types") == {}
    assert of("other fields") == {"current_bg": 77, "sens": 1.7} and of("empty") == {"carbs_required": 30}


def test_blob_of_insulin_on_board_is_taken_whole(spark):
    got = summaries(spark, {
        "whole": {"openaps": {"iob": {"basaliob": 0.35}}, "pump": {"iob": 4.4}},
        "past an empty one": {"openaps": {"iob": {}}, "loop": {"iob": {"iob": 2.6, "activity": 0.03}}, "pump": {"iob": 4.4}},
        "past zero": {"openaps": {"iob": 0}, "loop": {"iob": None}, "pump": {"iob": {"iob": 1.9}}},
        "zero at last": {"pump": {"iob": 0}},
        "a number": {"openaps": {"iob": 3.3}, "loop": {"iob": {"iob": 5}}},
        "text": {"openaps": {"iob": "6.1"}, "pump": {"iob": 4.4}},
        "a list": {"openaps": {"iob": [2]}, "pump": {"iob": 4.4}},
    })
    assert {k: (r["iob"], r["basal_iob"], r["insulin_activity"]) for k, r in got.items()} == {
        "whole": (None, 0.35, None), "past an empty one": (2.6, None, 0.03), "past zero": (1.9, None, None), "zero at last": (0, None, None), "a number": (3.3, None, None), "text": (None, None, None), "a list": (None, None, None),
    }


def test_leaves_of_pump_and_phone_each_from_its_place(spark):
    places = {
        "device": "device", "pump.battery.percent": "pump_battery", "pump.battery.voltage": "pump_voltage", "pump.reservoir": "reservoir", "pump.status.status": "pump_status", "pump.extended.ActiveProfile": "active_profile",
        "pump.extended.BaseBasalRate": "base_basal", "pump.extended.LastBolus": "last_bolus_at", "pump.extended.LastBolusAmount": "last_bolus", "pump.extended.TempBasalAbsoluteRate": "temp_basal", "pump.extended.TempBasalStart": "temp_basal_start",
        "pump.extended.Version": "version", "uploaderBattery": "uploader_battery", "uploader.battery": "uploader_battery", "isCharging": "is_charging", "openaps.enacted.rate": "enacted_rate", "openaps.enacted.duration": "enacted_minutes",
        "loop.enacted.minutesRemaining": "enacted_minutes_left", "loop.cob.cob": "cob", "openaps.suggested.COB": "cob", "loop.recommended.targetBG": "target_bg", "openaps.suggested.reason": "reason",
    }
    texts = {"device", "pump_status", "active_profile", "last_bolus_at", "temp_basal_start", "version", "reason"}
    docs, want = {}, {}
    for n, (path, column) in enumerate(places.items(), 2):
        value = True if column == "is_charging" else f"text {n}" if column in texts else n * 1.5
        doc = value
        for step in reversed(path.split(".")):
            doc = {step: doc}
        docs[path], want[path] = doc, {column: value}
    got = summaries(spark, docs)
    assert {k: {c: v for c, v in r.items() if v is not None and c not in ("patient_id", "id", "ts")} for k, r in got.items()} == want


def test_broken_and_absent_documents_have_no_fields(spark):
    docs = table(spark, {"broken": "{", "null": None, "list": "[1]", "number": "7"})
    for r in devices.devicestatus_summary(docs).collect():
        assert {k for k, v in r.asDict().items() if v is not None} == {"patient_id", "id", "ts"}
    assert devices.algorithm_state(docs).count() == devices.bg_predictions(docs).count() == 0


def test_long_reason_is_cut_in_the_summary_only(spark):
    docs = {"x": {"openaps": {"suggested": {"reason": "z" * 500}}}}
    assert len(summaries(spark, docs)["x"]["reason"]) == 200 and len(states(spark, docs)["x"]["reason"]) == 500


def test_predictions_of_decision_else_action(spark):
    docs = table(spark, {
        "decided": {"openaps": {"suggested": {"predBGs": {"ZT": [61, 62], "IOB": [70]}}, "enacted": {"predBGs": {"COB": [1]}}}},
        "done": {"loop": {"recommended": {"predBGs": {"UAM": []}}, "enacted": {"predBGs": {"UAM": [103, 102, 101]}}}},
        "none": {"openaps": {"suggested": {"predBGs": {"other": [5]}}}},
    })
    got = sorted((r["id"], r["trajectory"], r["minutes"], r["last_bg"]) for r in devices.bg_predictions(docs).collect())
    assert got == [("decided", "IOB", 5, 70), ("decided", "ZT", 10, 62), ("done", "UAM", 15, 101)]


def test_source_of_the_latest_is_whose_document_it_is(spark):
    for doc, source in (({"openaps": {"suggested": {"COB": 1}}, "pump": {"iob": 2}}, "openaps"), ({"openaps": {}, "loop": {"iob": 1}}, "loop"), ({"pump": {"iob": 1}}, "pump"), ({"pump": {}}, "unavailable")):
        assert devices.iob_cob_latest(table(spark, {"x": doc})).first()["source"] == source


def test_projections_of_stored_documents_read_their_columns_only(spark, tmp_path):
    table(spark, {"x": {"openaps": {"suggested": FIELDS}}}).write.parquet(f"{tmp_path}/documents")
    stored = spark.read.parquet(f"{tmp_path}/documents")
    for project in (devices.devicestatus_flat, devices.algorithm_state, devices.bg_predictions, devices.iob_cob_latest, devices.device_status_best):
        plan = project(stored)._jdf.queryExecution().executedPlan().toString()
        assert "parse_json" not in plan.lower() and "variant" not in plan.lower()
    read = devices.bg_predictions(stored)._jdf.queryExecution().executedPlan().toString().split("ReadSchema: ")[1].split("\n")[0]
    assert "predictions" in read and "reservoir" not in read and "state" not in read


def test_named_columns_equal_those_of_the_whole_document_and_read_no_other_leaves(spark):
    from sweetframe.operators import devices
    from sweetframe.sources import cohort

    docs = cohort.devicestatus_shapes(spark, "/root/testdata/sf0.001")
    columns, state = ("iob", "cob", "source", "state", "suggested_sens", "openaps_iob"), ("eventual_bg", "variable_sens", "carbs_required")
    some = devices.typed(docs, columns=columns, state=state)
    whole = devices.typed(docs).select("patient_id", "id", "ts", *[c for c in columns if c != "state"], "state")
    want = {r["id"]: (*[r[c] for c in columns if c != "state"], r["state"] and tuple(r["state"][k] for k in state)) for r in whole.collect()}
    got = {r["id"]: (*[r[c] for c in columns if c != "state"], r["state"] and tuple(r["state"][k] for k in state)) for r in some.collect()}
    assert got == want and len(want) > 50 and {x[-1] is None for x in want.values()} == {True, False}
    assert some.columns == ["patient_id", "id", "ts", *columns]
    assert "$.predBGs" not in (plan := some._jdf.queryExecution().optimizedPlan().toString()) and "$.pump.extended.ActiveProfile" not in plan
