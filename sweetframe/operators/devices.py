"""Controller documents: parsed once into a table of typed columns, which all projections then read.

``typed`` is the only function that sees JSON. It reads each document as a variant, picks the structs that count (of several
places the first that holds something), takes each leaf once and keeps it where it has the type that is asked for: text that
looks like a number is none. Stored as Parquet at ingestion, a projection of a few fields reads those columns only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sweetframe.functions.scalars import mmol

_NUMBER = "^(BIGINT|DOUBLE|FLOAT|INT|SMALLINT|TINYINT|DECIMAL)"
TRAJECTORIES = ("IOB", "COB", "UAM", "ZT")

#: The leaves of a document by column, from its root v, what was decided d, what was done e, or the blob of insulin on board b.
NUMBERS = {
    "basal_iob": "b.basaliob", "insulin_activity": "b.activity", "decided_cob": "d.COB", "loop_cob": "v.loop.cob.cob",
    "enacted_rate": "e.rate", "enacted_minutes": "e.duration", "enacted_minutes_left": "e.minutesRemaining",
    "pump_battery": "v.pump.battery.percent", "pump_voltage": "v.pump.battery.voltage", "reservoir": "v.pump.reservoir", "base_basal": "v.pump.extended.BaseBasalRate",
    "last_bolus": "v.pump.extended.LastBolusAmount", "temp_basal": "v.pump.extended.TempBasalAbsoluteRate", "phone_battery": "v.uploaderBattery", "old_phone_battery": "v.uploader.battery",
    "blob_iob": "b.iob", "blob_number": "b",
}
TEXTS = {
    "device": "v.device", "pump_status": "v.pump.status.status", "active_profile": "v.pump.extended.ActiveProfile", "last_bolus_at": "v.pump.extended.LastBolus",
    "temp_basal_start": "v.pump.extended.TempBasalStart", "version": "v.pump.extended.Version",
}
#: Fields of what was decided or done that say how the controller worked. Any of them makes a state.
STATE_NUMBERS = {
    "current_bg": "bg", "eventual_bg": "eventualBG", "target_bg": "targetBG", "variable_sens": "variable_sens", "isf_for_carbs": "isfMgdlForCarbs",
    "sensitivity_ratio": "sensitivityRatio", "insulin_required": "insulinReq", "carbs_required": "carbsReq", "smb_units": "units",
}
STATE_TEXTS = {"algorithm": "algorithm", "tick": "tick", "reason": "reason"}
STATE_FLAGS = {"dynamic_isf": "runningDynamicIsf"}
_WHOLE = ("current_bg", "eventual_bg", "target_bg")


def _leaf(path: str) -> Column:
    root, _, rest = path.partition(".")
    return F.try_variant_get(root, f"$.{rest}" if rest else "$", "variant")


def _leaves(paths: dict[str, str], kind: str) -> Column:
    """struct of the leaves that have the type; one expression for all, so that generated code stays small."""
    shape = {"double": _NUMBER, "string": "^STRING", "boolean": "^BOOLEAN"}[kind]
    values = F.transform(F.array(*[_leaf(p) for p in paths.values()]), lambda x: F.when(F.regexp_like(F.schema_of_variant(x), F.lit(shape)), F.try_variant_get(x, "$", kind)))
    return F.transform(F.array(values), lambda found: F.struct(*[found[i].alias(name) for i, name in enumerate(paths)]))[0]


def _holds(x: Column) -> Column:
    """Whether a variant is something: neither null nor an empty object, list or text, zero or false."""
    shape = F.schema_of_variant(x)
    empty = shape.isin("VOID", "OBJECT<>", "ARRAY<VOID>") | ((shape == "STRING") & (F.try_variant_get(x, "$", "string") == "")) | ((shape == "BOOLEAN") & ~F.try_variant_get(x, "$", "boolean"))
    zero = F.regexp_like(shape, F.lit(_NUMBER)) & (F.try_variant_get(x, "$", "double") == 0)
    return F.coalesce(~(empty | zero), F.lit(False))


def _first(keep: Column, *paths: str) -> Column:
    """The first of the paths whose value passes keep, a condition on ``x``; evaluated once for all."""
    return F.get(F.filter(F.array(*[_leaf(p) for p in paths]), lambda x: keep(x)), F.lit(0))


def _object(x: Column) -> Column:
    shape = F.schema_of_variant(x)
    return F.coalesce(shape.startswith("OBJECT<") & (shape != "OBJECT<>"), F.lit(False))


def _state(part: str, kept: tuple[str, ...]) -> Column:
    """struct of the state's fields that are kept; null where the part has none of all its fields, not even as null."""
    names = STATE_NUMBERS | STATE_TEXTS | STATE_FLAGS
    has = F.size(F.array_compact(F.array(*[_leaf(f"{part}.{x}") for x in names.values()]))) > 0
    of = {"double": STATE_NUMBERS, "string": STATE_TEXTS, "boolean": STATE_FLAGS}
    own = {kind: {k: f"{part}.{p}" for k, p in paths.items() if k in kept} for kind, paths in of.items()}
    more = [_leaves({"sens": f"{part}.sens"}, "double").alias("more")] if "sens" in kept else []
    return F.when(has, F.struct(*[_leaves(paths, kind).alias(kind) for kind, paths in own.items() if paths], *more))


#: All fields of a state, in its order.
STATE = (*STATE_NUMBERS, *STATE_TEXTS, *STATE_FLAGS, "sens")
_MADE_OF = {"iob": ("blob_iob", "blob_number"), "cob": ("decided_cob", "loop_cob"), "uploader_battery": ("phone_battery", "old_phone_battery")}


def typed(devicestatus: DataFrame, columns: tuple[str, ...] | None = None, state: tuple[str, ...] = STATE) -> DataFrame:
    """(patient_id, id, ts, ...) documents with all their fields as typed columns; nulls where they aren't JSON.

    The blob of insulin on board is that of openaps, else of loop, if it holds something, else the pump's, whole. The state
    comes from what was decided, or from what was done if that has no field of it. Where columns or the state's fields are
    named, no other leaves are read.
    """
    numbers = NUMBERS if columns is None else {k: NUMBERS[k] for c in columns for k in _MADE_OF.get(c, (c,)) if k in NUMBERS}
    blob = F.coalesce(_first(_holds, "v.openaps.iob", "v.loop.iob"), _leaf("v.pump.iob"))
    rows = devicestatus.select("patient_id", "id", "ts", F.try_parse_json("doc").alias("v"))
    rows = rows.select("*", _first(_object, "v.openaps.suggested", "v.loop.recommended").alias("d"), _first(_object, "v.openaps.enacted", "v.loop.enacted").alias("e"), blob.alias("b"))
    predictions = lambda part: F.filter(F.array(*[F.struct(F.lit(k).alias("trajectory"), F.try_variant_get(part, f"$.predBGs.{k}", "array<int>").alias("values")) for k in TRAJECTORIES]), lambda x: F.size(x["values"]) > 0)
    of_part = lambda made: F.coalesce(made("d", state), made("e", state))
    there = lambda *paths: F.size(F.filter(F.array(*[_leaf(p) for p in paths]), _holds)) > 0
    rows = rows.select(
        "patient_id", "id", "ts", _leaves(numbers or NUMBERS, "double").alias("n"), _leaves(TEXTS, "string").alias("t"), _leaves({"is_charging": "v.isCharging"}, "boolean").alias("f"), of_part(_state).alias("s"),
        _leaves({k: f"d.{STATE_NUMBERS[k]}" for k in ("eventual_bg", "target_bg")}, "double").alias("d_n"), _leaves({"reason": "d.reason"}, "string").alias("d_t"), predictions("d").alias("p_d"), predictions("e").alias("p_e"),
        F.when(there("v.openaps"), "openaps").when(there("v.loop"), "loop").otherwise("pump").alias("source"), F.transform(F.array(_leaf("v.openaps.suggested"), _leaf("v.openaps.iob"), _leaf("v.loop"), _leaf("v.pump")), lambda x: x.isNotNull()).alias("has"),
        _leaves({"suggested_variable": "v.openaps.suggested.variable_sens", "suggested_sens": "v.openaps.suggested.sens", "suggested_cob": "v.openaps.suggested.COB", "suggested_eventual": "v.openaps.suggested.eventualBG", "openaps_iob": "v.openaps.iob.iob"}, "double").alias("c"),
    )
    whole = lambda c: F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)).cast("double")
    fields = [(whole(F.col(f"s.double.{k}")) if k in _WHOLE else F.col(f"s.double.{k}")).alias(k) for k in STATE_NUMBERS if k in state] + [F.col(f"s.string.{k}").alias(k) for k in STATE_TEXTS if k in state] + [F.col(f"s.boolean.{k}").alias(k) for k in STATE_FLAGS if k in state]
    fields += [F.col("s.more.sens").alias("sens")] if "sens" in state else []
    kept = [k for k in NUMBERS if k not in ("decided_cob", "loop_cob", "phone_battery", "old_phone_battery", "blob_iob", "blob_number")]
    every = {k: F.col(f"t.{k}") for k in TEXTS} | {"iob": F.coalesce("n.blob_iob", "n.blob_number"), "cob": F.coalesce("n.decided_cob", "n.loop_cob")} | {k: F.col(f"n.{k}") for k in kept}
    every |= {"uploader_battery": F.coalesce("n.phone_battery", "n.old_phone_battery"), "is_charging": F.col("f.is_charging"), "decided_eventual_bg": F.col("d_n.eventual_bg"), "decided_target_bg": F.col("d_n.target_bg"), "decided_reason": F.substring("d_t.reason", 1, 200)}
    every |= {"state": F.when(F.col("s").isNotNull(), F.struct(*fields)), "predictions": F.when(F.size("p_d") > 0, F.col("p_d")).otherwise(F.col("p_e")), "source": F.col("source")}
    every |= {"has_loop": F.col("has")[0] | F.col("has")[1] | F.col("has")[2], "has_pump": F.col("has")[3]}
    every |= {k: F.col(f"c.{k}") for k in ("suggested_variable", "suggested_sens", "suggested_cob", "suggested_eventual", "openaps_iob")}
    return rows.select("patient_id", "id", "ts", *[every[k].alias(k) for k in columns or every])


def devicestatus_flat(documents: DataFrame) -> DataFrame:
    """One flat row for each typed document: openaps before loop before pump."""
    return devicestatus_summary(documents).select("patient_id", "id", "ts", "iob", "cob", "eventual_bg", "target_bg", "reason", "enacted_rate", "pump_battery", "reservoir", "uploader_battery", "is_charging")


def devicestatus_summary(documents: DataFrame) -> DataFrame:
    """One flat row for each typed document, with the state of controller, pump and phone."""
    own = ("device", "iob", "basal_iob", "insulin_activity", "cob")
    rest = ("enacted_rate", "enacted_minutes", "enacted_minutes_left", "pump_battery", "pump_voltage", "reservoir", "pump_status", "active_profile", "base_basal", "last_bolus_at", "last_bolus", "temp_basal", "temp_basal_start", "version", "uploader_battery", "is_charging")
    decided = [F.col(f"decided_{k}").alias(k) for k in ("eventual_bg", "target_bg", "reason")]
    return documents.select("patient_id", "id", "ts", *own, *decided, *rest)


def algorithm_state(documents: DataFrame) -> DataFrame:
    """What the controller worked with, of typed documents that say so; all of it from one struct."""
    got = documents.where("state is not null").select("patient_id", "id", "ts", "state.*")
    return got.withColumn("effective_isf_mmol", mmol(F.col("variable_sens"))).withColumn("eventual_mmol", mmol(F.col("eventual_bg")))


def bg_predictions(documents: DataFrame) -> DataFrame:
    """Each predicted trajectory of what was decided, or else of what was done: its length in minutes and its last value."""
    rows = documents.select("patient_id", "id", "ts", F.explode("predictions").alias("x"))
    return rows.select("patient_id", "id", "ts", "x.trajectory", (F.size("x.values") * 5).alias("minutes"), F.element_at("x.values", -1).alias("last_bg"))


def _newest(rows: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("patient_id").orderBy(F.desc("ts"), F.desc("id"))
    return rows.withColumn("age", F.row_number().over(w)).where(F.col("age") <= n)


def iob_cob_latest(documents: DataFrame) -> DataFrame:
    """The newest of the last five typed documents that has insulin or carbs on board, and whose it is."""
    rows = _newest(documents.select("patient_id", "id", "ts", "iob", "cob", "source"), 5)
    newest = F.min_by(F.struct("ts", "iob", "cob", "source"), F.when(F.col("iob").isNotNull() | F.col("cob").isNotNull(), F.col("age")))
    best = rows.groupBy("patient_id").agg(newest.alias("b"))
    return best.select("patient_id", "b.ts", "b.iob", "b.cob", F.coalesce("b.source", F.lit("unavailable")).alias("source"))


def device_status_best(documents: DataFrame) -> DataFrame:
    """Of the last ten typed documents: the newest with loop data, else with pump data, else the newest."""
    tier = F.when(F.col("has_loop"), 0).when(F.col("has_pump"), 1).otherwise(2)
    rows = _newest(documents.select("patient_id", "id", "ts", tier.alias("tier")), 10)
    w = Window.partitionBy("patient_id").orderBy("tier", "age")
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").select("patient_id", "id", "ts", "tier")


def sensitivity(documents: DataFrame, units_mmol: bool = True) -> DataFrame:
    """(patient_id, id, ts, sens_mmol, iob, cob, eventual_bg): the controller's sensitivity, variable_sens before sens.

    variable_sens is in mg/dL; sens in the profile's units. Only positive numbers count.
    """
    variable, fixed = F.col("suggested_variable"), F.col("suggested_sens")
    sens = F.coalesce(F.when(variable > 0, mmol(variable)), F.when(fixed > 0, fixed if units_mmol else mmol(fixed)))
    return documents.select("patient_id", "id", "ts", sens.alias("sens_mmol"), F.col("openaps_iob").alias("iob"), F.col("suggested_cob").alias("cob"), F.col("suggested_eventual").alias("eventual_bg"))
