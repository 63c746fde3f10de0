"""Ingestion of uploaded files into five collections, and writing them.

Files may be JSON arrays or objects, newline-delimited JSON, one object of all collections, or zip archives of these. The
bytes are unpacked row by row in workers; what a document is, is told by its file's name, else by its fields.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLLECTIONS = ("entries", "treatments", "devicestatus", "profile", "status")


def _documents(name: str, content: bytes) -> Iterator[tuple[str, str]]:
    if zipfile.is_zipfile(io.BytesIO(content)):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for inner in sorted(z.namelist()):
                if not inner.endswith("/"):
                    yield from _documents(inner, z.read(inner))
        return
    text = content.decode("utf-8", "replace")
    try:
        got = json.loads(text)
    except ValueError:
        got = []
        for line in text.splitlines():
            try:
                got.append(json.loads(line))
            except ValueError:
                continue
    if isinstance(got, dict) and any(k in COLLECTIONS and isinstance(v, (list, dict)) for k, v in got.items()):
        parts = [(k, v if isinstance(v, list) else [v]) for k, v in got.items() if k in COLLECTIONS]
    else:
        parts = [(name, got if isinstance(got, list) else [got])]
    for part, docs in parts:
        yield from ((part, json.dumps(d)) for d in docs if isinstance(d, dict))


def unpack(files: DataFrame) -> DataFrame:
    """(file, part, doc) of binary files (path, content)."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = list(_documents(path.rsplit("/", 1)[-1], bytes(content)))
                yield pd.DataFrame({"file": path, "part": [r[0] for r in rows], "doc": [r[1] for r in rows]}, columns=["file", "part", "doc"]).astype(str)

    return files.select("path", "content").mapInPandas(split, "file string, part string, doc string")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return unpack(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def collection(part: Column, doc: Column) -> Column:
    """The collection by name, else by content; null if neither tells."""
    name = F.lower(part)
    by_name = F.when(name.contains("entries") | name.contains("sgv"), "entries").when(name.contains("treatment"), "treatments").when(name.contains("devicestatus"), "devicestatus").when(name.contains("profile"), "profile").when(name.contains("status"), "status")
    has = lambda *fields: F.coalesce(*[F.get_json_object(doc, f"$.{f}") for f in fields]).isNotNull()
    by_content = F.when(has("sgv", "mbg"), "entries").when(has("eventType", "insulin", "carbs"), "treatments").when(has("openaps", "loop", "pump", "uploaderBattery"), "devicestatus").when(has("store", "defaultProfile"), "profile").when(has("apiEnabled", "settings"), "status")
    return F.coalesce(by_name, by_content)


def classify(documents: DataFrame, upload: str | None = None) -> DataFrame:
    """documents (file, part, doc, others) with their collection.

    Of an upload's files that hold the same collection the first by name wins; ``upload`` is the column that tells uploads
    apart, such as the patient; without it all files are one upload.
    """
    found = documents.withColumn("collection", collection(F.col("part"), F.col("doc"))).where("collection is not null")
    keys = [F.col(c) for c in (upload, "collection") if c]
    first = found.groupBy(*[k.alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.min("file").alias("__first"))
    same = F.col("file") == F.col("__first")
    for i, k in enumerate(keys):
        same = same & k.eqNullSafe(F.col(f"__k{i}"))
    return found.join(first, same, "left_semi")


def with_status(documents: DataFrame, upload: str = "patient_id") -> DataFrame:
    """Classified documents and, for each upload with a profile but no status, a status with the profile's units."""
    at = F.get_json_object("doc", "$.units")
    of = documents.groupBy(upload).agg(F.max(F.col("collection") == "status").alias("has"), F.max(F.col("collection") == "profile").alias("profile"), F.max(F.when(F.col("collection") == "profile", at)).alias("units"))
    made = of.where("profile and not has").select(upload, F.lit("made").alias("file"), F.lit("status").alias("part"), F.to_json(F.struct(F.lit("ok").alias("status"), F.struct(F.coalesce("units", F.lit("mg/dl")).alias("units")).alias("settings"))).alias("doc"), F.lit("status").alias("collection"))
    return documents.unionByName(made, allowMissingColumns=True)


def write_dataset(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").partitionBy("patient_id").parquet(path)
