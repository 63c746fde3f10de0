"""A pipeline over documents: language ID, near-dedup, decontamination, secret redaction and mixing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns the columns of documents;
the last returns each document as often as the mix takes it, with the number of the copy. ``run`` writes each stage's
result as Parquet into the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweetframe.llm import decontaminate, language_id, mixing, oddsketch, secrets
from sweetframe.llm._common import cut, spare
from sweetframe.llm.queries import TOKENIZERS


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language: texts with a letter in which one language has at least half the likelihood.

    Null, empty and letterless texts go; repeated rows are judged alike; columns of any name stay; an empty table stays empty.
    """
    model = language_id.fit(docs, f"{TOKENIZERS}/piece_bpe_32k.model")
    name = spare(docs.columns, "found")
    found = docs.withColumn(name, language_id.identify(spark, model, F.col("text")))
    return found.where((F.col(f"{name}.lang") != "und") & (F.col(f"{name}.score") >= 0.5)).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group: Jaccard similarity of 0.8 or more of the sets of five-word shingles.

    Multi-index hashing of SimHash prints names what differs in 4 bits at most, as in op9; bands and odd sketches name the
    similar pairs whose prints differ in more. All are confirmed on the full sets.
    """
    return oddsketch.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents; secrets in their texts, and linked weak parts, become [SECRET]; n_chars follows.

    Null and empty texts stay as they are; overlapping spans become one mark; repeated rows are redacted alike; columns of
    any name stay; an empty table stays empty.
    """
    name = spare(docs.columns, "spans")
    found = docs.withColumn(name, secrets.scan(spark, F.col("text")))
    found = found.withColumn(name, F.concat(f"{name}.strong", f"{name}.linked"))
    clean = found.withColumn("text", secrets.redacted(F.col("text"), F.col(name)))
    n_chars = F.when(F.size(name) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", n_chars).drop(name)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; __copy counts from 0."""
    return mixing.mix(docs)


STAGES = [
    ("language ID", identify_language),
    ("near-dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("secret scan", redact_secrets),
    ("mixing", mix_sources),
]

#: No SQL expresses these stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
