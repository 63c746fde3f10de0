"""Helpers shared by the operators: scratch tables in the shared folder and reading of inputs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: dict[str, str] = {}

#: The white space that ends a word in the contracts: a blank, and \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"
#: The same class for the regular expressions of Spark SQL and Python.
NOT_SPACE = "[^\\x20\\x09-\\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where that is unset (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="sweetframe-")
    return _own_dir[app]


def cut(df: DataFrame) -> DataFrame:
    """df, written as Parquet into the shared folder and read again: cuts the lineage and survives lost executors.

    The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/sweetframe-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def spare(taken: Iterable[str], name: str) -> str:
    """name, with as many ``_`` appended as it takes to differ from all names taken, in whatever case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def freed(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df with ``_`` appended to each column that has one of the names, so that results can bear them."""
    names = {n.lower() for n in names}
    own, out = list(df.columns), []
    for c in own:
        out.append(spare([*own, *out, *names], c) if c.lower() in names else c)
    return df.toDF(*out)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def bounded_batches(spark: SparkSession, rows: int = 1_500, mb: int = 6) -> None:
    """Arrow batches end by bytes too, so that a few thousand very long texts don't meet in a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))
