"""Schemas of the index tables, how they are stored, and where tables that a query needs for itself lie."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_long, _int, _str = T.LongType(), T.IntegerType(), T.StringType()

SCHEMAS = {
    "docs": T.StructType([T.StructField("doc_id", _long), T.StructField("path", _str), T.StructField("length", _int)]),
    "postings": T.StructType([T.StructField("term", _str), T.StructField("doc_id", _long), T.StructField("tf", _long), T.StructField("positions", T.ArrayType(_int))]),
    "vocab": T.StructType([T.StructField("term_id", _long), T.StructField("term", _str), T.StructField("df", _long)]),
    "trigrams": T.StructType([T.StructField("trigram", _str), T.StructField("term", _str)]),
    "stats": T.StructType([T.StructField("n", _long), T.StructField("avgdl", T.DoubleType())]),
}


def save(name: str, df: DataFrame, base: str) -> DataFrame:
    """One table as Parquet under base, read back; postings, trigrams and vocabulary sorted by their key, so that pages of other keys are skipped.

    Trigrams and vocabulary lie by range of the key; postings by its hash, for ranges would take a second look at the texts.
    """
    if name == "postings":
        df = df.repartition("term").sortWithinPartitions("term", "doc_id")
    elif name == "trigrams":
        df = df.repartitionByRange("trigram").sortWithinPartitions("trigram", "term")
    elif name == "vocab":
        df = df.repartitionByRange("term").sortWithinPartitions("term")
    df.write.mode("overwrite").parquet(f"{base}/{name}")
    return df.sparkSession.read.schema(SCHEMAS[name]).parquet(f"{base}/{name}")


def settle(df: DataFrame, path: str | None = None) -> DataFrame:
    """df written as Parquet and read back, in a new shared folder if no other is said, so that its plan runs once however often it is read."""
    path = path or shared_dir(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def load(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).parquet(f"{base}/{name}") for name, schema in SCHEMAS.items()}


_MADE: list = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir where the cluster sets it, else of this process (single-machine runs); deleted at exit."""
    said = spark.conf.get("spark.checkpoint.dir", None)
    if not said:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        said = tempfile.mkdtemp(prefix="skein-")
        spark.conf.set("spark.checkpoint.dir", said)
        _MADE.append((spark, said))
    path = f"{said.rstrip('/')}/skein-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _MADE:
        try:
            if spark.sparkContext._jsc is not None:
                delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return
