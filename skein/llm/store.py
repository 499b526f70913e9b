"""Intermediate tables in the folder that all executors share, and small helpers over DataFrames."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_KEPT: list = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir where the cluster sets it, else a folder of this process (single-machine runs)."""
    said = spark.conf.get("spark.checkpoint.dir", None)
    if not said:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        said = tempfile.mkdtemp(prefix="skein-")
        spark.conf.set("spark.checkpoint.dir", said)
        _KEPT.append((spark, said))
    return said


#: With it, the shuffle files of a query are deleted when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors.

    Nothing reads the shuffle files of the write again, so they are deleted at its end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/skein-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    _KEPT.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


#: Files of at most so many bytes are broadcast; larger tables are shuffled.
BROADCAST_BYTES = 8 << 20


def small(df: DataFrame) -> DataFrame:
    """A settled table, marked for broadcast if its files are at most BROADCAST_BYTES together."""
    paths = {p.rpartition("/")[0] for p in df.inputFiles()}
    return F.broadcast(df) if sum(_bytes(df.sparkSession, p) for p in paths) <= BROADCAST_BYTES else df


def release(df: DataFrame) -> None:
    """Delete the files of a settled table that no later plan reads."""
    for path in {p.rpartition("/")[0] for p in df.inputFiles()}:
        if "/skein-" in path:
            _delete(df.sparkSession, path)


def _bytes(spark: SparkSession, path: str) -> int:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _KEPT:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return


def named(df: DataFrame) -> list[Column]:
    """The columns of df as they are, whatever is in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def corpus(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (and more) alone, so other columns can't clash; rows without doc_id go, a null text is empty."""
    return docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
