"""Corpora from directories of text files and from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def from_directory(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, path, text) of the files below root.

    Files that aren't valid UTF-8, and everything whose name or directory below root begins with a dot, are left out;
    Spark's file sources also skip names that begin with an underscore. Ids are 0-based and follow the path compared
    name by name. Numbering is one task over the list of paths; contents don't pass through it.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    top = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri().getPath().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    full = F.regexp_replace("path", "^[a-z0-9]+:/+", "/")
    names = F.split(F.substring(full, F.lit(len(top) + 2), F.length(full)), "/")
    text = F.col("content").cast("string")
    good = files.select("path", names.alias("names"), text.alias("text")).where(F.is_valid_utf8("text") & ~F.exists("names", lambda x: x.startswith(".")))
    ids = good.select("path", (F.row_number().over(Window.orderBy("names")) - 1).cast("bigint").alias("doc_id"))
    return good.join(ids, "path").select("doc_id", F.array_join("names", "/").alias("path"), "text")


def from_table(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, path, text) of a table that has ids; rows without an id are left out, path is the id where none is given."""
    return df.where(F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias("doc_id"), F.col(path or key).cast("string").alias("path"), F.col(text).cast("string").alias("text")
    )
