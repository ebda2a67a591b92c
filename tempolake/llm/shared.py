"""Small things that the operators of this package share."""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six byte values that separate words, as a Java character class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hidden(columns: list[str]) -> list[Column]:
    """The columns as r_0, r_1, ..., names that no operator uses for its own."""
    return [F.col(f"`{c}`").alias(f"r_{i}") for i, c in enumerate(columns)]


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Where the session names none, Spark's warehouse folder serves on one machine (tests);
    on a cluster it may be a folder of the driver's own, so that is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/tempolake-{uuid.uuid4().hex}"


def remove(spark: SparkSession, name: str) -> None:
    """Removes a file or folder on any file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def remove_old(spark: SparkSession, hours: float = 72.0) -> int:
    """Removes tables of steps that are older than so many hours, and says how many.

    A result reads some of its steps' tables when it is used, so an operator can't remove them itself. Call
    this when no result of that age is in use any more."""
    base = os.path.dirname(shared_dir(spark))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return 0
    before = (time.time() - hours * 3600) * 1000
    old = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("tempolake-") and s.getModificationTime() < before]
    for p in old:
        fs.delete(p, True)
    return len(old)


def stored(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts the lineage
    so that a lost executor costs no recomputation, and steps run once."""
    path = shared_dir(df.sparkSession)
    schema = df.schema
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def apart(df: DataFrame, *columns: str) -> DataFrame:
    """Deals an aggregate out by other columns than a join's, so that the join gets a shuffle of its own
    on both sides; adaptive execution can only split hot keys of such joins."""
    return df.repartition(*columns)


def drop_stored(df: DataFrame) -> None:
    """Removes a table that ``stored`` wrote."""
    for name in {os.path.dirname(f) for f in df.inputFiles()}:
        remove(df.sparkSession, name)
