"""Tables of other shapes as logs."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Write order is a bijection of the event's number, so it differs from the order in time.
SCATTER, MODULUS = 7919, 1_000_003


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """A timestamp without zone as microseconds since 1970, whatever the session's zone."""
    epoch = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    return F.timestamp_diff("MICROSECOND", epoch, ts)


def _at(us: int) -> Column:
    """A time in microseconds since 1970 as a literal timestamp without zone, which the scan can compare."""
    return F.lit(datetime(1970, 1, 1) + timedelta(microseconds=us)).cast("timestamp_ntz")


def events_log(spark: SparkSession, sf_dir: str, user: int | None = None, min_ts: int | None = None, max_ts: int | None = None) -> DataFrame:
    """The events as a log with string keys: (k, ts, seqno, op, v) and the event's own columns.

    Keys and times are computed from the table's columns, so bounds on them don't reach the scan; a user and times that
    are given here do, as filters on the columns themselves."""
    rows = read(spark, sf_dir, "events")
    if user is not None:
        rows = rows.filter(F.col("user_id") == user)
    if min_ts is not None:
        rows = rows.filter(F.col("ts") >= _at(min_ts))
    if max_ts is not None:
        rows = rows.filter(F.col("ts") <= _at(max_ts))
    gone = (F.col("event_type") == "signup") & (F.col("value") < 0.4)
    return rows.select(
        F.col("user_id").cast("string").alias("k"), micros(F.col("ts")).alias("ts"), ((F.col("event_id") * SCATTER) % MODULUS).alias("seqno"),
        F.when(gone, 1).otherwise(0).alias("op"), F.when(gone, F.lit("")).otherwise(F.col("props")).alias("v"), "event_id", "event_type", "value",
    )
