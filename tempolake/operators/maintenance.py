"""Maintenance operators: merges, segments, and statistics over files and levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizes import entry_size
from .resolve import winners


def merge_latest(log: DataFrame, key: str = "key", strategy: str = "max_by") -> DataFrame:
    """A merge that keeps the newest version of each key and drops deleted keys.

    Only right where no older version of a key is left outside the merged rows."""
    return winners(log, "ts", key, strategy).filter("op = 0")


def merge_history(log: DataFrame, key: str = "key", horizon: int | None = None) -> DataFrame:
    """A merge that keeps every (key, ts), as last written.

    A tombstone may hide a put that is yet to come, as any time may be written at any time. Only if
    nothing before ``horizon`` is written any more, and no version of these keys is left outside, do
    tombstones before it that nothing precedes go too."""
    rank = [c for c in ("seqno", "op_index") if c in log.columns]
    rest = [c for c in log.columns if c not in (key, "ts")]
    one = log.groupBy(key, "ts").agg(F.max_by(F.struct(*rest), F.struct(*rank)).alias("__r"))
    one = one.select(key, "ts", *[F.col(f"__r.{c}").alias(c) for c in rest])
    if horizon is None:
        return one
    first_put = one.filter("op = 0").groupBy(key).agg(F.min("ts").alias("__put")).withColumnRenamed(key, "__k")
    kept = one.join(first_put, F.col(key) == F.col("__k"), "left")
    return kept.filter((F.col("op") == 0) | (F.col("ts") >= horizon) | F.coalesce(F.col("ts") > F.col("__put"), F.lit(False))).drop("__k", "__put")


def rotation_segments(log: DataFrame, limit: int, order: str, group: Column | None = None, key: str = "key", value: str = "value", per_range: int = 1 << 16) -> DataFrame:
    """Numbers the segments of ``limit`` bytes that the log fills in write order (``segment``).

    The running sum comes in two steps, over ranges of the order and inside them, so no task
    orders the whole log. ``order`` is a non-negative integer without gaps to speak of."""
    sized = log.withColumn("size", entry_size(F.col(key), F.col(value)).cast("long")).withColumn("__range", F.floor(F.col(order) / per_range))
    by_range = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = sized.groupBy("__range").agg(F.sum("size").alias("__n")).select("__range", F.coalesce(F.sum("__n").over(by_range), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = sized.withColumn("__sum", F.sum("size").over(inside)).join(before, "__range")
    return summed.withColumn("running", F.col("__before") + F.col("__sum")).withColumn("segment", F.floor((F.col("running") - F.col("size")) / limit)).drop("__range", "__sum", "__before")


def file_stats(log: DataFrame, file: Column, key: str = "key") -> DataFrame:
    """Each file's smallest and largest key and number of entries."""
    return log.groupBy(file.alias("file")).agg(F.min(key).alias("smallest_key"), F.max(key).alias("largest_key"), F.count(F.lit(1)).alias("entry_count"))


def overlapping_files(a: DataFrame, b: DataFrame) -> DataFrame:
    """(file, other) of all files of a and b whose key ranges meet. Both are file catalogues, not data."""
    left = a.select(F.col("file"), F.col("smallest_key").alias("a_min"), F.col("largest_key").alias("a_max"))
    right = b.select(F.col("file").alias("other"), F.col("smallest_key").alias("b_min"), F.col("largest_key").alias("b_max"))
    return left.join(right, (F.col("a_min") <= F.col("b_max")) & (F.col("b_min") <= F.col("a_max"))).select("file", "other")


def files_for_key(files: DataFrame, key: object) -> DataFrame:
    """Files whose key range holds a key; files without statistics may."""
    within = (F.col("smallest_key") <= F.lit(key)) & (F.col("largest_key") >= F.lit(key))
    return files.filter(F.coalesce(within, F.lit(True)))


def replay_manifest(actions: DataFrame) -> DataFrame:
    """The files that stand after all (version, action, file, ...) rows: the last action of each is an add."""
    rest = [c for c in actions.columns if c != "file"]
    last = actions.groupBy("file").agg(F.max_by(F.struct(*rest), F.col("version")).alias("__r"))
    return last.select("file", *[F.col(f"__r.{c}").alias(c) for c in rest]).filter("action = 'add'")


def level_limit(level: Column, base: int, factor: int) -> Column:
    """How many bytes a level may hold; level 0 goes by its number of files."""
    return F.when(level == 0, F.lit(2**63 - 1)).otherwise((F.lit(base) * F.pow(F.lit(factor), level - 1)).cast("long"))


def level_stats(files: DataFrame, base: int, factor: int, trigger: int) -> DataFrame:
    """Each level's files, bytes, limit, and whether it needs compaction."""
    sums = files.groupBy("level").agg(F.count(F.lit(1)).alias("files"), F.sum("file_size").alias("bytes"))
    limit = level_limit(F.col("level"), base, factor)
    return sums.withColumn("limit_bytes", limit).withColumn("needs_compaction", F.when(F.col("level") == 0, F.col("files") >= trigger).otherwise(F.col("bytes") > limit))


def inferred_level(size: Column, age_hours: Column, small: int = 64 << 20) -> Column:
    """The level of a file that no manifest names: recent and small files are level 0, others go by age."""
    return F.when((age_hours <= 1) | (size < small), 0).when(age_hours <= 24, 1).otherwise(2)
