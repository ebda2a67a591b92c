"""Read operators over a log: points, snapshots, ranges, lists, as-of joins, validity intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .resolve import bounded, has_prefix, resolve_latest, versions


def get_point(log: DataFrame, key: object, as_of: int | None = None, name: str = "key") -> DataFrame:
    """The value of one key as of a time: one row, or none."""
    return resolve_latest(log.filter(F.col(name) == F.lit(key)), as_of, key=name)


def snapshot(log: DataFrame, as_of: int | None = None, max_seqno: int | None = None, key: str = "key", strategy: str = "max_by") -> DataFrame:
    """The value of every key as of a time, by the writes up to a seqno."""
    return resolve_latest(log, as_of, max_seqno, key=key, strategy=strategy)


def range_latest(log: DataFrame, first_key: object, last_key: object, min_ts: int, max_ts: int, key: str = "key", strategy: str = "max_by") -> DataFrame:
    """The newest version of every key inside an inclusive box of keys and times."""
    return resolve_latest(bounded(log, max_ts, None, min_ts, first_key, last_key, key), key=key, strategy=strategy)


def range_versions(log: DataFrame, first_key: object, last_key: object, min_ts: int, max_ts: int, key: str = "key") -> DataFrame:
    """Every version inside the box, one for each (key, ts)."""
    return versions(bounded(log, max_ts, None, min_ts, first_key, last_key, key), key)


def version_exact(log: DataFrame, key_value: object, ts: int, seqno: int, key: str = "key") -> DataFrame:
    """The one version with this key, time and seqno."""
    return log.filter((F.col(key) == F.lit(key_value)) & (F.col("ts") == ts) & (F.col("seqno") == seqno))


def versions_exact(log: DataFrame, probes: DataFrame, key: str = "key") -> DataFrame:
    """The versions with the key, time and seqno of any of the probes (columns of the log's names)."""
    wanted = probes.select(F.col(key).alias("__k"), F.col("ts").alias("__t"), F.col("seqno").alias("__s")).distinct()
    return log.join(wanted, (F.col(key) == F.col("__k")) & (F.col("ts") == F.col("__t")) & (F.col("seqno") == F.col("__s")), "left_semi")


def list_prefix(
    log: DataFrame, prefix: str | bytes, limit: int | None = None, as_of: int | None = None, key: str = "key", keep: Column | None = None,
) -> DataFrame:
    """The latest values of the keys with a prefix, by key; with a limit, the first of them. ``keep`` chooses among the latest."""
    found = resolve_latest(log.filter(has_prefix(F.col(key), prefix)), as_of, key=key)
    found = found if keep is None else found.filter(keep)
    return found.orderBy(key).limit(limit) if limit is not None else found


def list_page(
    log: DataFrame, prefix: str | bytes, limit: int, as_of: int | None = None, after: object = None, key: str = "key", keep: Column | None = None,
) -> tuple[list, bool]:
    """The rows of a page and whether more follow; ``after`` is the last key of the page before."""
    if after is not None:
        log = log.filter(F.col(key) > F.lit(after))
    rows = list_prefix(log, prefix, limit + 1, as_of, key, keep).collect()  # limit + 1 rows
    return rows[:limit], len(rows) > limit


def _carried(events: DataFrame, key: str, at: str, width: int, order: list[str], what: str) -> DataFrame:
    """For each (key, bucket of time) the last non-null ``what`` of earlier buckets."""
    last = events.filter(F.col(what).isNotNull()).groupBy(key, "__bucket").agg(F.max_by(what, F.struct(at, *order)).alias("__last"))
    buckets = events.select(key, "__bucket").distinct().join(last, [key, "__bucket"], "left")
    earlier = Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    return buckets.select(key, "__bucket", F.last("__last", ignorenulls=True).over(earlier).alias("__carried"))


def asof_join(
    probes: DataFrame, log: DataFrame, time_bucket: int, probe_key: str = "key", probe_at: str = "at", key: str = "key", value: str = "value",
) -> DataFrame:
    """Each probe (key, at, ...) with the version of its key as of then: ``found_ts`` and ``found_value``, null
    if there is none or it is a tombstone. Bounds are inclusive.

    Probes and versions go through one window by (key, bucket of time), so a hot key is spread over its
    buckets; what a bucket inherits comes from one row for each bucket. Both steps read the same rows and
    neither makes pairs.
    """
    mine = [c for c in probes.columns if c not in (probe_key, probe_at)]
    none = F.lit(None)
    hit = F.struct(F.col("ts").alias("ts"), F.col("op").cast("int").alias("op"), F.col(value).alias("value"))
    side = log.select(F.col(key).alias("__k"), F.col("ts").alias("__at"), F.lit(0).alias("__probe"), F.col("seqno").alias("__seq"), (F.col("op_index") if "op_index" in log.columns else F.lit(0)).cast("int").alias("__op"), hit.alias("__hit"))
    for c in mine:
        side = side.withColumn(f"p_{c}", none.cast(probes.schema[c].dataType))
    asked = probes.select(F.col(probe_key).alias("__k"), F.col(probe_at).alias("__at"), F.lit(1).alias("__probe"), none.cast("long").alias("__seq"), none.cast("int").alias("__op"), *[F.col(c).alias(f"p_{c}") for c in mine])
    both = side.unionByName(asked, allowMissingColumns=True).withColumn("__bucket", F.floor(F.col("__at") / time_bucket))
    inside = Window.partitionBy("__k", "__bucket").orderBy("__at", "__probe", "__seq", "__op").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = _carried(both, "__k", "__at", time_bucket, ["__seq", "__op"], "__hit")
    now = both.withColumn("__now", F.last("__hit", ignorenulls=True).over(inside)).filter("__probe = 1")
    found = now.join(carried, ["__k", "__bucket"], "left").withColumn("__found", F.coalesce("__now", "__carried"))
    live = F.col("__found.op") == 0
    return found.select(
        F.col("__k").alias(probe_key), F.col("__at").alias(probe_at), *[F.col(f"p_{c}").alias(c) for c in mine],
        F.when(live, F.col("__found.ts")).alias("found_ts"), F.when(live, F.col("__found.value")).alias("found_value"),
    )


def validity_intervals(log: DataFrame, time_bucket: int, key: str = "key") -> DataFrame:
    """Every put with the time until which it holds (``valid_to``; null while it still does).

    A version holds until the next version of its key, put or tombstone. Like the as-of join, it works
    by buckets of time; the last version of a bucket ends where the key's next bucket begins.
    """
    rows = log.withColumn("__bucket", F.floor(F.col("ts") / time_bucket))
    order = [c for c in ("ts", "seqno", "op_index") if c in log.columns]
    inside = Window.partitionBy(key, "__bucket").orderBy(*order)
    begins = rows.groupBy(key, "__bucket").agg(F.min("ts").alias("__begins"))
    following = begins.select(key, "__bucket", F.lead("__begins").over(Window.partitionBy(key).orderBy("__bucket")).alias("__next"))
    ended = rows.withColumn("valid_to", F.lead("ts").over(inside)).join(following, [key, "__bucket"])
    return ended.withColumn("valid_to", F.coalesce("valid_to", "__next")).filter("op = 0").drop("__bucket", "__next")
