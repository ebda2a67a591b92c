"""Which version of a key counts: an arg-max for each key.

The rule is: of the versions within the bounds, the one with the largest (ts, seqno, op_index); if that
is a tombstone, the key has no value. The answer hangs on the log's rows only, never on how they
are dealt over files. ``order="seqno"`` gives the last write instead, and ``sticky_tombstones`` lets any
visible tombstone hide its key.

Arg-max aggregates are combined before the shuffle, so a key with a third of all rows sends one row
from each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDERS = {"ts": ("ts", "seqno", "op_index"), "seqno": ("seqno", "op_index", "ts")}


def bounded(
    log: DataFrame, as_of: int | None = None, max_seqno: int | None = None, min_ts: int | None = None,
    first_key: object = None, last_key: object = None, key: str = "key",
) -> DataFrame:
    """Versions within inclusive bounds; every bound is a plain comparison that reaches the scan."""
    for column, low, high in (("ts", min_ts, as_of), ("seqno", None, max_seqno), (key, first_key, last_key)):
        if low is not None:
            log = log.filter(F.col(column) >= F.lit(low))
        if high is not None:
            log = log.filter(F.col(column) <= F.lit(high))
    return log


def winners(log: DataFrame, order: str = "ts", key: str = "key", strategy: str = "max_by") -> DataFrame:
    """Each key's winning row, tombstones included."""
    rank = [c for c in ORDERS[order] if c in log.columns]
    rest = [c for c in log.columns if c != key]
    if strategy == "max_by":
        best = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*rank)).alias("__r"))
        return best.select(key, *[F.col(f"__r.{c}").alias(c) for c in rest])
    if strategy == "row_number":
        first = Window.partitionBy(key).orderBy(*[F.desc(c) for c in rank])
        return log.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n").select(key, *rest)
    raise ValueError(f"no such strategy: {strategy}")


def resolve_latest(
    log: DataFrame, as_of: int | None = None, max_seqno: int | None = None, order: str = "ts", sticky_tombstones: bool = False,
    key: str = "key", strategy: str = "max_by",
) -> DataFrame:
    """The value of every key as of a time: its winning row, if that is a put."""
    seen = bounded(log, as_of, max_seqno)
    if sticky_tombstones:
        rank = [c for c in ORDERS[order] if c in log.columns]
        rest = [c for c in log.columns if c != key]
        best = seen.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*rank)).alias("__r"), F.max("op").alias("__gone"))
        return best.filter("__gone = 0").select(key, *[F.col(f"__r.{c}").alias(c) for c in rest])
    return winners(seen, order, key, strategy).filter("op = 0")


def versions(log: DataFrame, key: str = "key") -> DataFrame:
    """One row for each (key, ts): the last written, if that is a put."""
    rank = [c for c in ("seqno", "op_index") if c in log.columns]
    rest = [c for c in log.columns if c not in (key, "ts")]
    best = log.groupBy(key, "ts").agg(F.max_by(F.struct(*rest), F.struct(*rank)).alias("__r"))
    return best.select(key, "ts", *[F.col(f"__r.{c}").alias(c) for c in rest]).filter("op = 0")


def has_prefix(key: Column, prefix: str | bytes) -> Column:
    """True prefixes; an empty prefix has all keys."""
    return F.startswith(key, F.lit(prefix))


def prefix_range(prefix: bytes) -> tuple[bytes, bytes | None]:
    """[first, end) of the keys with a prefix, for pruning; no end if all bytes are 0xFF."""
    cut = prefix.rstrip(b"\xff")
    return prefix, cut[:-1] + bytes([cut[-1] + 1]) if cut else None
