"""The named queries over the driver's tables, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sizes import entry_size, output_files, readable_size
from ..operators import maintenance as M
from ..operators import reads as R
from ..operators.resolve import bounded, has_prefix, resolve_latest, versions, winners
from ..sources.tables import events_log, micros, read

#: A time in the middle of the events, the lower bound of the ranges, an hour, and a day, in microseconds.
MIDDLE, EARLY, HOUR, DAY = 1_705_276_800_000_000, 1_704_500_000_000_000, 3_600_000_000, 86_400_000_000
FIRST, LAST = "100", "120"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_LOG = """
WITH kvt AS (SELECT CAST(user_id AS VARCHAR) k, epoch_us(ts) ts, (event_id*7919)%1000003 seqno,
  CASE WHEN event_type='signup' AND value<0.4 THEN 1 ELSE 0 END op,
  CASE WHEN event_type='signup' AND value<0.4 THEN '' ELSE props END v, event_id, event_type, value FROM events)
"""


def _first(where: str, order: str = "ts DESC, seqno DESC", by: str = "k", more: str = "") -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) rn{more} FROM kvt WHERE {where})"


def query(sql: str | None, log: bool = True, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query with its oracle; the oracle's log is the prelude's ``kvt``."""

    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE[name or f.__name__] = (_LOG if log else "") + sql
        return f

    return add



def _kv(df: DataFrame) -> DataFrame:
    return df.select("k", "ts", "v")


@query(f"SELECT k, ts, v FROM {_first(f'ts<={MIDDLE} AND k=' + chr(39) + '42' + chr(39))} WHERE rn=1 AND op=0")
def get_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kv(R.get_point(events_log(spark, sf_dir, user=42, max_ts=MIDDLE), "42", MIDDLE, "k"))


@query(f"SELECT k, ts, v FROM {_first(f'ts<={MIDDLE}')} WHERE rn=1 AND op=0")
def snapshot_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kv(R.snapshot(events_log(spark, sf_dir, max_ts=MIDDLE), MIDDLE, key="k"))


@query(f"SELECT k, ts, v FROM {_first(f'ts<={MIDDLE}')} WHERE rn=1 AND op=0")
def snapshot_asof_row_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kv(R.snapshot(events_log(spark, sf_dir, max_ts=MIDDLE), MIDDLE, key="k", strategy="row_number"))


@query(f"SELECT k, ts, v FROM {_first(f'ts<={MIDDLE} AND seqno<=500000')} WHERE rn=1 AND op=0")
def snapshot_seqno_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kv(R.snapshot(events_log(spark, sf_dir, max_ts=MIDDLE), MIDDLE, 500_000, key="k"))


@query(f"SELECT k, ts, v FROM {_first(f'ts<={MIDDLE}', 'seqno DESC, ts DESC', more=', max(op) OVER (PARTITION BY k) gone')} WHERE rn=1 AND gone=0")
def compat_lww_seqno(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kv(resolve_latest(events_log(spark, sf_dir, max_ts=MIDDLE), MIDDLE, order="seqno", sticky_tombstones=True, key="k"))


_BOX = f"k BETWEEN '{FIRST}' AND '{LAST}' AND ts BETWEEN {EARLY} AND {MIDDLE}"


@query(f"SELECT k, ts, v FROM {_first(_BOX)} WHERE rn=1 AND op=0")
def range_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kv(R.range_latest(events_log(spark, sf_dir, min_ts=EARLY, max_ts=MIDDLE), FIRST, LAST, EARLY, MIDDLE, "k"))


@query(f"SELECT k, ts, v FROM {_first(_BOX, 'seqno DESC', 'k, ts')} WHERE rn=1 AND op=0")
def range_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kv(R.range_versions(events_log(spark, sf_dir, min_ts=EARLY, max_ts=MIDDLE), FIRST, LAST, EARLY, MIDDLE, "k"))


@query("""SELECT k, ts, v, seqno FROM kvt WHERE op=0 AND (k, ts, seqno) IN
 (SELECT k, ts, seqno FROM kvt WHERE event_type='purchase' UNION ALL SELECT k, ts+1, seqno FROM kvt WHERE event_type='click')""")
def version_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact lookups: the versions of all purchases, and of clicks a microsecond later, which aren't there."""
    log = events_log(spark, sf_dir)
    probes = log.filter("event_type = 'purchase'").select("k", "ts", "seqno").union(log.filter("event_type = 'click'").select("k", F.col("ts") + 1, "seqno"))
    return R.versions_exact(log, probes, "k").filter("op = 0").select("k", "ts", "v", "seqno")


@query(f"SELECT k, ts, v FROM {_first('starts_with(k, ' + chr(39) + '1' + chr(39) + ')')} WHERE rn=1 AND op=0 ORDER BY k LIMIT 10")
def list_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of ten keys: the limit is the operator's."""
    return _kv(R.list_prefix(events_log(spark, sf_dir), "1", 10, key="k"))


@query(f"SELECT k, ts, v FROM {_first('k>=' + chr(39) + '1' + chr(39) + ' AND k<=' + chr(39) + '2' + chr(39))} WHERE rn=1 AND op=0")
def list_prefix_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix as the inclusive range up to its successor."""
    return _kv(resolve_latest(bounded(events_log(spark, sf_dir), first_key="1", last_key="2", key="k"), key="k"))


@query(f"SELECT count(*)>10 AS has_more FROM (SELECT k FROM {_first('starts_with(k, ' + chr(39) + '1' + chr(39) + ')')} WHERE rn=1 AND op=0 LIMIT 11)")
def list_has_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.list_prefix(events_log(spark, sf_dir), "1", 11, key="k").agg((F.count(F.lit(1)) > 10).alias("has_more"))


@query(f"""SELECT p.k, p.at, p.event_id, CASE WHEN l.op=0 THEN l.ts END found_ts, CASE WHEN l.op=0 THEN l.v END found_value
FROM (SELECT k, ts+{HOUR} AS at, event_id FROM kvt WHERE event_type='purchase') p ASOF LEFT JOIN kvt l ON p.k=l.k AND p.at>=l.ts""")
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events_log(spark, sf_dir)
    probes = log.filter("event_type = 'purchase'").select("k", (F.col("ts") + HOUR).alias("at"), "event_id")
    return R.asof_join(probes, log, DAY, "k", "at", "k", "v")


@query("SELECT k, ts, v, lead_ts AS valid_to FROM (SELECT *, lead(ts) OVER (PARTITION BY k ORDER BY ts, seqno) lead_ts FROM kvt) WHERE op=0")
def validity_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.validity_intervals(events_log(spark, sf_dir), DAY, "k").select("k", "ts", "v", "valid_to")


@query(f"SELECT k, ts, v FROM {_first(f'k BETWEEN {chr(39)}{FIRST}{chr(39)} AND {chr(39)}{LAST}{chr(39)} AND ts<={MIDDLE}')} WHERE rn=1 AND op=0")
def range_union_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log in three tiers gives what the whole gives."""
    log = events_log(spark, sf_dir)
    tiers = [log.filter(F.col("event_id") % 3 == i) for i in range(3)]
    return _kv(R.range_latest(tiers[0].unionByName(tiers[1]).unionByName(tiers[2]), FIRST, LAST, 0, MIDDLE, "k"))


@query(f"SELECT k, ts, v FROM {_first('true')} WHERE rn=1 AND op=0")
def compaction_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kv(M.merge_latest(events_log(spark, sf_dir), "k"))


_DAYS = f"(SELECT k, ts//{DAY} AS d, seqno, op, v FROM kvt)"


def _by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_log(spark, sf_dir).withColumn("ts", F.expr(f"ts div {DAY}")).select("k", "ts", "seqno", "op", "v")


@query(f"SELECT k, d AS ts, arg_max(v, seqno) v, arg_max(op, seqno) op FROM {_DAYS} GROUP BY k, d")
def history_preserving_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.merge_history(_by_day(spark, sf_dir), "k").select("k", "ts", "v", "op")


@query(f"SELECT k, d AS ts, v FROM (SELECT *, row_number() OVER (PARTITION BY k, d ORDER BY seqno DESC) rn FROM {_DAYS}) WHERE rn=1 AND op=0")
def versions_day_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kv(versions(_by_day(spark, sf_dir), "k"))


def _files(spark: SparkSession, sf_dir: str, events: int) -> DataFrame:
    return M.file_stats(events_log(spark, sf_dir), F.expr(f"event_id div {events}"), "k")


def _files_sql(events: int) -> str:
    return f"(SELECT event_id//{events} AS file, min(k) smallest_key, max(k) largest_key, count(*) entry_count FROM kvt GROUP BY 1)"


@query(f"SELECT file, smallest_key, largest_key, entry_count FROM {_files_sql(1000)}")
def file_minmax_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir, 1000)


@query(f"SELECT a.file, b.file AS other FROM {_files_sql(1000)} a JOIN {_files_sql(1000)} b ON a.smallest_key<=b.largest_key AND b.smallest_key<=a.largest_key WHERE a.file<b.file")
def file_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir, 1000)
    return M.overlapping_files(files, files).filter("file < other")


@query(f"SELECT file FROM {_files_sql(50)} WHERE smallest_key<='101' AND largest_key>='101'")
def file_prune_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.files_for_key(_files(spark, sf_dir, 50), "101").select("file")


_ACTIONS = "(SELECT event_id AS version, event_id%97 AS file, CASE WHEN (event_id*7919)%1000003%3=0 THEN 'remove' ELSE 'add' END AS action, event_id%3 AS level FROM events)"


@query(f"SELECT file, version, level FROM (SELECT file, max(version) AS version, arg_max(action, version) AS action, arg_max(level, version) AS level FROM {_ACTIONS} GROUP BY file) WHERE action='add'", log=False)
def manifest_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = (F.col("event_id") * 7919) % 1_000_003 % 3
    actions = read(spark, sf_dir, "events").select(
        F.col("event_id").alias("version"), (F.col("event_id") % 97).alias("file"), F.when(number == 0, "remove").otherwise("add").alias("action"), (F.col("event_id") % 3).alias("level")
    )
    return M.replay_manifest(actions).select("file", "version", "level")


@query("""SELECT level, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes,
 CASE WHEN level=0 THEN count(*)>=4 ELSE sum(file_size) > 10485760*power(10, level-1) END AS needs_compaction
FROM (SELECT event_id%3 AS level, event_id*7919 AS file_size FROM events) GROUP BY level""", log=False)
def level_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read(spark, sf_dir, "events").select((F.col("event_id") % 3).alias("level"), (F.col("event_id") * 7919).alias("file_size"))
    return M.level_stats(files, 10 << 20, 10, 4).select("level", "files", "bytes", "needs_compaction")


@query("SELECT event_id, CAST(33+octet_length(encode(k))+octet_length(encode(v)) AS INTEGER) AS entry_size FROM kvt", name="entry_size")
def entry_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_log(spark, sf_dir).select("event_id", entry_size(F.col("k"), F.col("v")).alias("entry_size"))


@query("SELECT event_id, CAST((s-n)//65536 AS BIGINT) AS segment FROM (SELECT event_id, n, sum(n) OVER (ORDER BY event_id) s FROM (SELECT event_id, 33+octet_length(encode(k))+octet_length(encode(v)) n FROM kvt))")
def rotation_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rotation_segments(events_log(spark, sf_dir), 65_536, "event_id", key="k", value="v").select("event_id", "segment")


@query("""SELECT event_id, CASE WHEN n>=1073741824 THEN printf('%.1fGiB', n/1073741824.0::DOUBLE) WHEN n>=1048576 THEN printf('%.1fMiB', n/1048576.0::DOUBLE)
 WHEN n>=1024 THEN printf('%.1fKiB', n/1024.0::DOUBLE) ELSE CAST(n AS VARCHAR) || 'B' END AS readable_size FROM (SELECT event_id, event_id*7919 AS n FROM events)""", log=False, name="readable_size")
def readable_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", readable_size(F.col("event_id") * 7919).alias("readable_size"))


@query("SELECT event_id, CAST(greatest(1, ceil(event_id*7919/2097152.0::DOUBLE)) AS BIGINT) AS files FROM events", log=False)
def estimated_output_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", output_files(F.col("event_id") * 7919, 2 << 20).alias("files"))


@query("SELECT event_id, CASE WHEN event_id%60<=1 OR event_id*79190<67108864 THEN 0 WHEN event_id%60<=24 THEN 1 ELSE 2 END AS level FROM events", log=False)
def infer_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", M.inferred_level(F.col("event_id") * 79_190, F.col("event_id") % 60).alias("level"))


@query("SELECT count(*) AS entries, count(DISTINCT k) AS keys, min(ts) AS min_ts, max(ts) AS max_ts, max(seqno) AS max_seqno FROM kvt")
def log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_log(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("entries"), F.count_distinct("k").alias("keys"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.max("seqno").alias("max_seqno")
    )


@query(None)
def row_crc32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums of values; DuckDB has no CRC-32."""
    return events_log(spark, sf_dir).select("event_id", F.crc32(F.col("v").cast("binary")).alias("crc32"))


_ORDERS = "(SELECT CAST(o_custkey AS VARCHAR) k, epoch_us(o_orderdate) ts, o_orderkey seqno, CASE WHEN o_orderstatus='F' THEN 1 ELSE 0 END op, o_totalprice v FROM orders)"


@query(f"SELECT k, ts, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts DESC, seqno DESC) rn FROM {_ORDERS}) WHERE rn=1 AND op=0", log=False)
def orders_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest order of every customer, unless it is finished; times collide here, so the seqno decides."""
    log = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("k"), micros(F.col("o_orderdate")).alias("ts"), F.col("o_orderkey").alias("seqno"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("op"), F.col("o_totalprice").alias("v"),
    )
    return _kv(R.snapshot(log, key="k"))


@query("SELECT CAST(conv_id AS VARCHAR) AS k, turn AS ts, role AS v FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) rn FROM conversations) WHERE rn=1", log=False)
def conversations_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last turn of each conversation as the current value of a key."""
    log = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("k"), F.col("turn").alias("ts"), F.lit(0).alias("seqno"), F.lit(0).alias("op"), F.col("role").alias("v"))
    return _kv(winners(log, key="k"))


@query("SELECT url AS k, max(page_id) AS ts FROM pages WHERE starts_with(url, 'http://') GROUP BY url", log=False)
def pages_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read(spark, sf_dir, "pages").select(F.col("url").alias("k"), F.col("page_id").alias("ts"), F.col("page_id").alias("seqno"), F.lit(0).alias("op"))
    return resolve_latest(log.filter(has_prefix(F.col("k"), "http://")), key="k").select("k", "ts")
