"""A versioned key/value store on Parquet files behind an atomically committed manifest.

There is one write path: a table of puts and tombstones becomes sorted files and one commit. Single writes are tables
of a row or a few, and durable when the call returns. A read takes the newest manifest version of its time, other writers'
commits included, picks files by key range and time from the manifest, and is a DataFrame over them.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import (
    LOG, CommitConflict, EncodingError, InvalidKey, InvalidLimit, InvalidTimestamp, KeyNotFound, StoreError, WriteBatch, MAX_KEY_BYTES,
    as_bytes, check_key, check_limit, check_ts,
)
from .operators import maintenance, reads
from .operators.resolve import bounded, prefix_range, resolve_latest
from .operators.maintenance import inferred_level
from .plans.compaction import CompactionOptions, Job, is_bottom, pick
from .plans.manifest import DataFile, Manifest, Version


@dataclass(frozen=True)
class Options:
    compaction: CompactionOptions = field(default_factory=CompactionOptions)
    #: "history" keeps all versions in a compaction, "latest" the newest of each key only.
    retention: str = "history"
    #: No version of a time before this is written any more, so compaction may forget old tombstones.
    horizon: int | None = None


class Store:
    """Opens or creates the store at a path that Spark's file systems can reach."""

    def __init__(self, spark: SparkSession, path: str, options: Options | None = None):
        if options is not None and options.retention not in ("history", "latest"):
            raise ValueError(f"no such retention: {options.retention}")
        self.spark, self.path, self.options = spark, path.rstrip("/"), options or Options()
        self.manifest = Manifest(spark, self.path)
        self._lock = threading.RLock()
        self.closed = False
        if self.manifest.latest() == 0 and self.manifest.files.status("data"):
            self.rebuild()
        self.version = self.manifest.at()

    @classmethod
    def open(cls, spark: SparkSession, path: str, options: Options | None = None) -> Store:
        return cls(spark, path, options)

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # writes

    def put(self, key: str | bytes, value: str | bytes, ts: int) -> int:
        return self.write_batch(WriteBatch().put(key, value, ts))

    def delete(self, key: str | bytes, ts: int) -> int:
        return self.write_batch(WriteBatch().delete(key, ts))

    def write_batch(self, batch: WriteBatch) -> int:
        """Writes all operations of a batch at once, or none; returns their seqno (0 for an empty batch)."""
        self._open()
        if not len(batch):
            return 0
        rows = [(bytearray(k), ts, i, op, bytearray(v)) for i, (k, ts, op, v) in enumerate(batch)]
        return self._add(self.spark.createDataFrame(rows, "key binary, ts long, op_index int, op byte, value binary"), 1, None)

    def append(self, rows: DataFrame, files: int | None = None, stream: tuple[str, int] | None = None) -> Version:
        """Adds a table of puts and tombstones (key, ts, value and, if there, op and op_index) as one commit of one seqno.

        The rows are range-partitioned by key and time and sorted, so a file covers few keys, and a hot key is
        spread over files by time. Without ``files``, Spark chooses how many. Bad keys or times are refused as a whole.
        ``stream`` names a stream's batch: the commit holds its number, and a batch that is in the store already adds nothing."""
        self._open()
        for c, d in (("op", F.lit(0)), ("op_index", F.lit(0))):
            rows = rows if c in rows.columns else rows.withColumn(c, d)
        op = F.col("op").cast("byte")
        table = rows.select(
            F.col("key").cast("binary").alias("key"), F.col("ts").cast("long").alias("ts"), F.col("op_index").cast("int").alias("op_index"), op.alias("op"),
            F.when(op == 1, F.lit(b"")).otherwise(F.col("value").cast("binary")).alias("value"),
        )
        wrong = lambda c, m: F.when(c, F.raise_error(F.lit(m)).cast("boolean")).otherwise(F.lit(True))
        table = table.filter(wrong(F.col("key").isNull() | (F.octet_length("key") > MAX_KEY_BYTES), "key")).filter(wrong(F.col("ts").isNull() | (F.col("ts") < 0), "ts")).filter(
            wrong(~F.coalesce(F.col("op").isin(0, 1), F.lit(False)) | F.col("value").isNull(), "op or value")
        )
        self._add(table, files, stream)
        return self.version

    def _add(self, table: DataFrame, files: int | None, stream: tuple[str, int] | None) -> int:
        """One commit of one seqno. The seqno is reserved by a commit of its own, so no two writers share one, and
        a commit that another writer forestalls is tried again without writing the rows again."""
        with self._lock:
            if stream is not None and self.refresh().streams.get(stream[0], -1) >= stream[1]:
                return 0
            while True:
                seqno = self.refresh().next_seqno
                if self._commit(next_seqno=seqno + 1):
                    break
            made = self._write(table.withColumn("seqno", F.lit(seqno).cast("long")), 0, files)
            while not self._commit(add=made, stream=stream):
                if stream is not None and self.version.streams.get(stream[0], -1) >= stream[1]:
                    return 0
            return seqno

    def close(self) -> None:
        """Compacts once if a level asks for it."""
        if not self.closed:
            self.compact_once()
            self.closed = True

    # reads

    def log(self, first: bytes | None = None, last: bytes | None = None, as_of: int | None = None, min_ts: int | None = None, version: int | None = None) -> DataFrame:
        """All versions of a key range and of times, from the files that may hold any; with ``version``, of that commit."""
        self._open()
        at = self.refresh() if version is None else self.manifest.at(version)
        files = at.prune(first, last, as_of, min_ts)
        rows = self.spark.read.schema(LOG).parquet(*[f"{self.path}/{f.path}" for f in files]) if files else self.spark.createDataFrame([], LOG)
        return bounded(rows, as_of, None, min_ts, first, last)

    def get(self, key: str | bytes, ts: int | None = None) -> dict:
        """The value as of a time (now, in nanoseconds, if none): a dict with the asked ``timestamp`` and the version's own ``version_ts``."""
        name, at = check_key(key), check_ts(time.time_ns() if ts is None else ts)
        rows = reads.get_point(self.log(name, name, at), name, at).collect()  # one row at most
        if not rows:
            raise KeyNotFound(f"{key!r} has no value as of {at}")
        try:
            return {"key": name.decode(), "value": bytes(rows[0].value).decode(), "timestamp": at, "version_ts": rows[0].ts}
        except UnicodeDecodeError as e:
            raise EncodingError(f"{key!r} isn't UTF-8") from e

    def get_bytes(self, key: str | bytes, ts: int | None = None) -> bytes | None:
        name, at = check_key(key), check_ts(time.time_ns() if ts is None else ts)
        rows = reads.get_point(self.log(name, name, at), name, at).collect()  # one row at most
        return bytes(rows[0].value) if rows else None

    def set(self, series: dict) -> str:
        """Writes {"key", "value", "timestamp"}."""
        self.put(series["key"], series["value"], check_ts(series["timestamp"]))
        return "OK"

    def list(self, key_prefix: str | bytes | None = None, limit: int | None = None, as_of: int | None = None, after: str | bytes | None = None) -> dict:
        """{"series": [...], "has_more"}: latest values by key prefix, in key order. Rows that aren't UTF-8 are left out."""
        n, prefix = check_limit(limit), as_bytes(key_prefix or b"")
        at = check_ts(time.time_ns() if as_of is None else as_of)
        first, end = prefix_range(prefix)
        text = F.expr("is_valid_utf8(cast(key as string)) and is_valid_utf8(cast(value as string))")
        rows, more = reads.list_page(self.log(first or None, end, at), prefix, n, at, None if after is None else as_bytes(after), keep=text)
        return {"series": [{"key": bytes(r.key).decode(), "value": bytes(r.value).decode(), "timestamp": r.ts} for r in rows], "has_more": more}

    def snapshot(self, as_of: int | None = None, version: int | None = None) -> DataFrame:
        """(key, ts, ..., value) of every key as of a time, of the current commit or an earlier one."""
        return resolve_latest(self.log(as_of=as_of, version=version), as_of)

    def range(self, first: str | bytes, last: str | bytes, min_ts: int, max_ts: int) -> DataFrame:
        """(key, value, ts): the newest version of each key in the inclusive box, by key."""
        a, b = check_key(first), check_key(last)
        return reads.range_latest(self.log(a, b, max_ts, min_ts), a, b, min_ts, max_ts).select("key", "value", "ts").orderBy("key")

    def range_versions(self, first: str | bytes, last: str | bytes, min_ts: int, max_ts: int) -> DataFrame:
        a, b = check_key(first), check_key(last)
        return reads.range_versions(self.log(a, b, max_ts, min_ts), a, b, min_ts, max_ts).select("key", "value", "ts")

    def get_many(self, probes: DataFrame, time_bucket: int, key: str = "key", at: str = "at") -> DataFrame:
        """The as-of join of many (key, at) probes."""
        return reads.asof_join(probes.withColumn(key, F.col(key).cast("binary")), self.log(), time_bucket, key, at)

    def stats(self) -> dict:
        """Levels with their files, bytes, entries and limits."""
        self._open()
        levels = []
        for n in range(self.options.compaction.levels):
            files = self.refresh().level(n)
            levels.append({"level": n, "files": len(files), "bytes": sum(f.file_size for f in files), "entries": sum(f.entry_count for f in files), "limit": self.options.compaction.limit(n)})
        return {"version": self.version.number, "levels": levels}

    def refresh(self) -> Version:
        """Takes up what other writers have committed; every read and write does so first."""
        self.version = self.manifest.newer(self.version)
        return self.version

    # maintenance

    def compact(self) -> int:
        """Compacts until no level asks for it; returns the number of jobs."""
        n = 0
        while self.compact_once():
            n += 1
        return n

    def compact_once(self) -> Job | None:
        with self._lock:
            job = pick(self.refresh(), self.options.compaction)
            return self.run_job(job) if job else None

    def run_job(self, job: Job) -> Job:
        """Merges a job's files into the next level, in one commit."""
        rows = self.spark.read.schema(LOG).parquet(*[f"{self.path}/{f.path}" for f in job.inputs])
        bottom = is_bottom(self.version, job)
        if self.options.retention == "latest":
            merged = maintenance.merge_latest(rows) if bottom else maintenance.winners(rows)
        else:
            merged = maintenance.merge_history(rows, horizon=self.options.horizon if bottom else None)
        files = self._write(merged, job.target, job.n_outputs(self.options.compaction))
        gone = {f.path for f in job.inputs}
        while not self._commit(add=files, remove=gone):
            if not gone <= set(self.version.files):
                raise CommitConflict("another writer compacted these files")
        for path in gone:
            self.manifest.files.create(self._mark(path, "replaced"), b"")
        return job

    def vacuum(self, keep_versions: int = 1, min_age_hours: float = 24.0) -> int:
        """Deletes data files that none of the newest versions names and that are older than so many hours; returns how many.

        Younger files may belong to a write that isn't committed yet, or to a reader of the version before."""
        latest = self.manifest.latest()
        named = {p for n in range(max(1, latest - keep_versions + 1), latest + 1) for p in self.manifest.at(n).files}
        before = (time.time() - min_age_hours * 3600) * 1000
        gone = [p for p, _, at in self.manifest.files.status("data") if p.endswith(".parquet") and at <= before and self._relative(p) not in named]
        for p in gone:
            self.manifest.files.delete(p, path=True)
        return len(gone)

    def rebuild(self) -> Version:
        """Makes a manifest from the data files that are there, for a store that has lost its own.

        Files carry marks beside them: those that no commit took up, and those that a compaction replaced, stay out."""
        status = self.manifest.files.status("data")
        marks = {self._relative(p) for p, *_ in status}
        now = time.time() * 1000
        paths = {self._relative(p): (size, (now - at) / 3_600_000) for p, size, at in status if p.endswith(".parquet")}
        paths = {p: x for p, x in paths.items() if self._mark(p, "committed") in marks and self._mark(p, "replaced") not in marks}
        files = self._stats([f"{self.path}/{p}" for p in paths], 0) if paths else []
        rows = self.spark.createDataFrame([(f.path, *map(float, paths[f.path])) for f in files] or [("", 0.0, 0.0)], "p string, size double, age double")
        levels = {r.p: r.level for r in rows.select("p", inferred_level(F.col("size"), F.col("age")).alias("level")).collect()}  # a row for each file
        # levels below 0 must not overlap; a file that may be newer than another must stand above it
        in_order, reach, crossed = sorted(files, key=lambda f: f.smallest_key), None, False
        for f in in_order:
            crossed |= reach is not None and f.smallest_key <= reach
            reach = f.largest_key if reach is None else max(reach, f.largest_key)
        files = [DataFile(**(vars(f) | {"level": 0 if crossed else levels[f.path]})) for f in files]
        return self.manifest.commit(self.manifest.at(), add=files)

    # parts

    def _open(self) -> None:
        if self.closed:
            raise StoreError("the store is closed")

    def _relative(self, path: str) -> str:
        return path[path.index("/data/") + 1 :] if "/data/" in path else path

    @staticmethod
    def _mark(path: str, kind: str) -> str:
        folder, name = path.rsplit("/", 1)
        return f"{folder}/_{kind}" if kind == "committed" else f"{folder}/_{kind}-{name}"

    def _write(self, rows: DataFrame, level: int, parts: int | None) -> list[DataFile]:
        folder = f"data/{uuid.uuid4().hex}"
        out = rows.coalesce(1) if parts == 1 else rows.repartitionByRange(*([parts] if parts else []), "key", "ts")
        out.sortWithinPartitions("key", F.desc("ts"), F.desc("seqno"), F.desc("op_index")).select(LOG.names).write.parquet(f"{self.path}/{folder}")
        return self._stats([f"{self.path}/{folder}"], level)

    def _stats(self, paths: list[str], level: int) -> list[DataFile]:
        rows = self.spark.read.schema(LOG).parquet(*paths).groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).agg(
            F.count(F.lit(1)).alias("n"), F.min("key").alias("a"), F.max("key").alias("b"), F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.max("seqno").alias("s")
        )
        now = time.time_ns()
        return [DataFile(self._relative(r.path), level, r["size"], r.n, bytes(r.a).hex(), bytes(r.b).hex(), r.t0, r.t1, r.s, now) for r in rows.collect()]  # a row for each new file

    def _commit(self, add: list[DataFile] = (), **changes) -> bool:
        """Commits on the version that is held; if another writer was first, takes up its version and says False."""
        if lost := [f.path for f in add if not self.manifest.files.exists(f.path)]:
            raise CommitConflict(f"files are gone before their commit: {lost[:3]}")
        try:
            self.version = self.manifest.commit(self.version, add=add, **changes)
        except CommitConflict:
            self.version = self.manifest.at()
            return False
        for mark in {self._mark(f.path, "committed") for f in add}:
            self.manifest.files.create(mark, b"")
        return True


def rest_answer(call: Callable[[], object]) -> tuple[int, object]:
    """A call's answer as an HTTP status and a body."""
    status, body = _answer(call)
    return {"OK": 200, "NOT_FOUND": 404, "INVALID_ARGUMENT": 400, "INTERNAL": 500}[status], body


def rpc_answer(call: Callable[[], object]) -> tuple[str, object]:
    """A call's answer as the name of an RPC status (OK, NOT_FOUND, INVALID_ARGUMENT, INTERNAL) and a value or message."""
    status, body = _answer(call)
    return status, body if status == "OK" else body["message"]


def _answer(call: Callable[[], object]) -> tuple[str, object]:
    try:
        return "OK", call()
    except StoreError as e:
        kinds = ((KeyNotFound, "NOT_FOUND"), ((InvalidKey, InvalidLimit, InvalidTimestamp), "INVALID_ARGUMENT"))
        return next((status for kind, status in kinds if isinstance(e, kind)), "INTERNAL"), {"error": type(e).__name__, "message": str(e)}
