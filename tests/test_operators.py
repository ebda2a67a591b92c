"""Operators on small logs."""

import pytest
from pyspark.sql import functions as F

from tempolake.functions.sizes import ReadableSize, n_output_files, readable_size
from tempolake.operators import maintenance as M
from tempolake.operators import reads as R
from tempolake.operators.resolve import prefix_range, resolve_latest, winners
from tempolake.plans.compaction import CompactionOptions, Job, is_bottom, needs_compaction, pick
from tempolake.plans.manifest import DataFile, Version

MIXED = [("sensor", 100, 1, "a"), ("sensor", 200, 2, "b"), ("sensor", 150, 3, "c"), ("sensor", 200, 4, "d")]


def log(spark, rows):
    return spark.createDataFrame([(k, ts, s, 0 if v is not None else 1, v or "") for k, ts, s, v in rows], "key string, ts long, seqno long, op int, value string")


def values(df):
    return {r.key: r.value for r in df.collect()}


@pytest.mark.parametrize("strategy", ["max_by", "row_number"])
@pytest.mark.parametrize(("as_of", "seqno", "expected"), [(300, 10, "d"), (300, 3, "b"), (175, 10, "c"), (125, 2, "a"), (50, 1, None), (200, 2, "b")])
def test_time_decides_then_seqno(spark, as_of, seqno, expected, strategy):
    assert values(resolve_latest(log(spark, MIXED), as_of, seqno, strategy=strategy)).get("sensor") == expected


def test_last_write_mode(spark):
    assert values(resolve_latest(log(spark, MIXED), 300, 3, order="seqno"))["sensor"] == "c"
    rows = [("a", 1, 1, "x"), ("a", 2, 2, None), ("a", 3, 3, "y"), ("b", 1, 4, "z")]
    assert values(resolve_latest(log(spark, rows))) == {"a": "y", "b": "z"}
    assert values(resolve_latest(log(spark, rows), sticky_tombstones=True)) == {"b": "z"}
    with pytest.raises(ValueError):
        winners(log(spark, rows), strategy="none")


def test_range_versions_and_exact(spark):
    rows = [("a", 1, 1, "x"), ("a", 1, 2, "y"), ("a", 2, 3, "x"), ("a", 2, 4, None)]
    assert [(r.ts, r.value) for r in R.range_versions(log(spark, rows), "a", "a", 0, 9).collect()] == [(1, "y")]
    assert R.version_exact(log(spark, rows), "a", 1, 1).first().value == "x"


def test_merges(spark):
    rows = [("key1", 1000, 1, "old"), ("key1", 1000, 2, "new"), ("key2", 1000, 1, "value2"), ("gone", 5, 1, "v"), ("gone", 6, 2, None), ("never", 7, 1, None)]
    assert values(M.merge_latest(log(spark, rows))) == {"key1": "new", "key2": "value2"}
    kept = lambda **kw: {(r.key, r.ts, r.op) for r in M.merge_history(log(spark, rows), **kw).collect()}
    assert kept() == {("key1", 1000, 0), ("key2", 1000, 0), ("gone", 5, 0), ("gone", 6, 1), ("never", 7, 1)}
    assert kept(horizon=8) == kept() - {("never", 7, 1)} and kept(horizon=7) == kept()


def test_empty_logs(spark):
    empty = spark.createDataFrame([], "key string, ts long, seqno long, op int, value string")
    assert resolve_latest(empty).count() == 0 and M.merge_history(empty, horizon=9).count() == 0
    assert R.validity_intervals(empty, 10).count() == 0
    probes = spark.createDataFrame([("a", 1)], "key string, at long")
    assert R.asof_join(probes, empty, 10).first().found_ts is None


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_asof_join_and_intervals_for_any_bucket(spark, width):
    rows = [("a", 3, 1, "1"), ("a", 20, 2, "2"), ("a", 20, 3, "3"), ("a", 90, 4, None), ("b", 50, 5, "x")]
    probes = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate([("a", 2), ("a", 3), ("a", 19), ("a", 20), ("a", 89), ("a", 90), ("b", 49), ("b", 500), ("c", 1)])], "key string, at long, n int")
    got = {r.n: (r.found_ts, r.found_value) for r in R.asof_join(probes, log(spark, rows), width).collect()}
    none = (None, None)
    assert got == {0: none, 1: (3, "1"), 2: (3, "1"), 3: (20, "3"), 4: (20, "3"), 5: none, 6: none, 7: (50, "x"), 8: none}
    spans = {(r.key, r.ts, r.seqno): r.valid_to for r in R.validity_intervals(log(spark, rows), width).collect()}
    assert spans == {("a", 3, 1): 20, ("a", 20, 2): 20, ("a", 20, 3): 90, ("b", 50, 5): None}


def test_tiers_give_what_the_whole_gives(spark):
    whole = log(spark, MIXED)
    tiers = [whole.filter(F.col("seqno") % 3 == i) for i in range(3)]
    assert values(resolve_latest(tiers[2].unionByName(tiers[0]).unionByName(tiers[1]))) == values(resolve_latest(whole))


def test_pages(spark):
    rows = log(spark, [(k, 1, 1, k) for k in "abcd"])
    page, more = R.list_page(rows, "", 3)
    assert [r.key for r in page] == ["a", "b", "c"] and more
    page, more = R.list_page(rows, "", 3, after="c")
    assert [r.key for r in page] == ["d"] and not more


def test_prefix_range():
    assert prefix_range(b"a") == (b"a", b"b") and prefix_range(b"a\xff") == (b"a\xff", b"b")
    assert prefix_range(b"\xff") == (b"\xff", None) and prefix_range(b"") == (b"", None)


def test_readable_size(spark):
    assert ReadableSize.of(2, "KiB").bytes == 2048
    assert ReadableSize.of(2, "MiB") / ReadableSize.of(1, "KiB") == 2048
    assert ReadableSize.of(1, "MiB") / 2 == ReadableSize.of(512, "KiB") and ReadableSize(3) * 2 == ReadableSize(6)
    for text, n in (("1.5MiB", 1_572_864), ("2K", 2048), ("2KB", 2048), ("7", 7), ("7B", 7), (" 1 GiB ", 1 << 30)):
        assert ReadableSize.parse(text).bytes == n
    for bad in ("", "1kb", "x", "1.5.2K", "-1"):
        with pytest.raises(ValueError):
            ReadableSize.parse(bad)
    assert str(ReadableSize(1023)) == "1023B" and str(ReadableSize(1536)) == "1.5KiB"
    assert ReadableSize(2048).exact() == "2KiB" and ReadableSize(2049).exact() == "2049B"
    got = spark.createDataFrame([(n,) for n in (0, 1023, 1536, 5 << 20, 3 << 40)], "n long").select(readable_size(F.col("n")).alias("t")).collect()
    assert [r.t for r in got] == ["0B", "1023B", "1.5KiB", "5.0MiB", "3.0TiB"]


def data_file(name, a, b, level=0, size=10, seqno=1):
    return DataFile(name, level, size, 1, a.encode().hex(), b.encode().hex(), 0, 9, seqno)


def version(*files):
    return Version(1, {f.path: f for f in files})


def test_compaction_decisions():
    options = CompactionOptions()
    assert [options.limit(n) for n in range(3)] == [None, 10 << 20, 100 << 20]
    large = CompactionOptions.for_files(1 << 30)
    assert (large.limit(1), large.limit(2), large.file_bytes) == (5 << 30, 50 << 30, 1 << 30)
    files = [data_file(f"f{i}", "a", "z", seqno=i) for i in range(4)]
    assert not needs_compaction(version(*files[:3]), 0, options) and needs_compaction(version(*files), 0, options)
    below = [data_file("x", "c", "d", 1), data_file("y", "zz", "zzz", 1)]
    job = pick(version(*files, *below), options)
    assert job.level == 0 and {f.path for f in job.inputs} == {"f0", "f1", "f2", "f3", "x"}
    assert not is_bottom(version(*files, data_file("deep", "b", "b", 3)), Job(tuple(files), 0)) and is_bottom(version(*files, below[1]), Job(tuple(files), 0))
    big = [data_file(f"g{i}", "a", "b", size=20 << 20, seqno=i) for i in range(4)]
    assert [f.path for f in pick(version(*big), options).inputs] == ["g0"]  # the oldest, and no gap
    full = version(data_file("m", "a", "c", 1, 11 << 20), data_file("n", "b", "d", 2))
    assert pick(full, options).level == 1 and len(pick(full, options).inputs) == 2
    assert pick(full, options, busy={1}) is None and pick(version(), options) is None


def test_output_files():
    assert [n_output_files(4500, t) for t in (2000, 5000, 0)] == [3, 1, 1] and n_output_files(0, 10) == 1


def test_overlap(spark):
    level = spark.createDataFrame([(1, "a", "d"), (2, "e", "h"), (3, "i", "l")], "file int, smallest_key string, largest_key string")
    probe = spark.createDataFrame([(9, "c", "f")], "file int, smallest_key string, largest_key string")
    assert {r.other for r in M.overlapping_files(probe, level).collect()} == {1, 2}
    assert {r.file for r in M.files_for_key(level.union(spark.createDataFrame([(4, None, None)], level.schema)), "f").collect()} == {2, 4}


def test_filters_reach_the_scan(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    log(spark, MIXED).write.parquet(path)
    plan = R.get_point(spark.read.parquet(path), "sensor", 300)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key,sensor)" in plan and "LessThanOrEqual(ts,300)" in plan
    plan = R.list_prefix(spark.read.parquet(path), "se", 3).select("key")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(key,se)" in plan and "TakeOrderedAndProject" in plan
