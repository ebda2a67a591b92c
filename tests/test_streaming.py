"""Streams into a store: late rows, restarts, atomic batches."""

from tempolake.store import Store
from tempolake.streaming.ingest import ingest


def test_ingest(spark, tmp_path):
    store = Store.open(spark, f"file://{tmp_path}/db")
    rows = spark.createDataFrame([("a", 10, "1", 0), ("a", 5, "late", 0), ("b", 7, "x", 0), ("b", 8, "", 1)], "key string, ts long, value string, op int")
    rows.write.parquet(f"{tmp_path}/in/1")
    stream = lambda: spark.readStream.schema("key string, ts long, value string, op int").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    ingest(store, stream(), f"file://{tmp_path}/ck").awaitTermination()
    assert {bytes(r.key): bytes(r.value) for r in store.snapshot().collect()} == {b"a": b"1"}
    assert store.get_bytes("a", 6) == b"late"
    spark.createDataFrame([("c", 1, "new", 0)], rows.schema).write.parquet(f"{tmp_path}/in/2")
    ingest(store, stream(), f"file://{tmp_path}/ck").awaitTermination()
    assert store.get_bytes("c", 1) == b"new" and store.log().count() == 5
    # a batch that is delivered again adds nothing: its number is in the commit that holds its rows
    again = spark.createDataFrame([("c", 1, "new", 0)], rows.schema)
    query, number = next(iter(store.refresh().streams.items()))
    store.append(again, stream=(query, number))
    assert store.log().count() == 5
    # a new checkpoint is a new query: its batch 0 holds what was there and the new file
    spark.createDataFrame([("d", 1, "newer", 0)], rows.schema).write.parquet(f"{tmp_path}/in/3")
    ingest(store, stream(), f"file://{tmp_path}/ck2").awaitTermination()
    assert store.get_bytes("d", 1) == b"newer" and store.get_bytes("a", 6) == b"late" and len(store.version.streams) == 2
