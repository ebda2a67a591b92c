"""The corpus pipeline, each stage against a plain version of it, on the smallest documents."""

import collections

import brute
import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tempolake.llm import line_dedup

SF = "/root/testdata/sf0.001"


def test_stages(spark, docs, tmp_path):
    tables, now = [docs], docs
    for i, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, now, SF).write.parquet(f"file://{tmp_path}/{i}")
        now = spark.read.parquet(f"file://{tmp_path}/{i}")
        tables.append(now)
    assert all(t.columns == docs.columns for t in tables[:-1])
    rows = [t.collect() for t in tables]

    # language ID keeps documents in the language that they declare
    before = {r.doc_id: r for r in rows[0]}
    after = {r.doc_id: r for r in rows[1]}
    assert all(after[i].text == before[i].text and after[i].source == before[i].source for i in after)
    assert all(not any(c.isalpha() for c in before[i].text or "") for i in set(before) - set(after)) and len(after) >= 0.98 * len(before)

    # line dedup
    kept = {r.doc_id: brute.sha(r.text) for r in rows[2]}
    assert kept == {i: x[2] for i, x in brute.lines({i: r.text for i, r in after.items()}).items()}
    assert all(r.n_chars == len(r.text) for r in rows[2])

    # near duplicates: the smallest id of each component stays
    sets = {r.doc_id: brute.shingle_set(r.text, 5) for r in rows[2]}
    same = brute.components(sets, 80, 100)
    assert {r.doc_id for r in rows[3]} == {i for i, c in same.items() if i == c}
    assert {r.doc_id: r.text for r in rows[3]} == {r.doc_id: r.text for r in rows[2] if same[r.doc_id] == r.doc_id}

    # mixing: words by source near their targets, from the documents' own words, each at most twice
    words = {r.doc_id: brute.words(r.text) for r in rows[3]}
    source = {r.doc_id: r.source for r in rows[3]}
    sizes, taken, passes = collections.Counter(), collections.Counter(), collections.defaultdict(collections.Counter)
    for i, w in words.items():
        sizes[source[i]] += len(w)
    for r in rows[4]:
        w = brute.words(r.text)
        taken[r.source] += len(w)
        passes[r.doc_id].update(w)
    goal = brute.mix_targets(sizes)
    assert all(abs(taken[s] - goal[s]) <= 1 for s in goal)
    for i, used in passes.items():
        own = collections.Counter(words[i])
        assert all(n <= 2 * own[w] for w, n in used.items())

    # tokens
    import public_tokenizers as P
    import tiktoken

    from tempolake.llm.bpe import read_ranks

    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    expected = collections.Counter((r.doc_id, tuple(coder.encode_ordinary(r.text))) for r in rows[4])
    assert collections.Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows[5]) == expected
    assert all(r.round_trip and r.n_tokens == len(r.ids) // 4 for r in rows[5])


def test_run_is_the_stages(spark):
    assert pipeline.ORACLE_SQL is None and 4 <= len(pipeline.STAGES) <= 5
    first, again = pipeline.run(spark, SF), pipeline.run(spark, SF)
    key = lambda df: sorted((r.doc_id, r.n_tokens, bytes(r.ids)) for r in df.collect())
    assert key(first) == key(again)


def test_odd_rows_pass_through(spark, odd, empty):
    for rows in (odd, empty):
        now = rows
        for _, stage in pipeline.STAGES[:-1]:
            now = stage(spark, now, SF)
            assert now.columns == rows.columns
        pipeline.STAGES[-1][1](spark, now, SF).collect()


def test_line_dedup_joins_no_runs_with_each_other(spark, monkeypatch):
    """Four batches, as a table of 200,000 documents has: each key in one document of each batch or nearly so."""
    joins, write = [], line_dedup.LineRuns._write

    def counted_write(self, df, level):
        joins.append((level, df._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin")))
        write(self, df, level)

    monkeypatch.setattr(line_dedup.LineRuns, "_write", counted_write)
    n, line = 200_000, F.concat(F.lit("a line of more than twenty characters "), F.col("doc_id") % 50_000)
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    docs = docs.withColumn("text", F.concat(line, F.lit("\nshort"))).select(*pipeline.COLUMNS)
    got = pipeline.line_dedup_stage(spark, docs, SF).withColumn("whole", F.col("text").contains("\n"))
    assert {(r.whole, r["count"], r.a, r.z) for r in got.groupBy("whole").agg(F.count(F.lit(1)).alias("count"), F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).collect()} == {
        (False, 150_000, 0, 149_999), (True, 50_000, 150_000, 199_999)
    }
    assert joins == [(0, 0), (0, 2), (0, 2), (1, 0), (0, 2)]
