"""The registered queries against brute force on the smallest tables."""

import collections

import brute
import numpy as np
import pytest

import __spark_entry__ as entry
from tempolake.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: queries.queries()[name](spark, SF).collect()


def test_all_are_registered():
    names = [f"op{n}_" for n in range(1, 11)]
    assert all(sum(q.startswith(n) for q in entry.queries()) == 1 for n in names) and "pipeline" in entry.queries()


def test_op1(run, texts):
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in run("op1_substring_dedup")} == brute.substrings(texts)


def test_op2(run, spark, texts):
    import zlib

    got = {r.doc_id: r for r in run("op2_quality_gam")}
    assert set(got) == set(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].predicted == r.quality for r in held) >= 0.95 * len(held)


def test_op3(run, spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    size = {r.doc_id: len(brute.words(r.text)) for r in rows}
    source = {r.doc_id: r.source for r in rows}
    total = collections.Counter()
    for i, n in size.items():
        total[source[i]] += n
    goal = brute.mix_targets(total)
    got, taken = run("op3_mixing"), collections.Counter()
    assert sorted(r.doc_id for r in got) == sorted(size)
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == total[source[r.doc_id]] and r.target == goal[source[r.doc_id]] and 0 <= r.taken <= 2 * r["size"]
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 1 for s in goal)
    assert sorted(map(str, got)) == sorted(map(str, run("op3_mixing")))


def test_op4(run, texts, spark):
    got = {r.doc_id: r for r in run("op4_language_id")}
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(got) == set(texts) and sum(got[i].language == lang[i] for i in got) >= 0.98 * len(got)
    assert sum(r.kept for r in got.values()) >= 0.98 * len(got)


def test_op5(run, texts):
    got = run("op5_sharding")
    assert sorted(r.doc_id for r in got) == sorted(texts)
    slots, sizes = collections.defaultdict(list), collections.Counter()
    for r in got:
        assert r["size"] == len((texts[r.doc_id] or "").encode()) + 1 and r.text_crc32 == brute.crc(texts[r.doc_id]) and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    mean, largest = sum(sizes.values()) / 16, max(r["size"] for r in got)
    assert all(abs(sizes[s] - mean) <= largest for s in range(16))


def test_op6(run, texts):
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in run("op6_line_dedup")} == brute.lines(texts)


def test_op7(run, spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    vectors = {r.vec_id: np.floor(1024 * np.array(r.embedding, dtype=np.float64)).astype(np.int64) for r in rows}
    assert {tuple(r) for r in run("op7_exact_top_k")} == brute.top_k(vectors, [i for i in vectors if i % 100 == 0])


def test_op8(run, texts):
    import hashlib

    import public_tokenizers as P
    import tiktoken

    from tempolake.llm.bpe import read_ranks

    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for r in run("op8_byte_bpe"):
        ids = coder.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == brute.sha(texts[r.doc_id] or "")


def test_op9(run, texts):
    sets = {i: brute.shingle_set(t, 3) for i, t in texts.items()}
    same = brute.components(sets, 90, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in run("op9_ngram_jaccard")} == {i: (len(sets[i]), same[i]) for i in texts}


def test_op10(run, texts):
    for r in run("op10_quality_rules"):
        n, *rest = expected = brute.base_rules(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        failed = n < 20 or 100 * rest[-1] > 30 * n
        assert r.base_failed == failed and not (failed and r.kept)


def test_page_language(run):
    got = run("page_language")
    assert sum(r.language == r.declared for r in got if r.declared) >= 0.95 * sum(bool(r.declared) for r in got)


@pytest.mark.parametrize("name", ["op5_sharding", "op6_line_dedup", "op10_quality_rules"])
def test_native_plans_have_no_python(spark, name):
    plan = queries.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def test_queries_read_whole_tables(spark):
    """One row for each document of any query over documents."""
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op1_substring_dedup", "op2_quality_gam", "op3_mixing", "op4_language_id", "op5_sharding", "op6_line_dedup", "op8_byte_bpe", "op9_ngram_jaccard", "op10_quality_rules"):
        assert queries.queries()[name](spark, SF).count() == n, name
