"""Nulls, empty and long texts, ties and repeated rows, empty tables, clashing columns."""

import collections
import hashlib

import brute
import numpy as np
import public_tokenizers as P
import pytest
from conftest import ODD
from pyspark.sql import functions as F

from tempolake.llm import bpe, jaccard, language, line_dedup, mixing, quality_gam, quality_rules, sharding, substring, topk

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [(r[0], r[1]) for r in ODD]


def counted(rows, *names):
    return collections.Counter(tuple(r[n] for n in names) for r in rows)


def test_substrings(odd, empty, clashing):
    got = substring.dedup_substrings(odd).collect()
    assert len(got) == len(ODD)
    assert counted(got, "doc_id", "n_words", "n_removed") == collections.Counter((i, len(brute.words(t)), 0) for i, t in TEXTS)
    assert all(r.text == " ".join(brute.words(t)) for r, t in zip(sorted(got, key=lambda r: (r.doc_id or 99, r.n_words)), [t for _, t in sorted(TEXTS, key=lambda x: (x[0] or 99, len(brute.words(x[1]))))], strict=True))
    assert substring.dedup_substrings(empty).collect() == []
    again = substring.dedup_substrings(clashing)
    assert again.count() == len(ODD) and {"key", "t", "doc", "__text"} - {"__text"} <= set(again.columns)


def test_substrings_share_passages(spark):
    rng = np.random.default_rng(1)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    passage, run = fresh(80), ["go"] * 120
    docs = {i: " ".join(fresh(30) + passage[: 50 + i % 31] + fresh(20) + (run[: 60 + i] if i % 2 else []) + fresh(5)) for i in range(1, 40)}
    docs |= {100: docs[3], 101: docs[4] + " tail", 102: " ".join(passage[:49])}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, brute.sha(r.text)) for r in substring.dedup_substrings(df).collect()}
    assert got == brute.substrings(docs)
    spans = {r.doc_id: r.removed_spans for r in substring.dedup_substrings(df).collect()}
    assert sum(s.end - s.start for s in spans[100]) == got[100][1] == got[100][0]


def test_substring_null_ids_come_last(spark):
    text = " ".join(f"v{i}" for i in range(60))
    df = spark.createDataFrame([(5, text), (None, text), (None, text), (5, text)], "doc_id long, text string")
    assert counted(substring.dedup_substrings(df).collect(), "doc_id", "n_removed") == {(5, 0): 2, (None, 60): 2}


def test_quality_gam(spark, odd, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)] + [(None, 1, 0), (7, None, 0), (8, 0, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_gam.train(odd, labels)
    got = quality_gam.score(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got) and {r.held_out for r in got if r.doc_id is None} == {False}
    assert quality_gam.score(empty, model).collect() == []
    flat = quality_gam.train(odd, labels.limit(0))
    assert {r.score for r in quality_gam.score(odd, flat).collect()} == {0.5}
    one = quality_gam.train(odd, labels.filter("quality = 1"))
    assert all(r.predicted == 1 for r in quality_gam.score(odd, one).collect())


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(quality_gam.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.95


def test_mixing(odd, empty, clashing):
    m = mixing.mix(odd)
    got = mixing.taken(m).collect()
    assert len(got) == len(ODD)
    sizes = collections.Counter()
    for _, t, _, s, _ in ODD:
        sizes[s] += len(brute.words(t))
    goal = brute.mix_targets(sizes)
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == goal[r.source] and r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 1 for s in goal)
    text = mixing.mixed_documents(odd, m)
    assert text.columns == odd.columns and sum(len(brute.words(r.text)) for r in text.collect()) == sum(taken.values())
    places = m.blocks.select("shard", "place").collect()
    assert len({tuple(p) for p in places}) == len(places)
    assert mixing.taken(mixing.mix(empty)).collect() == []
    assert len(mixing.taken(mixing.mix(clashing)).collect()) == len(ODD)


def test_splitting_tree():
    quotas = [1000, 0, 7, 333]
    drawn = mixing.split_quotas(quotas, 5, 1)
    assert drawn.sum(axis=1).tolist() == quotas and drawn.sum(axis=0).max() - drawn.sum(axis=0).min() <= 3 and (drawn >= 0).all()
    large = mixing.split_quotas([10**10, 3 * 10**10], 4, 2)
    assert large.sum(axis=1).tolist() == [10**10, 3 * 10**10] and abs(large[0] / large.sum(axis=0) - 0.25).max() < 1e-3


def test_hypergeometric_draws():
    """The law against its probabilities, and its mean and variance where populations pass 10^9."""
    import math

    rng = np.random.default_rng(5)
    for good, bad, n in ((5, 7, 6), (30, 1, 20), (100, 300, 50), (3, 1000, 900), (50, 60, 109), (0, 5, 3), (5, 0, 3), (4, 4, 8)):
        seen = np.bincount([mixing.hypergeometric(rng, good, bad, n) for _ in range(10_000)], minlength=min(good, n) + 1)
        told = np.array([math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) * 10_000 if 0 <= n - k <= bad else 0 for k in range(len(seen))])
        assert not seen[told == 0].any() and (((seen - told)[told > 5] ** 2 / told[told > 5]).sum() < 3 * (told > 5).sum() + 10)
    for scale in (10**8, 10**9, 10**12):  # below and above any limit of a library's sampler: one law
        good, bad, n = scale, 30 * scale, 5 * scale
        got = np.array([mixing.hypergeometric(rng, good, bad, n) for _ in range(2000)], dtype=np.float64)
        mean, var = n / 31, n / 31 * 30 / 31 * (good + bad - n) / (good + bad - 1)
        assert abs(got.mean() - mean) < 5 * (var / 2000) ** 0.5 and 0.85 < got.var() / var < 1.15


def test_mix_is_dealt_by_the_quotas(spark, docs):
    """Every pass holds each block once at most, shards hold what the tree drew, and places number each shard's blocks."""
    m = mixing.mix(docs, n_shards=5)
    rows = m.blocks.collect()
    assert len({(r.key, r.doc, r.copy, r.block, r.epoch) for r in rows}) == len(rows)
    by_source = collections.Counter(r.key for r in rows)
    keys = sorted(by_source, key=lambda k: (not k, k))
    drawn = mixing.split_quotas([by_source[k] for k in keys], 5, 7)
    assert collections.Counter((r.key, r.shard) for r in rows) == {(k, i): int(n) for k, row in zip(keys, drawn, strict=True) for i, n in enumerate(row) if n}
    shards = collections.defaultdict(list)
    for r in rows:
        shards[r.shard].append(r.place)
    assert all(sorted(v) == list(range(len(v))) for v in shards.values())
    mixed = [r.key for r in sorted(rows, key=lambda r: (r.shard, r.place))]
    assert sum(a != b for a, b in zip(mixed, mixed[1:])) > len(mixed) / 2  # sources alternate within a shard


def test_too_many_sources_are_refused(docs, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_ENTRIES", 64)
    with pytest.raises(ValueError, match="sources"):
        mixing.mix(docs)


def test_targets():
    assert [float(x) for x in mixing.targets([10, 100, 100], [3, 1, 2])] == [20.0, (315 - 20) / 3, (315 - 20) * 2 / 3]
    assert mixing.targets([0, 0], [3, 1]) == [0, 0] and mixing.targets([], []) == []


def test_language(odd, empty, clashing):
    model = language.train(odd, "doc_id", "text", "lang")
    args = {"declared": F.col("lang"), "host": F.col("source"), "suffix": language.suffix_of(F.col("source"))}
    got = language.identify(odd, model, **args).collect()
    assert len(got) == len(ODD) and all(not r.accepted for r in got if not brute.words(r.text)) and all(0 <= r.posterior <= 1.000001 for r in got)
    assert language.identify(empty, model, **args).collect() == []
    none = language.train(empty, "doc_id", "text", "lang")
    assert {r.language for r in language.identify(odd, none, **args).collect()} == {None}
    assert language.identify(clashing, model, **args).count() == len(ODD)


def test_language_evidence_moves_the_answer(spark, docs):
    model = language.train(docs, "doc_id", "text", "lang")
    rows = [(i, "Zu der die und ist", "de", "h.de") for i in range(40)] + [(100 + i, "The of and that is for", "en", "h.com") for i in range(40)] + [(900, "xq", None, "h.de"), (901, "xq", None, "h.com")]
    df = spark.createDataFrame(rows, "doc_id long, text string, said string, host string")
    got = {r.doc_id: r.language for r in language.identify(df, model, declared=F.col("said"), host=F.col("host"), suffix=language.suffix_of(F.col("host"))).collect()}
    assert got[0] == "de" and got[100] == "en" and got[900] == "de" and got[901] == "en"


def test_language_by_text_alone(spark):
    from tempolake.llm.shared import table

    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = language.train(docs.filter("doc_id % 2 = 0"), "doc_id", "text", "lang")
    got = language.identify(docs.filter("doc_id % 2 = 1 AND length(text) > 40"), model).collect()
    assert sum(r.language == r.lang for r in got) >= 0.99 * len(got)


def test_language_of_other_documents(docs):
    """Fitted on two thirds of the documents and judged on the rest, with the declared value hidden, and with one in four altered."""
    fit, held = docs.filter("doc_id % 3 > 0"), docs.filter("doc_id % 3 = 0")
    model = language.train(fit, "doc_id", "text", "lang")
    wrong = F.when(F.col("doc_id") % 4 > 0, F.col("lang")).otherwise(F.when(F.col("lang") == "de", "fr").otherwise("de"))
    for declared in (None, wrong):
        got = language.identify(held, model, declared=declared, host=F.col("source")).collect()
        told = [r for r in got if brute.words(r.text)]
        assert sum(r.language == r.lang for r in told) >= 0.97 * len(told) > 50


def test_posterior_is_bayes_rule(spark, docs):
    """The posterior against a plain computation from the same text likelihoods."""
    import math

    import pyarrow as pa

    model = language.train(docs, "doc_id", "text", "lang")
    rows = docs.select("doc_id", F.substring("text", 1, 9).alias("text"), F.when(F.col("doc_id") % 5 > 0, F.col("lang")).alias("declared"), F.when(F.col("doc_id") % 7 > 0, F.concat("source", F.when(F.col("doc_id") % 2 == 0, ".de").otherwise(".org"))).alias("host"))
    rows = rows.withColumn("suffix", F.when(F.col("doc_id") % 7 > 0, language.suffix_of(F.col("host"))).when(F.col("doc_id") % 14 == 0, "de"))
    got = {r.doc_id: r for r in language.identify(rows, model, declared=F.col("declared"), host=F.col("host"), suffix=F.col("suffix")).collect()}
    data = [r.asDict() for r in rows.collect()]
    ll, _ = model.evidence(pa.array([r["text"] for r in data], pa.large_string()))
    k, counts = len(model.languages), collections.defaultdict(lambda: np.zeros(len(model.languages)))
    for r, x in zip(data, ll, strict=True):
        if x.max() > 0:
            for name in ("declared", "host", "suffix", None):
                counts[name, r[name] if name else None][int(x.argmax())] += 1
    total = counts[None, None]
    base = (total + 1) / (total.sum() + k)
    for r, x in zip(data, ll, strict=True):
        of = lambda name: counts[name, r[name]] if r[name] is not None and (name, r[name]) in counts else np.zeros(k)
        group = (of("suffix") + 20 * base) / (of("suffix").sum() + 20)
        prior = (of("host") + 20 * group) / (of("host").sum() + 20)
        said = (of("declared") + 20 * base) / (total + 20) if r["declared"] is not None else np.ones(k)
        log = x + np.log(prior) + np.log(said)
        post = np.exp(log - log.max()) / np.exp(log - log.max()).sum()
        assert math.isclose(got[r["doc_id"]].posterior, post.max(), rel_tol=1e-9) and got[r["doc_id"]].language == model.languages[int(log.argmax())]


def test_rare_languages_are_known_and_unknown_ones_rejected(spark, docs):
    rows = docs.filter("length(text) > 200")
    rare = [r.doc_id for r in rows.filter("lang = 'fr'").orderBy("doc_id").limit(3).collect()]
    model = language.train(rows.filter("lang <> 'de'").filter((F.col("lang") != "fr") | F.col("doc_id").isin(rare)), "doc_id", "text", "lang", sample=10)
    assert model.languages == ["en", "es", "fr"]
    got = language.identify(rows, model).collect()
    told = lambda x: [r.accepted and r.language == x for r in got if r.lang == x]
    assert all(sum(told(x)) >= 0.9 * len(told(x)) > 0 for x in model.languages)
    assert sum(r.accepted for r in got if r.lang == "de") <= 0.05 * len(told("de"))


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_sharding(odd, empty, clashing, shards):
    got = sharding.shard(odd, shards).collect()
    assert len(got) == len(ODD)
    slots = collections.defaultdict(list)
    for r in got:
        assert r["size"] == len((r.text or "").encode()) + 1
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and max(slots) < shards
    assert sharding.shard(empty, shards).collect() == [] and sharding.shard(clashing, shards).count() == len(ODD)


def test_sharding_of_a_hot_group(spark, monkeypatch):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1500, F.lit("same " * 20)).otherwise(F.concat(F.lit("t"), F.col("id"), F.lit(" x" * 30))).alias("text"))
    got = sharding.shard(rows, 4, range_bytes=4000).collect()
    sizes = collections.Counter()
    for r in got:
        sizes[r.shard] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) < 0.02 * sum(sizes.values()) / 4
    small = sharding.shard(rows.withColumn("text", F.concat(F.lit("pair"), F.floor(F.col("doc_id") / 2))), 4).collect()
    shards = collections.defaultdict(set)
    for r in small:
        shards[r.text].add(r.shard)
    assert all(len(s) == 1 for s in shards.values())


def test_sharding_in_many_rounds_and_steps(spark, monkeypatch):
    """More rounds of subdividing than six, ranges in steps, one id in a third of the rows: slots stay gapless and sizes near equal."""
    monkeypatch.setattr(sharding, "OVERSAMPLE", 1)
    monkeypatch.setattr(sharding, "OVERFULL", 0.05)
    rows = spark.range(750).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, "one text").otherwise(F.concat(F.lit("t "), "id")).alias("text"), F.col("id").alias("more")
    )
    rounds = []
    cut = sharding._cut
    monkeypatch.setattr(sharding, "_cut", lambda *a: rounds.append(1) or cut(*a))
    for most, step in ((1 << 14, 100), (16, 100), (16, 8 << 20)):
        monkeypatch.setattr(sharding, "MAX_RANGES", most)
        slots, sizes = collections.defaultdict(list), collections.Counter()
        for r in sharding.shard(rows, 4, range_bytes=step).collect():
            slots[r.shard].append(r.slot)
            sizes[r.shard] += r["size"]
        assert sum(map(len, slots.values())) == 750 and all(sorted(v) == list(range(len(v))) for v in slots.values())
        assert max(sizes.values()) - min(sizes.values()) <= 0.03 * sum(sizes.values())
    assert len(rounds) > 20


def test_steps_keep_the_order(spark):
    """Later rows of a range stand in the same or a later step, also in ranges inside a group of equal texts."""
    cuts, steps = [(-(2**62), sharding._LEAST), (5, sharding._LEAST), (5, 0), (5, 2**61), (2**62, sharding._LEAST)], [3, 7, 2, 4, 5, 1]
    rng = np.random.default_rng(4)
    rows = [(int(g), int(d)) for g, d in rng.integers(-(2**63), 2**63 - 1, (500, 2))] + [(5, int(d)) for d in rng.integers(-(2**63), 2**63 - 1, 300)] + cuts + [(2**63 - 1, 2**63 - 1), (-(2**63), -(2**63))]
    found = spark.createDataFrame(rows, "g long, d long").withColumn("__r", sharding._range_of(cuts)).withColumn("__s", sharding._step_of(cuts, steps)).collect()
    in_order = [(r["__r"], r["__s"]) for r in sorted(found, key=lambda r: (r.g, r.d))]
    assert in_order == sorted(in_order) and {r for r, _ in in_order} == set(range(6)) and all(0 <= s < steps[r] for r, s in in_order)
    assert len({s for r, s in in_order if r == 1}) > 3 and len({s for r, s in in_order if r == 2}) == 2


def test_write_shards(spark, odd, tmp_path):
    sharding.write_shards(sharding.shard(odd, 3), f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == len(ODD)


def test_line_dedup(odd, empty, clashing):
    got = line_dedup.dedup_lines(odd).collect()
    assert counted(got, "doc_id", "n_lines", "n_dropped") == collections.Counter((i, len((t or "").split("\n")), 0) for i, t in TEXTS)
    assert line_dedup.dedup_lines(empty).collect() == []
    assert line_dedup.dedup_lines(clashing).count() == len(ODD)


def test_line_dedup_against_brute_force(spark):
    rng = np.random.default_rng(2)
    pool = [f"Line number {i} of the POOL Éé" for i in range(30)] + ["short", "  Line number 3 of the pool éé\t", "line NUMBER 4 of the pool Éé", ""]
    docs = {i: "\n".join(pool[j] for j in rng.integers(0, len(pool), rng.integers(0, 12))) for i in range(60)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    for batches, fanout in ((1, 2), (5, 2), (7, 3)):
        got = line_dedup.dedup_lines(df, least_batches=batches, most_batches=batches, fanout=fanout).collect()
        assert {r.doc_id: (r.n_lines, r.n_dropped, brute.sha(r.text)) for r in got} == brute.lines(docs)


def test_line_dedup_of_null_and_repeated_ids(spark):
    line = "a line of more than twenty characters"
    rows = [(None, line), (1, line), (2, line), (2, line), (2, line + "\nother")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert counted(got, "doc_id", "n_dropped") == {(None, 1): 1, (1, 1): 1, (2, 0): 3}
    got = line_dedup.dedup_lines(spark.createDataFrame(rows[1:], "doc_id long, text string")).collect()
    assert {r.n_dropped for r in got} == {0}  # two documents only


def test_runs_are_compacted_by_levels(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(1, 1, b), (b, 7, b)], "k1 long, k2 long, doc long"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    for plan in (runs._merge(runs._runs()), spark.table(runs.names[0]).join(spark.table(runs.names[-1]).hint("merge"), ["k1", "k2"])):
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()  # runs lie as their joins and merges need them
    tally = {(r.k1, r.k2): (r.n_docs, r.last_doc) for r in runs.tally().collect()}
    assert tally[(1, 1)] == (5, 4) and tally[(3, 7)] == (1, 3)
    lines = spark.createDataFrame([(1, 1, 0), (1, 1, 4), (3, 7, 3)], "k1 long, k2 long, doc long")
    assert {r.doc for r in runs.split(lines, 3, "left_anti").collect()} == {4, 3} and {r.doc for r in runs.split(lines, 3, "left_semi").collect()} == {0}


def test_settled_keys_take_no_more(spark):
    runs = line_dedup.LineRuns(spark, fanout=2, settle=3)
    for docs in ((9, 8), (7, 6), (5, 4), (3,)):
        runs.add(spark.createDataFrame([(1, 1, d) for d in docs] + [(docs[0], 7, docs[0])], "k1 long, k2 long, doc long"))
    tally = {(r.k1, r.k2): (r.n_docs, r.last_doc) for r in runs.tally().collect()}
    assert tally[(1, 1)] == (4, 9) and tally[(3, 7)] == (1, 3)  # settled by the second batch
    names = list(runs.names)
    runs.drop()
    assert names and runs.tally().count() == 0 and not any(spark.catalog.tableExists(n) for n in names)


def test_merging_more_runs_takes_no_more_joins(spark, monkeypatch):
    joins, write, tables = [], line_dedup.LineRuns._write, {x.name for x in spark.catalog.listTables()}
    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()

    def counted_write(self, df, level):
        joins.append((level, plan_of(df).count("SortMergeJoin")))
        write(self, df, level)

    monkeypatch.setattr(line_dedup.LineRuns, "_write", counted_write)
    runs, held, rng = line_dedup.LineRuns(spark, fanout=3, settle=5), collections.defaultdict(list), np.random.default_rng(4)
    for b in range(8):
        batch = [(int(k), -int(k), 100 - 10 * b - i) for i in range(10) for k in rng.integers(0, 60, 8)]
        runs.add(spark.createDataFrame(batch, "k1 long, k2 long, doc long"))
        for k in {k for k, _, _ in batch if len(held[k]) < 5}:
            held[k] += {doc for key, _, doc in batch if key == k}
    assert {level: max(n for x, n in joins if x == level) for level, _ in joins} == {0: 2, 1: 0}
    merged = runs._merge(runs._runs())
    assert len(runs._runs()) == 4 and "Join" not in plan_of(merged) and "Exchange" not in plan_of(merged)
    rows = merged.collect()  # one row for each key, though runs share keys
    assert len(rows) == len(held) and {r.k1: (r.k2, r.n_docs, r.last_doc) for r in rows} == {k: (-k, len(d), max(d)) for k, d in held.items()}
    runs.drop()
    assert {x.name for x in spark.catalog.listTables()} == tables


def test_a_shared_folder_is_asked_for_and_cleared(spark):
    from types import SimpleNamespace as N

    from tempolake.llm import shared

    far = N(conf=N(get=lambda k, *d: d[0] if d else "file:/here"), sparkContext=N(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(far)
    shared.stored(spark.range(3))
    assert shared.remove_old(spark, hours=1) == 0


def test_a_feed_admits_new_lines_only(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    seen, batches = set(), [[(1, 1, 5), (1, 1, 6), (2, 2, 5)], [(2, 2, 7), (3, 3, 7)], [(1, 1, 8), (4, 4, 8)], []]
    for batch in batches:
        got = {tuple(r) for r in runs.admit(spark.createDataFrame(batch, "k1 long, k2 long, doc long")).collect()}
        assert got == {r for r in batch if r[0] not in seen}
        seen |= {r[0] for r in batch}


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("vec_id", topk.quantised(F.col("embedding")).alias("vector"))


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8) * rng.choice([0.01, 1, 3, 50])]) for i in range(300)]
    rows += [(400 + i, rows[5][1]) for i in range(20)] + [(500, [0.0] * 8), (501, None), (502, [float("nan")] * 8), (503, [1.0, None] * 4), (504, [float("inf")] * 8), (505, []), (None, [1.0] * 8)]
    exact = {i: np.floor(1024 * np.array(v, dtype=np.float32).astype(np.float64)).astype(np.int64) for i, v in rows if i is not None and i <= 500}
    exact[505] = np.zeros(8, dtype=np.int64)
    base = vectors(spark, rows).repartition(5)
    for chunk, block, seeds, steep in ((8192, 1024, 2048, 0.5), (40, 7, 15, 0.1), (40, 7, 15, 2.0)):
        for k, v in (("CHUNK", chunk), ("BLOCK", block), ("SEEDS", seeds), ("STEEP", steep)):
            monkeypatch.setattr(topk, k, v)
        got = topk.exact_top_k(base, base.filter("vec_id % 5 = 0"), 10).collect()
        assert {tuple(r) for r in got} == brute.top_k(exact, [i for i in exact if i % 5 == 0])


def test_top_k_of_few_and_none(spark):
    two = vectors(spark, [(0, [1.0, 2.0]), (100, [1.0, 2.0])])
    assert {tuple(r) for r in topk.exact_top_k(two, two, 10).collect()} == {(0, 1, 100, 5 << 20), (100, 1, 0, 5 << 20)}
    none = two.limit(0)
    assert topk.exact_top_k(none, two).collect() == [] and topk.exact_top_k(two, none).collect() == []
    far = vectors(spark, [(0, [1e15, 1.0]), (1, [1e15, -1.0]), (2, [-1e15, 0.0])])
    assert [(r.id, r.score) for r in sorted(topk.exact_top_k(far, far.filter("vec_id = 0")).collect(), key=lambda r: r.rank)] == [(1, 2**63 - 1), (2, -(2**63))]


def coder():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_bpe(odd, empty, clashing):
    own = coder()
    got = bpe.encode(odd, RANKS, P.PATTERN, decoded="decoded").collect()
    assert len(got) == len(ODD)
    for r in got:
        ids = own.encode_ordinary(r.text or "")
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids) and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(empty, RANKS, P.PATTERN).collect() == []
    assert bpe.encode(clashing, RANKS, P.PATTERN).count() == len(ODD)
    back = bpe.decode(bpe.encode(odd, RANKS, P.PATTERN), RANKS).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back)


def test_bpe_on_random_text():
    import random

    rng, own = random.Random(1), coder()
    encoder = bpe.Encoder(bpe.Merges(bpe.read_ranks(RANKS)), P.PATTERN)
    texts = ["aaaaaaaaaaaaa", "abababab" * 40, "a" * 20_000] + ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x2FFF), 32, 0x1F600])) for _ in range(rng.randint(1, 200))) for _ in range(500)]
    for _ in range(2):  # the second time from the cache
        assert [x.tolist() for x in encoder.encode(texts)] == [own.encode_ordinary(t) for t in texts]
    with pytest.raises(ValueError):
        bpe.Merges({b"a": 0})


def test_jaccard(odd, empty, clashing):
    got = jaccard.jaccard_components(odd, n=3, num=90, den=100).collect()
    assert counted(got, "doc_id", "n_shingles") == collections.Counter((i, len(brute.shingle_set(t, 3))) for i, t in TEXTS)
    assert {r.component_id for r in got if r.doc_id is None} == {None} and {r.doc_id: r.component_id for r in got if r.doc_id and r.doc_id not in (8, 7)} == {i: i for i, _ in TEXTS if i and i not in (8, 7)}
    assert jaccard.jaccard_components(empty).collect() == [] and jaccard.jaccard_components(clashing).count() == len(ODD)


def near_copies(rng, base_words, copies, edits):
    base = [f"b{x}" for x in rng.integers(0, 10**6, base_words)]
    out = [" ".join(base)]
    for _ in range(copies):
        w = list(base)
        for _ in range(int(rng.integers(0, edits + 1))):
            w[int(rng.integers(0, len(w)))] = f"e{rng.integers(0, 50)}"
        out.append(" ".join(w[: int(rng.integers(base_words - 4, base_words + 1))]))
    return out


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80), (1, 50)])
@pytest.mark.parametrize("cell", [2_000_000, 3000])
def test_jaccard_against_brute_force(spark, monkeypatch, n, num, cell):
    monkeypatch.setattr(jaccard, "CELL_TOKENS", cell)
    monkeypatch.setattr(jaccard, "TILE_TOKENS", min(cell, 1 << 15) // 4)
    monkeypatch.setattr(jaccard, "HOT", 8)
    monkeypatch.setattr(jaccard, "SAMPLE", 1)
    rng = np.random.default_rng(n)
    passage = " ".join(f"p{i}" for i in range(12))
    texts = near_copies(rng, 60, 120, 6) + near_copies(rng, 12, 60, 3) + near_copies(rng, 300, 40, 25) + [f"{passage} " + " ".join(f"r{x}" for x in rng.integers(0, 10**6, rng.integers(1, 20))) for _ in range(60)]
    texts += texts[:15] + ["Two WORDS", "two words", ""]
    docs = dict(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5), n=n, num=num).collect()}
    sets = {i: brute.shingle_set(t, n) for i, t in docs.items()}
    same = brute.components(sets, num, 100)
    assert got == {i: (len(sets[i]), same[i]) for i in docs}


def test_signatures_find_every_link():
    """Sets that differ in as many elements as linked sets can share a signature."""
    rng = np.random.default_rng(9)
    for num in (50, 80, 90):
        for size in (9, 10, 18, 19, 40, 71, 150, 600):
            for _ in range(20):
                a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64) * np.uint64(2) + np.uint64(1))
                apart = jaccard.most_apart(len(a), num, 100)
                grown = int(rng.integers(0, apart + 1))
                drop = min(len(a) - 1, (apart - grown) // 2) if grown < apart else 0
                b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 2**63, grown).astype(np.uint64)]))
                common = len(np.intersect1d(a, b))
                if 100 * common >= num * (len(a) + len(b) - common) and common < max(len(a), len(b)):
                    assert set(jaccard.signatures(a, num, 100).tolist()) & set(jaccard.signatures(b, num, 100).tolist())


def test_no_link_is_lost_at_any_threshold():
    """Linked pairs of 1 to 40 elements, thresholds from 10 to 100 %, sets spread over the hash range and crowded: each set's bound on shared signatures holds."""
    rng = np.random.default_rng(10)
    pairs = 0
    while pairs < 20_000:
        num, a = int(rng.integers(10, 101)), int(rng.integers(1, 41))
        common = int(rng.integers(1, a + 1))
        more = common * 100 // num - a
        if more < 0 or (common == a and not more):
            continue
        more = more if rng.random() < 0.7 else int(rng.integers(0, more + 1))
        drawn = rng.integers(0, 2**64, a + more, dtype=np.uint64) >> np.uint64(rng.integers(0, 12) * (rng.random() < 0.5))
        if len(np.unique(drawn)) < a + more or (common == a and not more):
            continue
        one, other = np.sort(drawn[:a]), np.sort(np.r_[drawn[:common], drawn[a:]])
        (x, least_x), (y, least_y) = jaccard.signed_set(one, num, 100), jaccard.signed_set(other, num, 100)
        assert len(np.intersect1d(x, y)) >= max(1, least_x, least_y), (num, a, common, more)
        pairs += 1


def test_sets_that_share_a_little_with_many_make_no_family(spark, monkeypatch):
    """Each document shares a third with each of three others: enough signatures with all of them, too few with any."""
    n, sent, compare = 60, [], jaccard._links

    def counted_links(rows, num, den):
        sent.append(rows.count())
        return compare(rows, num, den)

    monkeypatch.setattr(jaccard, "CELL_TOKENS", 2000)
    monkeypatch.setattr(jaccard, "_links", counted_links)
    block = lambda name: " ".join(f"w{name}x{j}" for j in range(116))
    docs = [(i, f"{block(i)} {block((i + 1) % n)} {block(f'y{i % (n // 2)}')}") for i in range(n)]
    got = jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), n=1, num=80).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i for i in range(n)} and all(r.n_shingles == 348 for r in got)
    assert sent[0] >= n and sum(sent[1:]) <= n  # by leads, and as a whole: not each document for each cell


@pytest.mark.parametrize("paired", [0, 16])
@pytest.mark.parametrize(("n", "num"), [(1, 80), (3, 90)])
def test_rarest_signatures_show_every_link(spark, monkeypatch, paired, n, num):
    """Chains that drift away from their first document, so that many links are left for the comparison as a whole."""
    monkeypatch.setattr(jaccard, "CELL_TOKENS", 3000)
    monkeypatch.setattr(jaccard, "PAIRED", paired)
    rng, texts = np.random.default_rng(13 + n), []
    for words, most in ((200, 14), (60, 5), (15, 1), (90, 7)):
        now = [f"a{x}" for x in rng.integers(0, 10**6, words)]
        for _ in range(60):
            for at in rng.integers(0, words, int(rng.integers(1, most + 1))):
                now[int(at)] = f"a{rng.integers(0, 10**6)}"
            texts.append(" ".join(now))
    docs = dict(enumerate(texts[int(i)] for i in rng.permutation(len(texts))))
    got = jaccard.jaccard_components(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), n=n, num=num).collect()
    assert {r.doc_id: r.component_id for r in got} == brute.components({i: brute.shingle_set(t, n) for i, t in docs.items()}, num, 100)


def test_similarity_must_be_a_share(odd):
    for num, den in ((0, 100), (-1, 2), (101, 100)):
        with pytest.raises(ValueError, match="similarity"):
            jaccard.jaccard_components(odd, num=num, den=den)


def test_sets_in_few_parts_share_a_signature():
    """Linked sets whose elements stand in few parts of the hash range, as the pigeonhole rule alone loses them."""
    rng = np.random.default_rng(11)
    for num in (50, 80, 90):
        for size in (4, 5, 9, 10, 18, 20, 40, 150):
            for spread in (2, 30, 61):  # the elements stand below 2 to this power, or in all parts
                for _ in range(20):
                    top = min(63, spread + 8)
                    a = np.unique(rng.integers(0, 2**top, size).astype(np.uint64))
                    b = np.unique(np.concatenate([a, rng.integers(0, 2**top, jaccard.most_apart(len(a), num, 100)).astype(np.uint64)]))
                    if len(a) < len(b):
                        (x, least_x), (y, least_y) = jaccard.signed_set(a, num, 100), jaccard.signed_set(b, num, 100)
                        assert len(set(x.tolist()) & set(y.tolist())) >= max(1, least_x, least_y)


def test_short_near_copies_in_one_part_are_linked(spark):
    import pyarrow as pa

    rng = np.random.default_rng(12)
    texts = [" ".join(f"s{x}" for x in row) for row in rng.integers(0, 10**6, (40_000, 9)).tolist()]
    one = [t for t, s in zip(texts, jaccard.sets_of(pa.array(texts, pa.large_string()), 5), strict=True) if len(set((s >> np.uint64(61)).tolist())) == 1]
    assert one
    docs = [x for t in one for x in (t.rsplit(" ", 1)[0], t)]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), n=5, num=80).collect()}
    assert got == {i: i - i % 2 for i in range(len(docs))}


def test_quality_rules(odd, empty, clashing):
    got = quality_rules.quality_rules(odd).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert counted(got, "doc_id", *names) == collections.Counter((i, *brute.base_rules(t)) for i, t in TEXTS)
    assert quality_rules.quality_rules(empty).collect() == [] and quality_rules.quality_rules(clashing).count() == len(ODD)


def test_frequent_lines_deplete_documents(spark):
    menu = "Home About Contact Imprint and many other words of a menu that every page of this host has got"
    own = lambda i: " ".join(f"own{i}x{j}" for j in range(60))
    rows = [(i, f"{menu}\n{own(i)}", "a") for i in range(40)] + [(100 + i, f"{menu} \nfew own words {i} here", "a") for i in range(3)] + [(200, f"{menu}\nfew words", "b"), (201, f"{menu}\nfew words", None)]
    rows += [(300 + i, f"a page that the host serves again and again {own(0)}", "c") for i in range(50)] + [(400 + i, f"{own(i)}\nfew copies", "d") for i in range(9)]
    rows += [(None, f"{menu}\n{own(i)}", "e") for i in range(30)]  # one document, as they share an id
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()}
    assert all(got[i].kept and got[i].n_removed_words == 19 for i in range(40)) and not any(got[100 + i].kept for i in range(3))
    assert got[200].kept and got[201].kept and not any(got[300 + i].kept for i in range(50)) and all(got[400 + i].kept for i in range(9))
    assert got[None].n_removed_words == 0


def test_line_limits_of_small_and_large_hosts(spark):
    """9 documents are too few anywhere, 1 % is the limit between 1,000 and 10,000 documents, 100 from there on."""
    line = lambda k: f"a line that {k} documents of this host hold, beside other lines"
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 10_500, "large").when(F.col("id") < 11_900, "middle").otherwise("small").alias("source"))
    place = F.col("doc_id") - F.when(F.col("source") == "large", 0).when(F.col("source") == "middle", 10_500).otherwise(11_900)
    text = F.concat_ws("\n", F.concat(F.lit("own words "), "doc_id", F.lit(" own" * 30)), *[F.when(place < k, line(k)) for k in (9, 10, 13, 14, 99, 100)])
    got = quality_rules.quality_rules(docs.withColumn("text", text)).withColumnRenamed("doc_id", "id").join(docs, F.col("id") == F.col("doc_id"))
    first = {r.source: r.n for r in got.groupBy("source").agg(F.max("n_removed_words").alias("n")).collect()}
    words = 12  # of each of these lines
    assert first == {"small": 5 * words, "middle": 3 * words, "large": words}


def brute_kept(docs):
    """{doc_id: (n_removed_words, kept)}; docs: {doc_id: (text, host)}."""
    held, size = collections.defaultdict(set), collections.Counter(host for _, host in docs.values())
    lines = {i: [(x.strip(brute.SPACES).lower(), len(brute.words(x))) for x in (t or "").split("\n") if brute.words(x)] for i, (t, _) in docs.items()}
    for i, found in lines.items():
        for x, _ in found:
            held[docs[i][1], x].add(i)
    out = {}
    for i, (t, host) in docs.items():
        gone = sum(n for x, n in lines[i] if len(held[host, x]) >= 10 and (len(held[host, x]) >= 100 or 100 * len(held[host, x]) >= size[host]))
        n, *_, repeated = brute.base_rules(t)
        out[i] = (gone, n >= 20 and 100 * repeated <= 30 * n and 100 * (n - gone) >= 50 * n)
    return out


def test_quality_rules_against_brute_force(spark):
    """On the largest tables the rule removes words and rejects documents that pass the base rules."""
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = {r.doc_id: r for r in quality_rules.quality_rules(table).collect()}
    assert {i: (r.n_removed_words, r.kept) for i, r in got.items()} == brute_kept({r.doc_id: (r.text, r.source) for r in table.collect()})
    assert sum(r.n_removed_words > 0 for r in got.values()) > 1000 and any(not r.kept and not r.base_failed for r in got.values())


def test_components(spark):
    from tempolake.llm.components import components

    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 201)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_digest_of_ids_is_little_endian(odd):
    r = bpe.encode(odd.filter("doc_id = 9"), RANKS, P.PATTERN).select("ids", F.sha2("ids", 256).alias("s")).first()
    assert r.s == hashlib.sha256(np.array(coder().encode_ordinary(ODD[10][1]), "<u4").tobytes()).hexdigest()
