"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Documents are cut into blocks of consecutive words. A source whose target is f whole passes and a
rest gives every block f times, and for the rest the first blocks of a permutation (by a hash) up to the
target's last word. That fixes each source's quota of blocks exactly. A binary tree over the output shards
then splits the vector of quotas: each node draws, without replacement, how many blocks of each source
go left. The blocks of a source, in a second permutation, are dealt to the shards in
disjoint runs of these lengths, and each shard orders its own by a hash.

Ranks and running sums inside a source come from counts of hash ranges, so a source with a third of
all rows is spread over all tasks. The driver holds one row for each source, as the weights are, and the quotas
of all sources and shards, ``MAX_ENTRIES`` at most; more are refused.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, hidden, n_words, stored

#: Hash ranges of a source hold about so many words; there are at most 2 to MAX_BITS.
RANGE_WORDS, MAX_BITS = 1 << 21, 18
SHARD_WORDS = 1 << 26
#: The most figures by source and shard: 64 MB, which every task may hold.
MAX_ENTRIES = 1 << 23


def cycle_weights(sources: Sequence[str | None]) -> list[int]:
    """3, 1, 2, repeating, over the sources in order."""
    return [(3, 1, 2)[i % 3] for i in range(len(sources))]


def targets(sizes: Sequence[int], weights: Sequence[int], share: Fraction = Fraction(3, 2), most: int = 2) -> list[Fraction]:
    """Shares of ``share`` times all sizes by weight; what exceeds ``most`` times a source's
    size is shared again by weight among the others, until none is above."""
    rest, free, out = share * sum(sizes), set(range(len(sizes))), [Fraction(0)] * len(sizes)
    while free:
        total = sum(weights[i] for i in free)
        full = {i for i in free if rest * weights[i] > most * sizes[i] * total}
        if not full:
            for i in free:
                out[i] = rest * weights[i] / total
            break
        for i in full:
            out[i] = Fraction(most * sizes[i])
        rest -= sum(out[i] for i in full)
        free -= full
    return out


def _stirling_error(n: int) -> float:
    """log n! less Stirling's formula."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / n / n) / n / n) / n / n) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x, also where the two are close."""
    d = x - mean
    if abs(d) < 0.1 * (x + mean):
        v = d / (x + mean)
        total, term, k = d * v, 2 * x * v, 1
        while True:
            term *= v * v
            more = total + term / (2 * k + 1)
            if more == total:
                return total
            total, k = more, k + 1
    return x * math.log(x / mean) - d


def _log_binomial(x: int, n: int, p: float, q: float) -> float:
    """log of the binomial probability, to double precision at any size."""
    if x == 0:
        return n * (math.log1p(-p) if p < 0.5 else math.log(q))
    if x == n:
        return n * (math.log1p(-q) if q < 0.5 else math.log(p))
    return (
        _stirling_error(n) - _stirling_error(x) - _stirling_error(n - x) - _deviance(x, n * p) - _deviance(n - x, n * q)
        + 0.5 * math.log(n / (2 * math.pi * x * (n - x)))
    )


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many good ones are among n drawn without replacement: one law, by rejection, for populations of any size.

    The law is log-concave, so p min(1, exp(1 - p |k - mode|)) is above it, where p is its probability of the mode."""
    if not n or not good:
        return 0
    if n == good + bad or not bad:
        return min(good, n)
    p, q = n / (good + bad), (good + bad - n) / (good + bad)
    log = lambda k: _log_binomial(k, good, p, q) + _log_binomial(n - k, bad, p, q)
    mode = (n + 1) * (good + 1) // (good + bad + 2)
    top, low, high = log(mode), max(0, n - bad), min(n, good)
    peak = math.exp(top - _log_binomial(n, good + bad, p, q))
    w = 1 + peak / 2
    while True:
        u, v, x = rng.random(), 1 - rng.random(), 1 - rng.random()
        y = v * w / peak if u <= w / (1 + w) else (w - math.log(v)) / peak
        k = mode + (1 if rng.random() < 0.5 else -1) * round(y)
        if low <= k <= high and math.log(x) + min(0.0, w - peak * y) <= log(k) - top:
            return k


def split_quotas(quotas: Sequence[int], n_shards: int, seed: int) -> np.ndarray:
    """How many blocks of each source (rows) each shard (columns) gets: every shard gets an even
    part of all blocks, and every source's blocks go somewhere."""
    rng = np.random.default_rng(seed)
    out = np.zeros((len(quotas), n_shards), dtype=np.int64)

    def node(have: list[int], a: int, b: int) -> None:
        if b - a == 1:
            out[:, a] = have
            return
        middle, total = (a + b) // 2, sum(have)
        left = total * (middle - a) // (b - a)
        go, rest = [], total
        for h in have:  # one hypergeometric draw for each source, given those before
            rest -= h
            x = hypergeometric(rng, h, rest, left)
            go.append(x)
            left -= x
        node(go, a, middle)
        node([h - x for h, x in zip(have, go, strict=True)], middle, b)

    node([int(q) for q in quotas], 0, n_shards)
    return out


@dataclass
class Mix:
    #: (key, doc, t, copy, size): one row for each input row; key stands for the source.
    documents: DataFrame
    #: (key, source, source_size, target, weight)
    sources: DataFrame
    #: (key, doc, t, copy, block, epoch, words, taken, shard, place): the mix.
    blocks: DataFrame
    block_words: int


def _ends_before(ends: Column, rank: Column, n: int) -> Column:
    """How many of n ascending ends are not beyond the rank: a binary search."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(n.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, w: F.when(F.get(ends, at + w - 1) <= rank, at + w).otherwise(at))


def _key(source: str) -> Column:
    c = F.col(f"`{source}`").cast("string")
    return F.when(c.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), c))


def mix(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weigh: Callable[[Sequence[str | None]], list[int]] = cycle_weights,
    share: Fraction = Fraction(3, 2), n_shards: int | None = None, block_words: int = 256, seed: int = 7,
) -> Mix:
    """Plans the mix of a table. Sources are ordered by code point, null last.

    Without ``n_shards``, there are 16 or one for each SHARD_WORDS words, so that a
    shard can be ordered by one task.

    Null and empty texts have size 0 and no blocks. Rows that repeat each other are documents of their
    own. Every draw hangs on hashes and the seed only, so reruns agree. An empty table gives an
    empty mix.
    """
    spark = df.sparkSession
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = df.select(_key(source).alias("key"), F.col(f"`{id_col}`").cast("long").alias("doc"), F.xxhash64(body).alias("t"), n_words(body).alias("size"))
    documents = stored(
        rows.groupBy("key", "doc", "t", "size").count().select("key", "doc", "t", "size", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("copy"))
    )
    by_key = documents.groupBy("key").agg(F.sum("size").alias("size"))
    stats = sorted(by_key.limit(MAX_ENTRIES // 16 + 1).collect(), key=lambda r: (not r.key, r.key))  # a row for each source, of a bounded number
    if len(stats) * (n_shards or 16) > MAX_ENTRIES:
        raise ValueError(f"too many sources to mix: {len(stats)} times the shards is over {MAX_ENTRIES}")
    names, sizes = [r.key[1:] if r.key else None for r in stats], [int(r["size"]) for r in stats]
    n_shards = n_shards or max(16, -(-sum(sizes) // SHARD_WORDS))
    if len(names) * n_shards > MAX_ENTRIES:
        raise ValueError(f"{len(names)} sources times {n_shards} shards are over {MAX_ENTRIES}; mix fewer sources or name fewer shards")
    weights = weigh(names)
    goal = targets(sizes, weights, share)
    whole = [0 if not s else int(g) // s for s, g in zip(sizes, goal, strict=True)]
    rest = [round(g) - f * s for s, g, f in zip(sizes, goal, whole, strict=True)]
    keys = [r.key for r in stats]
    # figures by source, and by source and shard, have MAX_ENTRIES entries at most
    sources = F.broadcast(
        spark.createDataFrame([(k, n, s, float(g), w) for k, n, s, g, w in zip(keys, names, sizes, goal, weights, strict=True)], "key string, source string, source_size long, target double, weight int")
    )
    plan = F.broadcast(spark.createDataFrame([(k, f, r) for k, f, r in zip(keys, whole, rest, strict=True)], "key string, passes int, rest long"))
    bits = min(MAX_BITS, max(6, (sum(sizes) // RANGE_WORDS).bit_length()))

    blocks = (
        documents.filter("size > 0")
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.expr(f"cast((size - 1) div {block_words} as int)"))))
        .withColumn("words", F.least(F.lit(block_words), F.col("size") - F.col("block") * block_words).cast("long"))
        .withColumn("u", F.xxhash64("doc", "t", "copy", "block", F.lit(seed)))
        .withColumn("range", F.shiftrightunsigned("u", 64 - bits))
        .join(plan, "key")
    )
    by_source = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = blocks.filter("rest > 0").groupBy("key", "range", "rest").agg(F.sum("words").alias("words")).withColumn("upto", F.sum("words").over(by_source))
    crossing = filled.filter("upto >= rest AND upto - words < rest").select("key", "range", (F.col("upto") - F.col("words")).alias("before")).collect()  # a row for each source
    edge = F.broadcast(spark.createDataFrame([(r.key, int(r.range), int(r.before)) for r in crossing], "key string, edge long, before long"))
    partial = blocks.filter("rest > 0").join(edge, "key").filter("range <= edge")
    order = Window.partitionBy("key").orderBy("u", "doc", "t", "copy", "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = partial.filter("range = edge").withColumn("left", F.col("rest") - F.col("before") - F.sum("words").over(order) + F.col("words"))
    columns = ["key", "doc", "t", "copy", "block", "epoch", "words", "taken", "u"]
    chosen = (
        blocks.filter("passes > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("passes") - 1))).withColumn("taken", F.col("words")).select(columns)
        .union(partial.filter("range < edge").withColumn("epoch", F.col("passes")).withColumn("taken", F.col("words")).select(columns))
        .union(last.filter("left > 0").withColumn("epoch", F.col("passes")).withColumn("taken", F.least("left", "words")).select(columns))
    )
    chosen = stored(chosen.withColumn("v", F.xxhash64("u", "epoch", F.lit(seed + 1))).drop("u").withColumn("range", F.shiftrightunsigned("v", 64 - bits)))
    ranges = chosen.groupBy("key", "range").agg(F.count(F.lit(1)).alias("n"))
    quota = {r.key: r.n for r in ranges.groupBy("key").agg(F.sum("n").alias("n")).collect()}  # a row for each source
    drawn = split_quotas([quota.get(k, 0) for k in keys], n_shards, seed).cumsum(axis=1)
    ends = F.broadcast(spark.createDataFrame([(k, row.tolist()) for k, row in zip(keys, drawn, strict=True)], "key string, ends array<long>"))
    before = ranges.withColumn("before", F.sum("n").over(by_source) - F.col("n")).select("key", "range", "before")
    in_range = Window.partitionBy("key", "range").orderBy("v", "doc", "t", "copy", "block", "epoch")
    ranked = chosen.join(before, ["key", "range"]).withColumn("rank", F.col("before") + F.row_number().over(in_range) - 1)
    shard = _ends_before(F.col("ends"), F.col("rank"), n_shards)
    local = Window.partitionBy("shard").orderBy(F.xxhash64("v", F.lit(seed + 2)), "key", "rank")
    placed = ranked.join(ends, "key").withColumn("shard", shard).withColumn("place", F.row_number().over(local) - 1)
    return Mix(documents, sources, placed.select("key", "doc", "t", "copy", "block", "epoch", "words", "taken", "shard", "place"), block_words)


def taken(m: Mix) -> DataFrame:
    """(doc, size, source, source_size, target, taken, n_blocks, first_shard): what the mix takes of every row."""
    got = m.blocks.groupBy("key", "doc", "t", "copy").agg(F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("n_blocks"), F.min("shard").alias("first_shard"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) if c == "doc" else F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("key", "doc", "t", "copy")]
    joined = m.documents.alias("a").join(got.alias("b"), same, "left").select("a.key", "a.doc", "a.size", "b.taken", "b.n_blocks", "b.first_shard")
    return joined.join(m.sources, "key").select(
        "doc", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), "first_shard"
    )


def mixed_documents(df: DataFrame, m: Mix, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix with its text: one row of the table for each pass over a document that takes
    words of it, ``text`` cut to the taken blocks in their order (white space between
    words stays). Other columns stay as they are."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    runs = m.blocks.groupBy("key", "doc", "t", "copy", "epoch").agg(F.sum("taken").alias("n"), F.collect_list(F.struct("block", "taken")).alias("parts"))
    numbered = df.select(
        *hidden(df.columns), body.alias("__body"), _key(source).alias("__key"), F.col(f"`{id_col}`").cast("long").alias("__doc"), F.xxhash64(body).alias("__t"), n_words(body).alias("__n")
    ).withColumn("__copy", F.row_number().over(Window.partitionBy("__key", "__doc", "__t").orderBy(F.xxhash64(*[f"r_{i}" for i in range(len(df.columns))]))))
    joined = numbered.join(
        runs, (F.col("__key") == F.col("key")) & F.col("__doc").eqNullSafe(F.col("doc")) & (F.col("__t") == F.col("t")) & (F.col("__copy") == F.col("copy"))
    )
    pieces = F.regexp_extract_all("__body", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    cut = F.array_join(F.flatten(F.transform(F.array_sort("parts"), lambda p: F.slice("__pieces", p["block"] * m.block_words + 1, p["taken"].cast("int")))), "")
    joined = joined.withColumn("__pieces", F.when(F.col("n") < F.col("__n"), pieces))
    return joined.select(*[(F.when(F.col("n") < F.col("__n"), cut).otherwise(F.col(f"r_{i}")) if c == text else F.col(f"r_{i}")).alias(c) for i, c in enumerate(df.columns)])
