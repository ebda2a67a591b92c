"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length: a bucket holds lengths within a factor, and is cut into chunks
of bounded size. The longest vectors give every query a first bound on its k-th
score. A query visits only buckets whose greatest length can reach its bound. There, the
bound over the lengths' product is a local cosine threshold: where it is low, the candidates
are taken in order of length and cut off; where it is high, a candidate's direction must
lie within the range that the threshold leaves for the query's largest coordinates. What is left
is verified by exact integer products. The chunks' best are merged at the end.

Queries are a stated set and meet the chunks in blocks of queries that need candidates of about the same
length, so a bucket's vectors are sent to those blocks only whose queries can visit the bucket. Tasks hold one chunk and
one block: of N vectors and Q queries, N Q / BLOCK + N Q / CHUNK are sent at most.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

#: Vectors of a chunk, queries of a block, and the longest vectors that give the first bounds.
CHUNK, BLOCK, SEEDS = 8192, 8192, 2048
#: Lengths of a bucket differ by this factor at most.
FACTOR = 1.1
#: From this local cosine threshold on, coordinates prune; below, lengths.
STEEP = 0.8
#: How many of a query's largest coordinates prune.
FOCUS = 4
_TOP, _LOW = 2**63 - 1, -(2**63)


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component; null if the vector or a component is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integer matrices, exactly, as floats or integers; products beyond 64 bits stop at the range's ends."""
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return a.astype(np.float64) @ b.astype(np.float64).T
    if most < 2**62:
        return a @ b.T
    return np.clip((a.astype(object) @ b.astype(object).T), _LOW, _TOP).astype(np.int64)


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Lists of integers as the rows of a matrix, short ones filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    at = 0
    for i, n in enumerate(lengths.tolist()):
        out[i, :n] = values[at : at + n]
        at += n
    return out


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores, ties to the smaller id."""
    if len(ids) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= kth)
        return at[np.lexsort((ids[at], -scores[at]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def search_chunk(ids: np.ndarray, vectors: np.ndarray, q_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int):
    """(query, id, score) of what may be among each query's k best. bounds: scores that k candidates reach, nan if unknown."""
    length = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
    order = np.argsort(-length, kind="stable")
    ids, vectors, length = ids[order], vectors[order], length[order]
    unit = np.ascontiguousarray(vectors.T / np.maximum(length, 1e-300))  # by coordinate
    q_length = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(bounds > 0, bounds / (q_length * length[0]), -1.0) * (1 - 1e-9)
    local[np.isnan(local)] = -1.0
    flat = np.flatnonzero(local < STEEP)
    for part in np.array_split(flat, max(1, len(flat) // 256)):
        if not len(part):
            continue
        # by length: candidates that are too short for the most modest query of the part stay out
        need = np.where(bounds[part] > 0, bounds[part] / np.maximum(q_length[part], 1e-300) * (1 - 1e-9), -1.0)
        reach = np.searchsorted(-length, -np.nan_to_num(need, nan=-1.0), side="right")
        top = int(reach.max())
        if not top:
            continue
        scores = products(queries[part], vectors[:top])
        row, at = np.nonzero(~(scores < bounds[part][:, None]))  # a bound that is unknown (nan) leaves all
        fit = (at < reach[row]) & (ids[at] != q_ids[part[row]])
        row, at = row[fit], at[fit]
        for i, own in zip(part.tolist(), np.split(at, np.searchsorted(row, np.arange(1, len(part)))), strict=True):
            if len(own):
                mine = scores[np.searchsorted(part, i), own]
                for j in best(ids[own], mine, k).tolist():
                    yield q_ids[i], ids[own[j]], mine[j]
    for i in np.flatnonzero(local >= STEEP).tolist():
        t = local[i]
        if t > 1:
            continue
        direction = queries[i] / q_length[i]
        slack = math.sqrt(max(0.0, 1 - t * t))
        at = None
        for f in np.argsort(-np.abs(direction))[:FOCUS].tolist():
            mine = unit[f] if at is None else unit[f][at]
            wide = slack * math.sqrt(max(0.0, 1 - direction[f] ** 2)) + 1e-9
            fit = (mine >= direction[f] * t - wide) if direction[f] >= 0 else (mine <= direction[f] * t + wide)
            # on the far side only a direction beyond the query's own coordinate by more than the slack fails
            fit &= np.abs(mine - direction[f]) <= math.sqrt(max(0.0, 2 - 2 * t)) + 1e-9
            at = np.flatnonzero(fit) if at is None else at[fit]
        at = at[ids[at] != q_ids[i]] if at is not None else np.flatnonzero(ids != q_ids[i])
        if not len(at):
            continue
        scores = products(queries[i : i + 1], vectors[at])[0]
        ok = ~(scores < bounds[i])
        at, scores = at[ok], scores[ok]
        for j in best(ids[at], scores, k).tolist():
            yield q_ids[i], ids[at[j]], scores[j]


def exact_top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector: str = "vector") -> DataFrame:
    """(query_id, rank, id, score): each query's k highest integer inner products.

    Both tables have an id and a vector of integers (array<long>). Rows with a null id or vector take no part,
    nor does a candidate with the query's id. Ties go to the smaller id; a query with
    fewer than k candidates gets all. Shorter vectors count as filled with zeros. Repeated rows are candidates
    of their own; queries with the same id are answered once, for the least of their vectors. Empty tables give an empty result.
    """
    spark = candidates.sparkSession
    read = lambda df: df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<long>").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    bucket = F.when(F.col("norm") > 0, F.floor(F.log("norm") / math.log(FACTOR)).cast("int")).otherwise(-1)
    base = stored(read(candidates).withColumn("norm", norm).withColumn("bucket", bucket))
    asked = stored(read(queries).groupBy("id").agg(F.min("v").alias("v")).withColumn("norm", norm))
    stats = {r.bucket: (r.n, r.most) for r in base.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("most")).collect()}  # a row for each factor of length
    empty = "query_id long, rank int, id long, score long"
    n_queries, width_q = asked.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not stats or not n_queries:
        return spark.createDataFrame([], empty)
    width = max(width_q, base.agg(F.max(F.size("v"))).first()[0], 1)
    seeds = base.orderBy(F.desc("norm"), "id").limit(SEEDS).select("id", "v").toArrow()  # SEEDS rows
    lead_ids, lead = seeds.column(0).to_numpy(), matrix(seeds.column(1), width)
    held = spark.sparkContext.broadcast((lead_ids, lead))  # SEEDS vectors

    def bound(batches):
        ids, vectors = held.value
        for batch in batches:
            q = matrix(batch.column(1), width)
            out = []
            for at in range(0, len(q), 256):
                scores = products(q[at : at + 256], vectors)
                for own, row in zip(batch.column(0).slice(at, 256).to_pylist(), scores, strict=True):
                    others = row[ids != own]
                    out.append(float(np.partition(others, len(others) - k)[len(others) - k]) if len(others) >= k else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=["id", "v", "norm", "bound"])

    bounded = asked.mapInArrow(bound, "id long, v array<long>, norm double, bound double")
    # the least length of a candidate that reaches the bound; queries of one level need lengths within a factor
    need = F.when((F.col("bound") > 0) & (F.col("norm") > 0), F.col("bound") / F.col("norm") * (1 - 1e-9)).otherwise(0.0)
    level = F.when(F.col("need") > 0, F.floor(F.log("need") / math.log(FACTOR)).cast("int")).otherwise(-(1 << 30))
    bounded = stored(bounded.withColumn("need", need).withColumn("level", level))
    levels = [(r.level, -(-r.n // BLOCK), r.need) for r in bounded.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("need")).collect()]  # a row for each factor of length
    visits = {b: [(lv, blocks) for lv, blocks, least in levels if most * (1 + 1e-9) >= least] for b, (_, most) in stats.items()}
    chunks = {b: -(-n // CHUNK) for b, (n, _) in stats.items()}

    def spread(by: str, to: dict[int, list[tuple[int, int]]], names: tuple[str, str]) -> Column:
        """For a row's ``by``, an array of (other side's class, its number of parts)."""
        kind = f"array<struct<{names[0]}: int, {names[1]}: int>>"
        out = F.array().cast(kind)
        for key, found in to.items():
            if found:
                out = F.when(F.col(by) == key, F.array(*[F.struct(F.lit(a), F.lit(b)) for a, b in found]).cast(kind)).otherwise(out)
        return out

    own = lambda n: F.pmod(F.xxhash64("id", "v"), n).cast("int")
    count_of = lambda by, counts: F.create_map(*[F.lit(x) for pair in counts.items() for x in pair])[F.col(by)]
    rows = base.withColumn("chunk", own(count_of("bucket", chunks))).select("bucket", "chunk", "id", "v", F.inline(spread("bucket", visits, ("level", "blocks"))))
    rows = rows.select("bucket", "chunk", "level", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "v")
    reached = {lv: [(b, chunks[b]) for b, found in visits.items() if any(x == lv for x, _ in found)] for lv, *_ in levels}
    asks = bounded.withColumn("block", own(count_of("level", {lv: n for lv, n, _ in levels}))).select("level", "block", "id", "v", "bound", F.inline(spread("level", reached, ("bucket", "chunks"))))
    asks = asks.select("bucket", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "level", "block", "id", "v", "bound")

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            bounds = right.column("bound").to_numpy().astype(np.float64)
            found = list(search_chunk(left.column("id").to_numpy(), matrix(left.column("v"), width), right.column("id").to_numpy(), matrix(right.column("v"), width), bounds, k))
        return pa.table({n: pa.array([int(x[i]) for x in found], pa.int64()) for i, n in enumerate(("query_id", "id", "score"))})

    keys = ("bucket", "chunk", "level", "block")
    found = rows.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(solve, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
