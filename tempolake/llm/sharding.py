"""Sharding by sampled splitters.

Built from DataFrame functions only. Records are ordered by a hash of their text,
then by a hash of their id and other columns, so equal texts stand together. A sample in which a record's chance
grows with its size gives quantile boundaries; the sizes of the ranges between them
are summed, and ranges that hold too much are sampled again and subdivided, also
within a group of equal texts, until none is overfull or nothing tells its rows apart.
What lies before a range, and in it, gives the shards: a range that no shard boundary crosses
goes to its shard as a whole, one that a boundary crosses is cut there by a running sum.

The driver holds at most ``MAX_RANGES`` first ranges with their sample. In a larger table each is dealt into
steps of ``range_bytes`` at even distances of its hashes; their sums stay in a table and are joined, so a task
orders ``range_bytes`` or so, whatever the table.
"""

from __future__ import annotations

import math
from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import hidden, stored

#: Samples for each range, and the most ranges of the first cut.
OVERSAMPLE, MAX_RANGES = 16, 1 << 14
#: A range is overfull beyond this multiple of the mean.
OVERFULL = 3
_LEAST = -(2**63)


def _chance(g: str = "g", d: str = "d") -> Column:
    """A number in [0, 1) that hangs on the record only."""
    return F.shiftrightunsigned(F.xxhash64(g, d, F.lit(11)), 11).cast("double") / float(1 << 53)


def _longs(xs: list[int]) -> Column:
    """A constant array, sent as one literal."""
    return F.split(F.lit(",".join(map(str, xs))), ",").cast("array<long>")


def _range_of(cuts: list[tuple[int, int]]) -> Column:
    """How many of the ascending (g, d) cuts are not beyond the record: a binary search."""
    if not cuts:
        return F.lit(0)
    n, bits = len(cuts), len(cuts).bit_length()
    top = (2**63 - 1, 2**63 - 1)
    cuts = cuts + [top] * ((1 << bits) - 1 - len(cuts))
    gs, ds = _longs([g for g, _ in cuts]), _longs([d for _, d in cuts])
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(bits))])

    def step(lo: Column, w: Column) -> Column:
        sg, sd = F.get(gs, lo + w - 1), F.get(ds, lo + w - 1)
        return F.when((F.col("g") > sg) | ((F.col("g") == sg) & (F.col("d") >= sd)), lo + w).otherwise(lo)

    return F.least(F.aggregate(steps, F.lit(0), step), F.lit(n))  # the fill may be a record's own place


def _cut(sample: list[tuple[int, int, float]], n: int, before: tuple[int, int] | None = None) -> list[tuple[int, int]]:
    """n - 1 boundaries that split the weight of a sorted sample evenly. A boundary in a
    group of equal texts moves to the group's start unless the last one stands in it, too."""
    total, held, out = sum(w for *_, w in sample), 0.0, []
    last = before
    for g, d, w in sample:
        if held >= total * (len(out) + 1) / n and len(out) < n - 1:
            at = (g, d) if last is not None and last[0] == g else (g, _LEAST)
            if last is None or at > last:
                out.append(at)
                last = at
        held += w
    return out


def splitters(keys: DataFrame, n_ranges: int, total: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Ascending cuts of rows (g, d, size), and each range's (size, rows)."""
    def drawn(of: DataFrame, weight: float, n: int) -> list[tuple[int, int, float]]:
        share = F.col("size") * (n * OVERSAMPLE / weight)
        rows = of.filter(_chance() < share).select("g", "d", F.greatest(share, F.lit(1.0)).alias("w")).collect()
        return sorted((r.g, r.d, r.w) for r in rows)

    cuts = _cut(drawn(keys, max(total, 1), n_ranges), n_ranges)
    most = OVERFULL * max(total, 1) / n_ranges
    while True:
        filled = {r.r: (r.size, r.rows) for r in keys.groupBy(_range_of(cuts).alias("r")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).collect()}  # a row for each range
        parts = [filled.get(i, (0, 0)) for i in range(len(cuts) + 1)]
        over = {i for i, (size, rows) in enumerate(parts) if size > most and rows > 1}
        if not over:
            return cuts, parts
        inside = keys.withColumn("r", _range_of(cuts)).filter(F.col("r").isin(over))
        weight = sum(parts[i][0] for i in over)
        by: dict[int, list] = {}
        for x in drawn(inside.drop("r"), weight, math.ceil(weight * n_ranges / max(total, 1))):
            by.setdefault(bisect_right(cuts, (x[0], x[1])), []).append(x)
        added = {*cuts}
        for i, xs in by.items():
            if i in over:
                added |= {*_cut(xs, math.ceil(parts[i][0] * n_ranges / max(total, 1)) + 1, (xs[0][0], _LEAST) if len({x[0] for x in xs}) == 1 else None)}
        if len(added) == len(cuts):
            return cuts, parts  # nothing in the sample tells the rows of these ranges apart
        cuts = sorted(added)


def _step_of(cuts: list[tuple[int, int]], steps: list[int]) -> Column:
    """The step of the record inside its range ``__r``, in the order of (g, d), at even distances of the hash that tells the range's rows apart."""
    low, high = [(_LEAST, _LEAST), *cuts], [*cuts, (-_LEAST - 1, -_LEAST - 1)]
    by_g = [a[0] < b[0] for a, b in zip(low, high, strict=True)]
    first = [a[0] if g else a[1] for a, g in zip(low, by_g, strict=True)]
    width = [max(1.0, ((b[0] - a[0]) if g else (b[1] - a[1])) / n) for a, b, g, n in zip(low, high, by_g, steps, strict=True)]
    at = lambda xs, kind: F.get(F.split(F.lit(",".join(map(str, xs))), ",").cast(f"array<{kind}>"), F.col("__r"))
    x = F.when(at([int(g) for g in by_g], "int") == 1, F.col("g")).otherwise(F.col("d")).cast("double")
    step = F.floor((x - at(first, "long").cast("double")) / at(width, "double")).cast("int")
    return F.greatest(F.lit(0), F.least(step, at(steps, "int") - 1))


def shard(
    df: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text: str = "text", range_bytes: int = 8 << 20, group_share: float = 0.005,
) -> DataFrame:
    """Puts every record into one of ``n_shards`` shards of near equal size.

    Returns the table with ``size`` (UTF-8 bytes of the text, plus 1), ``shard`` and
    ``slot`` (from 0, without gaps in a shard); columns of these names are replaced.
    Shards are runs of one order, so they differ by a record and by the groups of
    equal texts that stay whole: those up to ``group_share`` of a shard. Larger groups
    may be cut. A null text has size 1 and is grouped with empty texts, null ids are ids like others,
    and rows that repeat each other in all columns take slots of their own, in one task for each such row. An empty table stays empty.
    """
    rest = [c for c in df.columns if c not in {"size", "shard", "slot"}]
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    base = df.select(
        *hidden(rest), (F.octet_length(body) + 1).cast("long").alias("size"), F.xxhash64(body).alias("g"),
        F.xxhash64(*[F.col(f"`{c}`") for c in [id_col, *rest] if c in rest and c != text], F.lit(5)).alias("d"),
    )
    keys = stored(base.select("g", "d", "size"))
    total, rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    n_ranges = min(MAX_RANGES, max(4 * n_shards, 1 << math.ceil(total / range_bytes).bit_length()))
    cuts, parts = splitters(keys, n_ranges, total)
    steps = [max(1, math.ceil(size / range_bytes)) for size, _ in parts]
    size_before, rows_before = [0], [0]
    for s, n in parts:
        size_before.append(size_before[-1] + s)
        rows_before.append(rows_before[-1] + n)

    def stepped(of: DataFrame) -> DataFrame:
        # inline keeps the searches out of the join's keys, which the optimizer would derive filters from
        of = of.select("*", F.inline(F.array(F.struct(_range_of(cuts).alias("__r")))))
        return of.select("*", F.inline(F.array(F.struct(_step_of(cuts, steps).alias("__s")))))

    at = lambda xs: F.get(_longs(xs), F.col("__r"))
    earlier = Window.partitionBy("__r").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)  # rows are steps
    sums = stepped(keys).groupBy("__r", "__s").agg(F.sum("size").alias("step_size"), F.count(F.lit(1)).alias("step_rows"))
    before = stored(sums.select(
        F.col("__r").alias("r"), F.col("__s").alias("s"), (at(size_before) + F.coalesce(F.sum("step_size").over(earlier), F.lit(0))).alias("from_size"),
        (at(rows_before) + F.coalesce(F.sum("step_rows").over(earlier), F.lit(0))).alias("from_rows"),
    ))

    def placed(of: DataFrame) -> DataFrame:
        order = Window.partitionBy("__r", "__s").orderBy("g", "d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        group = Window.partitionBy("__r", "__s", "g")
        of = stepped(of).join(before, (F.col("__r") == F.col("r")) & (F.col("__s") == F.col("s")))
        of = of.withColumn("__at", F.col("from_size") + F.sum("size").over(order) - F.col("size"))
        of = of.withColumn("__n", F.col("from_rows") + F.row_number().over(order) - 1)
        of = of.withColumn("__from", F.min("__at").over(group)).withColumn("__all", F.sum("size").over(group))
        whole = F.col("__all") <= group_share * total / n_shards
        middle = F.when(whole, 2 * F.col("__from") + F.col("__all")).otherwise(2 * F.col("__at") + F.col("size"))
        return of.withColumn("shard", F.least(F.floor(middle * n_shards / (2 * max(total, 1))), F.lit(n_shards - 1)).cast("int"))

    first = {r.shard: r.n for r in placed(keys).groupBy("shard").agg(F.min("__n").alias("n")).collect()}  # n_shards rows
    starts = _longs([first.get(i, 0) for i in range(n_shards)])
    return placed(base).select(*[F.col(f"r_{i}").alias(c) for i, c in enumerate(rest)], "size", "shard", (F.col("__n") - F.get(starts, F.col("shard"))).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes one folder for each shard, in slot order within each file."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
