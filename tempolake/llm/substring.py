"""Substring dedup by seed and extend on winnowed anchors.

Seed: every window of ``length`` words picks the least hash among its runs of
``seed`` words (the leftmost, if equal). The runs that windows pick are the
document's anchors, about one in 18 words, and equal windows pick equal anchors at equal
places. So a repeat of ``length`` words or more shares an anchor, and only anchors
that two documents share go on.

Extend: the windows that pick one anchor are consecutive, and cover a span of words to both
sides of it. Spans are compared first: a span that an earlier document has is a repeat as
a whole. Where an anchor stands in different spans, the extension ends inside, and
its windows are compared one by one, once for each different span. Covered windows
that touch are then merged into maximal repeats.

This finds what extending each pair of equal anchors word by word, to the left and to the right, would find. A window of
``length`` words is in a repeat of two documents if and only if both have it; it picks an anchor, and both pick that
anchor at the same place in the window, so it stands in the reach of a matching anchor pair. The maximal match around
such a pair covers exactly those windows over the anchor that both documents have: if the spans (all windows that
pick the anchor) are equal, the match reaches across the whole span on both sides, and the windows beyond pick the neighbouring
anchors; if they differ, the match ends inside, and comparing the span's windows one by one finds
where. The union of covered windows over all pairs is then the union of the maximal matches of ``length`` words or more. But a pair at
a time would cost the square of a passage's holders; comparing with the first holder by joins costs a row for each of them, and
gives the same answer, as a word goes if any earlier document has its window.

Everything is compared by joins and sums on hashes, so a passage
that many documents share costs a row for each of them. Texts are shuffled once, by document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .shared import apart, hidden, stored

_LAST = 2**63 - 1


def anchors(block: K.Block, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """(document in the block, anchor hash, span hash, first window, last window) of each
    run of windows that pick the same anchor, or equal anchors in equal spans; windows count
    from 0 in their document."""
    h = block.word_hashes()
    w = window_hashes(h, length)
    g = K.shingles(h, seed)
    none = np.empty(0, dtype=np.int64)
    if not len(w):
        return none, none, none, none, none
    pick = np.arange(len(g), dtype=np.int64)
    width, reach = length - seed + 1, 1
    while reach < width:  # the place of the least hash among `reach` runs
        step = min(reach, width - reach)
        left, right = pick[:-step], pick[step:]
        pick = np.where(g[right] < g[left], right, left)
        reach += step
    doc = np.searchsorted(block.first, np.arange(len(w)), side="right") - 1
    valid = np.arange(len(w)) + length <= block.first[doc + 1]
    at = np.flatnonzero(valid)
    if not len(at):
        return none, none, none, none, none
    doc, place = doc[at], pick[at]
    new = np.r_[True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(at)) - 1
    d = doc[start]
    a, b, anchor = at[start], at[stop], place[start]
    # two windows that overlap and their places tell the whole span
    span = K.chain(K.chain(w[a], w[b], 201), (b - a).astype(np.uint64) * np.uint64(1 << 20) + (anchor - a).astype(np.uint64), 202)
    # one word or a few that repeat pick equal anchors in equal spans again and again: one row for them all
    seed_hash = K.mix(g[anchor])
    other = np.r_[True, (seed_hash[1:] != seed_hash[:-1]) | (span[1:] != span[:-1]) | (d[1:] != d[:-1])]
    start = np.flatnonzero(other)
    stop = np.append(start[1:], len(d)) - 1
    d = d[start]
    return d, seed_hash[start].view(np.int64), span[start].view(np.int64), a[start] - block.first[d], b[stop] - block.first[d]


def window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    return K.shingles(h, length)


def _seeds(batches, length: int, seed: int):
    names = ["doc", "t", "anchor", "span", "first", "last"]
    for batch in batches:
        for block in K.blocks(K.column(batch, "text")):
            d, anchor, span, first, last = anchors(block, length, seed)
            row = pa.array(d + block.row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), batch.column(1).take(row), pa.array(anchor, pa.int64()), pa.array(span, pa.int64()), pa.array(first, pa.int32()), pa.array(last, pa.int32())],
                names=names,
            )


def _windows(batches, length: int):
    """The hash of every window of the documents' open spans."""
    for batch in batches:
        firsts, lasts = batch.column("firsts").to_pylist(), batch.column("lasts").to_pylist()
        for block in K.blocks(K.column(batch, "__text")):
            w = window_hashes(block.word_hashes(), length).view(np.int64)
            rows, places = [], []
            for i in range(block.n):
                a, b = np.array(firsts[block.row + i], dtype=np.int64), np.array(lasts[block.row + i], dtype=np.int64)
                n = b - a + 1
                p = np.unique(np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum())))
                rows.append(np.full(len(p), block.row + i)), places.append(p)
            row, place = np.concatenate(rows), np.concatenate(places)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(w[block.first[row - block.row] + place], pa.int64()), pa.array(place, pa.int32())], names=["doc", "t", "window", "first"]
            )


def _cut(batches, length: int, rest: list[str], schema_names: list[str]):
    """Removes the words of the covered windows and joins the others by one space."""
    for batch in batches:
        k = len(rest)
        texts = K.column(batch, "__text").to_pylist()
        firsts, lasts = batch.column(k + 1).to_pylist(), batch.column(k + 2).to_pylist()
        n_words, n_removed, kept, spans = [], [], [], []
        for text, a, b in zip(texts, firsts, lasts, strict=True):
            words = text.encode("utf-8", "surrogatepass").split()  # bytes split at exactly the six white-space values
            runs = []
            if a:
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(edge, np.array(a), 1)
                np.add.at(edge, np.array(b) + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                turn = np.flatnonzero(np.diff(np.r_[False, gone, False]))
                runs = [{"start": int(x), "end": int(y)} for x, y in zip(turn[::2], turn[1::2], strict=True)]
                n_removed.append(int(gone.sum()))
                n_words.append(len(words))
                words = [x for x, g in zip(words, gone.tolist(), strict=True) if not g]
            else:
                n_removed.append(0)
                n_words.append(len(words))
            kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            spans.append(runs)
        yield pa.RecordBatch.from_arrays(
            [batch.column(i) for i in range(k)]
            + [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
            names=schema_names,
        )


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 50, seed: int = 16) -> DataFrame:
    """Removes the words of every repeat of ``length`` words or more that starts in a document with a smaller id.

    Returns the table with ``text`` (the kept words, joined by one space), ``n_words``,
    ``n_removed`` and ``removed_spans`` (maximal runs of removed words, [start, end));
    columns of these names are replaced. Repeats are judged on the input. A null text has no words and
    becomes empty. Null ids come after all others, and rows of one id never remove words from each other. An
    empty table stays empty.
    """
    if not 1 <= seed <= length:
        raise ValueError("seed must be from 1 to length")
    added = ["n_words", "n_removed", text, "removed_spans"]
    rest = [c for c in df.columns if c not in added]
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    keyed = df.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(body).alias("t"), body.alias("__text"),
        *hidden(rest),
    )
    seeds = stored(
        keyed.select("doc", "t", F.col("__text").alias("text")).mapInArrow(
            K.lean(lambda it: _seeds(it, length, seed)), "doc long, t long, anchor long, span long, first int, last int"
        )
    )
    shared = seeds.groupBy("anchor").agg(F.min("doc").alias("lead"), F.max("doc").alias("tail")).filter("lead < tail").select("anchor", "lead")
    met = stored(seeds.join(apart(shared, "anchor", "lead"), "anchor").drop("lead"))
    spans = met.groupBy("anchor", "span").agg(F.min("doc").alias("owner"))
    several = spans.groupBy("anchor").agg(F.count(F.lit(1)).alias("n_spans"))
    # a span of an earlier document goes as a whole; the first holder of a span is open where its anchor has other spans
    judged = met.join(apart(spans, "anchor", "span", "owner"), ["anchor", "span"])
    whole = judged.filter("doc > owner").select("doc", "t", "first", "last")
    open_ = (
        judged.filter("doc = owner").join(apart(several.filter("n_spans > 1"), "anchor", "n_spans").select("anchor"), "anchor", "left_semi")
        .groupBy("doc", "t").agg(F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts"))
    )
    opened = keyed.join(
        open_.select(F.col("doc").alias("o_doc"), F.col("t").alias("o_t"), "firsts", "lasts").hint("shuffle_hash"), (F.col("doc") == F.col("o_doc")) & (F.col("t") == F.col("o_t"))
    )
    # all columns go in, so that this and the last step share one shuffle of the texts
    windows = opened.mapInArrow(K.lean(lambda it: _windows(it, length)), "doc long, t long, window long, first int")
    owners = windows.groupBy("window").agg(F.min("doc").alias("owner"), F.max("doc").alias("tail")).filter("owner < tail").select("window", "owner")
    part = windows.join(apart(owners, "window", "owner"), "window").filter("doc > owner").select("doc", "t", "first", F.col("first").alias("last"))
    gone = whole.union(part).groupBy("doc", "t").agg(F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts"))
    joined = keyed.join(
        gone.select(F.col("doc").alias("o_doc"), F.col("t").alias("o_t"), "firsts", "lasts").hint("shuffle_hash"), (F.col("doc") == F.col("o_doc")) & (F.col("t") == F.col("o_t")), "left"
    ).select(*[f"r_{i}" for i in range(len(rest))], "__text", "firsts", "lasts")
    run = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType(
        [df.schema[c] for c in rest]
        + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField(text, T.StringType()), T.StructField("removed_spans", T.ArrayType(run))]
    )
    names = schema.names
    return joined.mapInArrow(K.lean(lambda it: _cut_all(it, length, rest, names)), schema)


def _cut_all(it, length, rest, names):
    """_cut in slices, so that a batch of long texts makes no large lists."""
    for batch in it:
        for at in range(0, batch.num_rows, 1000):
            yield from _cut([batch.slice(at, 1000)], length, rest, names)
