"""Language ID by Bayesian fusion of evidence.

For each language, the text gives a likelihood (byte trigrams under a model trained here), the declared
markup language gives one (how often documents of a language carry it), and the address gives the prior: the host's
language shares, smoothed towards those of its suffix, which are smoothed towards the whole table's. The suffix
counts once: the share of a language among documents of a suffix is, by Bayes' rule, the table's share times the likelihood of the
suffix, so a likelihood of its own beside that prior would count it twice; where the host is unknown, the suffix's
shares are the prior. Shares and likelihoods are counts over all documents by grouped aggregation, with each document
counted for its most likely language by text alone. ``documents`` have no addresses, only a source that serves as host; ``pages`` have.
The column ``lang`` is both the label of the fit and the declared value there, so agreement with it proves little: the tests fit and
judge on different documents, with the declared value hidden and altered.

The languages are those of all labelled documents, by a grouped count; only the fit is bounded: for
each language, about ``sample`` of its documents are drawn by hash (all where it has no more). Each
language is smoothed by a background model, the product of byte shares over all languages, with the weight of
as many trigrams as it has different ones, so that few documents are enough to tell it. A text that the
background tells better than its language is in none of these, and is rejected. The figures of hosts are joined, never broadcast without a bound; texts are not shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .shared import apart, hidden, stored

#: Trigrams are hashed to 2 to this power cells; a text speaks with the weight of this many trigrams at most.
BITS, WEIGHT = 16, 60.0
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = _LETTER[128:] = True


#: Texts with such a trigram, whose middle byte is an ASCII letter or a byte of another character.
_HAS_TRIGRAM = r"(?s).[A-Za-z].|[^\x00-\x7F].|.[^\x00-\x7F]|[^\x{0}-\x{7FF}]"


def _cells(code: np.ndarray) -> np.ndarray:
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64)


def trigrams(block: K.Block) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the lower-cased byte trigrams with a letter, and the document of each."""
    code, owner = _coded(block)
    return _cells(code), owner


def _coded(block: K.Block) -> tuple[np.ndarray, np.ndarray]:
    data = K._LOWER[block.data].astype(np.uint32)
    if len(data) < 3:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    code = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    keep = _LETTER[data[1:-1]]
    owner = np.searchsorted(block.offsets, np.arange(len(code)), side="right") - 1
    keep &= np.arange(2, len(data)) < block.offsets[owner + 1]
    return code[keep], owner[keep]


def _background(middle: np.ndarray, side: np.ndarray) -> np.ndarray:
    """The probability of each cell if the bytes of a trigram are independent; from counts of bytes."""
    middle, side = np.where(_LETTER, middle, 0.0), side / side.sum()
    both = np.outer(middle / middle.sum(), side).ravel()
    rest = np.arange(1 << 16, dtype=np.uint32)
    out = np.zeros(1 << BITS)
    for first in range(256):
        out += side[first] * np.bincount(_cells(rest | np.uint32(first << 16)), weights=both, minlength=1 << BITS)
    return out


@dataclass
class TextModel:
    languages: list[str]
    #: languages x cells: log probabilities, less those of the background
    table: np.ndarray

    def evidence(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(log likelihood of each language over the background's, number of trigrams) of each text; the weight of long texts is bounded."""
        out, seen = [], []
        for b in K.blocks(text):
            cell, owner = trigrams(b)
            n = np.bincount(owner, minlength=b.n)
            sums = np.column_stack([np.bincount(owner, weights=row[cell], minlength=b.n) for row in self.table]) if self.languages else np.zeros((b.n, 0))
            out.append(sums / np.maximum(n, 1)[:, None] * np.minimum(n, WEIGHT)[:, None])
            seen.append(n)
        return (np.concatenate(out), np.concatenate(seen)) if out else (np.zeros((0, len(self.languages))), np.zeros(0, np.int64))


def train(df: DataFrame, id_col: str, text: str, label: str, sample: int = 4000, smoothing: float = 0.5) -> TextModel:
    """Counts trigrams by label over about ``sample`` documents of each label, one at least.

    The driver holds a row for each label and a table of labels x cells. ``smoothing`` is added to the counts of bytes."""
    labelled = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{label}`").cast("string").alias("label"))
    labelled = labelled.filter(F.col("label").isNotNull() & F.col("text").rlike(_HAS_TRIGRAM))
    labelled = labelled.select("text", "label", (F.shiftrightunsigned(F.xxhash64("id", "text", F.lit(3)), 11).cast("double") / float(1 << 53)).alias("share"))
    known = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("share").alias("least")).collect()  # languages
    if not known:
        return TextModel([], np.zeros((0, 1 << BITS)))
    limits = df.sparkSession.createDataFrame([(r.label, max(min(1.0, sample / r.n), r.least)) for r in known], "name string, most double")
    drawn = labelled.join(F.broadcast(limits), F.col("label") == F.col("name")).filter("share <= most").select("text", "label")

    def count(batches):
        total: dict[str | None, np.ndarray] = {None: np.zeros(512, np.int64)}  # bytes in the middle and beside it
        for batch in batches:
            labels = batch.column(1).to_pylist()
            for b in K.blocks(K.column(batch, "text")):
                code, owner = _coded(b)
                cell = _cells(code)
                for k, shift in ((0, 8), (256, 16), (256, 0)):
                    total[None][k : k + 256] += np.bincount((code >> np.uint32(shift)) & np.uint32(255), minlength=256)
                for i in range(b.n):
                    total.setdefault(labels[b.row + i], np.zeros(1 << BITS, np.int64))
                ends = np.searchsorted(owner, np.arange(b.n + 1))
                for i in range(b.n):
                    np.add.at(total[labels[b.row + i]], cell[ends[i] : ends[i + 1]], 1)
        rows = [(k, int(c), int(v[c])) for k, v in total.items() for c in np.flatnonzero(v)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], names=["label", "cell", "n"])

    got = drawn.mapInArrow(K.lean(count), "label string, cell int, n long").groupBy("label", "cell").agg(F.sum("n").alias("n")).collect()  # languages x cells
    languages = sorted(r.label for r in known)
    place = {x: i for i, x in enumerate(languages)}
    table, bytes_ = np.zeros((len(languages), 1 << BITS)), np.full(512, smoothing)
    for r in got:
        if r.label is None:
            bytes_[r.cell] += r.n
        else:
            table[place[r.label], r.cell] += r.n
    behind = _background(bytes_[:256], bytes_[256:])
    kinds = (table > 0).sum(axis=1, keepdims=True)
    return TextModel(languages, np.log((table / behind + kinds) / (table.sum(axis=1, keepdims=True) + kinds)))


def with_evidence(df: DataFrame, text: str, model: TextModel, keep_text: bool = True) -> DataFrame:
    """Adds ``__text_ll`` (an array by language), ``__trigrams`` and ``__best`` (the language that the text alone tells, null for none of these)."""
    rest = [c for c in df.columns if keep_text or c != text]
    source = df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").cast("string").alias("__body"))
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField("__text_ll", T.ArrayType(T.DoubleType())), T.StructField("__trigrams", T.LongType()), T.StructField("__best", T.StringType())])
    k = len(model.languages)
    shared = df.sparkSession.sparkContext.broadcast((model.languages, model.table))  # languages x cells

    def run(batches):
        held = TextModel(*shared.value)
        for batch in batches:
            ll, n = held.evidence(K.column(batch, "__body"))
            best = [held.languages[i] if x > 0 else None for i, x in zip(ll.argmax(axis=1).tolist(), ll.max(axis=1).tolist(), strict=True)] if k else [None] * len(n)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * k), pa.array(ll.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists, pa.array(n, pa.int64()), pa.array(best, pa.string())], names=schema.names)

    return source.mapInArrow(K.lean(run), schema)


def suffix_of(address: Column) -> Column:
    """The last label of a host name; null if it has no dot."""
    return F.when(address.contains("."), F.lower(F.substring_index(address, ".", -1)))


def _shares(counts: DataFrame, by: str, languages: list[str], other: str = "__best") -> DataFrame:
    """For each value of ``by``, its count by language as an array."""
    return counts.filter(F.col(by).isNotNull()).groupBy(by).agg(F.array(*[F.sum(F.when(F.col(other) == x, F.col("n")).otherwise(0)).cast("double") for x in languages]).alias(f"{by}_n"))


def identify(
    df: DataFrame, model: TextModel, text: str = "text", declared: Column | None = None, host: Column | None = None, suffix: Column | None = None,
    strength: float = 20.0, min_posterior: float = 0.5, keep_text: bool = True,
) -> DataFrame:
    """Adds ``language``, ``posterior`` and ``accepted`` to each row; columns of these names are replaced.

    A document is rejected if its text has no letter trigram, no language reaches ``min_posterior``, or the
    background model tells its text as well as the language does. Missing
    evidence (a null declaration, suffix or host, or a value never seen with any text) says nothing.
    Null and empty texts get the language that the other evidence tells, and are rejected. An empty table, or a
    model without languages, gives null languages.
    """
    none = F.lit(None).cast("string")
    rest = [c for c in df.columns if c not in {"language", "posterior", "accepted"}]
    parts = {"__declared": declared, "__host": host, "__suffix": suffix}
    source = df.select(*hidden(rest), *[(none if c is None else c.cast("string")).alias(k) for k, c in parts.items()])
    body = f"r_{rest.index(text)}"
    languages, k = model.languages, len(model.languages)
    kept = [F.col(f"r_{i}").alias(c) for i, c in enumerate(rest) if keep_text or c != text]
    if not k:
        return source.select(*kept, none.alias("language"), F.lit(None).cast("double").alias("posterior"), F.lit(False).alias("accepted"))
    told = source.select("__declared", "__host", "__suffix", F.col(body).alias("__b"))
    counts = stored(with_evidence(told, "__b", model, keep_text=False).filter("__best IS NOT NULL").groupBy("__declared", "__host", "__suffix", "__best").agg(F.count(F.lit(1)).alias("n")))
    whole = counts.agg(*[F.sum(F.when(F.col("__best") == x, F.col("n")).otherwise(0)) for x in languages]).first()
    total = [float(x or 0) for x in whole]
    base = [(x + 1) / (sum(total) + k) for x in total]  # shares of the whole table
    array = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    at = lambda c, i: F.get(F.col(c), F.lit(i))
    # priors: host -> its suffix group -> the whole table
    groups = _shares(counts, "__suffix", languages)
    hosts = _shares(counts, "__host", languages)
    said = _shares(counts, "__declared", languages)

    def add(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
        return rows.join(apart(table, key, f"{key}_n").withColumnRenamed(key, f"{key}_key"), F.col(key) == F.col(f"{key}_key"), "left").drop(f"{key}_key")

    rows = with_evidence(source, body, model, keep_text=keep_text)
    for table, key in ((hosts, "__host"), (groups, "__suffix"), (said, "__declared")):
        rows = add(rows, table, key)
    zero = array([0.0] * k)
    rows = rows.withColumns({f"{c}_n": F.coalesce(f"{c}_n", zero) for c in parts})
    sums = {c: F.aggregate(f"{c}_n", F.lit(0.0), lambda a, x: a + x) for c in ("__host", "__suffix")}
    rows = rows.withColumns({f"{c}_all": v for c, v in sums.items()})
    logs = []
    for i in range(k):
        group = (at("__suffix_n", i) + strength * base[i]) / (F.col("__suffix_all") + strength)
        prior = (at("__host_n", i) + strength * group) / (F.col("__host_all") + strength)
        # P(value | language) over its mean for all languages: 1 where the value is unseen
        likely = lambda c, i: F.log((at(c, i) + strength * base[i]) / (total[i] + strength))
        logs.append(at("__text_ll", i) + F.log(prior) + F.when(F.col("__declared").isNotNull(), likely("__declared_n", i)).otherwise(0.0))
    rows = rows.withColumn("__log", F.array(*logs)).withColumn("__top", F.array_max("__log"))
    posterior = 1.0 / F.aggregate("__log", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("__top")))
    place = F.array_position("__log", F.col("__top")).cast("int")
    return rows.select(
        *kept, F.get(F.array(*[F.lit(x) for x in languages]), place - 1).alias("language"), posterior.alias("posterior"),
        ((F.col("__trigrams") > 0) & (posterior >= min_posterior) & (F.get("__text_ll", place - 1) > 0)).alias("accepted"),
    )
