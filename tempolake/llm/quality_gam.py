"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature has a lookup table over quantile bins, and the strongest pairs of features have
tables over coarser bins. Cyclic boosting grows them: in each round every feature in turn gets
a shallow tree on the current gradients, at a small learning rate, added into its table; the
pairs follow. A score is the sigmoid of a sum of table entries, looked up for whole batches at once.

The features are figures of the text only. The model is fitted on at most ``max_rows`` labelled rows,
chosen by a hash of the id; this bound is a parameter. Everything else reads all rows, and nothing is shuffled to score.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K

FEATURES = (
    "log_words", "word_bytes", "upper", "digit", "mark", "symbol", "other_bytes", "repeat_word", "distinct_words", "words_a_line", "repeat_line",
)


def _class(values: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=np.int32)
    out[list(values)] = 1
    return out


_CLASSES = {
    "upper": _class(bytes(range(65, 91))), "lower": _class(bytes(range(97, 123))), "digit": _class(bytes(range(48, 58))), "mark": _class(b"!?.,;:'\"()-"),
    "symbol": _class(b"#*$%&|<>{}[]=_\\/^~@+"), "other": _class(bytes(range(128, 256))), "newline": _class(b"\n"),
}


def features(text: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text of a large_string array without nulls."""
    out = []
    for b in K.blocks(text):
        counted = {}
        for name, table in _CLASSES.items():
            total = np.concatenate([[0], np.cumsum(table[b.data], dtype=np.int64)])
            counted[name] = np.diff(total[b.offsets]).astype(np.float64)
        n_bytes = np.diff(b.offsets).astype(np.float64)
        words = np.diff(b.first).astype(np.float64)
        h = b.word_hashes(lower=True)
        owner = np.repeat(np.arange(b.n), np.diff(b.first))
        again = np.zeros(len(h), dtype=np.int64)
        again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
        repeats = np.bincount(owner, weights=again, minlength=b.n)
        order = np.lexsort((h, owner))
        new = np.ones(len(h), dtype=bool)
        if len(h):
            hs, os_ = h[order], owner[order]
            new[1:] = (hs[1:] != hs[:-1]) | (os_[1:] != os_[:-1])
            distinct = np.bincount(os_[new], minlength=b.n)
        else:
            distinct = np.zeros(b.n)
        n = np.maximum(words, 1)
        size = np.maximum(n_bytes, 1)
        letters = np.maximum(counted["upper"] + counted["lower"], 1)
        lines = counted["newline"] + 1
        out.append(np.column_stack([
            np.log1p(words), (n_bytes - words) / n, counted["upper"] / letters, counted["digit"] / size, counted["mark"] / n, counted["symbol"] / n,
            counted["other"] / size, repeats / n, distinct / np.maximum(np.minimum(n, 200 + 0.2 * n), 1), np.log1p(words / lines), np.minimum(lines / n, 1),
        ]))
    return np.concatenate(out) if out else np.empty((0, len(FEATURES)))


@dataclass
class Gam:
    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    #: (feature, feature, coarse edges, coarse edges, table)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for f, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += t[np.searchsorted(e, x[:, f], side="right")]
        for f, g, e, d, t in self.pairs:
            z += t[np.searchsorted(e, x[:, f], side="right"), np.searchsorted(d, x[:, g], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Boundaries between quantile bins, halfway between neighbouring values."""
    values = np.unique(x)
    if len(values) < 2:
        return np.empty(0)
    middle = (values[1:] + values[:-1]) / 2
    if len(middle) < bins:
        return middle
    wanted = np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])
    return np.unique(middle[np.clip(np.searchsorted(middle, wanted), 0, len(middle) - 1)])


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """A tree over ordered bins, grown leaf by leaf where the gain is largest; each bin's value."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])

    def split(a: int, b: int):
        if b - a < 2:
            return 0.0, a
        at = np.arange(a + 1, b)
        gl, hl, gr, hr = cg[at] - cg[a], ch[at] - ch[a], cg[b] - cg[at], ch[b] - ch[at]
        whole = (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
        gain = np.where((hl > 1) & (hr > 1), gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - whole, 0)
        k = int(gain.argmax())
        return float(gain[k]), int(at[k])

    parts = [(0, len(g))]
    while len(parts) < leaves:
        found = [(*split(a, b), i) for i, (a, b) in enumerate(parts)]
        gain, at, i = max(found)
        if gain <= 1e-9:
            break
        a, b = parts[i]
        parts[i : i + 1] = [(a, at), (at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = -(cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def _tree2(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best cross of one cut on each axis: its gain and the cells' values."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    gain = np.zeros((g.shape[0] - 1, g.shape[1] - 1))
    if not gain.size:
        return 0.0, np.zeros(g.shape)
    i, j = np.arange(1, g.shape[0]), np.arange(1, g.shape[1])
    quarter = lambda c: (
        c[np.ix_(i, j)], c[i, -1][:, None] - c[np.ix_(i, j)], c[-1, j][None, :] - c[np.ix_(i, j)], c[-1, -1] - c[i, -1][:, None] - c[-1, j][None, :] + c[np.ix_(i, j)]
    )
    for a, b in zip(quarter(cg), quarter(ch), strict=True):
        gain += a**2 / (b + ridge)
    gain -= cg[-1, -1] ** 2 / (ch[-1, -1] + ridge)
    a, b = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.zeros(g.shape)
    for rows in (slice(0, a + 1), slice(a + 1, None)):
        for cols in (slice(0, b + 1), slice(b + 1, None)):
            out[rows, cols] = -g[rows, cols].sum() / (h[rows, cols].sum() + ridge)
    return float(gain[a, b]), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, n_pairs: int = 4, bins: int = 64, pair_bins: int = 12, leaves: int = 3, rate: float = 0.1, ridge: float = 1.0) -> Gam:
    """Cyclic boosting. Without rows or with rows of one class only, the score is a constant."""
    if not len(y):
        return Gam(0.0, [np.empty(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES))
    p = (y.sum() + 0.5) / (len(y) + 1)
    model = Gam(float(np.log(p / (1 - p))), [_edges(x[:, f], bins) for f in range(x.shape[1])])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if y.min() == y.max():
        return model
    places = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.edges)]
    z = np.full(len(y), model.base)

    def slopes():
        q = 1 / (1 + np.exp(-z))
        return q - y, np.maximum(q * (1 - q), 1e-6)

    for _ in range(rounds):
        for f, at in enumerate(places):
            g, h = slopes()
            step = rate * _tree(np.bincount(at, g, len(model.tables[f])), np.bincount(at, h, len(model.tables[f])), leaves, ridge)
            model.tables[f] += step
            z += step[at]
    coarse = [_edges(x[:, f], pair_bins) for f in range(x.shape[1])]
    rough = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(coarse)]

    def cells(f: int, k: int, v: np.ndarray) -> np.ndarray:
        shape = (len(coarse[f]) + 1, len(coarse[k]) + 1)
        return np.bincount(rough[f] * shape[1] + rough[k], v, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    ranked = sorted(((_tree2(cells(f, k, g), cells(f, k, h), ridge)[0], f, k) for f in range(x.shape[1]) for k in range(f)), reverse=True)[:n_pairs]
    tables = [np.zeros((len(coarse[f]) + 1, len(coarse[k]) + 1)) for _, f, k in ranked]
    for _ in range(pair_rounds):
        for t, (_, f, k) in zip(tables, ranked, strict=True):
            g, h = slopes()
            step = rate * _tree2(cells(f, k, g), cells(f, k, h), ridge)[1]
            t += step
            z += step[rough[f], rough[k]]
    model.pairs = [(f, k, coarse[f], coarse[k], t) for t, (_, f, k) in zip(tables, ranked, strict=True)]
    return model


def held_out(id_col: str) -> Column:
    """Whether the row's label is kept from learning: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _featured(df: DataFrame, text: str, extra: list[Column], names: list[str], then) -> DataFrame:
    """Rows of ``extra`` and what ``then`` makes of the features (a list of arrays)."""
    source = df.select(F.col(f"`{text}`").cast("string").alias("text"), *[c.alias(f"x{i}") for i, c in enumerate(extra)])
    out, fields = then
    schema = T.StructType([T.StructField(n, source.schema[i + 1].dataType) for i, n in enumerate(names)] + fields)

    def run(batches):
        for batch in batches:
            made = out(features(K.column(batch, "text")))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], names=schema.names)

    return source.mapInArrow(K.lean(run), schema)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = 20_000, **params) -> Gam:
    """Fits on at most ``max_rows`` labelled rows that aren't held out.

    Labels that are null or that contradict each other (one id with 0 and 1) are left out."""
    usable = labels.select(F.col(f"`{id_col}`").alias("l_id"), F.col(f"`{label}`").cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("l_id").isNotNull() & ~held_out("l_id"))
    chosen = (
        usable.groupBy("l_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z")
        .orderBy(F.xxhash64("l_id", F.lit(5)), "l_id").limit(max_rows).select("l_id", "y")
    )
    ids = docs.sparkSession.createDataFrame(chosen.toArrow())  # max_rows rows
    rows = docs.join(F.broadcast(ids), F.col(f"`{id_col}`") == F.col("l_id"))
    got = _featured(
        rows, text, [F.col("l_id"), F.col("y")], ["id", "y"], (lambda m: [pa.array(m[:, i]) for i in range(m.shape[1])], [T.StructField(n, T.DoubleType()) for n in FEATURES])
    ).toArrow().to_pandas()  # max_rows rows of figures; more only if ids repeat
    got = got.sort_values(["id", "y", *FEATURES], kind="stable")
    return fit(got[list(FEATURES)].to_numpy(dtype=float), got["y"].to_numpy(dtype=float), **params)


def score(docs: DataFrame, model: Gam, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row; null and empty texts are scored as texts without words."""
    def out(m: np.ndarray):
        s = model.score(m)
        return [pa.array(s), pa.array((s >= 0.5).astype(np.int32))]

    return _featured(docs, text, [F.col(f"`{id_col}`"), held_out(id_col)], [id_col, "held_out"], (out, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
