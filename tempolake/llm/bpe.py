"""Byte-level BPE encoding and decoding by merge replay over a corpus slice.

The distinct pre-tokens ("words") of a task's documents are laid out once as a
linked list of symbols. An inverted index maps each pair, named by the rank of
the token it makes, to the positions where it stands. Ranks are applied from
the lowest up: each application merges all positions of that rank at once and
touches only their left and right neighbours, whose new pairs enter the index.
The work follows the distinct words, not the running text; the id runs of
documents are then gathered from the words.

Rows are independent, so nothing is shuffled and a lost executor costs only its
tasks. A task keeps at most ``CACHE_WORDS`` finished words between batches.

The index is a slice's, not the whole corpus's: corpus-level words would be made distinct by a shuffle, replayed once,
and then joined back to every occurrence, which moves each token of the corpus with its place, several times the text.
That form was not built, so which is faster is not known; the README has what was measured.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .shared import hidden

CACHE_WORDS = 200_000
CACHE_BYTES = 16 << 20
#: Texts are encoded in slices of about so many characters; this bounds a task's memory.
SLICE_CHARS = 2_000_000
#: No pair, or none that a merge makes.
NONE = np.int32(1 << 30)


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file of a tokenizer: base64 of the token, its id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Merges:
    """Ranks prepared for replay."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        for k, v in ranks.items():
            self.token[v] = k
        self.byte = np.full(256, -1, dtype=np.int32)
        for b in range(256):
            self.byte[b] = ranks.get(bytes([b]), -1)
        if (self.byte < 0).any():
            raise ValueError("the ranks lack single bytes")
        pairs = []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a = ranks.get(token[:cut])
                if a is not None and (b := ranks.get(token[cut:])) is not None:
                    pairs.append(((a << 20) | b, rank))
        pairs.sort()
        self.pair = np.array([k for k, _ in pairs] + [np.iinfo(np.int64).max], dtype=np.int64)
        self.rank = np.array([r for _, r in pairs] + [0], dtype=np.int32)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the token that each two symbols make, or NONE."""
        key = (left.astype(np.int64) << 20) | right
        at = np.searchsorted(self.pair, key)
        return np.where(self.pair[at] == key, self.rank[at], NONE)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and the number of ids of each word."""
        size = np.array([len(w) for w in words], dtype=np.int64)
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        n = len(data)
        if not n:
            return np.empty(0, dtype=np.int32), size
        sym = self.byte[data]
        end = np.cumsum(size)
        kind = np.int32 if n < 2**31 else np.int64
        after = np.arange(1, n + 1, dtype=kind)
        after[end[size > 0] - 1] = -1
        before = np.arange(-1, n - 1, dtype=kind)
        before[(end - size)[size > 0]] = -1
        rank = np.full(n, NONE, dtype=np.int32)
        has = np.flatnonzero(after >= 0).astype(kind)
        rank[has] = self.lookup(sym[has], sym[has + 1])
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def enter(at: np.ndarray) -> None:
            r = rank[at]
            at, r = at[r < NONE], r[r < NONE]
            if not len(at):
                return
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cuts = np.flatnonzero(np.diff(r)) + 1
            for key, part in zip(r[np.r_[0, cuts]].tolist(), np.split(at, cuts) if len(cuts) else (at,), strict=True):
                if key in index:
                    index[key].append(part)
                else:
                    index[key] = [part]
                    heapq.heappush(queue, key)

        enter(has)
        while queue:
            r = heapq.heappop(queue)
            parts = index.pop(r)
            at = parts[0] if len(parts) == 1 else np.concatenate(parts)
            at = np.unique(at[rank[at] == r])
            if not len(at):
                continue
            nxt = after[at]
            if len(at) > 1 and (chained := np.r_[False, nxt[:-1] == at[1:]]).any():
                # runs of one symbol: from the left, every other position merges
                place = np.arange(len(at))
                begin = np.maximum.accumulate(np.where(chained, 0, place))
                at = at[(place - begin) % 2 == 0]
                nxt = after[at]
            far = after[nxt]
            sym[at] = r
            after[at] = far
            rank[nxt] = NONE
            sym[nxt] = -1
            more = far >= 0
            before[far[more]] = at[more]
            rank[at] = NONE
            rank[at[more]] = self.lookup(sym[at[more]], sym[far[more]])
            prev = before[at]
            left = prev[prev >= 0]
            rank[left] = self.lookup(sym[left], sym[after[left]])
            enter(np.concatenate([at[more], left]))
        alive = sym >= 0
        total = np.concatenate([[0], np.cumsum(alive)])
        return sym[alive], total[end] - total[end - size]


class Encoder:
    """Encodes texts as the pattern's matches, each by merge replay."""

    def __init__(self, merges: Merges, pattern: str):
        import regex

        self.merges, self.find = merges, regex.compile(pattern).findall
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.empty(0, dtype=np.int32)
        self.from_ = np.zeros(1, dtype=np.int64)
        self.held = 0

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        if len(self.place) > CACHE_WORDS or self.held > CACHE_BYTES:
            self.clear()
        place, known = self.place, len(self.place)
        runs = []
        for text in texts:
            words = self.find(text)
            for w in words:
                if w not in place:
                    place[w] = len(place)
            runs.append(np.fromiter(map(place.__getitem__, words), dtype=np.int32, count=len(words)))
        if len(place) > known:
            fresh = [w.encode("utf-8", "surrogatepass") for w in list(place)[known:]]
            self.held += sum(map(len, fresh))
            whole = np.array([self.merges.ranks.get(w, -1) for w in fresh], dtype=np.int64)
            ids, count = self.merges.replay([w if k < 0 else b"" for w, k in zip(fresh, whole.tolist(), strict=True)])
            out = np.empty(int(count.sum() + (whole >= 0).sum()), dtype=np.int32)
            count = np.where(whole >= 0, 1, count)
            end = np.cumsum(count)
            single = (end - count)[whole >= 0]
            rest = np.ones(len(out), dtype=bool)
            rest[single] = False
            out[single], out[rest] = whole[whole >= 0], ids
            self.from_ = np.concatenate([self.from_, self.from_[-1] + end])
            self.ids = np.concatenate([self.ids, out])
        result = []
        for run in runs:
            size = self.from_[run + 1] - self.from_[run]
            step = np.cumsum(size)
            total = int(step[-1]) if len(step) else 0
            result.append(self.ids[np.repeat(self.from_[run] - (step - size), size) + np.arange(total)].astype("<u4"))
        return result

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.merges.token.__getitem__, ids.tolist()))


def _slices(texts, most: int):
    """(start, stop) so that each slice has about ``most`` characters."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(
    df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids",
    n_tokens: str = "n_tokens", decoded: str | None = None, keep_text: bool = True,
) -> DataFrame:
    """Adds the token ids of ``text``: packed (little-endian unsigned 32-bit) in
    ``ids``, their number in ``n_tokens`` and, if named, the bytes that the ids
    decode to in ``decoded``.

    A null or empty text has no ids and decodes to no bytes. Every other column
    stays as it is (``text`` only if ``keep_text``); one that has the name of
    an added column is replaced. Texts of any length are encoded whole.
    """
    session = df.sparkSession
    added = {ids, n_tokens, *([decoded] if decoded else [])}
    rest = [c for c in df.columns if c not in added and (keep_text or c != text)]
    source = df.select(*hidden(rest), F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType(
        [df.schema[c] for c in rest]
        + [T.StructField(n_tokens, T.LongType()), T.StructField(ids, T.BinaryType())]
        + ([T.StructField(decoded, T.BinaryType())] if decoded else [])
    )
    shared = session.sparkContext.broadcast(Merges(read_ranks(ranks_path)))  # prepared once; bounded by the vocabulary

    def run(batches):
        coder = Encoder(shared.value, pattern)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            texts = [t or "" for t in column.to_pylist()]
            for a, b in _slices(texts, SLICE_CHARS):
                coded = coder.encode(texts[a:b])
                at = a
                for c, d in _slices(texts[a:b], SLICE_CHARS // 4):
                    part = coded[c:d]
                    out = [batch.column(i).slice(at, d - c) for i in range(len(rest))]
                    out.append(pa.array([len(x) for x in part], pa.int64()))
                    out.append(pa.array([x.tobytes() for x in part], pa.binary()))
                    if decoded:
                        out.append(pa.array([coder.decode(x) for x in part], pa.binary()))
                    yield pa.RecordBatch.from_arrays(out, names=schema.names)
                    at += d - c

    return source.mapInArrow(K.lean(run), schema)


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the bytes that packed ``ids`` stand for; null ids give null."""
    rest = [c for c in df.columns if c != decoded]
    source = df.select(*hidden(rest))
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField(decoded, T.BinaryType())])
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches):
        token = [b""] * (max(shared.value.values()) + 1)
        for k, v in shared.value.items():
            token[v] = k
        for batch in batches:
            packed = batch.column(rest.index(ids)).to_pylist()
            out = [None if x is None else b"".join(map(token.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in packed]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=schema.names)

    return source.mapInArrow(K.lean(run), schema)


def digest(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()
