"""The log's schema, limits and write batches.

A log row is one version of a key: ``(key, ts, seqno, op_index, op, value)``. ``op`` is 0 for a put
and 1 for a tombstone. Timestamps have no unit. The rows of one batch share a seqno; ``op_index`` keeps
their order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

PUT, TOMBSTONE = 0, 1
MAX_KEY_BYTES = 65_535
MAX_TS = 2**63 - 1
DEFAULT_LIMIT, MAX_LIMIT = 100, 1000
#: A stored entry is this many bytes beside its key and value.
ENTRY_OVERHEAD = 33

LOG = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("ts", T.LongType(), False),
        T.StructField("seqno", T.LongType(), False),
        T.StructField("op_index", T.IntegerType(), False),
        T.StructField("op", T.ByteType(), False),
        T.StructField("value", T.BinaryType(), False),
    ]
)
SERIES = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType()), T.StructField("timestamp", T.LongType())])


class StoreError(Exception):
    """What the store refuses or cannot do."""


class KeyNotFound(StoreError):
    pass


class InvalidTimestamp(StoreError):
    pass


class InvalidLimit(StoreError):
    pass


class InvalidKey(StoreError):
    pass


class EncodingError(StoreError):
    """A key or value that is not UTF-8."""


class CommitConflict(StoreError):
    pass


def check_ts(ts: int) -> int:
    if not isinstance(ts, int) or isinstance(ts, bool) or not 0 <= ts <= MAX_TS:
        raise InvalidTimestamp(f"timestamp must be from 0 to {MAX_TS}: {ts!r}")
    return ts


def check_limit(limit: int | None) -> int:
    limit = DEFAULT_LIMIT if limit is None else limit
    if not 1 <= limit <= MAX_LIMIT:
        raise InvalidLimit(f"limit must be from 1 to {MAX_LIMIT}: {limit}")
    return limit


def as_bytes(x: str | bytes) -> bytes:
    return x.encode() if isinstance(x, str) else bytes(x)


def check_key(key: str | bytes) -> bytes:
    key = as_bytes(key)
    if len(key) > MAX_KEY_BYTES:
        raise InvalidKey(f"a key has at most {MAX_KEY_BYTES} bytes: {len(key)}")
    return key


@dataclass
class WriteBatch:
    """Puts and deletes that become visible together, in their order."""

    #: (key, ts, op, value)
    ops: list[tuple[bytes, int, int, bytes]] = field(default_factory=list)

    def put(self, key: str | bytes, value: str | bytes, ts: int) -> WriteBatch:
        self.ops.append((check_key(key), check_ts(ts), PUT, as_bytes(value)))
        return self

    def delete(self, key: str | bytes, ts: int) -> WriteBatch:
        self.ops.append((check_key(key), check_ts(ts), TOMBSTONE, b""))
        return self

    def clear(self) -> None:
        self.ops.clear()

    def __len__(self) -> int:
        return len(self.ops)

    def __iter__(self):
        return iter(self.ops)

    @property
    def size(self) -> int:
        """The bytes that the entries take."""
        return sum(ENTRY_OVERHEAD + len(k) + len(v) for k, _, _, v in self.ops)
