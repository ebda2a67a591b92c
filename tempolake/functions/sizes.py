"""Sizes with binary units, on the driver and as columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import ENTRY_OVERHEAD

#: Every unit counts 1024 of the one below, whether written K, KB or KiB.
UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB")
_SIZE = re.compile(r"\s*((?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\s*([A-Za-z]*)\s*")


@dataclass(frozen=True, order=True)
class ReadableSize:
    bytes: int

    @classmethod
    def of(cls, n: float, unit: str) -> ReadableSize:
        return cls(int(n * 1024 ** UNITS.index(unit)))

    @classmethod
    def parse(cls, text: str) -> ReadableSize:
        """A number, with a fraction or exponent or not, and a unit (case matters); no unit means bytes."""
        m = _SIZE.fullmatch(text)
        if not m:
            raise ValueError(f"not a size: {text!r}")
        number, unit = m.groups()
        for power, name in enumerate(UNITS):
            if unit in ({"", "B"} if not power else {name, name[0], f"{name[0]}B"}):
                return cls(int(number) * 1024**power if number.isdigit() else int(float(number) * 1024**power))
        raise ValueError(f"not a unit: {unit!r}")

    def __mul__(self, n: int) -> ReadableSize:
        return ReadableSize(self.bytes * n)

    def __truediv__(self, n: int | ReadableSize) -> ReadableSize | int:
        return self.bytes // n.bytes if isinstance(n, ReadableSize) else ReadableSize(self.bytes // n)

    def exact(self) -> str:
        """The largest unit that divides the size, for configuration files; else the bytes."""
        for power in range(len(UNITS) - 1, 0, -1):
            if self.bytes and self.bytes % 1024**power == 0:
                return f"{self.bytes // 1024**power}{UNITS[power]}"
        return f"{self.bytes}B"

    def __str__(self) -> str:
        for power in range(len(UNITS) - 1, 0, -1):
            if self.bytes >= 1024**power:
                return f"{self.bytes / 1024**power:.1f}{UNITS[power]}"
        return f"{self.bytes}B"


def readable_size(n: Column) -> Column:
    """A size in bytes as text, like ``str(ReadableSize)``."""
    out = F.concat(n.cast("string"), F.lit("B"))
    for power, unit in enumerate(UNITS):
        if power:
            out = F.when(n >= 1024**power, F.concat(F.call_function("format_number", n / float(1024**power), F.lit("0.0")), F.lit(unit))).otherwise(out)
    return out


def entry_size(key: Column, value: Column) -> Column:
    return F.lit(ENTRY_OVERHEAD) + F.octet_length(key) + F.octet_length(value)


def output_files(n: Column, target: int) -> Column:
    """How many files of ``target`` bytes a merge of n bytes makes, one at least."""
    return F.greatest(F.lit(1), F.ceil(n / float(target)) if target else F.lit(1)).cast("long")


def n_output_files(n: int, target: int) -> int:
    return max(1, -(-n // target)) if target else 1
