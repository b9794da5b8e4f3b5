"""Key ranges: two bounds, each included, excluded or open."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.errors import InvalidConfig


@dataclass(frozen=True)
class Bound:
    """value is None where the side is open."""

    value: Any = None
    included: bool = True


OPEN = Bound()


def included(value) -> Bound:
    return Bound(value, True)


def excluded(value) -> Bound:
    return Bound(value, False)


@dataclass(frozen=True)
class KeyRange:
    """Keys between two bounds. Bounds in the wrong order are an error, before anything is read."""

    low: Bound = OPEN
    high: Bound = OPEN

    def __post_init__(self):
        if self.low.value is not None and self.high.value is not None and self.low.value > self.high.value:
            raise InvalidConfig("the range's start is behind its end")

    def is_empty(self) -> bool:
        """No key can be inside: one value that is not included on both sides, or what is below the empty key."""
        lo, hi = self.low, self.high
        if lo.value is not None and lo.value == hi.value and not (lo.included and hi.included):
            return True
        return not hi.included and hi.value in (b"", "")

    def holds(self, key) -> bool:
        lo, hi = self.low, self.high
        above = lo.value is None or key > lo.value or (lo.included and key == lo.value)
        return above and (hi.value is None or key < hi.value or (hi.included and key == hi.value))

    def overlaps(self, first, last) -> bool:
        """Whether keys from first to last may be inside: what a run's smallest and largest key are tested with."""
        lo, hi = self.low, self.high
        below = lo.value is not None and (last < lo.value or (last == lo.value and not lo.included))
        above = hi.value is not None and (first > hi.value or (first == hi.value and not hi.included))
        return not (below or above or self.is_empty())

    def predicates(self, key: Column) -> list[Column]:
        out = []
        if self.low.value is not None:
            v = F.lit(self.low.value)
            out.append(key >= v if self.low.included else key > v)
        if self.high.value is not None:
            v = F.lit(self.high.value)
            out.append(key <= v if self.high.included else key < v)
        return out

    def restrict(self, df: DataFrame, key: str = "key") -> DataFrame:
        """df inside the range. The filter is on the key alone, so it passes below a merge by key and reaches the scan."""
        if self.is_empty():
            return df.limit(0)
        for p in self.predicates(F.col(key)):
            df = df.filter(p)
        return df


def successor(prefix: bytes) -> bytes | None:
    """The smallest key behind all that begin with the prefix; None if there is none (only 0xFF, or empty)."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


def prefix_range(prefix: bytes | str) -> KeyRange:
    """All keys that begin with the prefix, as a range, so that minima and maxima of files and row groups prune it."""
    if isinstance(prefix, str):
        end = successor(prefix.encode())
        if end is not None:
            try:
                return KeyRange(included(prefix), excluded(end.decode()))
            except UnicodeDecodeError:
                pass
        return KeyRange(included(prefix), included(prefix + "\U0010ffff")) if prefix else KeyRange()
    end = successor(prefix)
    return KeyRange(included(prefix), OPEN if end is None else excluded(end))
