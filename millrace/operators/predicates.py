"""Filter algebra: small immutable trees that become Column predicates."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, functions as F


class Filter:
    def column(self) -> Column:
        raise NotImplementedError

    def __and__(self, other: "Filter") -> "Filter":
        return And((self, other))

    def __or__(self, other: "Filter") -> "Filter":
        return Or((self, other))

    def __invert__(self) -> "Filter":
        return Not(self)


@dataclass(frozen=True)
class All(Filter):
    def column(self) -> Column:
        return F.lit(True)


@dataclass(frozen=True)
class Eq(Filter):
    """Equality; of a number, a text or a reference. Null equals nothing."""

    name: str
    value: int | str | None

    def column(self) -> Column:
        return F.lit(False) if self.value is None else F.col(self.name) == F.lit(self.value)


@dataclass(frozen=True)
class Range(Filter):
    """Inclusive; nothing if lo > hi."""

    name: str
    lo: int
    hi: int

    def column(self) -> Column:
        return F.col(self.name).between(self.lo, self.hi)


@dataclass(frozen=True)
class In(Filter):
    name: str
    values: tuple

    def column(self) -> Column:
        return F.col(self.name).isin(list(self.values)) if self.values else F.lit(False)


@dataclass(frozen=True)
class And(Filter):
    """All parts; of no part: everything."""

    parts: tuple[Filter, ...]

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, (p.column() for p in self.parts), F.lit(True)) if self.parts else F.lit(True)


@dataclass(frozen=True)
class Or(Filter):
    parts: tuple[Filter, ...]

    def column(self) -> Column:
        return reduce(lambda a, b: a | b, (p.column() for p in self.parts)) if self.parts else F.lit(False)


@dataclass(frozen=True)
class Not(Filter):
    """All rows but those of the part: a row whose field is missing stays."""

    part: Filter

    def column(self) -> Column:
        return ~F.coalesce(self.part.column(), F.lit(False))


def conjunction(conditions: dict | list[tuple]) -> Column:
    """Multi-condition AND; an empty list matches nothing."""
    pairs = list(conditions.items()) if isinstance(conditions, dict) else conditions
    return And(tuple(Eq(n, v) for n, v in pairs)).column() if pairs else F.lit(False)
