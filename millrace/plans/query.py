"""Immutable fluent queries over one table."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import aggregates as agg
from ..types import LEAF, NUMBER, TAG, BadValue, TableSpec


@dataclass(frozen=True)
class Query:
    """Predicates are Columns until a terminal builds one plan of them.

    Unknown columns: nothing is found by equality or range, comparisons and IN are
    left out, aggregates refuse."""

    df: DataFrame
    spec: TableSpec
    parts: tuple[Column, ...] = ()
    most: int | None = None
    has_in: bool = False

    def _and(self, p: Column, **more) -> "Query":
        return replace(self, parts=(*self.parts, p), **more)

    def where_eq(self, name: str, value) -> "Query":
        c = self.spec.column(name)
        if c is None or value is None or c.type == LEAF or (c.type == TAG) != isinstance(value, str):
            return self._and(F.lit(False))
        return self._and(F.col(c.name) == F.lit(value))

    def where_range(self, name: str, lo: int, hi: int) -> "Query":
        c = self.spec.column(name)
        return self._and(F.col(c.name).between(lo, hi) if c else F.lit(False))

    def _compare(self, name: str, f) -> "Query":
        c = self.spec.column(name)
        return self._and(f(F.col(c.name))) if c else self

    def where_gt(self, name: str, v: int) -> "Query":
        return self._compare(name, lambda c: c > v)

    def where_ge(self, name: str, v: int) -> "Query":
        return self._compare(name, lambda c: c >= v)

    def where_lt(self, name: str, v: int) -> "Query":
        return self._compare(name, lambda c: c < v)

    def where_le(self, name: str, v: int) -> "Query":
        return self._compare(name, lambda c: c <= v)

    def where_ref(self, name: str, eid: int) -> "Query":
        return self._compare(name, lambda c: c == eid)

    def where_in(self, name: str, values: list[int]) -> "Query":
        if self.has_in:
            raise BadValue("one IN list a query")
        c = self.spec.column(name)
        return self._and(F.col(c.name).isin(list(values)) if values else F.lit(False), has_in=True) if c else self

    def limit(self, n: int) -> "Query":
        return replace(self, most=n)

    def find(self) -> DataFrame:
        """Matching rows; a limit takes the smallest entities."""
        out = self.df
        if self.parts:
            for p in self.parts:
                out = out.where(p)
        else:
            first = self.spec.primary_key or (self.spec.columns[0].name if self.spec.columns else "eid")
            out = out.where(F.col(first).isNotNull())
        return out if self.most is None else out.orderBy("eid").limit(self.most)

    def find_one(self) -> DataFrame:
        return self.limit(1).find()

    def count(self) -> DataFrame:
        return agg.count(self.find())

    def _known(self, *names: str) -> list[str]:
        found = [self.spec.column(n) for n in names]
        if None in found:
            raise BadValue(f"unknown column among {names}")
        if found[-1].type not in (NUMBER, "ref"):
            raise BadValue(f"{names[-1]} is not a number")
        return [c.name for c in found]

    def count_col(self, x: str) -> DataFrame:
        c = self.spec.column(x)
        if c is None:
            raise BadValue(x)
        return agg.count_col(self.find(), c.name)

    def sum(self, x: str) -> DataFrame:
        return agg.sum_(self.find(), *self._known(x))

    def min(self, x: str) -> DataFrame:
        return agg.min_(self.find(), *self._known(x))

    def max(self, x: str) -> DataFrame:
        return agg.max_(self.find(), *self._known(x))

    def avg(self, x: str) -> DataFrame:
        return agg.avg(self.find(), *self._known(x))

    def group_count(self, k: str) -> DataFrame:
        c = self.spec.column(k)
        if c is None:
            raise BadValue(k)
        return agg.group_count(self.find(), c.name)

    def group_sum(self, k: str, x: str) -> DataFrame:
        return agg.group_sum(self.find(), *self._known(k, x))

    def group_min(self, k: str, x: str) -> DataFrame:
        return agg.group_min(self.find(), *self._known(k, x))

    def group_max(self, k: str, x: str) -> DataFrame:
        return agg.group_max(self.find(), *self._known(k, x))

    def group_avg(self, k: str, x: str) -> DataFrame:
        return agg.group_avg(self.find(), *self._known(k, x))

    def histogram(self, x: str, lo: int, hi: int, n: int) -> DataFrame:
        return agg.histogram(self.find(), *self._known(x), lo, hi, n)
