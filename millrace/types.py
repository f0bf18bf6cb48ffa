"""Attribute types and table specifications."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, functions as F, types as T

MAX_NUMBER = (1 << 32) - 2
NUMBER, TAG, LEAF, REF = "number", "tag", "leaf", "ref"
_SPARK = {NUMBER: T.LongType(), TAG: T.StringType(), LEAF: T.StringType(), REF: T.LongType()}


class EngineError(Exception):
    """Any refusal of the engine; subclasses name the reason."""


class BadValue(EngineError):
    pass


class Unsupported(EngineError):
    pass


class DuplicateKey(EngineError):
    pass


class SchemaConflict(EngineError):
    pass


class UnknownTable(EngineError):
    pass


class UnknownColumn(EngineError):
    pass


@dataclass(frozen=True)
class ColumnSpec:
    """A typed column. ``cardinality`` is a hint and never changes a result."""

    name: str
    type: str
    target: str | None = None
    cardinality: int | None = None

    def field(self) -> T.StructField:
        return T.StructField(self.name, _SPARK[self.type], True, {"type": self.type, **({"target": self.target} if self.target else {})})


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: tuple[ColumnSpec, ...] = ()
    primary_key: str | None = None

    def column(self, name: str) -> ColumnSpec | None:
        """Case-insensitive."""
        return next((c for c in self.columns if c.name.lower() == name.lower()), None)

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("eid", T.LongType(), False), *(c.field() for c in self.columns)])


@dataclass
class TableBuilder:
    """Fluent declaration of a table."""

    name: str
    _columns: list[ColumnSpec] = field(default_factory=list)
    _key: str | None = None

    def column(self, name: str, type_: str, target: str | None = None) -> "TableBuilder":
        if name.startswith(("_c_", "_")) or any(x in name for x in ("|", ";", ":", "\n", "->")):
            raise BadValue(f"reserved column name {name!r}")
        if any(c.name.lower() == name.lower() for c in self._columns):
            raise SchemaConflict(f"column {name} twice")
        self._columns.append(ColumnSpec(name, type_, target))
        return self

    def number(self, name: str) -> "TableBuilder":
        return self.column(name, NUMBER)

    def tag(self, name: str) -> "TableBuilder":
        return self.column(name, TAG)

    def leaf(self, name: str) -> "TableBuilder":
        return self.column(name, LEAF)

    def ref_to(self, name: str, target: str) -> "TableBuilder":
        return self.column(name, REF, target)

    def cardinality(self, n: int) -> "TableBuilder":
        self._columns[-1] = replace(self._columns[-1], cardinality=n)
        return self

    def primary_key(self, name: str) -> "TableBuilder":
        self._key = name
        return self

    def build(self) -> TableSpec:
        spec = TableSpec(self.name, tuple(self._columns), self._key)
        if self._key and not spec.column(self._key):
            raise UnknownColumn(f"primary key {self._key}")
        return spec


def kind_of(t: T.DataType) -> str:
    """The attribute type of a Spark type."""
    return TAG if isinstance(t, T.StringType) else NUMBER if isinstance(t, T.NumericType) else LEAF


def checked_number(c: Column) -> Column:
    """A number column that raises outside 0 .. 2**32 - 2."""
    n = c.cast("bigint")
    return F.when(n.isNull() | n.between(0, MAX_NUMBER), n).otherwise(F.raise_error(F.lit("number out of range")).cast("bigint"))


def check_number(v: int) -> int:
    if not 0 <= v <= MAX_NUMBER:
        raise BadValue(f"{v} is out of range")
    return v
