"""Catalog of typed virtual tables; state is immutable DataFrames by name."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import dml
from ..sources.store import cut, snapshot
from ..types import LEAF, NUMBER, REF, TAG, BadValue, ColumnSpec, SchemaConflict, TableBuilder, TableSpec, UnknownColumn, UnknownTable, Unsupported, check_number, kind_of
from .query import Query

#: A table is written after so many changes.
SETTLE = 16
SPECS = "name string, primary_key string, columns array<struct<name:string,type:string,target:string,cardinality:bigint>>"


class Catalog:
    """Named tables with specifications, keys, references and tenant scopes."""

    def __init__(self, spark: SparkSession, read_only: bool = False):
        self.spark, self.read_only = spark, read_only
        self.specs: dict[str, TableSpec] = {}
        self.tables: dict[str, DataFrame] = {}
        self.next_eid: dict[str, int] = {}
        self.changes: dict[str, int] = {}

    def _writable(self) -> None:
        if self.read_only:
            raise Unsupported("a replica takes no writes")

    def put(self, name: str, df: DataFrame) -> None:
        """A table's next version. After ``SETTLE`` changes it is written, so a plan
        never holds more than that many."""
        self._writable()
        self.tables[name] = df
        self.changes[name] = self.changes.get(name, 0) + 1
        if self.changes[name] >= SETTLE:
            self.settle(name)

    # -- declaration -----------------------------------------------------------
    def declare(self, builder: TableBuilder | TableSpec, data: DataFrame | None = None) -> "Table":
        """Create a table, or migrate it: declared columns must begin with the old
        ones, new ones follow."""
        self._writable()
        spec = builder.build() if isinstance(builder, TableBuilder) else builder
        for c in spec.columns:
            if c.type == REF and c.target not in self.specs and c.target != spec.name:
                raise UnknownTable(f"reference target {c.target}")
        if old := self.specs.get(spec.name):
            same = [(a.name, a.type, a.target) for a in old.columns] == [(a.name, a.type, a.target) for a in spec.columns[: len(old.columns)]]
            if not same or old.primary_key != spec.primary_key:
                raise SchemaConflict(spec.name)
            now = self.tables[spec.name]
            for c in spec.columns[len(old.columns) :]:
                now = dml.add_column(now, c.name, c.field().dataType.simpleString())
        else:
            now = data if data is not None else self.spark.createDataFrame([], spec.schema())
        self.specs[spec.name], self.tables[spec.name] = spec, now
        return Table(self, spec.name)

    def register(self, name: str, df: DataFrame, key: str | None = None) -> "Table":
        """A table over existing data: numbers become numbers, texts tags, and all else
        (dates, booleans, arrays) leaves, which no equality finds."""
        columns = tuple(ColumnSpec(f.name, kind_of(f.dataType)) for f in df.schema if f.name != "eid")
        self.specs[name] = TableSpec(name, columns, key)
        self.tables[name] = df
        return Table(self, name)

    def add_column(self, table: str, column: ColumnSpec) -> None:
        """Idempotent; a different type under the name is a conflict."""
        self._writable()
        spec = self.spec(table)
        if old := spec.column(column.name):
            if (old.type, old.target) != (column.type, column.target):
                raise SchemaConflict(column.name)
            return
        self.specs[table] = replace(spec, columns=(*spec.columns, column))
        self.tables[table] = dml.add_column(self.tables[table], column.name, column.field().dataType.simpleString())

    def spec(self, name: str) -> TableSpec:
        if name not in self.specs:
            raise UnknownTable(name)
        return self.specs[name]

    def table(self, name: str) -> "Table":
        self.spec(name)
        return Table(self, name)

    def list_tables(self) -> list[str]:
        return sorted(n for n in self.specs if not n.startswith("_"))

    def references(self, table: str) -> dict[str, str]:
        return {c.name: c.target for c in self.spec(table).columns if c.type == REF}

    def scope(self, prefix: str) -> "Scope":
        return Scope(self, prefix)

    def describe(self) -> DataFrame:
        """(table, column, type, target, key): every declared column."""
        rows = [(t, c.name, c.type, c.target, c.name == s.primary_key) for t, s in sorted(self.specs.items()) for c in s.columns]
        return self.spark.createDataFrame(rows, "table string, column string, type string, target string, key boolean")

    def ranges(self) -> DataFrame:
        """(table, first, last, rows): the ids of each table."""
        each = [df.agg(F.lit(n).alias("table"), F.min("eid").alias("first"), F.max("eid").alias("last"), F.count("*").alias("rows")) for n, df in sorted(self.tables.items())]
        return reduce(DataFrame.union, each, self.spark.createDataFrame([], "table string, first bigint, last bigint, rows bigint"))

    def save(self, path: str) -> None:
        """Every table and, last, the declarations, which ``open`` reads back."""
        for name, df in self.tables.items():
            snapshot(df, f"{path}/tables/{name}")
        rows = [(s.name, s.primary_key, [(c.name, c.type, c.target, c.cardinality) for c in s.columns]) for s in self.specs.values()]
        snapshot(self.spark.createDataFrame(rows, SPECS).coalesce(1), f"{path}/specs")

    @classmethod
    def open(cls, spark: SparkSession, path: str, read_only: bool = False) -> "Catalog":
        """A saved catalog: the same declarations over the same rows. ``read_only`` opens
        it as a replica, which refuses writes."""
        out = cls(spark, read_only)
        for r in spark.read.schema(SPECS).parquet(f"{path}/specs").collect():  # a row a table
            out.specs[r.name] = TableSpec(r.name, tuple(ColumnSpec(*c) for c in r.columns), r.primary_key)
            out.tables[r.name] = spark.read.parquet(f"{path}/tables/{r.name}")
        return out

    def settle(self, name: str) -> None:
        """Write a table that many changes were made to, which ends its lineage."""
        self.tables[name] = cut(self.tables[name], "table")
        self.changes[name] = 0


class Scope:
    """A tenant's tables: the prefix is added to names and left out of listings."""

    def __init__(self, catalog: Catalog, prefix: str):
        self.catalog, self.prefix = catalog, prefix

    def declare(self, builder: TableBuilder, data: DataFrame | None = None) -> "Table":
        spec = builder.build()
        own = lambda n: f"{self.prefix}.{n}" if n else n
        return self.catalog.declare(replace(spec, name=own(spec.name), columns=tuple(replace(c, target=own(c.target)) for c in spec.columns)), data)

    def table(self, name: str) -> "Table":
        return self.catalog.table(f"{self.prefix}.{name}")

    def list_tables(self) -> list[str]:
        return [n.removeprefix(self.prefix + ".") for n in self.catalog.list_tables() if n.startswith(self.prefix + ".")]


class Table:
    """One table of a catalog."""

    def __init__(self, catalog: Catalog, name: str):
        self.catalog, self.name = catalog, name

    @property
    def spec(self) -> TableSpec:
        return self.catalog.spec(self.name)

    @property
    def df(self) -> DataFrame:
        return self.catalog.tables[self.name]

    def _checked(self, values: dict) -> dict:
        out = {}
        for n, v in values.items():
            c = self.spec.column(n)
            if c is None:
                raise UnknownColumn(n)
            if v is None or (c.type in (TAG, LEAF)) != isinstance(v, str):
                raise BadValue(f"{n} = {v!r}")
            out[c.name] = v if isinstance(v, str) else check_number(v) if c.type == NUMBER else v
        return out

    def insert(self, *rows: dict) -> None:
        """Append rows; keys are not checked, nulls are refused."""
        self._append([self._checked(r) for r in rows])

    def _append(self, rows: list[dict]) -> None:
        self.catalog._writable()
        if self.name not in self.catalog.next_eid:  # once a table; later inserts count on
            self.catalog.next_eid[self.name] = self.df.agg(F.coalesce(F.max("eid"), F.lit(-1))).first()[0] + 1
        first = self.catalog.next_eid[self.name]
        data = [(first + i, *(r.get(c.name) for c in self.spec.columns)) for i, r in enumerate(rows)]
        self.catalog.next_eid[self.name] = first + len(rows)
        self.catalog.put(self.name, self.df.unionByName(self.catalog.spark.createDataFrame(data, self.spec.schema())))

    def upsert(self, row: dict) -> None:
        """Change the row with this key, or insert it."""
        row, key = self._checked(row), self.spec.primary_key
        if key and key in row and not self.df.where(F.col(key) == row[key]).isEmpty():
            self.catalog.put(self.name, dml.tie(self.df, F.col(key) == row[key], {n: v for n, v in row.items() if n != key}))
        else:
            self._append([row])

    def get(self, eid: int) -> DataFrame:
        return self.df.where(F.col("eid") == eid)

    def update(self, eid: int, values: dict) -> None:
        self.catalog.put(self.name, dml.tie(self.df, F.col("eid") == eid, self._checked(values)))

    def delete(self, eid: int) -> None:
        self.catalog.put(self.name, dml.delete(self.df, F.col("eid") == eid))

    def query(self) -> Query:
        return Query(self.df, self.spec)

    def all(self) -> DataFrame:
        """Rows that have the key, or without a key the first column."""
        first = self.spec.primary_key or (self.spec.columns[0].name if self.spec.columns else "eid")
        return self.df.where(F.col(first).isNotNull())
