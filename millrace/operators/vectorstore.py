"""A store of texts, vectors and their fields, as immutable versions of one table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.store import check_dim, cut, snapshot
from ..types import BadValue, UnknownColumn
from . import rag
from .predicates import All, Filter

#: Kinds of fields and their Spark types.
KINDS = {"value": "bigint", "symbol": "string", "ref": "bigint"}


@dataclass(frozen=True)
class StoreBuilder:
    """Fluent declaration: dimension, metric and typed fields."""

    size: int = 0
    by: str = "cosine"
    fields: dict[str, str] = field(default_factory=dict)

    def dim(self, n: int) -> "StoreBuilder":
        return replace(self, size=n)

    def metric(self, name: str) -> "StoreBuilder":
        return replace(self, by=name)

    def _field(self, name: str, kind: str) -> "StoreBuilder":
        return replace(self, fields={**self.fields, name: KINDS[kind]})

    def meta_value(self, name: str) -> "StoreBuilder":
        return self._field(name, "value")

    def meta_symbol(self, name: str) -> "StoreBuilder":
        return self._field(name, "symbol")

    def meta_ref(self, name: str) -> "StoreBuilder":
        return self._field(name, "ref")

    def build(self, spark: SparkSession) -> "VectorStore":
        if self.size <= 0:
            raise BadValue("a store needs a dimension")
        rest = "".join(f", `{n}` {t}" for n, t in self.fields.items())
        return VectorStore(self, spark.createDataFrame([], f"eid bigint, text string, embedding array<float>{rest}"))


@dataclass(frozen=True)
class VectorStore:
    """Chunks (eid, text, embedding, fields). A change gives a new store; the table of
    the old one stays as it was. Whole tables are inserted, replaced and deleted by
    joins; a store that many changes were made to is written by ``settled``."""

    spec: StoreBuilder
    df: DataFrame

    def _chunks(self, rows: DataFrame) -> DataFrame:
        """Rows with the store's columns; fields that they lack are missing."""
        if unknown := set(rows.columns) - set(self.df.columns):
            raise UnknownColumn(", ".join(sorted(unknown)))
        named = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.df.schema))
        return check_dim(named, "embedding", self.spec.size)

    def insert(self, rows: DataFrame) -> "VectorStore":
        """Append chunks; ids that are there already make a second chunk, so give new ones."""
        return replace(self, df=self.df.unionByName(self._chunks(rows)))

    def upsert(self, rows: DataFrame) -> "VectorStore":
        """Chunks of these ids become these rows as a whole: fields not given go."""
        return replace(self, df=self.df.join(rows.select("eid"), "eid", "left_anti").unionByName(self._chunks(rows)))

    def delete(self, ids: DataFrame) -> "VectorStore":
        return replace(self, df=self.df.join(ids.select("eid"), "eid", "left_anti"))

    def settled(self) -> "VectorStore":
        return replace(self, df=cut(self.df, "store"))

    def save(self, path: str) -> None:
        snapshot(self.df, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str, spec: StoreBuilder) -> "VectorStore":
        return cls(spec, check_dim(spark.read.parquet(path), "embedding", spec.size))

    def count(self) -> DataFrame:
        return self.df.agg(F.count("*").alias("count"))

    def texts(self, ids: DataFrame) -> DataFrame:
        return self._of(ids, "text")

    def vectors(self, ids: DataFrame) -> DataFrame:
        return self._of(ids, "embedding")

    def meta(self, ids: DataFrame, name: str) -> DataFrame:
        if name not in self.spec.fields:
            raise UnknownColumn(name)
        return self._of(ids, name)

    def _of(self, ids: DataFrame, name: str) -> DataFrame:
        """(eid, value) of each asked id; null where there is none."""
        return ids.select("eid").join(self.df.select("eid", name), "eid", "left")

    def search(self, vector: list[float], k: int, where: Filter = All()) -> DataFrame:
        if len(vector) != self.spec.size:
            raise BadValue(f"the query has {len(vector)} numbers, not {self.spec.size}")
        return rag.topk(self.df, vector, k, self.spec.by, where=where)

    def search_text(self, query: str, k: int, where: Filter = All()) -> DataFrame:
        found = rag.bm25(self.df.where("text <> ''"), query, candidates=self.df.where(where.column()))
        return found.orderBy(F.col("score").desc(), "eid").limit(k)

    def hybrid(self, vector: list[float], query: str, k: int, where: Filter = All()) -> DataFrame:
        return rag.hybrid(self.df, vector, query, k, self.spec.by, where=where)

    def reranked(self, found: DataFrame, score: Column | Callable[[str], float]) -> DataFrame:
        return rag.rerank(found.join(self.df.select("eid", "text"), "eid"), score)
