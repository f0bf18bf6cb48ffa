"""Row changes as new versions of immutable tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import date_to_days, days_to_date
from ..types import BadValue, DuplicateKey


def tie(df: DataFrame, which: Column, values: dict[str, object]) -> DataFrame:
    """Set attributes of matching rows; null values leave the old ones."""
    hit = F.coalesce(which, F.lit(False))
    return df.withColumns({n: F.when(hit, F.lit(v).cast(df.schema[n].dataType)).otherwise(F.col(n)) for n, v in values.items() if v is not None})


def untie(df: DataFrame, which: Column, *names: str) -> DataFrame:
    hit = F.coalesce(which, F.lit(False))
    return df.withColumns({n: F.when(~hit, F.col(n)) for n in names})


def delete(df: DataFrame, which: Column | None = None) -> DataFrame:
    """Without matching rows; without a condition, without any. References to
    deleted entities stay."""
    return df.limit(0) if which is None else df.where(~F.coalesce(which, F.lit(False)))


def add_column(df: DataFrame, name: str, type_: str) -> DataFrame:
    return df if name.lower() in (c.lower() for c in df.columns) else df.withColumn(name, F.lit(None).cast(type_))


def insert(df: DataFrame, rows: DataFrame, key: str | None = None) -> DataFrame:
    """Append. With a key, the whole batch is refused if any key is there already or
    twice in the batch (one check job)."""
    if key:
        again = rows.groupBy(key).count().where("count > 1").select(key).union(rows.join(df.select(key), key, "left_semi").select(key)).limit(1).collect()
        if again:
            raise DuplicateKey(f"{key} = {again[0][0]!r}")
    return df.unionByName(rows, allowMissingColumns=True)


def merge(df: DataFrame, rows: DataFrame, key: str, supplied: list[str] | None = None) -> DataFrame:
    """Insert or replace by key: of rows that are there, only supplied columns change,
    and not to null. One full outer join on the key; keys of ``rows`` must be unique."""
    supplied = [c for c in (supplied or rows.columns) if c != key]
    new = rows.select(F.col(key), *(F.col(c).alias(f"_n_{c}") for c in supplied))
    both = df.join(new, key, "full_outer")
    return both.select(*(F.coalesce(f"_n_{c}", c).alias(c) if c in supplied else F.col(c) for c in df.columns))


def tie_date(df: DataFrame, which: Column, name: str, day: str) -> DataFrame:
    """Set a number column of matching rows to a date's days since the epoch."""
    return df.withColumn(name, F.when(F.coalesce(which, F.lit(False)), date_to_days(F.lit(day).cast("date"))).otherwise(F.col(name)))


def get_date(df: DataFrame, name: str) -> DataFrame:
    """(eid, name): a column of days as dates."""
    return df.select("eid", days_to_date(F.col(name)).alias(name))


def tie_bytes(df: DataFrame, which: Column, name: str, data: bytes) -> DataFrame:
    """Set a binary column of matching rows."""
    return df.withColumn(name, F.when(F.coalesce(which, F.lit(False)), F.lit(bytearray(data))).otherwise(F.col(name)))


def tie_ref(df: DataFrame, which: Column, name: str, eid: int, target: DataFrame) -> DataFrame:
    """Let matching rows refer to an entity, which must be one of ``target`` (one look
    at that id)."""
    if target.where(F.col("eid") == eid).isEmpty():
        raise BadValue(f"{name} = {eid}: there is no such entity")
    return tie(df, which, {name: eid})
