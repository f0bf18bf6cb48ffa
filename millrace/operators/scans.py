"""Scans and point reads over one table with an ``eid`` column. All are lazy and
leave pruning and pushdown to Catalyst."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .predicates import In, conjunction


def known(df: DataFrame, *names: str) -> bool:
    return all(n in df.columns for n in names)


def entities(df: DataFrame) -> DataFrame:
    return df.select("eid")


def having(df: DataFrame, name: str) -> DataFrame:
    """Entities that have an attribute; none for an unknown one."""
    return df.where(F.col(name).isNotNull()).select("eid") if known(df, name) else df.limit(0).select("eid")


def pull(df: DataFrame, name: str, value) -> DataFrame:
    return df.where(conjunction([(name, value)])) if known(df, name) else df.limit(0)


def query(df: DataFrame, conditions: list[tuple]) -> DataFrame:
    """AND of equalities; nothing for no condition or an unknown attribute."""
    return df.where(conjunction(conditions)) if known(df, *(n for n, _ in conditions)) else df.limit(0)


def pull_in(df: DataFrame, name: str, values: list) -> DataFrame:
    return df.where(In(name, tuple(dict.fromkeys(values))).column()) if known(df, name) else df.limit(0)


def pull_range(df: DataFrame, name: str, lo, hi, ordered: bool = False) -> DataFrame:
    """Inclusive range; by value, then entity, if the order is asked for."""
    out = df.where(F.col(name).between(lo, hi)) if known(df, name) else df.limit(0)
    return out.orderBy(name, "eid") if ordered else out


def range_scan(df: DataFrame, name: str, lo, hi, ordered: bool = False) -> DataFrame:
    """Inclusive range; by entity, if the order is asked for."""
    out = pull_range(df, name, lo, hi)
    return out.orderBy("eid") if ordered else out


def point(df: DataFrame, eid: int, name: str) -> DataFrame:
    return df.where(F.col("eid") == eid).select(name)


def stored_many(df: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """value + 1 for each asked entity, 0 where the value is missing."""
    return ids.select("eid").join(df.select("eid", name), "eid", "left").select("eid", F.coalesce(F.col(name) + 1, F.lit(0)).alias("stored"))


def facts(df: DataFrame) -> DataFrame:
    """(eid, attribute, value): every value that is there, as text."""
    rest = [c for c in df.columns if c != "eid"]
    return df.select("eid", *(F.col(c).cast("string").alias(c) for c in rest)).unpivot("eid", rest, "attribute", "value").where("value is not null")


def entity(df: DataFrame, eid: int) -> DataFrame:
    return facts(df.where(F.col("eid") == eid))


def attributes_of(df: DataFrame, eid: int) -> DataFrame:
    return entity(df, eid).select("attribute")


def find_value(df: DataFrame, name: str, text: str) -> DataFrame:
    """One row if the attribute has this text anywhere."""
    return df.where(F.col(name) == text).select(F.col(name).alias("value")).limit(1)


def cardinality(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count_distinct(name).alias("cardinality"))


def pull_dates(df: DataFrame, name: str, since: str, until: str) -> DataFrame:
    """Rows of which a date column lies within two dates, both included."""
    return df.where(F.col(name).between(F.lit(since).cast("date"), F.lit(until).cast("date")))


def live(df: DataFrame, ids: DataFrame) -> DataFrame:
    """(eid, live) for each asked id."""
    return ids.select("eid").join(df.select("eid", F.lit(True).alias("live")).distinct(), "eid", "left").select("eid", F.coalesce("live", F.lit(False)).alias("live"))


def counters(df: DataFrame, most: int = 1 << 32) -> DataFrame:
    """(entities, next_eid, remaining): how many there are, the id the next one gets,
    and how many more ids there are."""
    top = F.coalesce(F.max("eid") + 1, F.lit(0))
    return df.agg(F.count_distinct("eid").alias("entities"), top.alias("next_eid"), (F.lit(most) - top).alias("remaining"))
