"""Aggregates over a filtered table; missing values are skipped.

Groups of zero sums and all keys are kept, whatever cardinality was hinted."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def sum_(df: DataFrame, x: str) -> DataFrame:
    return df.agg(F.coalesce(F.sum(F.col(x).cast("bigint")), F.lit(0)).alias("sum"))


def count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("count"))


def count_col(df: DataFrame, x: str) -> DataFrame:
    return df.agg(F.count(x).alias("count"))


def min_(df: DataFrame, x: str) -> DataFrame:
    return df.agg(F.min(x).alias("min"))


def max_(df: DataFrame, x: str) -> DataFrame:
    return df.agg(F.max(x).alias("max"))


def avg(df: DataFrame, x: str) -> DataFrame:
    """Integer division; null for no value."""
    return df.agg(F.sum(F.col(x).cast("bigint")).alias("s"), F.count(x).alias("n")).selectExpr("s div nullif(n, 0) as avg")


def distinct(df: DataFrame, x: str) -> DataFrame:
    return df.where(F.col(x).isNotNull()).select(F.col(x).alias("value")).distinct()


def _grouped(df: DataFrame, k: str, x: str):
    """A row counts only if both group and value are there."""
    return df.where(F.col(k).isNotNull() & F.col(x).isNotNull()).groupBy(F.col(k).alias("key"))


def group_count(df: DataFrame, k: str) -> DataFrame:
    return df.where(F.col(k).isNotNull()).groupBy(F.col(k).alias("key")).agg(F.count("*").alias("count"))


def group_sum(df: DataFrame, k: str, x: str) -> DataFrame:
    return _grouped(df, k, x).agg(F.sum(F.col(x).cast("bigint")).alias("sum"))


def group_avg(df: DataFrame, k: str, x: str) -> DataFrame:
    return _grouped(df, k, x).agg(F.sum(F.col(x).cast("bigint")).alias("s"), F.count(x).alias("n")).selectExpr("key", "s div n as avg")


def group_min(df: DataFrame, k: str, x: str) -> DataFrame:
    return _grouped(df, k, x).agg(F.min(x).alias("min"))


def group_max(df: DataFrame, k: str, x: str) -> DataFrame:
    return _grouped(df, k, x).agg(F.max(x).alias("max"))


def histogram(df: DataFrame, x: str, lo: int, hi: int, n: int) -> DataFrame:
    """(bucket, count): n equal buckets of lo .. hi, empty ones too; values outside
    are left out. No rows for n = 0 or lo > hi."""
    buckets = df.sparkSession.range(n if lo <= hi else 0).select(F.col("id").alias("bucket"))
    if x not in df.columns:
        return buckets.select("bucket", F.lit(0).cast("bigint").alias("count"))
    v = F.col(x).cast("bigint")
    counts = df.where(v.between(lo, hi)).select(v.alias("v")).selectExpr(f"((v - {lo}) * {n}) div ({hi} - {lo} + 1) as bucket").groupBy("bucket").agg(F.count("*").alias("c"))
    return buckets.join(counts, "bucket", "left").select("bucket", F.coalesce("c", F.lit(0)).alias("count"))
