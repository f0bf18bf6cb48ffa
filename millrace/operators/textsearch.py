"""n-gram candidates and exact substring search."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import check_n, grams
from ..sources.store import cut_at, discard
from ..types import Unsupported


def index(df: DataFrame, text: str = "text", n: int = 2) -> DataFrame:
    """(gram, eid), each once: the posting lists as a long table."""
    check_n(n)
    return df.select("eid", F.explode(F.array_distinct(grams(F.col(text), n))).alias("gram")).select("gram", "eid")


def query_grams(q: str, n: int = 2) -> list[str]:
    return list(dict.fromkeys(q[i : i + n] for i in range(len(q) - n + 1)))


def candidates(postings: DataFrame, q: str, n: int = 2) -> DataFrame:
    """Entities whose text has every gram of the query; none for shorter queries."""
    want = query_grams(q, n)
    hit = postings.where(F.col("gram").isin(want)) if want else postings.limit(0)
    return hit.groupBy("eid").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(want)).select("eid")


def search(df: DataFrame, q: str, text: str = "text", postings: DataFrame | None = None, n: int = 2) -> DataFrame:
    """Entities whose text contains the query, letter case included; none for an empty
    query. With postings, only candidates are verified, and a query of n characters
    needs no look at the text."""
    if not q:
        return df.limit(0).select("eid")
    if postings is not None and len(q) >= n:
        found = candidates(postings, q, n)
        return found if len(q) == n else df.join(found, "eid", "left_semi").where(F.contains(F.col(text), F.lit(q))).select("eid")
    return df.where(F.contains(F.col(text), F.lit(q))).select("eid")


def search_postings(postings: DataFrame, q: str, n: int = 2) -> DataFrame:
    """Search without texts: exact only for queries of n characters."""
    if len(q) != n:
        raise Unsupported("without texts, a query must have as many characters as a gram")
    return candidates(postings, q, n)


def gram_count(postings: DataFrame) -> DataFrame:
    return postings.agg(F.count_distinct("gram").alias("grams"))


def remove(postings: DataFrame, ids: DataFrame) -> DataFrame:
    return postings.join(ids.select("eid"), "eid", "left_anti").select("gram", "eid")


#: A file of an index has about so many postings, which a task can sort in its memory.
FILE_ROWS = 2_000_000


def save(postings: DataFrame, path: str, files: int | None = None) -> None:
    """Write an index sorted by gram, so that a query's grams prune row groups. Postings
    are written unsorted first, which makes them once and tells how many there are; a
    gram that very many texts have goes on over several files."""
    rows, held = cut_at(postings.select("gram", "eid"), "postings")
    files = files or max(1, -(-rows.count() // FILE_ROWS))
    rows.repartitionByRange(files, "gram", "eid").sortWithinPartitions("gram", "eid").write.mode("overwrite").parquet(path)
    discard(postings.sparkSession, held)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def add(postings: DataFrame, df: DataFrame, text: str = "text", n: int = 2) -> DataFrame:
    """The index with the texts of these entities in place of what they had."""
    return remove(postings, df).union(index(df, text, n))


def entry(postings: DataFrame, eid: int) -> DataFrame:
    """(gram): what an entity is found by."""
    return postings.where(F.col("eid") == eid).select("gram")


def scan(df: DataFrame, predicate: Column | Callable[[str], bool], text: str = "text") -> DataFrame:
    """Entities whose text meets any predicate: a Column, or a function of the text,
    which is called batch by batch. Null texts meet none."""
    if not isinstance(predicate, Column):
        call = predicate

        @F.pandas_udf("boolean")
        def met(texts: pd.Series) -> pd.Series:
            return pd.Series([t is not None and bool(call(t)) for t in texts], dtype=bool)

        predicate = met(text)
    return df.where(F.col(text).isNotNull()).where(predicate).select("eid")
