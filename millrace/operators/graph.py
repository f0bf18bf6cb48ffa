"""Navigation over reference columns: every hop is an equi-join on ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.store import cut


def _edges(table: DataFrame, ref: str) -> DataFrame:
    return table.where(F.col(ref).isNotNull()).select(F.col("eid").alias("_from"), F.col(ref).cast("bigint").alias("_to"))


def follow(start: DataFrame, steps: list[tuple[DataFrame, str]]) -> DataFrame:
    """Entities at the end of N:1 hops from ``start`` (eid); each step is a table and
    its reference column. Duplicates stay, gaps drop out."""
    out = start.select("eid")
    for table, ref in steps:
        out = out.join(_edges(table, ref), F.col("eid") == F.col("_from")).select(F.col("_to").alias("eid"))
    return out


def path(start: DataFrame, steps: list[tuple[DataFrame, str]]) -> DataFrame:
    """(eid, target): where each start's hops end, null on a gap or for no step."""
    out = start.select("eid", F.col("eid").alias("target"))
    for table, ref in steps:
        out = out.join(_edges(table, ref), F.col("target") == F.col("_from"), "left").select("eid", F.col("_to").alias("target"))
    return out if steps else out.select("eid", F.lit(None).cast("bigint").alias("target"))


def reverse(start: DataFrame, table: DataFrame, ref: str) -> DataFrame:
    """Distinct entities of ``table`` that refer to any of ``start``."""
    return _edges(table, ref).join(start.select("eid"), F.col("_to") == F.col("eid"), "left_semi").select(F.col("_from").alias("eid")).distinct()


def bfs(start: DataFrame, table: DataFrame, ref: str, depth: int, backward: bool = True) -> DataFrame:
    """(level, eid): level 0 is the start as given; each further level the entities
    that refer to the one before (or, forward, are referred to) and were not seen.
    A level is written to the shared folder, so lineage does not grow with depth."""
    edges = _edges(table, ref)
    near, far = ("_to", "_from") if backward else ("_from", "_to")
    level = start.select("eid")
    seen = level.distinct()
    out = level.select(F.lit(0).alias("level"), "eid")
    for d in range(1, depth + 1):
        found = edges.join(level, F.col(near) == F.col("eid"), "left_semi").select(F.col(far).alias("eid")).distinct().join(seen, "eid", "left_anti")
        level = cut(found, f"bfs-{d}")
        if level.isEmpty():
            break
        out = out.union(level.select(F.lit(d).alias("level"), "eid"))
        seen = seen.union(level)
    return out


def dangling(table: DataFrame, ref: str, target: DataFrame) -> DataFrame:
    """Rows whose reference points to no entity of ``target``; empty when it is sound."""
    return table.where(F.col(ref).isNotNull()).join(target.select(F.col("eid").alias("_t")), F.col(ref) == F.col("_t"), "left_anti")
