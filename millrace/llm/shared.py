"""Helpers that several training-data operators use."""

from __future__ import annotations

import ctypes
import functools
import math
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.store import cut, cut_at, discard, shared_dir

#: ASCII white space of the word definition, as a Java or Python character class body.
SPACE = r"\x20\x09-\x0D"

__all__ = ["PIECES", "SPACE", "bitmap_of", "components", "cut", "in_bitmap", "release", "released", "shared_dir", "spread_join", "utf8"]


def utf8(column: str = "text") -> F.Column:
    """A text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


#: glibc's; other C libraries have none.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give back to the system what this process holds unused: Arrow's pool and the C
    heap keep what was freed, some hundred megabytes after a few batches of texts."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function from batches to batches whose worker gives unused memory back, once a
    second at most and when the task ends: Spark keeps workers for later stages, and all
    of them count besides the executor's heap."""

    @functools.wraps(run)
    def tidy(batches: Iterator) -> Iterator:
        last = time.monotonic()
        try:
            for out in run(batches):
                yield out
                del out
                if time.monotonic() - last > 1:
                    release()
                    last = time.monotonic()
        finally:
            release()

    return tidy


#: A key of over one in so many rows is dealt out in pieces of about that share.
PIECES = 1000


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], counts: DataFrame, total: int) -> DataFrame:
    """Inner equi-join where single keys may hold a large share of ``big``: such a key's
    rows are dealt over as many tasks as it has pieces, its rows of ``small`` go to all.

    ``counts`` (keys, n) says how many of the ``total`` rows of ``big`` each key has and
    should be a written table, ``big``, too, as rows are dealt by position. The list of
    large keys is broadcast: fewer than ``PIECES`` rows whatever the input, as each has
    over a ``PIECES``-th of all. Pieces of all keys together: under twice ``PIECES``."""
    hot = counts.where(F.col("n") * PIECES > total).select(*(F.col(k).alias(f"_{k}") for k in keys), F.ceil(F.col("n") * PIECES / max(total, 1)).cast("int").alias("_pieces"))
    on = [F.col(k) == F.col(f"_{k}") for k in keys]
    salt = F.pmod(F.monotonically_increasing_id(), F.coalesce("_pieces", F.lit(1)).cast("long")).cast("int")
    left = big.join(F.broadcast(hot), on, "left").select(*big.columns, salt.alias("_salt"))
    right = small.join(F.broadcast(hot), on, "left").select(*small.columns, F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1)).alias("_salt"))
    return left.join(right, [*keys, "_salt"]).drop("_salt")


def bitmap_of(df: DataFrame, column: str, bits: int | None = None) -> np.ndarray:
    """A bitmap of 2**bits bits of the hashes in a long column, gathered as at most
    2**(bits - 6) words: 32 bits a row, between 8 and 64 megabytes whatever the number of
    rows. A fuller bitmap lets more through, which an exact join then leaves out."""
    if bits is None:
        bits = min(max(math.ceil(math.log2(32 * max(df.count(), 1))), 26), 29)
    low = df.select(F.col(column).bitwiseAND(F.lit((1 << bits) - 1)).alias("low"))
    words = low.selectExpr("low >> 6 as i", "shiftleft(1L, cast(low & 63 as int)) as b").groupBy("i").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy().view(np.uint64)
    return out


def in_bitmap(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    low = h.astype(np.uint64) & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1) > 0


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable over ``edges`` (a, b: long).

    Alternating large-star and small-star steps. Every step is a map-side combined
    minimum for each node and an equi-join that deals a node of very many links over
    many tasks; links never leave the executors. A round's tables go when the next is
    written. Nodes without links have no row."""
    spark = edges.sparkSession
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())

    def with_least(rows: DataFrame, total: int) -> tuple[DataFrame, str]:
        """Each row (a, b) with m, the least b of its a."""
        each, path = cut_at(rows.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
        return spread_join(rows, each.select("a", "m"), ["a"], each.select("a", "n"), total), path

    now, at = cut_at(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = mark(now)
    if not before[0]:
        return spark.createDataFrame([], "node long, root long")
    for _ in range(rounds):
        both, p = with_least(now.union(now.select("b", "a")), 2 * before[0])
        star = both.select("a", "b", F.least("a", "m").alias("m")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large, q = cut_at(star, "stars")
        small, r = with_least(large, before[0])
        new = small.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        now, done = cut_at(new, "links")
        for path in (at, p, q, r):
            discard(spark, path)
        at, after = done, mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
