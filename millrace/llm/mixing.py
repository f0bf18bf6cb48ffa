"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

#: More sources than this are joined by a shuffle instead of a broadcast.
BROADCAST_SOURCES = 10_000


def unit_interval(*parts) -> F.Column:
    """A number in (0, 1) from the MD5 of the parts, joined by colons: 52 bits."""
    digest = F.md5(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts)))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def poisson_cdf(rate: float) -> list[float]:
    """P(X <= k) for k = 0, 1, ... until it is 1 for a double. Terms by logarithms,
    so that a large rate does not vanish at zero."""
    out, log_p, total, k = [], -rate, 0.0, 0
    while True:
        total += math.exp(log_p)
        out.append(min(total, 1.0))
        k += 1
        log_p += math.log(rate / k) if rate else -math.inf
        if k > rate and math.exp(log_p) < 1e-18:
            return out


def rates(docs: DataFrame, weights: dict[str, float], default: float = 1.0, source_col: str = "source", total: float | None = None) -> DataFrame:
    """(source, n, weight, rate): how often a document of each source is to be
    repeated on average, so that sources have shares in proportion to their weights
    among ``total`` documents (as many as there are, unless given). Sources that
    ``weights`` does not name have the weight ``default``; null is a source, too."""
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    spark = docs.sparkSession
    named = spark.createDataFrame(list(weights.items()) or [("", 0.0)], "name string, given double")
    counts = counts.join(F.broadcast(named if weights else named.limit(0)), F.col("source") == F.col("name"), "left").select("source", "n", F.coalesce("given", F.lit(float(default))).alias("weight"))
    sums = counts.agg(F.sum("n").alias("ns"), F.sum("weight").alias("ws"))
    size = F.lit(float(total)) if total is not None else F.col("ns")
    return counts.join(F.broadcast(sums)).select("source", "n", "weight", F.when(F.col("weight") > 0, size * F.col("weight") / F.col("ws") / F.col("n")).otherwise(0.0).alias("rate"))


def mix(docs: DataFrame, weights: dict[str, float], default: float = 1.0, seed: int = 17, source_col: str = "source", id_col: str = "doc_id", total: float | None = None) -> DataFrame:
    """Every input column, with replica (1, 2, ...) and shuffle_key: each document as
    often as a Poisson number with its source's rate, in random order over all.

    The number is the inverse of the distribution function at a hash of seed and id,
    so it does not depend on partitions or reruns. Copies go to a partition by hash
    of their key and are sorted by it there, which shuffles globally without
    sampling; a hot source is thinned before anything moves. Null id: hashed as the
    word null. Null source: a source of its own. Rows that repeat an id are drawn
    alike. Null or empty text, very long text: moved like any other. Equal shuffle keys:
    of rows that repeat an id, in any order among themselves. Empty table: no rows.
    Columns named replica or shuffle_key in the input are replaced; any other name may
    be among the columns."""
    spark = docs.sparkSession
    per = rates(docs, weights, default, source_col, total)
    rows = per.limit(BROADCAST_SOURCES + 1).collect()  # bounded
    if len(rows) <= BROADCAST_SOURCES:
        table = spark.createDataFrame([(r.source, poisson_cdf(r.rate)) for r in rows], "_source string, _cdf array<double>")
        table = F.broadcast(table)
    else:
        cdf = F.udf(poisson_cdf, "array<double>")
        table = per.select(F.col("source").alias("_source"), cdf("rate").alias("_cdf"))
    # A row is one column until the end, so no name of its columns can clash.
    packed = docs.drop("replica", "shuffle_key").select(F.struct("*").alias("_row"))
    id_, source = F.col("_row").getField(id_col), F.col("_row").getField(source_col)
    u = unit_interval(F.lit(seed), id_)
    drawn = packed.join(table, source.eqNullSafe(F.col("_source"))).select("_row", F.size(F.filter("_cdf", lambda c: c < u)).alias("_n"))
    copies = drawn.where("_n > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_replica"))
    key = F.md5(F.concat_ws(":", F.lit("shuffle"), F.lit(seed), F.coalesce(id_.cast("string"), F.lit("null")), F.col("_replica")))
    keyed = copies.select("_row", "_replica", key.alias("_key"))
    return keyed.repartition(F.xxhash64("_key")).sortWithinPartitions("_key").select("_row.*", F.col("_replica").alias("replica"), F.col("_key").alias("shuffle_key"))
