"""Exact deduplication by content-defined chunk recipes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .shared import cut, released, spread_join, utf8

#: A value for each byte, from a fixed multiplicative rule; the rolling hash adds these.
GEAR = ((np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def normalized(text: bytes) -> bytes:
    """Each run of ASCII white space becomes one space; nothing is trimmed."""
    words = text.split()
    if not words:
        return b" " if text else b""
    space = b" \t\n\r\x0b\x0c"
    return b" " * (text[0] in space) + b" ".join(words) + b" " * (text[-1] in space)


def chunks(data: bytes, mean: int = 2048, least: int = 512, most: int = 16384) -> list[int]:
    """Ends of content-defined chunks. A boundary follows byte i where the gear hash
    of the 32 bytes up to i (each older byte shifted by one more) has log2(mean) zero
    top bits. Chunks of under ``least`` bytes grow on; ``most`` bounds them."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    h = GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):  # doubling: h then covers 2k bytes
        h[k:] += h[:-k] << np.uint32(k)
    out, at = [], 0
    for cut_at in np.flatnonzero(h >> np.uint32(32 - (mean.bit_length() - 1)) == 0).tolist() + [n - 1]:
        end = cut_at + 1
        while end - at > most:
            at += most
            out.append(at)
        if end - at >= least or end == n and end > at:
            out.append(end)
            at = end
    return out


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bits: int = 64) -> DataFrame:
    """(doc_id, n_bytes, text_sha256, keys, digests): for each text, in order, every
    chunk's 64-bit key and its SHA-256. Texts stay where they are read. Fewer
    ``key_bits`` make keys clash, for tests."""
    mask = (1 << key_bits) - 1

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, sha, keys, digests = [], [], [], []
            for t in b.column(1):
                data = normalized(t.as_py())
                view, at, k, d = memoryview(data), 0, [], []
                for end in chunks(data):
                    part = view[at:end]
                    k.append((xxhash.xxh3_64_intdigest(part) & mask) - (1 << 63))
                    d.append(hashlib.sha256(part).digest())
                    at = end
                size.append(len(data)), keys.append(k), digests.append(d), sha.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(sha, pa.string()), pa.array(keys, pa.list_(pa.int64())), pa.array(digests, pa.list_(pa.binary()))], names=["doc_id", "n_bytes", "text_sha256", "keys", "digests"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, text_sha256 string, keys array<long>, digests array<binary>")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bits: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    1. Each text becomes a recipe, its ordered chunk keys; only keys and digests
       leave the scan, so a long document is moved as some forty bytes a chunk.
    2. Chunks are deduplicated to verified identifiers: a key that stands for one
       digest is its own identifier, and any key found with two is told apart by
       digest from then on.
    3. Ordered identifier lists are compared: equal lists are equal texts.

    Counts are combined before the shuffle, so copies of one text are one row from
    each task, and a group of very many copies is answered by many tasks. Null text:
    as empty. Null id: takes part, is never keep_id unless all ids of the group are
    null. Repeated rows (an id more than once): one result each, all alike. Very long
    texts: some forty bytes a chunk. Empty table: no rows. Other columns are not read."""
    own = cut(recipes(docs, id_col, text_col, key_bits), "recipes")
    pairs = own.select(F.explode(F.arrays_zip("keys", "digests")).alias("c")).select(F.col("c.keys").alias("key"), F.col("c.digests").alias("digest"))
    # A row for each distinct chunk, then for each key; keys of one digest need no more.
    clash = pairs.distinct().groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    clash = cut(clash, "chunk-clashes")
    if clash.isEmpty():
        lists = own.withColumn("ids", F.col("keys").cast("array<string>"))
    else:
        # The number is given before the chunks are unfolded, or each chunk had its own.
        numbered = own.withColumn("row", F.monotonically_increasing_id())
        each = numbered.select("doc_id", "text_sha256", "row", "n_bytes", F.posexplode_outer(F.arrays_zip("keys", "digests")).alias("i", "c")).join(clash.withColumnRenamed("key", "k"), F.col("c.keys") == F.col("k"), "left")
        name = F.when(F.col("k").isNull(), F.col("c.keys").cast("string")).otherwise(F.concat_ws(":", F.col("c.keys"), F.hex("c.digests")))
        lists = each.groupBy("row", "doc_id", "text_sha256", "n_bytes").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", name.alias("id"))))), lambda x: x["id"]).alias("ids"))
    lists = cut(lists.select("doc_id", "text_sha256", "n_bytes", "ids", F.xxhash64("ids", "n_bytes").alias("h")), "recipe-lists")
    groups = cut(lists.groupBy("h", "n_bytes", "ids").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "recipe-groups")
    by_hash = groups.groupBy("h").agg(F.sum("group_size").alias("n"))
    small = groups.select("h", F.col("n_bytes").alias("gn"), F.col("ids").alias("gi"), "keep_id", "group_size")
    out = spread_join(lists, small, ["h"], by_hash, lists.count()).where((F.col("n_bytes") == F.col("gn")) & (F.col("ids") == F.col("gi")))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
