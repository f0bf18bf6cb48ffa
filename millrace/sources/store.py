"""Tables on shared storage: open, create, snapshot, seal, blobs, relays."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import blob_id
from ..types import BadValue, EngineError

_own: str | None = None
_folders: dict[str, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, which driver and executors share. Where
    it is unset, a temporary folder on a local master, as in tests; on a cluster, where
    no other host could read that, a refusal."""
    global _own
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise EngineError("spark.checkpoint.dir is not set: intermediate tables need a folder that all hosts share")
    _own = _own or tempfile.mkdtemp(prefix="millrace-")
    return _own


def _deleter(spark: SparkSession, path: str) -> Callable[[], None]:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return lambda: files.delete(at, True)


def _clean() -> None:
    """At the end of the program: what it wrote. A session that is gone leaves its folder."""
    for delete in _folders.values():
        with contextlib.suppress(Exception):
            delete()


def cut_at(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """A table as ``cut`` gives it, and the path it was written to."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/millrace/{spark.sparkContext.applicationId}"
    if folder not in _folders:
        if not _folders:
            atexit.register(_clean)
        _folders[folder] = _deleter(spark, folder)
    path = f"{folder}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write to the shared folder and read again, which ends the lineage: an executor
    that is lost later costs no recomputation, and a plan that uses the table twice
    computes it once. The folder goes when the program ends."""
    return cut_at(df, what)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of ``cut_at`` that nothing will read again."""
    _deleter(spark, path)()


def open_table(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """A Parquet table; ``key`` names the column that becomes ``eid``."""
    df = spark.read.parquet(path)
    return df.withColumn("eid", F.col(key).cast("bigint")) if key else df


def from_rows(spark: SparkSession, rows: list, schema) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def snapshot(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def compact(df: DataFrame, path: str, files: int, sort_by: str | None = None) -> None:
    """Fewer, larger files, sorted for pruning by statistics; the same rows."""
    out = df.repartitionByRange(files, sort_by).sortWithinPartitions(sort_by) if sort_by else df.coalesce(files)
    out.write.mode("overwrite").parquet(path)


def seal(df: DataFrame, part: str | None = None) -> DataFrame:
    """(rows, digest): an order-independent digest of all rows, or of each ``part``."""
    h = df.select(*([F.col(part).alias("part")] if part else []), F.xxhash64(*df.columns).cast("decimal(38,0)").alias("h"))
    return (h.groupBy("part") if part else h).agg(F.count("*").alias("rows"), F.coalesce(F.sum("h"), F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest"))


def seal_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(part, change): parts of two seals that differ: added, removed or changed."""
    a, b = old.select(F.struct("part").alias("p"), "rows", "digest"), new.select(F.struct("part").alias("p"), F.col("rows").alias("r"), F.col("digest").alias("d"))
    change = F.when(F.col("rows").isNull(), "added").when(F.col("r").isNull(), "removed").when((F.col("rows") != F.col("r")) | (F.col("digest") != F.col("d")), "changed")
    return a.join(b, "p", "full_outer").select(F.col("p.part").alias("part"), change.alias("change")).where("change is not null")


def put_blobs(df: DataFrame, data: str) -> DataFrame:
    """(sha256, data): each content once."""
    return df.where(F.col(data).isNotNull()).select(blob_id(F.col(data)).alias("sha256"), F.col(data).cast("binary").alias("data")).dropDuplicates(["sha256"])


def get_blobs(store: DataFrame, ids: DataFrame) -> DataFrame:
    """(sha256, data): data is null for an unknown id."""
    return ids.select("sha256").join(store, "sha256", "left")


class BlobStore:
    """Contents by their SHA-256 in a folder of Parquet files, each once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def all(self) -> DataFrame:
        try:
            return self.spark.read.parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], "sha256 string, data binary")

    def put(self, df: DataFrame, data: str) -> DataFrame:
        """Write contents that are not there yet; their ids, each once."""
        blobs = put_blobs(df, data)
        blobs.join(self.all().select("sha256"), "sha256", "left_anti").write.mode("append").parquet(self.path)
        return blobs.select("sha256")

    def get(self, ids: DataFrame) -> DataFrame:
        return get_blobs(self.all(), ids)

    def exists(self, ids: DataFrame) -> DataFrame:
        """(sha256, found)."""
        return ids.select("sha256").join(self.all().select("sha256", F.lit(True).alias("found")), "sha256", "left").select("sha256", F.coalesce("found", F.lit(False)).alias("found"))


def content(df: DataFrame, keys: list[str]) -> DataFrame:
    """(eid, content): keyed bytes of each entity as a map, missing keys left out."""
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("binary").alias("value")) for k in keys))
    return df.select("eid", F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("content"))


def check_dim(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """The table with an error raised at any vector of another length."""
    bad = F.size(vector) != dim
    return df.withColumn(vector, F.when(bad, F.raise_error(F.lit(f"a vector is not of {dim} numbers")).cast(df.schema[vector].dataType)).otherwise(F.col(vector)))


# -- relays: batches of op records in rooms, as files that any stream can read --------
def publish(records: DataFrame, path: str, room: str = "default") -> None:
    if not room or any(c in room for c in "/=\\"):
        raise BadValue(f"room {room!r}")
    records.withColumn("room", F.lit(room)).write.mode("append").partitionBy("room").parquet(path)


def pull(spark: SparkSession, path: str, room: str = "default", after: Column | None = None) -> DataFrame:
    """Records of a room, each clock once, in clock order."""
    df = spark.read.parquet(path).where(F.col("room") == room)
    df = df.where(after) if after is not None else df
    return df.dropDuplicates(["wall", "logical", "peer"]).orderBy("wall", "logical", "peer")


def stream(spark: SparkSession, path: str, schema, room: str | None = None) -> DataFrame:
    df = spark.readStream.schema(schema).parquet(path)
    return df.where(F.col("room") == room) if room else df


def to_wire(df: DataFrame) -> DataFrame:
    """Records as one JSON text each."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def from_wire(df: DataFrame, schema: str) -> DataFrame:
    return df.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
