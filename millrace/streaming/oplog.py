"""Change logs: last-writer-wins merging, audit, cursors, subscriptions, shards.

An op row: lsn, wall, logical, peer, author, eid, attribute, kind (tie, untie, delete,
content, commit), value (text)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import fnv1a_32, hlc

OPS = "lsn bigint, wall bigint, logical bigint, peer bigint, author string, eid bigint, attribute string, kind string, value string"
CLOCK = ("wall", "logical", "peer")


def clock() -> Column:
    return hlc(*(F.col(c) for c in CLOCK))


def committed(ops: DataFrame) -> DataFrame:
    """Records that a later commit closes."""
    last = ops.where("kind = 'commit'").agg(F.max("lsn").alias("_last"))
    return ops.join(F.broadcast(last)).where((F.col("kind") != "commit") & (F.col("lsn") <= F.col("_last"))).drop("_last")


def merge(ops: DataFrame) -> DataFrame:
    """(eid, attribute, value) after all ops: of each attribute the op with the latest
    clock, unless it is an untie or an entity's delete is later. The order in which
    ops arrive does not matter. Both aggregates combine before their shuffle."""
    dead = ops.where("kind = 'delete'").groupBy(F.col("eid").alias("_e")).agg(F.max(clock()).alias("_dead"))
    won = ops.where("kind in ('tie', 'untie', 'content')").groupBy("eid", "attribute").agg(F.max_by(F.struct("kind", "value"), clock()).alias("w"), F.max(clock()).alias("at"))
    live = won.join(dead, F.col("eid") == F.col("_e"), "left").where("_dead is null or at > _dead").where("w.kind <> 'untie'")
    return live.select("eid", "attribute", F.col("w.value").alias("value"))


def tombstones(ops: DataFrame) -> DataFrame:
    return ops.where("kind = 'delete'").groupBy("eid").agg(F.max(clock()).alias("clock"))


def allowed(ops: DataFrame, writers: DataFrame | None) -> DataFrame:
    """Ops of members (author); without a list, of everybody."""
    return ops if writers is None else ops.join(writers.select("author"), "author", "left_semi")


def granted(ops: DataFrame, grants: DataFrame) -> DataFrame:
    """Ops that a grant (author, attribute) covers; a null attribute covers all. Deletes
    need a grant for all."""
    whole = grants.where("attribute is null").select(F.col("author").alias("_author"), F.lit(None).cast("string").alias("_attribute"))
    own = grants.where("attribute is not null").select(F.col("author").alias("_author"), F.col("attribute").alias("_attribute"))
    covers = (F.col("author") == F.col("_author")) & (F.col("_attribute").isNull() | ((F.col("attribute") == F.col("_attribute")) & (F.col("kind") != "delete")))
    return ops.join(whole.union(own), covers, "left_semi")


def apply_counts(ops: DataFrame, writers: DataFrame | None = None) -> DataFrame:
    """(received, rejected, repeated, applied, skipped): of all ops, those of strangers,
    those whose clock came before, those that decide a value or a deletion, and those
    that a later clock outdid."""
    mine = ops if writers is None else ops.join(writers.select("author", F.lit(1).alias("_in")).distinct(), "author", "left")
    flag = mine.select("*", (F.lit(True) if writers is None else F.col("_in").isNotNull()).alias("_ok"))
    once = deduplicated(flag.where("_ok"))
    dead = once.where("kind = 'delete'").groupBy("eid").agg(F.max(clock()).alias("at")).select("at.*")
    won = once.where("kind in ('tie', 'untie', 'content')").groupBy("eid", "attribute").agg(F.max(clock()).alias("at")).select("at.*")
    number = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("k"), "n")
    parts = [number(flag, "received"), number(flag.where("not _ok"), "rejected"), number(flag.where("_ok and kind <> 'commit'"), "own"), number(once.where("kind <> 'commit'"), "different"), number(dead.union(won), "applied")]
    of = lambda name: F.max(F.when(F.col("k") == name, F.col("n")))
    return reduce(DataFrame.union, parts).agg(of("received").alias("received"), of("rejected").alias("rejected"), (of("own") - of("different")).alias("repeated"), of("applied").alias("applied"), (of("different") - of("applied")).alias("skipped"))


def replay(df: DataFrame, ops: DataFrame) -> DataFrame:
    """A table (eid, columns) after the committed part of a log: what is merged for an
    entity replaces its values; unties and deletes make them missing; new ones come in."""
    done = committed(ops)
    names = [c for c in df.columns if c != "eid"]
    last = done.where("kind in ('tie', 'untie', 'content')").groupBy("eid", "attribute").agg(F.max_by(F.struct("kind", "value"), clock()).alias("w"), F.max(clock()).alias("at"))
    said = last.groupBy("eid").agg(*(F.max(F.when(F.col("attribute") == n, F.struct("at", "w"))).alias(f"_said_{i}") for i, n in enumerate(names)))
    dead = tombstones(done).select("eid", F.col("clock").alias("_dead"))
    both = df.withColumn("_old", F.lit(True)).join(said, "eid", "full_outer").join(dead, "eid", "left")

    def now(i: int, n: str) -> Column:
        s = F.col(f"_said_{i}")
        late = F.col("_dead").isNull() | (s["at"] > F.col("_dead"))
        own = F.when(s.isNotNull() & late, F.when(s["w"]["kind"] != "untie", s["w"]["value"]).cast(df.schema[n].dataType))
        return F.when(s.isNull() & F.col("_dead").isNull(), F.col(n)).otherwise(own).alias(n)

    out = both.select("eid", *(now(i, n) for i, n in enumerate(names)), F.col("_dead").isNotNull().alias("_dead"))
    any_left = reduce(lambda a, b: a | b, (F.col(n).isNotNull() for n in names), F.lit(False))
    return out.where(~F.col("_dead") | any_left).drop("_dead")


def audit(ops: DataFrame, since: tuple[int, int, int] | None = None, until: tuple[int, int, int] | None = None, author: str | None = None) -> DataFrame:
    """Ops within clocks, both inclusive, and of an author."""
    lit = lambda c: hlc(*(F.lit(v) for v in c))
    if since is not None:
        ops = ops.where(clock() >= lit(since))
    if until is not None:
        ops = ops.where(clock() <= lit(until))
    return ops if author is None else ops.where(F.col("author") == author)


def after(ops: DataFrame, cursor: tuple[int, int, int]) -> DataFrame:
    return ops.where(clock() > hlc(*(F.lit(v) for v in cursor)))


def next_cursor(pulled: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """The latest clock pulled, but not past the first rejected one."""
    if rejected is None:
        return pulled.agg(F.max(clock()).alias("cursor"))
    first = rejected.agg(F.min(clock()).alias("_first"))
    return pulled.join(F.broadcast(first)).where(F.col("_first").isNull() | (clock() < F.col("_first"))).agg(F.max(clock()).alias("cursor"))


def deduplicated(ops: DataFrame) -> DataFrame:
    return ops.dropDuplicates(list(CLOCK))


def ack(peers: DataFrame, acks: DataFrame) -> DataFrame:
    """(peer, lsn): acknowledged positions never go back."""
    return peers.union(acks).groupBy("peer").agg(F.max("lsn").alias("lsn"))


def watermark(peers: DataFrame) -> DataFrame:
    """The position that all peers have; 0 without peers."""
    return peers.agg(F.coalesce(F.min("lsn"), F.lit(0)).alias("watermark"))


def pending(ops: DataFrame, since: int) -> DataFrame:
    return ops.where(F.col("lsn") > since)


def reclaim(ops: DataFrame, peers: DataFrame) -> DataFrame:
    """The log without what all peers have."""
    return ops.join(F.broadcast(watermark(peers))).where("lsn >= watermark").drop("watermark")


def subscribe(ops: DataFrame, filters: dict[int, Column], peer_col: str = "target") -> DataFrame:
    """Ops for each peer by its filter: one pass, a row for each target."""
    targets = F.array_compact(F.array(*(F.when(F.coalesce(f, F.lit(False)), F.lit(p)) for p, f in filters.items())))
    return ops.withColumn(peer_col, F.explode(targets))


def stats(ops: DataFrame) -> DataFrame:
    return ops.groupBy("kind").agg(F.count("*").alias("ops"), F.max("lsn").alias("last_lsn"))


# -- shards -----------------------------------------------------------------------------
class ShardRouter:
    """Which peer owns an attribute: by an explicit map, else by hash."""

    def __init__(self, peers: list[int], fixed: dict[str, int] | None = None):
        self.peers, self.fixed = sorted(peers), fixed or {}

    def owner(self, attribute: str) -> int:
        return self.fixed.get(attribute, self.peers[fnv1a_32(attribute.encode()) % len(self.peers)])

    def query(self, shards: dict[int, DataFrame], conditions: list[tuple[str, object]]) -> DataFrame:
        """Entities that meet all conditions, each asked of its attribute's owner;
        nothing for no condition."""
        if not conditions:
            return next(iter(shards.values())).select("eid").limit(0)
        found = [shards[self.owner(n)].where(F.col(n) == v).select("eid") for n, v in conditions]
        out = found[0]
        for f in found[1:]:
            out = out.join(f, "eid", "left_semi")
        return out


# -- streaming ---------------------------------------------------------------------------
class _Merge(StatefulProcessor):
    """State of an entity: its latest delete, and each attribute's latest op."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.dead = handle.getValueState("dead", "wall bigint, logical bigint, peer bigint")
        self.last = handle.getMapState("last", "attribute string", "wall bigint, logical bigint, peer bigint, kind string, value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        dead = tuple(self.dead.get()) if self.dead.exists() else None
        changed: set[str] = set()
        for part in rows:
            for r in part.sort_values(list(CLOCK)).itertuples():
                at = (int(r.wall), int(r.logical), int(r.peer))
                if r.kind == "delete":
                    if dead is None or at > dead:
                        dead = at
                        changed.update(k[0] for k, v in self.last.iterator() if tuple(v[:3]) < at)
                    continue
                old = self.last.getValue((r.attribute,)) if self.last.containsKey((r.attribute,)) else None
                if old is None or at > tuple(old[:3]):
                    self.last.updateValue((r.attribute,), (*at, r.kind, None if pd.isna(r.value) else r.value))
                    changed.add(r.attribute)
        if dead is not None:
            self.dead.update(dead)
        out = []
        for a in sorted(changed):
            v = self.last.getValue((a,))
            gone = v[3] == "untie" or dead is not None and tuple(v[:3]) <= dead
            out.append((key[0], a, None if gone else v[4], not gone))
        if out:
            yield pd.DataFrame(out, columns=["eid", "attribute", "value", "live"])

    def close(self) -> None:
        pass


def merge_stream(ops: DataFrame) -> DataFrame:
    """Changes of the merged view (eid, attribute, value, live) from a stream of ops;
    late ops change nothing that a later clock decided."""
    return ops.where("kind in ('tie', 'untie', 'content', 'delete')").groupBy("eid").transformWithStateInPandas(_Merge(), "eid bigint, attribute string, value string, live boolean", "Update", "None")


def listen(ops: DataFrame, listener: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    """Hand each micro-batch, in clock order, to a listener; at least once."""
    writer = ops.writeStream.foreachBatch(lambda df, n: listener(df.orderBy(*CLOCK), n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


class Rooms:
    """Batches of ops in rooms as one DataFrame each: what a test or a notebook hands
    from peer to peer without files."""

    def __init__(self) -> None:
        self.rooms: dict[str, DataFrame] = {}

    def publish(self, ops: DataFrame, room: str = "default") -> None:
        now = self.rooms.get(room)
        self.rooms[room] = ops if now is None else now.union(ops.select(now.columns))

    def pull(self, room: str = "default", cursor: tuple[int, int, int] | None = None) -> DataFrame:
        """Each clock once, in clock order, after a cursor."""
        ops = deduplicated(self.rooms[room])
        return (ops if cursor is None else after(ops, cursor)).orderBy(*CLOCK)
