"""The key-value table: a fold over the ordered operation log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorekeep.functions import keys

from .running import with_era

SHARDS = 32


def expiry(ts_ms: Column, ttl_ms: Column) -> Column:
    """0: never."""
    return F.when(ttl_ms > 0, ts_ms + ttl_ms).otherwise(F.lit(0).cast("long"))


def live(now_ms: int | Column) -> Column:
    """At its last millisecond an entry still lives."""
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    return (F.col("expiry_ms") == 0) | (now <= F.col("expiry_ms"))


def state(log: DataFrame, as_of_lsn: int | None = None, shards: int = SHARDS) -> DataFrame:
    """The entries that are physically there after the writes up to an LSN, expired ones included. One exchange on key,
    after a partial aggregation, so a hot key costs a row a task. A CLEAR empties the table at its LSN."""
    log = log if as_of_lsn is None else log.where(F.col("lsn") <= as_of_lsn)
    cleared = log.where("op = 'CLEAR'").agg(F.coalesce(F.max("lsn"), F.lit(-1)).alias("clear_lsn"))
    writes = log.where(F.col("op").isin("PUT", "DELETE")).crossJoin(F.broadcast(cleared)).where("lsn > clear_lsn")  # one row
    last = F.max_by(F.struct("op", "value", F.col("ts_ms").alias("put_ms"), expiry(F.col("ts_ms"), F.col("ttl_ms")).alias("expiry_ms"), "lsn"), "lsn")
    latest = writes.groupBy("key").agg(last.alias("w")).where("w.op = 'PUT'")
    return latest.select("key", "w.value", "w.put_ms", "w.expiry_ms", "w.lsn", keys.shard(F.col("key"), shards).alias("shard"))


class KVTable:
    """A table of operations; reads are queries, writes return a new table with the operations appended."""

    def __init__(self, log: DataFrame, shards: int = SHARDS) -> None:
        self.log, self.shards = log, shards

    @classmethod
    def empty(cls, spark, shards: int = SHARDS) -> KVTable:
        from lorekeep.schemas import KV_LOG

        return cls(spark.createDataFrame([], KV_LOG), shards)

    def current_lsn(self) -> int:
        return self.log.agg(F.max("lsn")).first()[0] or 0

    def append(self, ops: list[tuple[str, str, str | None, int]], now_ms: int) -> KVTable:
        """Operations (op, key, value, ttl_ms) of one writer, numbered on from the last."""
        from lorekeep.schemas import KV_LOG

        at = self.current_lsn()
        rows = [(at + 1 + i, now_ms, op, key, value, ttl) for i, (op, key, value, ttl) in enumerate(ops)]
        return KVTable(self.log.unionByName(self.log.sparkSession.createDataFrame(rows, KV_LOG)), self.shards)

    def put(self, key: str, value: str, ttl_ms: int = 0, now_ms: int = 0) -> KVTable:
        return self.append([("PUT", key, value, ttl_ms)], now_ms)

    def remove(self, key: str, now_ms: int = 0) -> tuple[KVTable, bool]:
        """Logged even if absent; true if the key was physically there."""
        there = self.state().where(F.col("key") == key).count() > 0
        return self.append([("DELETE", key, None, 0)], now_ms), there

    def clear(self, now_ms: int = 0) -> KVTable:
        return self.append([("CLEAR", "", None, 0)], now_ms)

    def update(self, key: str, change, now_ms: int = 0) -> tuple[KVTable, str]:
        """Read, change, write; the result never expires."""
        new = change(self.get(key, now_ms))
        return self.put(key, new, 0, now_ms), new

    def state(self, as_of_lsn: int | None = None) -> DataFrame:
        return state(self.log, as_of_lsn, self.shards)

    def get(self, key: str, now_ms: int = 0) -> str | None:
        row = KVTable(self.log.where((F.col("key") == key) | (F.col("op") == "CLEAR")), self.shards).state().where(live(now_ms)).first()
        return row["value"] if row else None

    def multi_get(self, wanted: DataFrame, now_ms: int) -> DataFrame:
        """``wanted`` (key) with value, null where absent or expired."""
        return wanted.join(self.state().where(live(now_ms)).select("key", "value"), "key", "left")

    def size(self) -> int:
        return self.state().count()

    def export(self, now_ms: int) -> DataFrame:
        return self.state().where(live(now_ms)).select("key", "value").orderBy("key")

    def prefix(self, prefix: str, now_ms: int) -> DataFrame:
        """The prefix goes to the scan of the log, before the fold."""
        own = self.log.where(F.col("key").startswith(prefix) | (F.col("op") == "CLEAR"))
        return state(own, None, self.shards).where(live(now_ms))


def counters(log: DataFrame) -> DataFrame:
    """Read-modify-write of a counter: the number of increments since the key's last removal."""
    return since_removal(log).groupBy("key").agg(F.count("*").alias("counter"))


def since_removal(log: DataFrame) -> DataFrame:
    """The PUTs of each key after its last DELETE and the last CLEAR. Removals are one row a key before the join."""
    removed = log.where("op = 'DELETE'").groupBy("key").agg(F.max("lsn").alias("removed"))
    cleared = log.where("op = 'CLEAR'").agg(F.coalesce(F.max("lsn"), F.lit(-1)).alias("cleared"))  # one row
    puts = log.where("op = 'PUT'").crossJoin(F.broadcast(cleared)).where("lsn > cleared").drop("cleared")
    return puts.join(removed, "key", "left").where("removed IS NULL OR lsn > removed").drop("removed")


def appended_lists(log: DataFrame) -> DataFrame:
    """Read-modify-write of a list: values since the key's last removal in the order of their first append, each once."""
    first = since_removal(log).groupBy("key", "value").agg(F.min("lsn").alias("lsn"))
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("lsn", "value"))), lambda x: x["value"])
    return first.groupBy("key").agg(in_order.alias("items"))


def fold(log: DataFrame, change, schema: str) -> DataFrame:
    """An arbitrary read-modify-write for each key: ``change(rows in LSN order as pandas) -> pandas``."""
    return log.groupBy("key").applyInPandas(lambda rows: change(rows.sort_values("lsn")), schema)


def as_of(lookups: DataFrame, log: DataFrame, on: str = "key", at: str = "lsn") -> DataFrame:
    """As-of join: each lookup (columns ``on``, ``at``, lookup_id) with the last write at or before it; null if there
    is none, it removed the key, or a CLEAR came after it. Both sides meet in one exchange and one sorted pass."""
    nothing = F.lit(None)
    clears = log.where("op = 'CLEAR'").select(F.col(at), F.col("op"))
    asked = with_era(lookups.withColumn("op", F.lit("GET")).unionByName(clears, allowMissingColumns=True), at).where("op = 'GET'")
    writes = with_era(log, at).where(F.col("op").isin("PUT", "DELETE")).select(on, at, F.lit(0).alias("side"), nothing.cast("long").alias("lookup_id"), F.struct("op", "value", F.col("lsn").alias("write_lsn"), "era").alias("w"), "era")
    reads = asked.select(on, at, F.lit(1).alias("side"), F.col("lookup_id").cast("long").alias("lookup_id"), nothing.cast("struct<op:string,value:string,write_lsn:bigint,era:bigint>").alias("w"), "era")
    order = Window.partitionBy(on).orderBy(at, "side").rowsBetween(Window.unboundedPreceding, 0)
    seen = writes.unionByName(reads).withColumn("last", F.last("w", ignorenulls=True).over(order)).where("side = 1")
    return seen.select("lookup_id", on, at, F.when((F.col("last.op") == "PUT") & (F.col("last.era") == F.col("era")), F.col("last.value")).alias("value"), "last.write_lsn")
