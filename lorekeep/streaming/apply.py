"""Applying the operation log as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lorekeep.operators.kv import expiry

STATE = "key string, value string, put_ms long, expiry_ms long, lsn long"


def stream_log(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def latest(log: DataFrame) -> DataFrame:
    """State as a streaming aggregation (output mode complete or update). Entries that arrive late or twice change
    nothing, as the largest LSN of a key wins. The last CLEAR is a row of its own (null key): ``current`` applies it."""
    writes = log.where(F.col("op").isin("PUT", "DELETE", "CLEAR")).withColumn("key", F.when(F.col("op") != "CLEAR", F.col("key")))
    w = F.max_by(F.struct("op", "value", F.col("ts_ms").alias("put_ms"), expiry(F.col("ts_ms"), F.col("ttl_ms")).alias("expiry_ms"), "lsn"), "lsn")
    return writes.groupBy("key").agg(w.alias("w")).where("w.op <> 'DELETE'").select("key", "w.value", "w.put_ms", "w.expiry_ms", "w.lsn", "w.op")


def current(table: DataFrame) -> DataFrame:
    """The state in a table that ``latest`` fills: entries after the last CLEAR."""
    cleared = table.where("op = 'CLEAR'").agg(F.coalesce(F.max("lsn"), F.lit(-1)).alias("cleared"))  # one row
    return table.crossJoin(F.broadcast(cleared)).where("op = 'PUT' AND lsn > cleared").drop("op", "cleared")


def drained(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there now, into a table in memory (for results that fit, as state by key does)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


class Applier(StatefulProcessor):
    """Keeps the last write of each key; an entry leaves the state by itself when nothing touched it for ``ttl_ms``, and
    a timer removes it when its own expiry passes. A CLEAR comes under its own key and is passed on as a change: it
    ends all entries up to its LSN, which are other keys' states."""

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        schema = "lsn long, op string, value string, put_ms long, expiry_ms long"
        self.last = handle.getValueState("last", schema, ttlDurationMs=self.ttl_ms) if self.ttl_ms else handle.getValueState("last", schema)

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        best = self.last.get() if self.last.exists() else None
        changed = False
        for part in rows:
            for r in part.sort_values("lsn").itertuples(index=False):
                if r.op in ("PUT", "DELETE", "CLEAR") and (best is None or r.lsn > best[0]):
                    best = (int(r.lsn), r.op, r.value, int(r.ts_ms), int(r.ts_ms + r.ttl_ms) if r.ttl_ms > 0 else 0)
                    changed = True
        if not changed:
            return
        self.last.update(best)
        if best[4]:
            self.handle.registerTimer(best[4])
        yield pd.DataFrame([{"key": key[0], "op": best[1], "value": best[2], "put_ms": best[3], "expiry_ms": best[4], "lsn": best[0]}])

    def handleExpiredTimer(self, key, timer_values, expired_timer_info) -> Iterator[pd.DataFrame]:
        best = self.last.get() if self.last.exists() else None
        if best is not None and best[4] and best[4] <= expired_timer_info.getExpiryTimeInMs():
            self.last.clear()
            yield pd.DataFrame([{"key": key[0], "op": "EXPIRE", "value": None, "put_ms": best[3], "expiry_ms": best[4], "lsn": best[0]}])

    def close(self) -> None:
        pass


def changes(log: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """A stream of the last change of each key in a batch (op PUT, DELETE, CLEAR or EXPIRE). Needs the RocksDB state store."""
    schema = "key string, op string, value string, put_ms long, expiry_ms long, lsn long"
    return log.groupBy("key").transformWithStateInPandas(Applier(ttl_ms), schema, "update", "ProcessingTime")


def once(log: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Entries that a writer sent twice are taken once within the delay."""
    return log.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["lsn"]).drop("ts")


def checkpoint_each(table, clock):
    """A ``foreachBatch`` function: appends a batch to a durable table and checkpoints when the rule says so."""
    from lorekeep.sources.oplog import should_checkpoint, size_bytes

    since, logged = [clock()], [size_bytes(table.read_log()).first()["bytes"]]  # what a restart finds

    def write(batch: DataFrame, _: int) -> None:
        table.append(batch)
        logged[0] += size_bytes(batch).first()["bytes"]
        now = clock()
        if should_checkpoint((now - since[0]) / 60_000, logged[0]):
            table.checkpoint(now)
            since[0], logged[0] = now, 0

    return write
