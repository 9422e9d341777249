"""The operation log, snapshots and recovery on files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorekeep.functions import checksum
from lorekeep.operators.kv import SHARDS, KVTable, expiry
from lorekeep.schemas import KV_LOG, SNAPSHOT_META, SNAPSHOT_VERSION

MAX_BYTES, MAX_MINUTES, KEEP = 64 << 20, 60, 3


def with_lsn(ops: DataFrame, after: int) -> DataFrame:
    """Numbers operations of one writer's batch by (ts_ms, seq)."""
    order = ops.agg(F.min("ts_ms"), F.max("ts_ms")).first()
    width = max(1, ((order[1] or 0) - (order[0] or 0)) // 64 + 1)
    dealt = ops.withColumn("_range", F.floor((F.col("ts_ms") - F.lit(order[0] or 0)) / width))
    sums = dealt.groupBy("_range").agg(F.count("*").alias("_n"))  # 65 rows at most
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("_range").orderBy("ts_ms", "seq"))
    placed = dealt.join(F.broadcast(sums.select("_range", before.alias("_before"))), "_range")
    return placed.withColumn("lsn", F.lit(after) + F.col("_before") + own).drop("seq", "_range", "_before")


def with_checksum(log: DataFrame) -> DataFrame:
    return log.withColumn("checksum", checksum.entry(F.col("key"), F.col("value")))


def tail(log: DataFrame, lsn: int) -> DataFrame:
    return log.where(F.col("lsn") > lsn).orderBy("lsn")


def size_bytes(log: DataFrame) -> DataFrame:
    return log.agg(F.coalesce(F.sum(checksum.entry_bytes(F.col("key"), F.col("value"))), F.lit(0)).alias("bytes"))


def first_bad(log: DataFrame) -> DataFrame:
    return log.where(F.col("checksum") != checksum.entry(F.col("key"), F.col("value"))).agg(F.min("lsn").alias("bad_lsn"))


def valid_prefix(log: DataFrame) -> DataFrame:
    """The entries before the first one whose checksum is wrong."""
    return log.crossJoin(F.broadcast(first_bad(log))).where("bad_lsn IS NULL OR lsn < bad_lsn").drop("bad_lsn")  # one row


def should_checkpoint(minutes_since: float, log_bytes: int) -> bool:
    return minutes_since >= MAX_MINUTES or log_bytes >= MAX_BYTES


def snapshot_of(log: DataFrame, as_of_lsn: int) -> DataFrame:
    """A snapshot as log entries at its LSN; absolute expiry is kept."""
    state = KVTable(log).state(as_of_lsn)
    return state.select(F.lit(as_of_lsn).cast("long").alias("lsn"), "put_ms", "expiry_ms", "key", "value")


def recovered(snapshot: DataFrame, log: DataFrame, snapshot_lsn: int) -> DataFrame:
    """State from a snapshot and the log after it: union and latest by key. A CLEAR drops all that came before it."""
    old = snapshot.select("key", "lsn", F.lit("PUT").alias("op"), "value", "put_ms", "expiry_ms")
    new = log.where(F.col("op").isin("PUT", "DELETE", "CLEAR") & (F.col("lsn") > snapshot_lsn))
    new = new.select("key", "lsn", "op", "value", F.col("ts_ms").alias("put_ms"), expiry(F.col("ts_ms"), F.col("ttl_ms")).alias("expiry_ms"))
    every = old.unionByName(new)
    cleared = new.where("op = 'CLEAR'").agg(F.coalesce(F.max("lsn"), F.lit(-1)).alias("clear_lsn"))
    every = every.crossJoin(F.broadcast(cleared)).where("lsn > clear_lsn AND op <> 'CLEAR'")  # one row
    latest = every.groupBy("key").agg(F.max_by(F.struct("op", "value", "put_ms", "expiry_ms", "lsn"), "lsn").alias("w")).where("w.op = 'PUT'")
    return latest.select("key", "w.value", "w.put_ms", "w.expiry_ms", "w.lsn")


class DurableTable:
    """A log and its snapshots under one folder: ``log/`` (Parquet, append), ``snapshots/lsn=<n>/`` and ``meta/``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def exists(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def delete(self, name: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def read_log(self, after: int | None = None) -> DataFrame:
        """The log after an LSN, by default after the snapshot that recovery starts from; segments that end before it
        are not read."""
        schema = KV_LOG.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", checksum bigint"
        if not self.exists("log"):
            return self.spark.createDataFrame([], schema)
        floor = self.usable()[0] if after is None else after
        read = self.spark.read.schema(f"{schema}, first bigint, last bigint").parquet(f"{self.folder}/log")
        log = read.where((F.col("last") > floor) & (F.col("lsn") > floor)).drop("first", "last")
        bad = first_bad(log).first()[0]  # checksums are computed once, not with each use of the log
        return log if bad is None else log.where(F.col("lsn") < bad)

    def append(self, ops: DataFrame) -> None:
        """ops: as the log's schema, LSNs given. A batch is a segment, named by its first and last LSN."""
        first, last = ops.agg(F.min("lsn"), F.max("lsn")).first()
        if first is not None:
            with_checksum(ops.select(*KV_LOG.fieldNames())).write.mode("append").parquet(f"{self.folder}/log/first={first}/last={last}")

    def segments(self) -> list[tuple[int, int]]:
        """First and last LSN of each segment, by the names of folders alone."""
        if not self.exists("log"):
            return []
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/log")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        folders = [x.getPath() for x in fs.listStatus(path) if x.isDirectory()]
        return sorted((int(a.getName()[6:]), int(b.getPath().getName()[5:])) for a in folders for b in fs.listStatus(a) if b.isDirectory())

    def clear_log(self, upto: int) -> list[tuple[int, int]]:
        """Deletes the segments that end at or before an LSN; what goes is returned."""
        old = [s for s in self.segments() if s[1] <= upto]
        for first, last in old:
            self.delete(f"log/first={first}/last={last}")
        return old

    def meta(self) -> DataFrame:
        return self.spark.read.schema(SNAPSHOT_META).parquet(f"{self.folder}/meta") if self.exists("meta") else self.spark.createDataFrame([], SNAPSHOT_META)

    def checkpoint(self, now_ms: int) -> int:
        """Writes a snapshot of all that is logged and publishes it by its row in ``meta``. Log entries up to the oldest
        snapshot that is kept then go, so that writes meanwhile stay, and recovery can fall back on an older snapshot
        and the log after it. Before the row is there, nothing is lost if the writer dies."""
        state, lsn = self.recover_rows()
        if lsn == 0:
            return 0
        rows = state.select(F.lit(lsn).cast("long").alias("lsn"), "put_ms", "expiry_ms", "key", "value")
        rows.drop("lsn").write.mode("overwrite").parquet(f"{self.folder}/snapshots/lsn={lsn}")
        count = self.spark.read.parquet(f"{self.folder}/snapshots/lsn={lsn}").count()
        one = self.spark.createDataFrame([(lsn, count, now_ms, SNAPSHOT_VERSION)], "snapshot_lsn long, record_count long, created_ms long, version int")
        one.withColumn("checksum", checksum.header(F.col("version"), F.col("record_count"), F.col("snapshot_lsn"), F.col("created_ms"))).write.mode("append").parquet(f"{self.folder}/meta")
        self.rotate()
        self.clear_log(min((r["snapshot_lsn"] for r in self.valid_meta().collect() if self.exists(f"snapshots/lsn={r['snapshot_lsn']}")), default=0))
        return lsn

    def valid_meta(self) -> DataFrame:
        good = checksum.header(F.col("version"), F.col("record_count"), F.col("snapshot_lsn"), F.col("created_ms"))
        return self.meta().where((F.col("version") == SNAPSHOT_VERSION) & (F.col("checksum") == good))

    def usable(self) -> tuple[int, DataFrame]:
        """The latest snapshot whose header is valid and whose records are as many as it says; (0, no rows) if none is.
        Headers are few: one for each checkpoint."""
        schema = "put_ms long, expiry_ms long, key string, value string"
        for meta in self.valid_meta().orderBy(F.desc("snapshot_lsn"), F.desc("created_ms")).collect():
            lsn = meta["snapshot_lsn"]
            if self.exists(f"snapshots/lsn={lsn}"):
                snapshot = self.spark.read.schema(schema).parquet(f"{self.folder}/snapshots/lsn={lsn}")
                if snapshot.count() == meta["record_count"]:
                    return lsn, snapshot.withColumn("lsn", F.lit(lsn).cast("long"))
        return 0, self.spark.createDataFrame([], f"{schema}, lsn long")

    def recover_rows(self) -> tuple[DataFrame, int]:
        """State and last LSN: the latest usable snapshot, then the log after it."""
        lsn, snapshot = self.usable()
        log = self.read_log(lsn)
        return recovered(snapshot, log, lsn), max(lsn, log.agg(F.max("lsn")).first()[0] or 0)

    def recover(self, ttl_recovery: str = "keep") -> tuple[DataFrame, int]:
        """``ttl_recovery="drop"`` makes all recovered entries permanent."""
        state, lsn = self.recover_rows()
        return (state.withColumn("expiry_ms", F.lit(0).cast("long")) if ttl_recovery == "drop" else state), lsn

    def rotate(self, keep: int = KEEP) -> list[int]:
        """Deletes all but the newest snapshots, by number; returns what went."""
        old = [r["snapshot_lsn"] for r in rotation(self.valid_meta().select("snapshot_lsn").distinct(), keep).where("NOT kept").collect()]
        for lsn in old:
            self.delete(f"snapshots/lsn={lsn}")
        return old


def rotation(snapshots: DataFrame, keep: int = KEEP) -> DataFrame:
    """snapshot_lsn, kept: the newest ``keep`` stay. Snapshots are few: a list, not a table of data."""
    return snapshots.withColumn("kept", F.row_number().over(Window.orderBy(F.desc("snapshot_lsn"))) <= keep)


def checkpoint_stats(meta: DataFrame) -> DataFrame:
    return meta.agg(F.max("created_ms").alias("last_ms"), F.max_by("record_count", "snapshot_lsn").alias("last_records"), F.count("*").alias("checkpoints"), F.avg("duration_ms").alias("avg_duration_ms"))
