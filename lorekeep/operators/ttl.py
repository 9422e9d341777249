"""Expiry: sweeps, their statistics, and the life of each written entry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorekeep.functions.keys import shard as shard_of

from .kv import expiry, live
from .running import with_era


def sweep(state: DataFrame, now_ms: int, shard: int = -1) -> tuple[DataFrame, DataFrame]:
    """What stays, and the number removed by shard (all shards, or one)."""
    own = F.lit(True) if shard < 0 else F.col("shard") == shard
    dead = own & ~live(now_ms)
    return state.where(~dead), state.where(own).groupBy("shard").agg(F.count_if(~live(now_ms)).alias("removed"))


def check_parameters(callback, shards: int, interval_ms: int, sample: int) -> None:
    if callback is None:
        raise ValueError("a callback is needed")
    for name, value in (("shards", shards), ("interval_ms", interval_ms), ("sample", sample)):
        if value <= 0:
            raise ValueError(f"{name} must be positive")


def sample_keys(state: DataFrame, n: int, seed: int) -> DataFrame:
    """A random sample of at most n keys (the sample is the feature)."""
    return state.orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(n).select("key")


def sweep_stats(rounds: DataFrame, shards: int, sample: int, interval_ms: int) -> DataFrame:
    """rounds (round, expired, skipped) to totals; the mean ratio is over rounds that removed something."""
    ratio = F.avg(F.when(F.col("expired") > 0, F.col("expired") / F.lit(shards * sample)))
    return rounds.agg(
        F.count("*").alias("checks"), F.coalesce(F.sum("expired"), F.lit(0)).alias("expired"), F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped"),
        F.coalesce(ratio, F.lit(0.0)).alias("avg_ratio"), F.lit(float(interval_ms)).alias("avg_check_ms"),
    )


def told(log: DataFrame) -> DataFrame:
    """Every operation but CLEARs with the write that it follows (``w``, ``write_no``) and, for reads, whether that entry
    is there and whether it is read too late. Timestamps follow the LSN."""
    write = F.col("op").isin("PUT", "DELETE")
    numbered = with_era(log).where(F.col("op") != "CLEAR").withColumn("write_no", F.sum(write.cast("long")).over(Window.partitionBy("key").orderBy("lsn").rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy("key", "write_no").orderBy("lsn").rowsBetween(Window.unboundedPreceding, 0)
    put = F.first(F.when(write, F.struct("op", "lsn", "ts_ms", "era", expiry(F.col("ts_ms"), F.col("ttl_ms")).alias("expiry_ms"))), ignorenulls=True).over(own)
    there = (F.col("op") == "GET") & (F.coalesce(F.col("w.op"), F.lit("")) == "PUT") & (F.col("w.era") == F.col("era"))
    seen = numbered.withColumn("w", put).withColumn("there", F.coalesce(there, F.lit(False)))
    return seen.withColumn("late", F.col("there") & (F.col("w.expiry_ms") > 0) & (F.col("ts_ms") > F.col("w.expiry_ms")))


def epochs(log: DataFrame) -> DataFrame:
    """One row for each write with what was read of it: (key, write_no, op, lsn, ts_ms, expiry_ms, hits, late, misses,
    first_late_lsn, first_late_ms, era). The first read after an entry's expiry removes it and counts as expired and as a
    miss; further ones are plain misses, and so are reads after a CLEAR (era: the CLEARs before the write). Write 0 stands
    for the time before a key's first write."""
    read, hit = F.col("op") == "GET", F.col("there") & ~F.col("late")
    return told(log).groupBy("key", "write_no").agg(
        F.first("w.op", ignorenulls=True).alias("op"), F.first("w.lsn", ignorenulls=True).alias("lsn"), F.first("w.ts_ms", ignorenulls=True).alias("ts_ms"),
        F.first("w.expiry_ms", ignorenulls=True).alias("expiry_ms"), F.count_if(hit).alias("hits"), F.count_if("late").alias("late"),
        F.count_if(read & ~hit).alias("misses"), F.min(F.when(F.col("late"), F.col("lsn"))).alias("first_late_lsn"),
        F.min(F.when(F.col("late"), F.col("ts_ms"))).alias("first_late_ms"), F.first("w.era", ignorenulls=True).alias("era"),
    )


def sweep_rounds(log: DataFrame, busy: DataFrame, shards: int, interval_ms: int) -> DataFrame:
    """round, expired, skipped: what a sweep every ``interval_ms`` from the log's first time on removes of all shards, and
    how many shards it leaves out. busy: (round, shard) that are left out; their entries go with the shard's next round.
    An entry goes in the first round after its expiry, unless a write, a late read or a CLEAR ended it before. Rounds after
    the log's last time have not come yet."""
    busy = busy.select("shard", "round").distinct()
    order = Window.partitionBy("shard").orderBy("round")
    islands = busy.withColumn("island", F.col("round") - F.row_number().over(order))
    free = islands.withColumn("free", F.max("round").over(Window.partitionBy("shard", "island")) + 1).select("shard", "round", "free")
    times = log.agg(F.coalesce(F.min("ts_ms"), F.lit(0)).alias("start_ms"), F.coalesce(F.max("ts_ms"), F.lit(0)).alias("end_ms"))
    start, end = times.first()
    rounds = (end - start) // interval_ms
    e = epochs(log).withColumn("next_ms", F.lead("ts_ms").over(Window.partitionBy("key").orderBy("write_no")))
    clears = with_era(log).where("op = 'CLEAR'").groupBy((F.col("era") - 1).alias("era")).agg(F.min("ts_ms").alias("clear_ms"))
    mortal = e.where("op = 'PUT' AND expiry_ms > 0").join(clears, "era", "left")
    mortal = mortal.select(shard_of(F.col("key"), shards).alias("shard"), F.least("next_ms", "first_late_ms", "clear_ms").alias("ended_ms"), (F.floor((F.col("expiry_ms") - start) / interval_ms) + 1).alias("round"))
    due = mortal.join(free, ["shard", "round"], "left").withColumn("round", F.coalesce("free", "round"))
    gone = due.where(F.col("ended_ms").isNull() | (F.col("ended_ms") > start + F.col("round") * interval_ms)).groupBy("round").agg(F.count("*").alias("expired"))
    left_out = busy.groupBy("round").agg(F.count("*").alias("skipped"))
    every = log.sparkSession.range(1, rounds + 1).select(F.col("id").alias("round"))
    return every.join(gone, "round", "left").join(left_out, "round", "left").select("round", F.coalesce("expired", F.lit(0)).cast("long").alias("expired"), F.coalesce("skipped", F.lit(0)).cast("long").alias("skipped"))
