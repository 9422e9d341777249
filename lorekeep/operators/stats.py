"""Statistics of caches, latencies, shards and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorekeep.functions.keys import shard as shard_of

from .running import running_total, with_era
from .ttl import epochs, told


def share(part: Column, whole: Column) -> Column:
    """0 where the whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def with_removals(log: DataFrame) -> DataFrame:
    """Epochs with what became of each: whether a PUT met the key absent (inserted), whether a DELETE met it (removed),
    and the CLEAR that ended the entry, if one did (cleared_lsn)."""
    e = epochs(log)
    w = Window.partitionBy("key").orderBy("write_no")
    there = (F.lag("op").over(w) == "PUT") & (F.coalesce(F.lag("late").over(w), F.lit(0)) == 0) & (F.lag("era").over(w) == F.col("era"))
    there = F.coalesce(there, F.lit(False))
    last = F.coalesce(F.lead("era").over(w) != F.col("era"), F.lit(True))
    e = e.withColumn("last", last & (F.col("op") == "PUT") & (F.col("late") == 0)).withColumn("removed", (F.col("op") == "DELETE") & there).withColumn("inserted", (F.col("op") == "PUT") & ~there)
    clears = log.where("op = 'CLEAR'")
    if clears.isEmpty():
        return e.withColumn("cleared_lsn", F.lit(None).cast("long"))
    ends = with_era(log).where("op = 'CLEAR'").groupBy((F.col("era") - 1).alias("era")).agg(F.min("lsn").alias("end_lsn"))
    return e.join(ends, "era", "left").withColumn("cleared_lsn", F.when(F.col("last"), F.col("end_lsn"))).drop("end_lsn")


def cache_stats(log: DataFrame, capacity: int, now_ms: int | None = None) -> DataFrame:
    """One row of counters and rates of an unbounded cache that the log went through."""
    e = with_removals(log)
    n = e.agg(
        F.sum("hits").alias("hits"), F.sum("misses").alias("misses"), F.count_if(F.col("late") > 0).alias("expired"), F.count_if(F.col("op") == "PUT").alias("puts"),
        F.count_if("removed").alias("removes"),
        (F.count_if("inserted") - F.count_if("removed") - F.count_if((F.col("op") == "PUT") & (F.col("late") > 0)) - F.count("cleared_lsn")).alias("size"),
    )
    times = log.agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("last_access_ms"))
    rows = n.crossJoin(F.broadcast(times))  # one row each
    gets = F.col("hits") + F.col("misses")
    uptime = F.floor((F.col("last_access_ms") - F.col("start_ms")) / 1000)
    return rows.select(
        "hits", "misses", "expired", "puts", "removes", "size", F.lit(capacity).cast("long").alias("capacity"), gets.alias("total_gets"),
        share(F.col("hits"), gets).alias("hit_rate"), share(F.col("misses"), gets).alias("miss_rate"), share(F.col("expired"), F.col("misses")).alias("expiry_rate"),
        share(F.col("size"), F.lit(capacity)).alias("usage_rate"), uptime.alias("uptime_seconds"), share(gets, uptime).alias("avg_qps"),
    )


def counters_by_shard(log: DataFrame, shards: int, capacity: int) -> DataFrame:
    """The counters of each shard that the log went through, with its size; ``capacity`` is a shard's, and that of the
    cache is ``shards`` times it. The caches are unbounded: evictions are ``lru.simulate``'s."""
    n = with_removals(log).groupBy(shard_of(F.col("key"), shards).alias("shard")).agg(
        F.sum("hits").alias("hits"), F.sum("misses").alias("misses"), F.count_if(F.col("late") > 0).alias("expired"), F.count_if(F.col("op") == "PUT").alias("puts"),
        F.count_if("removed").alias("removes"),
        (F.count_if("inserted") - F.count_if("removed") - F.count_if((F.col("op") == "PUT") & (F.col("late") > 0)) - F.count("cleared_lsn")).alias("size"),
    )
    return n.withColumn("capacity", F.lit(capacity).cast("long")).withColumn("total_capacity", F.lit(shards * capacity).cast("long"))


def counters_since(log: DataFrame, reset_lsn: int) -> DataFrame:
    """One row of counters that were set to zero after ``reset_lsn`` while the data stayed: an entry from before is still
    hit. The times of the last read, hit and miss are null where there was none."""
    hit = F.col("there") & ~F.col("late")
    miss = (F.col("op") == "GET") & ~hit
    reads = told(log).where(F.col("lsn") > reset_lsn).agg(
        F.count_if(hit).alias("hits"), F.count_if(miss).alias("misses"), F.count_if(F.col("op") == "PUT").alias("puts"),
        F.max(F.when(hit, F.col("ts_ms"))).alias("last_hit_ms"), F.max(F.when(miss, F.col("ts_ms"))).alias("last_miss_ms"), F.max(F.when(F.col("op") == "GET", F.col("ts_ms"))).alias("last_access_ms"),
    )
    ends = with_removals(log).agg(F.count_if(F.col("first_late_lsn") > reset_lsn).alias("expired"), F.count_if(F.col("removed") & (F.col("lsn") > reset_lsn)).alias("removes"))
    return reads.crossJoin(F.broadcast(ends))  # one row each


def size_changes(log: DataFrame) -> DataFrame:
    """lsn, delta: +1 where a key is inserted, -1 where it is removed, cleared or dies of a late read."""
    e = with_removals(log)
    changes = F.array(
        F.when(F.col("inserted"), F.struct(F.col("lsn").alias("lsn"), F.lit(1).alias("delta"))),
        F.when(F.col("removed"), F.struct(F.col("lsn").alias("lsn"), F.lit(-1).alias("delta"))),
        F.when((F.col("op") == "PUT") & (F.col("late") > 0), F.struct(F.col("first_late_lsn").alias("lsn"), F.lit(-1).alias("delta"))),
        F.when(F.col("cleared_lsn").isNotNull(), F.struct(F.col("cleared_lsn").alias("lsn"), F.lit(-1).alias("delta"))),
    )
    return e.select(F.explode(F.array_compact(changes)).alias("c")).select("c.lsn", "c.delta")


def peak_size(log: DataFrame) -> DataFrame:
    return running_total(size_changes(log), "lsn", "delta").agg(F.max("total").alias("peak_size"))


def percentiles(df: DataFrame, group: str, value: str, points: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """``sorted[n * p / 100]`` (zero-based, rounded down) for each group: equal values are counted before they are
    ordered, so the ordered rows are the distinct values only."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("n"))
    own = Window.partitionBy(group)
    upto = F.sum("n").over(own.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("upto", upto).withColumn("all", F.sum("n").over(own))
    return ranked.groupBy(group).agg(*[F.min(F.when(F.col("upto") > F.floor(F.col("all") * p / 100), F.col(value))).alias(f"p{p}") for p in points])


def latency_summary(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("avg_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value"), (F.count("*") / (F.sum(value) / 1000)).alias("qps"))


def uniformity(counts: DataFrame, column: str = "n") -> DataFrame:
    """Spread of shard counts: mean, population deviation, coefficient of variation, extremes, chi-square, grade."""
    c = F.col(column)
    base = counts.agg(
        F.count("*").alias("shards"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("stddev"), F.max(c).alias("most"), F.min(c).alias("least"),
        F.sum(c * c).alias("squares"), F.sum(c).alias("total"),
    )
    cv = 100 * F.col("stddev") / F.col("mean")
    chi = F.col("squares") / F.col("mean") - F.col("total")
    return base.select(
        "shards", "mean", "stddev", cv.alias("cv_percent"), (100 * (F.col("most") - F.col("mean")) / F.col("mean")).alias("over_percent"),
        (100 * (F.col("mean") - F.col("least")) / F.col("mean")).alias("under_percent"), (F.col("most") - F.col("least")).alias("spread"), (F.col("most") / F.col("least")).alias("ratio"),
        chi.alias("chi_square"), (chi < 1.5 * F.col("shards")).alias("chi_passes"),
        F.when(cv < 5, "excellent").when(cv < 10, "good").when(cv < 20, "fair").otherwise("poor").alias("grade"),
    )


def hit_percent(hits: Column, misses: Column) -> Column:
    """Whole percents, one added to the divisor."""
    return F.floor(hits * 100 / (hits + misses + 1)).cast("long")


def relative(df: DataFrame, qps: str) -> DataFrame:
    """Share of the best and the drop from it, in percent."""
    best = df.agg(F.max(qps).alias("_best"))  # one row
    return df.crossJoin(F.broadcast(best)).withColumn("of_best_percent", 100 * F.col(qps) / F.col("_best")).drop("_best").withColumn("drop_percent", 100 - F.col("of_best_percent"))


def speedup(single_s: Column, batch_s: Column, n: Column) -> Column:
    return F.struct((single_s * n / batch_s).alias("speedup"), (single_s / batch_s).alias("efficiency"))


def health(runs: DataFrame, shards: int, limit: int = 5) -> DataFrame:
    """runs (group_id, run): a shard with ``limit`` errors in a row is disabled; the whole is healthy while more than
    half of the shards are."""
    per = runs.groupBy("group_id").agg(F.max("run").alias("worst"), F.max("tail").alias("open_errors"))
    n = per.agg(F.coalesce(F.count_if(F.col("worst") >= limit), F.lit(0)).alias("disabled"), F.coalesce(F.sum("open_errors"), F.lit(0)).alias("errors"))
    healthy = F.lit(shards) - F.col("disabled")
    return n.select(F.lit(shards).cast("long").alias("total_shards"), "disabled", healthy.cast("long").alias("healthy"), (healthy > F.lit(shards // 2)).alias("overall_healthy"), (F.col("errors") / F.lit(5 * shards)).alias("error_rate"))
