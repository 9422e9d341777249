"""Cache residency under bounded capacity, by shard."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorekeep.functions import keys

PROMOTE_MS = 1000
ZERO = dict.fromkeys(("hits", "misses", "expired", "evictions", "puts", "removes"), 0)
STATS = "shard int, hits long, misses long, expired long, evictions long, puts long, removes long, size long, peak_size long"


def resident_put_only(log: DataFrame, capacity: int, shards: int) -> DataFrame:
    """Keys that a log of puts alone leaves in the cache: by the stack property, the last ``capacity`` of each shard."""
    last = log.where("op = 'PUT'").groupBy("key").agg(F.max("lsn").alias("lsn")).withColumn("shard", keys.shard(F.col("key"), shards))
    rank = F.row_number().over(Window.partitionBy("shard").orderBy(F.desc("lsn")))
    return last.withColumn("rank", rank).where(F.col("rank") <= capacity)


def simulate(log: DataFrame, capacity: int, shards: int) -> DataFrame:
    """Exact counters by shard with eviction, expiry and throttled promotion: a hit moves a key to the front only if
    more than a second has passed since it was last promoted. Each step depends on the outcome of those before, so a
    shard is one sequential run; shards are the parallelism, and the table's shard count is the knob. A shard's rows
    stream through in batches, in order: a task holds its cache (``capacity`` entries) and no more. A CLEAR empties all
    shards and leaves their counters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, cache, n, peak = None, OrderedDict(), dict(ZERO), 0  # key: expiry, last promotion; the front is the last item

        def told() -> pd.DataFrame:
            return pd.DataFrame([{"shard": shard, **n, "size": len(cache), "peak_size": peak}])

        for own, op, key, ts, ttl in (row for b in batches for row in zip(b["shard"], b["op"], b["key"], b["ts_ms"], b["ttl_ms"], strict=True)):
            if own != shard:
                if shard is not None:
                    yield told()
                shard, cache, n, peak = own, OrderedDict(), dict(ZERO), 0
            entry = cache.get(key)
            if op == "GET":
                if entry is None:
                    n["misses"] += 1
                elif entry[0] and ts > entry[0]:
                    del cache[key]
                    n["expired"] += 1
                    n["misses"] += 1
                else:
                    n["hits"] += 1
                    if ts - entry[1] > PROMOTE_MS:
                        cache.move_to_end(key)
                        entry[1] = ts
            elif op == "PUT":
                n["puts"] += 1
                dies = ts + ttl if ttl > 0 else 0
                if entry is not None:
                    entry[0] = dies
                    cache.move_to_end(key)
                else:
                    if len(cache) >= capacity:
                        cache.popitem(last=False)
                        n["evictions"] += 1
                    cache[key] = [dies, 0]
                    peak = max(peak, len(cache))
            elif op == "DELETE" and entry is not None:
                del cache[key]
                n["removes"] += 1
            elif op == "CLEAR":
                cache.clear()
        if shard is not None:
            yield told()

    every = F.array(*[F.lit(k) for k in range(shards)])
    places = F.explode(F.when(F.col("op") == "CLEAR", every).otherwise(F.array(keys.shard(F.col("key"), shards))))
    dealt = log.select(places.alias("shard"), "lsn", "ts_ms", "op", "key", "ttl_ms")
    return dealt.repartition("shard").sortWithinPartitions("shard", "lsn").mapInPandas(run, STATS)
