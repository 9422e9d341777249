"""Commits written in groups: a batch closes when it is large or old enough."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BYTES, MAX_AGE_MS = 4096, 10


def batches(requests: DataFrame, max_bytes: int = MAX_BYTES, max_age_ms: int = MAX_AGE_MS) -> DataFrame:
    """requests (stream, req_id, ts_ms, bytes, sync): the exact batch of each, stream by stream. A batch closes with the
    request that fills it, with a synchronous one, or before one that comes when it is too old. Requests pass through
    in order; a task holds the open batch's size and age only."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, batch, size, since = None, 0, 0, None
        for rows in parts:
            out = []
            for own, ts, n, sync in zip(rows["stream"], rows["ts_ms"], rows["bytes"], rows["sync"], strict=True):
                if own != stream:
                    stream, batch, size, since = own, 0, 0, None
                if since is not None and ts - since >= max_age_ms:
                    batch, size, since = batch + 1, 0, None
                since = ts if since is None else since
                size += n
                out.append(batch)
                if size >= max_bytes or sync:
                    batch, size, since = batch + 1, 0, None
            yield pd.DataFrame({"stream": rows["stream"], "req_id": rows["req_id"], "batch": out, "bytes": rows["bytes"]})

    dealt = requests.select("stream", "req_id", "ts_ms", "bytes", "sync").repartition("stream").sortWithinPartitions("stream", "ts_ms", "req_id")
    return dealt.mapInPandas(run, f"stream {requests.schema['stream'].dataType.simpleString()}, req_id long, batch long, bytes long")


def bucketed(requests: DataFrame, interval_ms: int) -> DataFrame:
    """Batches by time alone: what arrives in one interval is one commit."""
    own = F.floor(F.col("ts_ms") / interval_ms)
    return requests.groupBy(own.alias("batch")).agg(F.count("*").alias("commits"), F.sum("bytes").alias("bytes"), F.min("req_id").alias("first_req"), F.max("req_id").alias("last_req"))


def by_batch(batched: DataFrame) -> DataFrame:
    """A row for each batch of ``batches``."""
    return batched.groupBy("stream", "batch").agg(F.count("*").alias("commits"), F.sum("bytes").alias("bytes"))


def stats(batched: DataFrame, interval_ms: int) -> DataFrame:
    """batched: a row for each batch."""
    n = batched.agg(F.sum("commits").alias("commits"), F.count("*").alias("batches"), F.sum("bytes").alias("bytes"))
    return n.withColumn("commits_per_batch", F.col("commits") / F.col("batches")).withColumn("latency_ms", F.lit(float(interval_ms)))
