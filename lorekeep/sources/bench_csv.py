"""Benchmark results as CSV with comment lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "`Test` STRING, `WorkloadType` STRING, `Threads` INT, `TotalOps` BIGINT, `Duration(ms)` DOUBLE, `QPS` DOUBLE, `AvgLatency(us)` DOUBLE, `P50(us)` DOUBLE, `P95(us)` DOUBLE, "
    "`P99(us)` DOUBLE, `HitRate(%)` INT, `PreloadCount` INT, `KeyRange` INT, `Shards` INT, `WAL` STRING"
)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("header", True).option("comment", "#").csv(path)


def write(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").option("header", True).csv(path)
