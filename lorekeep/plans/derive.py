"""The engine's tables as views of the test tables: log, vectors, nodes, edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators.graph import Graph, latest_edges


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_log(events: DataFrame) -> DataFrame:
    """Views read, errors delete, all else puts; clicks live an hour."""
    kind = F.col("event_type")
    return events.select(
        (F.col("event_id") + 1).alias("lsn"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        F.when(kind == "view", "GET").when(kind == "error", "DELETE").otherwise("PUT").alias("op"),
        F.concat(F.lit("user_"), F.col("user_id")).alias("key"), F.col("props").alias("value"), F.when(kind == "click", 3600000).otherwise(0).cast("long").alias("ttl_ms"),
    )


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_log(table(spark, sf_dir, "events"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("vec_"), F.col("vec_id")).alias("key"), "vec_id", "embedding", "label")


def edge_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large purchase leads to the user of the next event; clicks and purchases lead to their item."""
    e = table(spark, sf_dir, "events")
    following = e.select((F.col("event_id") - 1).alias("event_id"), F.col("user_id").alias("next_id"))
    user = F.concat(F.lit("user_"), F.col("user_id"))
    follows = e.where("event_type = 'purchase' AND value > 60").join(following, "event_id").where("user_id <> next_id")
    follows = follows.select(user.alias("src_id"), F.concat(F.lit("user_"), F.col("next_id")).alias("dst_id"), F.lit("follows").alias("label"), F.col("value").alias("weight"), (F.col("event_id") * 2).alias("seq"))
    touched = e.where("event_type IN ('purchase', 'click')")
    items = touched.select(user.alias("src_id"), F.concat(F.lit("item_"), F.get_json_object("props", "$.k")).alias("dst_id"), F.col("event_type").alias("label"), F.col("value").alias("weight"), (F.col("event_id") * 2 + 1).alias("seq"))
    return follows.unionByName(items)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_edges(edge_log(spark, sf_dir))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and items of all events."""
    e = table(spark, sf_dir, "events")
    users = e.select(F.concat(F.lit("user_"), F.col("user_id")).alias("node_id"))
    items = e.select(F.concat(F.lit("item_"), F.get_json_object("props", "$.k")).alias("node_id"))
    return users.union(items).distinct().withColumn("properties_json", F.concat(F.lit('{"id":"'), F.col("node_id"), F.lit('"}')))


def node_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users have the vector of their number; items have none."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("vec_id")).distinct()
    return table(spark, sf_dir, "embeddings").join(users, "vec_id", "left_semi").select(F.concat(F.lit("user_"), F.col("vec_id")).alias("node_id"), "embedding")


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(nodes(spark, sf_dir), edges(spark, sf_dir), node_vectors(spark, sf_dir))


def vector_of(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"])


def label_heads(spark: SparkSession, sf_dir: str) -> dict[int, list[float]]:
    """The stated query set: the first vector of each label."""
    heads = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v"), F.min("vec_id").alias("q")).collect()
    return {r["q"]: list(r["v"]) for r in heads}
