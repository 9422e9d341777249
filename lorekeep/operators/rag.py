"""Graph-augmented retrieval: similar nodes, their neighbourhood, the nodes' properties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import Graph, k_hop
from .similar import top_k, top_k_batch


def entries(graph: Graph, query: list[float], k: int) -> DataFrame:
    """node_id, score of the k nodes most similar by cosine, ties by id."""
    return top_k(graph.vectors.select(F.col("node_id").alias("key"), "embedding"), query, k, "cosine").withColumnRenamed("key", "node_id")


def expanded(graph: Graph, starts: DataFrame, hops: int) -> DataFrame:
    """The existing nodes among the starts and what they reach. A start without a node row still expands."""
    reached = starts.select("node_id")
    if hops > 0:
        reached = reached.union(k_hop(graph.edges, starts, hops).select("node_id")).distinct()
    return graph.nodes.join(reached.distinct(), "node_id", "left_semi")


def graph_rag(graph: Graph, query: list[float], k: int = 3, hops: int = 2) -> DataFrame:
    """One walk from all entries at once: the union of the walks from each has the same nodes."""
    return expanded(graph, entries(graph, query, k).select("node_id"), hops)


def graph_rag_batch(graph: Graph, queries: list[list[float]], k: int = 3, hops: int = 2) -> DataFrame:
    """The union over the queries, with one search and one walk for all of them."""
    found = top_k_batch(graph.vectors.select(F.col("node_id").alias("key"), "embedding"), dict(enumerate(queries)), k)
    return expanded(graph, found.select(F.col("key").alias("node_id")).distinct(), hops)


def recall(results: DataFrame, expected: DataFrame) -> DataFrame:
    """query, found, expected, recall for expected (query, node_id) against results (query, node_id)."""
    hit = results.select("query", "node_id").distinct().withColumn("hit", F.lit(1))
    both = expected.join(hit, ["query", "node_id"], "left")
    return both.groupBy("query").agg(F.count("hit").alias("found"), F.count("*").alias("expected")).withColumn("recall", F.col("found") / F.col("expected"))
