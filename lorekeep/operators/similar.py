"""Exact similarity search over a vector table (key, embedding)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorekeep.functions import vectors as V

#: Most queries of a batch: their vectors go to every task.
MOST_QUERIES = 10_000


def scored(vectors: DataFrame, query: list[float], metric: str = "l2") -> DataFrame:
    """Rows of the query's dimension with their score; other dimensions and empty vectors are skipped."""
    return vectors.where((F.size("embedding") == len(query)) & (F.size("embedding") > 0)).withColumn("score", V.distance(metric, F.col("embedding"), V.literal(query)))


def top_k(vectors: DataFrame, query: list[float], k: int, metric: str = "l2") -> DataFrame:
    """key, score of the k best, ties by key: a partial top k in every task, then one of these."""
    if k <= 0 or not query:
        return vectors.select("key").withColumn("score", F.lit(0.0)).where(F.lit(False))
    order = F.desc("score") if V.best_is_large(metric) else F.asc("score")
    return scored(vectors, query, metric).select("key", "score").orderBy(order, "key").limit(k)


def top_k_batch(vectors: DataFrame, queries: dict[int, list[float]], k: int, metric: str = "cosine") -> DataFrame:
    """qid, key, score, rank: the k best for each query. All queries meet each block of rows in one matrix product, and
    a block passes on no more than its own best."""
    if len(queries) > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries in a batch")
    schema = "qid long, key string, score double"
    dims = {len(q) for q in queries.values()}
    if k <= 0 or not queries or dims == {0}:
        return vectors.sparkSession.createDataFrame([], f"{schema}, rank int")
    parts = [{i: q for i, q in queries.items() if len(q) == d} for d in sorted(dims) if d]
    found = None
    for part in parts:
        own = vectors.where(F.size("embedding") == len(next(iter(part.values())))).select(F.col("key").cast("string"), "embedding")
        block = own.mapInArrow(V.partial_top(part, k, metric), schema)
        found = block if found is None else found.unionByName(block)
    best = F.desc("score") if V.best_is_large(metric) else F.asc("score")
    # Scores of a product of blocks differ in the last bits from block to block; ties are judged at nine decimals.
    ranked = found.withColumn("score", F.round("score", 9)).withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(best, "key")))
    return ranked.where(F.col("rank") <= k)


def get(vectors: DataFrame, key: str) -> list[float]:
    row = vectors.where(F.col("key") == key).select(F.coalesce("embedding", F.array().cast("array<float>")).alias("v")).first()
    return list(row["v"]) if row else []


class VectorIndex:
    """Vectors of one dimension with metadata; an index that becomes empty takes any dimension again."""

    SCHEMA = "key string, embedding array<float>, metadata string, expiry_ms long"

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows

    def dimension(self) -> int:
        row = self.rows.select(F.size("embedding").alias("n")).first()
        return row["n"] if row else 0

    def insert(self, key: str, embedding: list[float], metadata: str = "", expiry_ms: int = 0) -> VectorIndex:
        if not embedding or self.dimension() not in (0, len(embedding)):
            raise ValueError("the dimension differs from the index's")
        new = self.rows.sparkSession.createDataFrame([(key, [float(x) for x in embedding], metadata, expiry_ms)], self.SCHEMA)
        return VectorIndex(self.rows.where(F.col("key") != key).unionByName(new))

    def remove(self, key: str) -> VectorIndex:
        return VectorIndex(self.rows.where(F.col("key") != key))

    def size(self) -> int:
        return self.rows.count()

    def list_keys(self, prefix: str = "") -> DataFrame:
        return self.rows.where(F.col("key").startswith(prefix)).select("key").orderBy("key")

    def search(self, query: list[float], k: int, metric: str = "l2") -> DataFrame:
        return top_k(self.rows, query, k, metric)
