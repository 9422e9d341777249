"""Property multigraph: edges are the authority, adjacency and counters are views of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorekeep.schemas import EDGES, NODE_VECTORS, NODES
from lorekeep.sources.tables import materialised


def latest_edges(log: DataFrame) -> DataFrame:
    """Upserts to one row for each (src, dst, label): the last values, and the first seq, which orders adjacency."""
    rest = [c for c in log.columns if c not in ("src_id", "dst_id", "label", "seq")]
    last = F.max_by(F.struct(*rest), "seq").alias("last")
    return log.groupBy("src_id", "dst_id", "label").agg(last, F.min("seq").alias("seq")).select("src_id", "dst_id", "label", *[F.col("last")[c].alias(c) for c in rest], "seq")


def neighbours(edges: DataFrame, direction: str = "out") -> DataFrame:
    """node_id, neighbours: distinct over labels, in the order of first insertion."""
    own, other = ("src_id", "dst_id") if direction == "out" else ("dst_id", "src_id")
    first = edges.groupBy(F.col(own).alias("node_id"), F.col(other).alias("other")).agg(F.min("seq").alias("seq"))
    return first.groupBy("node_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "other"))), lambda x: x["other"]).alias("neighbours"))


def rebuilt_neighbours(edges: DataFrame) -> DataFrame:
    """Out-neighbours in the order of edge keys, as a rebuild from the edge table gives them."""
    first = edges.groupBy(F.col("src_id").alias("node_id"), "dst_id").agg(F.min("label").alias("label"))
    return first.groupBy("node_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("dst_id", "label"))), lambda x: x["dst_id"]).alias("neighbours"))


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src_id", "dst_id").agg(F.count("*").alias("n"))


def without_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """``gone`` (src_id, dst_id, label); a neighbour stays while another label is left."""
    return edges.join(gone, ["src_id", "dst_id", "label"], "left_anti")


def without_nodes(nodes: DataFrame, edges: DataFrame, vectors: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``gone`` (node_id): nodes, their vectors and every edge at either end go."""
    left = edges.join(gone.select(F.col("node_id").alias("src_id")), "src_id", "left_anti")
    return nodes.join(gone, "node_id", "left_anti"), left.join(gone.select(F.col("node_id").alias("dst_id")), "dst_id", "left_anti"), vectors.join(gone, "node_id", "left_anti")


def k_hop(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """node_id, hop: the shortest distance (1 .. hops) from any start; starts themselves are not in the result.

    One join and one anti join a level; each level is a table in the shared folder, and the loop ends when one is empty.
    """
    links = edges.select("src_id", "dst_id").distinct()
    seen = materialised(starts.select("node_id").distinct().withColumn("hop", F.lit(0)), "frontier")
    frontier, levels = seen, [seen]
    for hop in range(1, hops + 1):
        reached = links.join(frontier.select(F.col("node_id").alias("src_id")), "src_id", "left_semi").select(F.col("dst_id").alias("node_id")).distinct()
        for level in levels:
            reached = reached.join(level.select("node_id"), "node_id", "left_anti")
        frontier = materialised(reached.withColumn("hop", F.lit(hop)), "frontier")
        if frontier.isEmpty():
            break
        levels.append(frontier)
        if len(levels) > 8:  # a deep walk meets one table, not one for each level
            levels = [levels[0], materialised(_union(levels[1:]), "frontier")]
    return _union(levels).where("hop > 0")


def _union(levels: list[DataFrame]) -> DataFrame:
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def shortest_path(edges: DataFrame, src: str, dst: str, max_hops: int | None = None) -> list[str]:
    """Node ids from src to dst; of equal lengths the one that a queue finds first which takes neighbours in the order
    of their insertion. [src] if both are one, [] if there is none. Each level keeps one row for each new node, with its
    parent and its place in the queue, which is counted within the level's parents (never over a single task)."""
    if src == dst:
        return [src]
    spark = edges.sparkSession
    steps = materialised(edges.groupBy("src_id", "dst_id").agg(F.min("seq").alias("seq")), "steps")
    frontier = spark.createDataFrame([(src, None, [])], "node_id string, parent string, place array<bigint>")
    levels, hop = [frontier], 0
    seen = materialised(frontier.select("node_id"), "seen")
    while max_hops is None or hop < max_hops:
        hop += 1
        # A node's place is the row of seqs on its way here; rows of one length compare in the queue's order.
        ways = steps.join(frontier.select(F.col("node_id").alias("src_id"), "place"), "src_id")
        ways = ways.select(F.col("dst_id").alias("node_id"), F.col("src_id").alias("parent"), F.concat("place", F.array("seq")).alias("place"))
        frontier = materialised(ways.join(seen, "node_id", "left_anti").groupBy("node_id").agg(F.min_by("parent", "place").alias("parent"), F.min("place").alias("place")), "frontier")
        if frontier.isEmpty():
            return []
        levels.append(frontier)
        if not frontier.where(F.col("node_id") == dst).isEmpty():
            path = [dst]
            for level in reversed(levels[1:]):
                path.append(level.where(F.col("node_id") == path[-1]).first()["parent"])
            return path[::-1]
        seen = materialised(seen.union(frontier.select("node_id")), "seen")
    return []


class Graph:
    """Nodes, edges and node vectors; changes give a new graph."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, vectors: DataFrame) -> None:
        self.nodes, self.edges, self.vectors = nodes, edges, vectors
        self.spark = nodes.sparkSession

    @classmethod
    def empty(cls, spark) -> Graph:
        return cls(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES), spark.createDataFrame([], NODE_VECTORS))

    def add_nodes(self, rows: list[tuple[str, str]]) -> Graph:
        new = self.spark.createDataFrame(list(dict(rows).items()), NODES)
        return Graph(self.nodes.join(new, "node_id", "left_anti").unionByName(new), self.edges, self.vectors)

    update_nodes = add_nodes

    def add_edges(self, rows: list[tuple]) -> Graph:
        """(src, dst, label[, weight[, properties]]); ends need not exist."""
        at = (self.edges.agg(F.max("seq")).first()[0] or 0) + 1
        new = self.spark.createDataFrame([(s, d, l, float(w[0]) if w else 1.0, w[1] if len(w) > 1 else "{}", at + i) for i, (s, d, l, *w) in enumerate(rows)], EDGES)
        return Graph(self.nodes, latest_edges(self.edges.unionByName(new)), self.vectors)

    def set_vectors(self, rows: list[tuple[str, list[float]]]) -> Graph:
        new = self.spark.createDataFrame([(k, [float(x) for x in v]) for k, v in rows], NODE_VECTORS)
        return Graph(self.nodes, self.edges, self.vectors.join(new, "node_id", "left_anti").unionByName(new))

    def delete_edge(self, src: str, dst: str, label: str) -> Graph:
        gone = self.spark.createDataFrame([(src, dst, label)], "src_id string, dst_id string, label string")
        return Graph(self.nodes, without_edges(self.edges, gone), self.vectors)

    def delete_node(self, node_id: str) -> Graph:
        return Graph(*without_nodes(self.nodes, self.edges, self.vectors, self.spark.createDataFrame([(node_id,)], "node_id string")))

    def get_node(self, node_id: str) -> str | None:
        row = self.nodes.where(F.col("node_id") == node_id).first()
        return row["properties_json"] if row else None

    def get_edge(self, src: str, dst: str, label: str):
        return self.edges.where((F.col("src_id") == src) & (F.col("dst_id") == dst) & (F.col("label") == label)).first()

    def get_vector(self, node_id: str) -> list[float]:
        row = self.vectors.where(F.col("node_id") == node_id).first()
        return list(row["embedding"]) if row else []

    def out(self, node_id: str) -> list[str]:
        row = neighbours(self.edges.where(F.col("src_id") == node_id)).first()
        return row["neighbours"] if row else []

    def into(self, node_id: str) -> list[str]:
        row = neighbours(self.edges.where(F.col("dst_id") == node_id), "in").first()
        return row["neighbours"] if row else []

    def k_hop(self, node_id: str, hops: int) -> dict[str, int]:
        starts = self.spark.createDataFrame([(node_id,)], "node_id string")
        return {r["node_id"]: r["hop"] for r in k_hop(self.edges, starts, hops).collect()}

    def path(self, src: str, dst: str, max_hops: int | None = None) -> list[str]:
        return shortest_path(self.edges, src, dst, max_hops)


def error_runs(outcomes: DataFrame) -> DataFrame:
    """Longest run of errors in each group (group_id, lsn, failed): gaps and islands by two row numbers."""
    w = Window.partitionBy("group_id").orderBy("lsn")
    both = Window.partitionBy("group_id", "failed").orderBy("lsn")
    islands = outcomes.withColumn("island", F.row_number().over(w) - F.row_number().over(both)).where("failed")
    return islands.groupBy("group_id", "island").agg(F.count("*").alias("run"), F.min("lsn").alias("first_lsn"))
