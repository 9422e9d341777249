"""The operation set of the engine's front ends, as one object, and its JSON-RPC dispatcher."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lorekeep.operators.graph import Graph
from lorekeep.operators.kv import KVTable
from lorekeep.operators.rag import graph_rag, graph_rag_batch
from lorekeep.operators.similar import get, top_k
from lorekeep.sources.tables import materialised

Embedder = Callable[[str], list[float]]
VECTORS = "key string, embedding array<float>, metadata string"


def hash_embedder(dims: int = 64) -> Embedder:
    """A deterministic stand-in for a model: signed word hashes, normalised."""

    def embed(text: str) -> list[float]:
        v = [0.0] * dims
        for word in text.lower().split():
            h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "little")
            v[h % dims] += 1.0 if h >> 63 else -1.0
        norm = math.sqrt(sum(x * x for x in v))
        return [x / norm for x in v] if norm else v

    return embed


class RequestError(Exception):
    def __init__(self, status: int, message: str) -> None:
        super().__init__(message)
        self.status = status


class Engine:
    def __init__(self, spark: SparkSession, embedder: Embedder | None = None, clock: Callable[[], int] | None = None) -> None:
        import time

        self.spark, self.embedder, self.clock = spark, embedder or hash_embedder(), clock or (lambda: int(time.time() * 1000))
        self.kv, self.graph = KVTable.empty(spark), Graph.empty(spark)
        self.vectors = spark.createDataFrame([], VECTORS)

    def settle(self, kv: KVTable | None = None, vectors=None, graph: Graph | None = None) -> None:
        """A change is a table before the next one builds on it, so plans stay as small as one operation."""
        if kv is not None:
            self.kv = KVTable(materialised(kv.log.coalesce(1), "engine"), kv.shards)
        if vectors is not None:
            self.vectors = materialised(vectors.coalesce(1), "engine")
        if graph is not None:
            self.graph = Graph(*(materialised(t.coalesce(1), "engine") for t in (graph.nodes, graph.edges, graph.vectors)))

    @staticmethod
    def need(**fields) -> None:
        for name, value in fields.items():
            if value is None or value == "" or value == []:
                raise RequestError(400, f"{name} is required")

    def health(self) -> dict:
        return {"status": "ok"}

    def kv_set(self, key: str | None = None, value: str | None = None, ttl_ms: int = 0) -> dict:
        self.need(key=key)
        if value is None:
            raise RequestError(400, "value is required")
        self.settle(kv=self.kv.put(key, value, ttl_ms, self.clock()))
        return {"success": True}

    def kv_get(self, key: str | None = None) -> dict:
        self.need(key=key)
        value = self.kv.get(key, self.clock())
        if value is None:
            raise RequestError(404, "key not found")
        return {"key": key, "value": value}

    def kv_delete(self, key: str | None = None) -> dict:
        self.need(key=key)
        after, there = self.kv.remove(key, self.clock())
        self.settle(kv=after)
        if not there:
            raise RequestError(404, "key not found")
        return {"success": True}

    def vector_put(self, key: str | None = None, embedding: list[float] | None = None, metadata: str = "") -> dict:
        self.need(key=key, embedding=embedding)
        new = self.spark.createDataFrame([(key, [float(x) for x in embedding], metadata)], VECTORS)
        self.settle(vectors=self.vectors.where(F.col("key") != key).unionByName(new))
        return {"success": True, "dim": len(embedding)}

    def vector_get(self, key: str | None = None) -> dict:
        self.need(key=key)
        found = get(self.vectors, key)
        if not found:
            raise RequestError(404, "vector not found")
        return {"key": key, "embedding": found, "dim": len(found)}

    def vector_delete(self, key: str | None = None) -> dict:
        self.vector_get(key)
        self.settle(vectors=self.vectors.where(F.col("key") != key))
        return {"success": True}

    def vector_search(self, query: list[float] | None = None, top_k_: int | None = None, metric: str = "l2") -> dict:
        self.need(query=query, top_k=top_k_)
        found = top_k(self.vectors, query, top_k_, metric).join(self.vectors.select("key", "metadata"), "key").collect()
        order = sorted(found, key=lambda r: (r["score"] if metric not in ("cosine", "dot", "dot_product") else -r["score"], r["key"]))
        return {"results": [r.asDict() for r in order], "count": len(order), "dim": len(query)}

    def add_node(self, node_id: str | None = None, properties_json: str = "{}", embedding: list[float] | None = None) -> dict:
        self.need(node_id=node_id)
        graph = self.graph.add_nodes([(node_id, properties_json)])
        self.settle(graph=graph.set_vectors([(node_id, embedding)]) if embedding else graph)
        return {"success": True}

    def add_edge(self, src_id: str | None = None, dst_id: str | None = None, label: str | None = None, weight: float = 1.0, properties_json: str = "{}") -> dict:
        self.need(src_id=src_id, dst_id=dst_id, label=label)
        self.settle(graph=self.graph.add_edges([(src_id, dst_id, label, weight, properties_json)]))
        return {"success": True}

    def rag_query(self, query_embedding: list[float] | None = None, query_embeddings: list[list[float]] | None = None, vector_top_k: int = 3, hop_depth: int = 2) -> dict:
        if query_embeddings:
            found = graph_rag_batch(self.graph, query_embeddings, vector_top_k, hop_depth)
        else:
            self.need(query_embedding=query_embedding)
            found = graph_rag(self.graph, query_embedding, vector_top_k, hop_depth)
        rows = [r.asDict() for r in found.orderBy("node_id").collect()]
        return {"nodes": rows, "count": len(rows)}

    # Tools that take text and embed it.

    def text_insert(self, key: str, text: str, metadata: str = "") -> dict:
        raw = text.encode()
        self.vector_put(key, self.embedder(text), metadata or raw[:200].decode("utf-8", "ignore"))
        return {"key": key, "text_length": len(raw), "preview": raw[:200].decode("utf-8", "ignore")}

    def text_search(self, query: str, top_k: int = 5, metric: str = "cosine") -> dict:
        return self.vector_search(self.embedder(query), top_k, metric)

    def text_node(self, node_id: str, properties_json: str = "{}", text: str = "") -> dict:
        return self.add_node(node_id, properties_json, self.embedder(text) if text else None)

    def text_rag(self, query: str, vector_top_k: int = 3, hop_depth: int = 2) -> dict:
        return self.rag_query(self.embedder(query), None, vector_top_k, hop_depth)

    def memory_recall(self, key: str = "", query: str = "", top_k: int = 3) -> dict:
        """The exact key first, else what is similar."""
        if not key and not query:
            raise RequestError(400, "key or query is required")
        if key and (value := self.kv.get(key, self.clock())) is not None:
            return {"source": "exact", "key": key, "value": value}
        if query:
            return {"source": "semantic", **self.text_search(query, top_k)}
        raise RequestError(404, "nothing is remembered")


TOOLS = {
    "vector_search": ("text_search", ["query"]), "vector_insert": ("text_insert", ["key", "text"]), "graph_add_node": ("text_node", ["node_id"]),
    "graph_add_edge": ("add_edge", ["src_id", "dst_id", "label"]), "graph_rag_query": ("text_rag", ["query"]), "kv_set": ("kv_set", ["key", "value"]),
    "kv_get": ("kv_get", ["key"]), "kv_delete": ("kv_delete", ["key"]), "memory_recall": ("memory_recall", []),
}


def dispatch(engine: Engine, line: str) -> dict:
    """One JSON-RPC request to one response: initialize, tools/list, tools/call."""

    def fail(code: int, message: str, id_=None) -> dict:
        return {"jsonrpc": "2.0", "id": id_, "error": {"code": code, "message": message}}

    try:
        request = json.loads(line)
    except ValueError:
        return fail(-32700, "parse error")
    id_, method = request.get("id"), request.get("method")
    if method == "initialize":
        return {"jsonrpc": "2.0", "id": id_, "result": {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "lorekeep", "version": "1"}}}
    if method == "tools/list":
        tools = [{"name": n, "inputSchema": {"type": "object", "required": needed}} for n, (_, needed) in TOOLS.items()]
        return {"jsonrpc": "2.0", "id": id_, "result": {"tools": tools}}
    if method != "tools/call":
        return fail(-32601, "method not found", id_)
    params = request.get("params") or {}
    if params.get("name") not in TOOLS:
        return fail(-32602, "unknown tool", id_)
    name, needed = TOOLS[params["name"]]
    arguments = params.get("arguments") or {}
    if missing := [x for x in needed if x not in arguments]:
        return fail(-32602, f"missing: {', '.join(missing)}", id_)
    try:
        result, wrong = getattr(engine, name)(**arguments), False
    except RequestError as e:
        result, wrong = {"found": False, "error": str(e)}, True
    except TypeError as e:
        return fail(-32602, str(e), id_)
    return {"jsonrpc": "2.0", "id": id_, "result": {"content": [{"type": "text", "text": json.dumps(result)}], "isError": wrong}}
