"""Streams, the service object and the registry."""

import json
import uuid

from pyspark.sql import functions as F

import __spark_entry__
from lorekeep.operators import kv
from lorekeep.schemas import KV_LOG
from lorekeep.service import Engine, dispatch, hash_embedder
from lorekeep.sources import bench_csv, oplog
from lorekeep.streaming import apply

ROWS = [(i + 1, 1000 + i, ["PUT", "PUT", "DELETE", "GET"][i % 4], f"k{i % 7}", f"v{i}", 0) for i in range(60)]


def test_stream_equals_batch(spark, tmp_path):
    log = spark.createDataFrame(ROWS, KV_LOG)
    log.repartition(3).write.parquet(f"{tmp_path}/log")
    log.where("lsn % 2 = 0").write.mode("append").parquet(f"{tmp_path}/log")  # sent twice
    stream = apply.stream_log(spark, f"{tmp_path}/log", KV_LOG)
    got = apply.drained(apply.latest(stream), f"t{uuid.uuid4().hex}")
    want = kv.state(log).drop("shard")
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    once = apply.drained(apply.once(stream), f"t{uuid.uuid4().hex}", "append")
    assert once.count() == len(ROWS)


class FakeState:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class FakeHandle:
    def __init__(self):
        self.timers = []

    def getValueState(self, name, schema, ttlDurationMs=None):
        return FakeState()

    def registerTimer(self, at):
        self.timers.append(at)


class FakeTimer:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):
        return self.at


def test_stateful_applier():
    """The processor by itself, without a stream around it."""
    import pandas as pd

    names = ["lsn", "ts_ms", "op", "key", "value", "ttl_ms"]
    part = lambda *rows: iter([pd.DataFrame([(r[0], r[1], r[2], "k", r[3], r[4]) for r in rows], columns=names)])
    own, handle = apply.Applier(), FakeHandle()
    own.init(handle)
    first = list(own.handleInputRows(("k",), part((2, 5, "PUT", "b", 100), (1, 4, "PUT", "a", 0), (3, 6, "GET", None, 0)), None))
    assert first[0].iloc[0]["value"] == "b" and first[0].iloc[0]["expiry_ms"] == 105 and handle.timers == [105]
    assert list(own.handleInputRows(("k",), part((1, 4, "PUT", "a", 0)), None)) == []  # late: it changes nothing
    assert list(own.handleExpiredTimer(("k",), None, FakeTimer(105)))[0].iloc[0]["op"] == "EXPIRE"
    assert list(own.handleExpiredTimer(("k",), None, FakeTimer(105))) == []


def test_foreach_batch_checkpoints(spark, tmp_path):
    spark.createDataFrame(ROWS, KV_LOG).write.parquet(f"{tmp_path}/log")
    table, times = oplog.DurableTable(spark, f"{tmp_path}/table"), iter([0, 3_600_000, 3_600_001])
    write = apply.checkpoint_each(table, lambda: next(times))
    apply.stream_log(spark, f"{tmp_path}/log", KV_LOG).writeStream.foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    assert table.meta().count() == 1 and table.recover()[1] == 60


def test_engine_contract(spark):
    engine = Engine(spark, clock=lambda: 1000)

    def call(name, **arguments):
        return dispatch(engine, json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": arguments}}))

    result = lambda r: json.loads(r["result"]["content"][0]["text"])
    assert result(call("kv_set", key="a", value="1")) == {"success": True} and result(call("kv_get", key="a"))["value"] == "1"
    assert call("kv_get", key="none")["result"]["isError"] and not call("kv_delete", key="a")["result"]["isError"]
    call("vector_insert", key="m1", text="the quick brown fox")
    call("vector_insert", key="m2", text="stocks and bonds")
    assert result(call("vector_search", query="quick fox", top_k=1))["results"][0]["key"] == "m1"
    assert result(call("memory_recall", key="zz", query="bonds"))["source"] == "semantic" and call("memory_recall")["result"]["isError"]
    for node in ("n1", "n2"):
        call("graph_add_node", node_id=node, text="node " + node)
    call("graph_add_edge", src_id="n1", dst_id="n2", label="to")
    assert result(call("graph_rag_query", query="node n1", vector_top_k=1, hop_depth=1))["count"] == 2
    assert dispatch(engine, "{")["error"]["code"] == -32700 and dispatch(engine, '{"id":1,"method":"x"}')["error"]["code"] == -32601
    assert call("nope")["error"]["code"] == -32602 and call("kv_set", key="a")["error"]["code"] == -32602
    assert len(dispatch(engine, '{"id":1,"method":"tools/list"}')["result"]["tools"]) == 9 and engine.health() == {"status": "ok"}
    assert abs(sum(x * x for x in hash_embedder()("some words")) - 1) < 1e-9


def test_bench_csv(spark, tmp_path):
    (tmp_path / "r.csv").write_text("# made by a test\nTest,WorkloadType,Threads,TotalOps,Duration(ms),QPS,AvgLatency(us),P50(us),P95(us),P99(us),HitRate(%),PreloadCount,KeyRange,Shards,WAL\nx,mixed,4,100,1.5,66.6,1,2,3,4,50,1,2,3,off\n")
    rows = bench_csv.read(spark, str(tmp_path / "r.csv"))
    assert rows.count() == 1 and rows.first()["Threads"] == 4
    bench_csv.write(rows, str(tmp_path / "out"))
    assert bench_csv.read(spark, str(tmp_path / "out")).collect() == rows.collect()


def test_registry():
    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert sql.keys() <= found.keys() and len(sql) >= 60


def test_streamed_state_honours_clear(spark, tmp_path):
    rows = [(1, 0, "PUT", "a", "1", 0), (2, 0, "PUT", "b", "2", 0), (3, 0, "CLEAR", "", None, 0), (4, 0, "PUT", "b", "3", 0), (5, 0, "DELETE", "c", None, 0)]
    spark.createDataFrame(rows, KV_LOG).repartition(3).write.parquet(f"{tmp_path}/log")
    table = apply.drained(apply.latest(apply.stream_log(spark, f"{tmp_path}/log", KV_LOG)), f"t{uuid.uuid4().hex}")
    assert [(r["key"], r["value"]) for r in apply.current(table).collect()] == [("b", "3")]
