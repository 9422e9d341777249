"""The engine's operators against plain Python models and fixed fixtures."""

import math
import random
from collections import OrderedDict, deque

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorekeep.functions import checksum, codec, keys, resp
from lorekeep.functions import vectors as V
from lorekeep.operators import graph as G
from lorekeep.operators import kv, lru, rag, similar, stats, ttl
from lorekeep.schemas import KV_LOG
from lorekeep.sources import group_commit, oplog

IDS = st.text(alphabet="ab:\\é", max_size=6)


def log_of(spark, ops):
    """(op, key, value, ttl, at) in order."""
    return spark.createDataFrame([(i + 1, at, op, key, value, t) for i, (op, key, value, t, at) in enumerate(ops)], KV_LOG)


def put(key, value="v", ttl_ms=0, at=0):
    return "PUT", key, value, ttl_ms, at


def read(key, at=0):
    return "GET", key, None, 0, at


def random_log(seed, n=400, n_keys=12):
    r, at, ops = random.Random(seed), 0, []
    for _ in range(n):
        at += r.choice([1, 5, 400, 1500])
        kind = r.random()
        key = f"k{r.randrange(n_keys)}"
        ops.append(put(key, f"v{r.randrange(9)}", r.choice([0, 0, 2000, 50]), at) if kind < 0.5 else read(key, at) if kind < 0.9 else ("DELETE", key, None, 0, at))
    return ops


def test_state_is_the_fold_of_the_log(spark):
    ops = random_log(1)
    want = {}
    for i, (op, key, value, t, at) in enumerate(ops):
        if op == "PUT":
            want[key] = (value, at + t if t else 0, i + 1)
        elif op == "DELETE":
            want.pop(key, None)
    table = kv.KVTable(log_of(spark, ops))
    assert {r["key"]: (r["value"], r["expiry_ms"], r["lsn"]) for r in table.state().collect()} == want
    now = ops[-1][4]
    alive = sorted((k, v[0]) for k, v in want.items() if not v[1] or now <= v[1])
    assert [tuple(r) for r in table.export(now).collect()] == alive
    assert table.size() == len(want) and table.prefix("k1", now).count() == sum(k.startswith("k1") for k, _ in alive)


def test_kv_table_operations(spark):
    t = kv.KVTable.empty(spark).put("a", "1", now_ms=5).put("b", "2", 100, 5)
    assert (t.get("a", 9), t.get("b", 105), t.get("b", 106), t.get("c", 9)) == ("1", "2", None, None)
    t, new = t.update("a", lambda old: str(int(old or 0) + 1), 6)
    t, there = t.remove("b", 200)  # expired but still there
    assert new == "2" and t.get("a") == "2" and there and not t.remove("zzz")[1]
    assert t.clear().put("x", "9").state().count() == 1 and t.state(as_of_lsn=1).count() == 1
    assert kv.fold(t.log, lambda p: p.tail(1)[["key", "value"]], "key string, value string").where("key = 'a'").first()["value"] == "2"


def test_as_of_join(spark):
    log = log_of(spark, [put("a", "1"), put("a", "2"), ("DELETE", "a", None, 0, 0), put("b", "3")])
    asked = spark.createDataFrame([(0, "a", 1), (1, "a", 2), (2, "a", 9), (3, "b", 3), (4, "b", 4), (5, "c", 4)], "lookup_id long, key string, lsn long")
    assert {r["lookup_id"]: r["value"] for r in kv.as_of(asked, log).collect()} == {0: "1", 1: "2", 2: None, 3: None, 4: "3", 5: None}


def test_expiry_bounds_and_sweep(spark):
    ops = [put(f"key{i}", "v", 100 if i < 50 else 0, 0) for i in range(100)]
    state = kv.state(log_of(spark, ops), shards=4)
    kept, removed = ttl.sweep(state, 150)
    assert kept.count() == 50 and removed.agg(F.sum("removed")).first()[0] == 50
    assert ttl.sweep(state, 100)[0].count() == 100  # the last millisecond lives
    one = ttl.sweep(state, 150, shard=0)
    assert one[1].count() == 1 and one[0].count() == 100 - one[1].first()["removed"]
    assert ttl.sample_keys(state, 7, 1).count() == 7
    for bad in ((None, 1, 1, 1), (print, 0, 1, 1), (print, 1, 0, 1), (print, 1, 1, 0)):
        with pytest.raises(ValueError):
            ttl.check_parameters(*bad)


def model_cache(ops, capacity):
    cache, n, peak = OrderedDict(), dict.fromkeys(("hits", "misses", "expired", "evictions", "puts", "removes"), 0), 0
    for op, key, _, t, at in ops:
        e = cache.get(key)
        if op == "GET":
            if e and e[0] and at > e[0]:
                del cache[key]
                n["expired"] += 1
                e = None
            n["hits" if e else "misses"] += 1
            if e and at - e[1] > 1000:
                e[1] = at
                cache.move_to_end(key)
        elif op == "PUT":
            n["puts"] += 1
            if e:
                e[0] = at + t if t else 0
                cache.move_to_end(key)
            else:
                if len(cache) >= capacity:
                    cache.popitem(last=False)
                    n["evictions"] += 1
                cache[key] = [at + t if t else 0, 0]
                peak = max(peak, len(cache))
        elif e:
            del cache[key]
            n["removes"] += 1
    return {**n, "size": len(cache), "peak_size": peak}, set(cache)


def test_cache_stats_equal_a_model_without_bounds(spark):
    ops = random_log(2)
    want, _ = model_cache(ops, 10**9)
    s = stats.cache_stats(log_of(spark, ops), 100).first()
    assert {k: s[k] for k in ("hits", "misses", "expired", "puts", "removes", "size")} == {k: want[k] for k in ("hits", "misses", "expired", "puts", "removes", "size")}
    assert s["hit_rate"] == pytest.approx(want["hits"] / (want["hits"] + want["misses"]))
    assert stats.peak_size(log_of(spark, ops)).first()[0] == want["peak_size"]


@pytest.mark.parametrize("seed", [3, 4])
def test_lru_simulation_equals_a_model(spark, seed):
    ops = random_log(seed)
    row = lru.simulate(log_of(spark, ops), 5, 1).first()
    want, _ = model_cache(ops, 5)
    assert {k: row[k] for k in want} == want


def test_resident_keys_of_puts(spark):
    ops = [o for o in random_log(5) if o[0] == "PUT"]
    _, left = model_cache(ops, 5)
    assert {r["key"] for r in lru.resident_put_only(log_of(spark, ops), 5, 1).collect()} == left


def test_eviction_order_and_counters(spark):
    ops = [put("key1"), read("key1", 1), put("key2", at=2), put("key3", at=3), read("key1", 4), read("key2", 5), put("key4", at=6), read("key3", 7)]
    ops = [(*o[:4], 10**12 + o[4]) for o in ops]  # a clock far from 0: the first hit always promotes
    r = lru.simulate(log_of(spark, ops), 2, 1).first()
    assert (r["hits"], r["misses"], r["evictions"]) == (2, 2, 2)
    ops = [put(str(i)) for i in range(5)] + [read(str(i)) for i in range(5)]
    r = lru.simulate(log_of(spark, ops), 3, 1).first()
    assert (r["evictions"], r["hits"], r["misses"]) == (2, 3, 2)


def test_durable_table(spark, tmp_path):
    t = oplog.DurableTable(spark, str(tmp_path))
    first = log_of(spark, [put(f"k{i:02}", f"välue:{i}", 5000 if i % 2 else 0, i) for i in range(50)])
    t.append(first)
    assert t.checkpoint(1) == 50 and t.read_log().count() == 0
    second = log_of(spark, [put(f"n{i:02}", "", 0, 99) for i in range(49)] + [("DELETE", "k00", None, 0, 99)]).withColumn("lsn", F.col("lsn") + 50)
    t.append(second)
    state, lsn = t.recover()
    rows = {r["key"]: r for r in state.collect()}
    assert lsn == 100 and len(rows) == 98 and rows["k01"]["expiry_ms"] == 5001 and rows["n00"]["value"] == "" and rows["k01"]["value"] == "välue:1"
    assert t.recover("drop")[0].where("expiry_ms > 0").count() == 0
    for lsn in range(101, 105):
        t.append(log_of(spark, [put("z", str(lsn))]).withColumn("lsn", F.lit(lsn).cast("long")))
        assert t.checkpoint(2) == lsn
    assert sorted(int(p.name[4:]) for p in (tmp_path / "snapshots").iterdir()) == [102, 103, 104]
    assert {r["key"]: r["value"] for r in t.recover()[0].collect()}["z"] == "104"


def test_log_prefix_tail_and_numbers(spark):
    log = oplog.with_checksum(log_of(spark, [put(f"k{i}") for i in range(9)]))
    assert oplog.valid_prefix(log.withColumn("checksum", F.when(F.col("lsn").isin(5, 7), 0).otherwise(F.col("checksum")))).count() == 4
    assert [r["lsn"] for r in oplog.tail(log, 6).collect()] == [7, 8, 9]
    ops = spark.createDataFrame([(5, 1, "a"), (3, 0, "b"), (5, 0, "c")], "ts_ms long, seq long, key string")
    assert [r["key"] for r in oplog.with_lsn(ops, 10).orderBy("lsn").collect()] == ["b", "c", "a"]
    assert oplog.should_checkpoint(60, 0) and oplog.should_checkpoint(0, 64 << 20) and not oplog.should_checkpoint(59, 1)
    kept = {r["snapshot_lsn"]: r["kept"] for r in oplog.rotation(spark.createDataFrame([(9,), (10,), (100,), (11,)], "snapshot_lsn long")).collect()}
    assert kept == {9: False, 10: True, 100: True, 11: True}  # by number, not by name


def test_checksum(spark):
    texts = ["", "a", "key:1value", "é日🙂", "x" * 300]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(checksum.polynomial(F.col("t"))).collect()]
    for t, g in zip(texts, got, strict=True):
        h = 0
        for b in t.encode():
            h = (h * 31 + b) % 2**32
        assert g == h


def test_group_commit(spark):
    rows = [(1, i, i, 29, False) for i in range(1000)]
    d = spark.createDataFrame(rows, "stream long, req_id long, ts_ms long, bytes long, sync boolean")
    b = group_commit.batches(d, 4096, 10**9).groupBy("batch").agg(F.sum("bytes").alias("n"), F.count("*").alias("commits")).collect()
    assert len(b) == math.ceil(1000 / math.ceil(4096 / 29)) and sum(x["commits"] for x in b) == 1000
    old = group_commit.batches(d.limit(30), 10**9, 10).groupBy("batch").count().collect()
    assert sorted(r["count"] for r in old) == [10, 10, 10]
    sync = group_commit.batches(d.limit(3).withColumn("sync", F.lit(True))).select("batch").distinct().count()
    assert sync == 3


@settings(max_examples=200, deadline=None)
@given(IDS, IDS, IDS, st.floats(width=32, allow_nan=False, allow_infinity=False))
def test_codecs_round_trip(a, b, c, w):
    assert codec.unpack_edge(codec.pack_edge(a, b, c, w, "{}")) == (a, b, c, w, "{}")
    assert codec.unpack(codec.pack_node(a, b)) == [a, b]
    raw = codec.pack(a, b)
    if len(raw) > 8:
        with pytest.raises(ValueError):
            codec.unpack(raw[:-1])
    assert V.from_bytes(V.to_bytes([w])) == [w] and V.from_bytes(b"abc") is None


def test_keys_round_trip(spark):
    ids = ["a", "a:b", "a\\", "a\\:b", ":", "\\", "é", "a\\\\b:"]
    d = spark.createDataFrame([(x, y) for x in ids for y in ids], "x string, y string")
    out = d.select("x", "y", keys.edge_key(F.col("x"), F.col("y"), F.lit("L:1")).alias("k")).withColumn("s", keys.segments(F.col("k"))).collect()
    assert all(r["s"] == ["e", r["x"], r["y"], "L:1"] for r in out) and len({r["k"] for r in out}) == len(out)
    assert d.select(keys.unescape(keys.escape(F.col("x"))) == F.col("x")).distinct().collect() == [(True,)]


def test_resp():
    assert resp.parse(b"*3\r\n$3\r\nSET\r\n$3\r\nkey\r\n$5\r\nvalue\r\n*1\r\n") == ["SET", "key", "value"]
    for bad in (b"*2\r\n$3\r\nGET\r\n$3\r\nke", b"", None, b"+OK\r\n", b"*1\r\n$-1\r\n", b"*x\r\n", b"*1\r\n$3\r\nabcd\r\n"):
        assert resp.parse(bad) is None
    assert resp.parse(b"*0\r\n") == []


def test_resp_replies(spark):
    r = spark.createDataFrame([("hello", None)], "a string, b string").select(resp.simple(F.lit("OK")), resp.bulk(F.col("a")), resp.bulk(F.col("b")), resp.error(F.lit("ERR x"))).first()
    assert tuple(r) == ("+OK\r\n", "$5\r\nhello\r\n", "$-1\r\n", "-ERR x\r\n")


def vector_table(spark, rows):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in rows], "key string, embedding array<float>")


def test_vector_metrics_and_search(spark):
    t = vector_table(spark, [("vec1", [1, 2, 3, 4]), ("vec2", [2, 3, 4, 5]), ("vec3", [10, 20, 30, 40]), ("short", [1, 2]), ("none", []), ("zero", [0, 0, 0, 0])])
    q = [1.5, 2.5, 3.5, 4.5]
    assert [(r["key"], r["score"]) for r in similar.top_k(t, q, 2).collect()] == [("vec1", 1.0), ("vec2", 1.0)]
    assert similar.top_k(t, q, 0).count() == 0 and similar.top_k(t, [], 3).count() == 0
    cos = {r["key"]: r["score"] for r in similar.top_k(t, q, 9, "cosine").collect()}
    assert cos["zero"] == 0 and len(cos) == 4
    assert [r["key"] for r in similar.top_k(t, q, 1, "dot").collect()] == ["vec3"]
    assert (V.parse_metric("COSINE"), V.parse_metric("euclidean"), V.parse_metric("?")) == ("cosine", "l2", "l2")
    assert similar.get(t, "vec1") == [1, 2, 3, 4] and similar.get(t, "nope") == []


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_batched_search_equals_single(spark, metric):
    r = random.Random(6)
    t = vector_table(spark, [(f"v{i}", [r.uniform(-1, 1) for _ in range(8)]) for i in range(300)]).repartition(5)
    qs = {i: [r.uniform(-1, 1) for _ in range(8)] for i in range(4)}
    got = similar.top_k_batch(t, qs, 7, metric).orderBy("qid", "rank").collect()
    for i, q in qs.items():
        want = similar.top_k(t, q, 7, metric).collect()
        own = [x for x in got if x["qid"] == i]
        assert [x["key"] for x in own] == [x["key"] for x in want]
        assert all(abs(x["score"] - y["score"]) < 1e-6 for x, y in zip(own, want, strict=True))


def test_vector_index_and_validity(spark):
    index = similar.VectorIndex(spark.createDataFrame([], similar.VectorIndex.SCHEMA)).insert("user:123", [1, 2]).insert("doc:789", [3, 4])
    with pytest.raises(ValueError):
        index.insert("x", [1, 2, 3])
    assert [r["key"] for r in index.list_keys("user:").collect()] == ["user:123"] and index.size() == 2
    assert index.remove("user:123").remove("doc:789").insert("x", [1, 2, 3]).dimension() == 3
    rows = [("ok", [1.0]), ("empty", []), ("nan", [float("nan")]), ("inf", [float("inf")])]
    got = {r["key"]: r["valid"] for r in vector_table(spark, rows).select("key", V.is_valid(F.col("embedding")).alias("valid")).collect()}
    assert got == {"ok": True, "empty": False, "nan": False, "inf": False}


def test_graph_changes(spark):
    g = G.Graph.empty(spark).add_nodes([("alice", "{}"), ("bob", "{}"), ("charlie", "{}"), ("a:b", "{}"), ("a", "{}")])
    g = g.add_edges([("alice", "bob", "KNOWS", 0.9), ("bob", "charlie", "KNOWS"), ("alice", "bob", "LIKES"), ("a:b", "a", "TYPE:A")])
    g = g.add_edges([("alice", "bob", "KNOWS", 0.5)])
    assert g.get_edge("alice", "bob", "KNOWS")["weight"] == 0.5 and g.out("alice") == ["bob"] and g.into("a") == ["a:b"]
    one = g.delete_edge("alice", "bob", "KNOWS")
    assert one.out("alice") == ["bob"] and one.delete_edge("alice", "bob", "NONE").out("alice") == ["bob"]
    assert one.delete_edge("alice", "bob", "LIKES").out("alice") == []
    gone = g.set_vectors([("bob", [1, 0])]).delete_node("bob")
    assert gone.out("alice") == [] and gone.into("charlie") == [] and gone.get_vector("bob") == [] and gone.get_node("bob") is None
    assert gone.get_edge("a:b", "a", "TYPE:A") is not None and g.update_nodes([("a", "new")]).get_node("a") == "new"


def model_path(edges, src, dst, most=None):
    out = {}
    for s, d, *_ in edges:
        if d not in out.setdefault(s, []):
            out[s].append(d)
    if src == dst:
        return [src]
    seen, queue = {src: [src]}, deque([src])
    while queue:
        n = queue.popleft()
        if most is not None and len(seen[n]) - 1 >= most:
            continue
        for m in out.get(n, []):
            if m not in seen:
                seen[m] = [*seen[n], m]
                if m == dst:
                    return seen[m]
                queue.append(m)
    return []


def test_walks_equal_models(spark):
    r = random.Random(8)
    rows = [(f"n{r.randrange(25)}", f"n{r.randrange(25)}", r.choice("xy")) for _ in range(60)]
    g = G.Graph.empty(spark).add_edges(rows)
    unique = list(dict.fromkeys(rows))
    for src, dst in (("n0", "n7"), ("n3", "n3"), ("n5", "zz"), ("n1", "n20"), ("zz", "zz")):
        assert g.path(src, dst) == model_path(unique, src, dst)
    assert g.path("n1", "n20", 1) == model_path(unique, "n1", "n20", 1)
    hops = {n: len(p) - 1 for n in {d for _, d, _ in rows} if n != "n0" and (p := model_path(unique, "n0", n))}
    assert g.k_hop("n0", 3) == {n: h for n, h in hops.items() if h <= 3} and g.k_hop("n0", 0) == {} and g.k_hop("none", 2) == {}


def test_retrieval_reaches_nodes_without_vectors(spark):
    g = G.Graph.empty(spark).add_nodes([("Elon_Musk", "{}"), ("SpaceX", "{}"), ("Starship", "{}")]).add_edges([("Elon_Musk", "SpaceX", "founded"), ("SpaceX", "Starship", "product"), ("SpaceX", "ghost", "x")])
    g = g.set_vectors([("Elon_Musk", [1, 0, 0]), ("SpaceX", [0.8, 0.6, 0])])
    ids = lambda d: {r["node_id"] for r in d.collect()}
    q = [1.0, 0.0, 0.0]
    assert ids(rag.graph_rag(g, q, 1, 1)) == {"Elon_Musk", "SpaceX"} and ids(rag.graph_rag(g, q, 1, 2)) == {"Elon_Musk", "SpaceX", "Starship"}
    assert ids(rag.graph_rag(g, q, 1, 0)) == {"Elon_Musk"} and ids(rag.graph_rag(g, [], 3, 2)) == set() and ids(rag.graph_rag_batch(g, [], 3, 2)) == set()
    assert ids(rag.graph_rag_batch(g, [q, [0.0, 1.0, 0.0]], 1, 1)) == {"Elon_Musk", "SpaceX", "Starship"}
    found = spark.createDataFrame([("a", "x"), ("a", "x")], "query string, node_id string")
    expected = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "query string, node_id string")
    assert {r["query"]: r["recall"] for r in rag.recall(found, expected).collect()} == {"a": 0.5, "b": 0.0}


def test_percentiles_running_totals_health(spark):
    r = random.Random(9)
    values = [(f"g{i % 2}", r.randrange(40)) for i in range(201)]
    got = {x["g"]: x for x in stats.percentiles(spark.createDataFrame(values, "g string, v int"), "g", "v").collect()}
    for g in ("g0", "g1"):
        own = sorted(v for k, v in values if k == g)
        assert [got[g][f"p{p}"] for p in (50, 95, 99)] == [own[len(own) * p // 100] for p in (50, 95, 99)]
    deltas = [(i * 7, r.choice([-1, 1])) for i in range(100)]
    rows = stats.running_total(spark.createDataFrame(deltas, "o long, d int"), "o", "d", 9).orderBy("o").collect()
    assert [x["total"] for x in rows] == [sum(d for _, d in deltas[: i + 1]) for i in range(100)]
    o = spark.createDataFrame([(1, i, f) for i, f in enumerate([True] * 5 + [False] + [True] * 2)] + [(2, 1, True)], "group_id int, lsn long, failed boolean")
    assert sorted(x["run"] for x in G.error_runs(o).collect()) == [1, 2, 5]
    u = stats.uniformity(spark.createDataFrame([(10,), (10,), (13,), (7,)], "n long")).first()
    assert u["mean"] == 10 and u["chi_square"] == pytest.approx(1.8) and u["chi_passes"] and u["spread"] == 6


def test_shortest_path_length_has_no_cap(spark, monkeypatch):
    from lorekeep.plans import catalogue

    chain = [(f"n{i}", f"n{i + 1}", "follows") for i in range(14)]
    g = G.Graph.empty(spark).add_edges(chain)
    monkeypatch.setattr(catalogue.derive, "edges", lambda *_: g.edges)
    row = catalogue.QUERIES["graph_shortest_path_len"](spark, "").first()
    assert tuple(row) == ("n0", "n14", len(model_path(chain, "n0", "n14")) - 1) == ("n0", "n14", 14)


def durable(spark, tmp_path, *batches):
    """A durable table of batches of puts, with a checkpoint after each but the last."""
    t, lsn = oplog.DurableTable(spark, str(tmp_path)), 0
    for i, keys_ in enumerate(batches):
        rows = [(lsn + 1 + k, 0, "PUT", key, f"{key}{i}", 0) for k, key in enumerate(keys_)]
        lsn += len(rows)
        t.append(spark.createDataFrame(rows, KV_LOG))
        if i < len(batches) - 1:
            assert t.checkpoint(i + 1) == lsn
    return t


def test_recovery_with_a_bad_newest_header_loses_nothing(spark, tmp_path):
    t = durable(spark, tmp_path, ["a"], ["b"], ["c"])
    bad = spark.createDataFrame([(3, 99, 5, 1, -1)], "snapshot_lsn long, record_count long, created_ms long, version int, checksum long")
    bad.write.mode("append").parquet(f"{tmp_path}/meta")
    state, lsn = t.recover()
    assert (lsn, {r["key"]: r["value"] for r in state.collect()}) == (3, {"a": "a0", "b": "b1", "c": "c2"})


def test_recovery_computes_checksums_once(spark, tmp_path):
    """What is read of the log holds no checksum any more, and a wrong one still ends it."""
    t = oplog.DurableTable(spark, str(tmp_path))
    rows = [(i, i, "PUT", f"k{i}", v, 0) for i, v in enumerate(["", None, "a\x00b", "日本🙂 é\xa0\x85", "x" * 500], 1)]
    t.append(spark.createDataFrame(rows, "lsn long, ts_ms long, op string, key string, value string, ttl_ms long"))
    log = t.read_log()
    assert "aggregate(" not in log._jdf.queryExecution().optimizedPlan().toString() and log.count() == 5
    for r in log.collect():
        want = 0
        for b in (r["key"] + (r["value"] or "")).encode():
            want = (want * 31 + b) % (1 << 32)
        assert r["checksum"] == want
    bad = [(6, 6, "PUT", "k6", "v", 0, 1), (7, 7, "PUT", "k7", "v", 0, 2)]
    spark.createDataFrame(bad, "lsn long, ts_ms long, op string, key string, value string, ttl_ms long, checksum long").write.parquet(f"{tmp_path}/log/first=6/last=7")
    assert t.read_log().count() == 5 and t.recover()[1] == 5


def test_recovery_falls_back_to_an_older_snapshot_and_the_log_after_it(spark, tmp_path):
    t = durable(spark, tmp_path, ["a", "x"], ["b", "x"], ["c"])
    spark.createDataFrame([(0, 0, "odd", "v")], "put_ms long, expiry_ms long, key string, value string").write.mode("append").parquet(f"{tmp_path}/snapshots/lsn=4")
    state, lsn = t.recover()  # snapshot 4 has one record too many
    assert (lsn, {r["key"]: r["value"] for r in state.collect()}) == (5, {"a": "a0", "b": "b1", "c": "c2", "x": "x1"})


def test_checkpoints_delete_log_segments_and_old_snapshots(spark, tmp_path):
    t = durable(spark, tmp_path, ["a"], ["b"], ["c"], ["d"], ["e"], ["f"])
    assert t.segments() == [(4, 4), (5, 5), (6, 6)] and not t.exists("snapshots/lsn=2") and t.exists("snapshots/lsn=3")
    assert {r["key"] for r in t.recover()[0].collect()} == set("abcdef") and t.read_log().count() == 1
    assert t.clear_log(5) == [(4, 4), (5, 5)] and {r["key"] for r in t.recover()[0].collect()} == set("abcdef")


def test_clear_ends_entries_for_every_reader(spark):
    clear = ("CLEAR", "", None, 0, 0)
    ops = [put("a", "1"), put("b", "2"), read("a"), clear, read("a"), put("a", "3"), read("a"), ("DELETE", "b", None, 0, 0), clear, read("a"), put("c"), put("c", "5")]
    log = log_of(spark, ops)
    row = stats.cache_stats(log, 10).first()
    assert (row["hits"], row["misses"], row["puts"], row["removes"], row["size"]) == (2, 2, 5, 0, 1)
    assert stats.peak_size(log).first()[0] == 2
    sims = lru.simulate(log, 10, 4)
    total = sims.agg(*[F.sum(c).alias(c) for c in ("hits", "misses", "puts", "removes", "size")]).first()
    assert tuple(total) == (2, 2, 5, 0, 1)
    asked = spark.createDataFrame([(i, "a", lsn) for i, lsn in enumerate((3, 4, 5, 6, 8, 9, 12))], "lookup_id long, key string, lsn long")
    assert [r["value"] for r in kv.as_of(asked, log).orderBy("lookup_id").collect()] == ["1", None, None, "3", "3", None, None]
    assert {r["key"]: r["counter"] for r in kv.counters(log).collect()} == {"c": 2}
    assert {r["key"]: r["items"] for r in kv.appended_lists(log).collect()} == {"c": ["v", "5"]}


def test_appended_lists_start_anew_after_a_removal(spark):
    log = log_of(spark, [put("k", "x"), put("k", "z"), ("DELETE", "k", None, 0, 0), put("k", "y"), put("k", "x"), put("k", "y"), put("j", "x")])
    assert {r["key"]: r["items"] for r in kv.appended_lists(log).collect()} == {"k": ["y", "x"], "j": ["x"]}


def test_near_numbers(spark):
    rows = [(1.0, 1.00005, True), (1.0, 1.0002, False), (1e6, 1e6 + 90, True), (1e6, 1e6 + 200, False), (0.0, -0.00009, True), (math.nan, math.nan, False), (math.nan, 1.0, False), (math.inf, math.inf, True), (math.inf, 5.0, False), (math.inf, -math.inf, False), (None, 1.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, want boolean")
    assert df.where(~V.approx_equal(F.col("a"), F.col("b")).eqNullSafe(F.col("want"))).collect() == []


@pytest.mark.parametrize("seed", [3, 4])
def test_sweep_rounds_against_a_loop(spark, seed):
    r, shards, interval = random.Random(seed), 3, 700
    ops = random_log(seed)
    ops.insert(200, ("CLEAR", None, None, 0, ops[199][4]))
    log = log_of(spark, ops)
    keys_of = {x["key"]: x["s"] for x in log.where("key IS NOT NULL").select("key", keys.shard(F.col("key"), shards).alias("s")).distinct().collect()}
    start, last = ops[0][4], ops[-1][4]
    rounds = (last - start) // interval
    busy = {(i, s) for i in range(1, rounds + 1) for s in range(shards) if r.random() < 0.5}
    busy -= {(rounds, s) for s in range(shards)}
    held, at, want = {}, 0, []
    for i in range(1, rounds + 1):
        now = start + i * interval
        while at < len(ops) and ops[at][4] <= now:
            op, key, _, t, when = ops[at]
            if op == "PUT":
                held[key] = when + t if t else 0
            elif op == "CLEAR":
                held.clear()
            elif op == "DELETE" or held.get(key) and when > held[key]:
                held.pop(key, None)
            at += 1
        dead = [k for k, e in held.items() if e and now > e and (i, keys_of[k]) not in busy]
        for k in dead:
            del held[k]
        want.append((i, len(dead), sum((i, s) in busy for s in range(shards))))
    got = ttl.sweep_rounds(log, spark.createDataFrame(sorted(busy), "round long, shard int"), shards, interval).orderBy("round").collect()
    assert [tuple(x) for x in got] == want
    assert sum(x[1] for x in want) > 5 and rounds > 20


def test_counters_after_a_reset_keep_the_data(spark):
    ops = [put("a"), put("b", ttl_ms=10), read("a", 1), read("c", 2), put("a", at=3), read("a", 4), read("b", 20), read("b", 21), ("DELETE", "a", None, 0, 22), ("DELETE", "a", None, 0, 23)]
    one = stats.counters_since(log_of(spark, ops), 4).first().asDict()
    assert one == {"hits": 1, "misses": 2, "puts": 1, "last_hit_ms": 4, "last_miss_ms": 21, "last_access_ms": 21, "expired": 1, "removes": 1}
    none = stats.counters_since(log_of(spark, ops), 99).first().asDict()
    assert none == {"hits": 0, "misses": 0, "puts": 0, "last_hit_ms": None, "last_miss_ms": None, "last_access_ms": None, "expired": 0, "removes": 0}


def test_counters_by_shard_add_up(spark):
    log = log_of(spark, random_log(6))
    parts = stats.counters_by_shard(log, 4, 25).collect()
    whole = stats.cache_stats(log, 100).first()
    for c in ("hits", "misses", "expired", "puts", "removes", "size"):
        assert sum(p[c] for p in parts) == whole[c]
    assert {p["total_capacity"] for p in parts} == {100} and len(parts) > 1
