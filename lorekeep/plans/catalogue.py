"""The registered queries of the engine and the SQL that each is held against.

Every query runs over its whole tables. Constants: the clock of a query is its log's last time, capacities and shard
counts are parameters of the cache.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import checksum, codec, keys, resp
from lorekeep.functions import vectors as V
from lorekeep.operators import graph as G
from lorekeep.operators import kv, lru, rag, similar, stats, ttl
from lorekeep.sources import group_commit, oplog, tables
from lorekeep.streaming import apply

from . import derive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SHARDS, CAPACITY = 32, 4


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


LOG = """log AS (
  SELECT event_id + 1 AS lsn, epoch_us(ts) // 1000 AS ts_ms, CASE event_type WHEN 'view' THEN 'GET' WHEN 'error' THEN 'DELETE' ELSE 'PUT' END AS op,
         'user_' || user_id AS key, props AS value, CASE WHEN event_type = 'click' THEN 3600000 ELSE 0 END::BIGINT AS ttl_ms
  FROM events
)"""
STATE = f"""{LOG}, latest AS (
  SELECT key, arg_max(op, lsn) AS op, arg_max(value, lsn) AS value, arg_max(ts_ms, lsn) AS put_ms,
         arg_max(CASE WHEN ttl_ms > 0 THEN ts_ms + ttl_ms ELSE 0 END, lsn) AS expiry_ms, max(lsn) AS lsn
  FROM log WHERE op <> 'GET' GROUP BY key
), state AS (SELECT * EXCLUDE (op) FROM latest WHERE op = 'PUT'), clock AS (SELECT max(ts_ms) AS now_ms FROM log)"""
LIVE = "(expiry_ms = 0 OR now_ms <= expiry_ms)"
SHARD = "(('0x' || substr(md5(key), 1, 8))::BIGINT % 32)::INTEGER"


def clock(log: DataFrame) -> int:
    return log.agg(F.max("ts_ms")).first()[0] or 0


# Key-value operators.


@query(f"WITH {STATE} SELECT key, value, put_ms, expiry_ms, lsn, {SHARD} AS shard FROM state")
def kv_state_latest(spark, d):
    return kv.state(derive.log(spark, d))


READS = """numbered AS (
  SELECT *, sum(CASE WHEN op <> 'GET' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY lsn ROWS UNBOUNDED PRECEDING) AS write_no FROM log
), writes AS (
  SELECT key, write_no, op AS w_op, lsn AS w_lsn, CASE WHEN ttl_ms > 0 THEN ts_ms + ttl_ms ELSE 0 END AS expiry_ms FROM numbered WHERE op <> 'GET'
), reads AS (
  SELECT n.key, n.write_no, n.lsn, n.ts_ms, coalesce(w_op, '') = 'PUT' AS there, coalesce(w_op, '') = 'PUT' AND expiry_ms > 0 AND n.ts_ms > expiry_ms AS late
  FROM numbered n LEFT JOIN writes w ON n.key = w.key AND n.write_no = w.write_no WHERE n.op = 'GET'
), epochs AS (
  SELECT key, write_no, w_op AS op, w_lsn AS lsn, coalesce(hits, 0) AS hits, coalesce(late, 0) AS late, coalesce(misses, 0) AS misses, first_late
  FROM (SELECT key, write_no, count(*) FILTER (there AND NOT late) AS hits, count(*) FILTER (late) AS late, count(*) FILTER (NOT there OR late) AS misses, min(lsn) FILTER (late) AS first_late
        FROM reads GROUP BY ALL) r FULL JOIN writes w USING (key, write_no)
), told AS (
  SELECT *, coalesce(lag(op) OVER k = 'PUT' AND lag(late) OVER k = 0, false) AS was FROM epochs WINDOW k AS (PARTITION BY key ORDER BY write_no)
)"""


@query(f"WITH {LOG}, {READS} SELECT key, write_no::BIGINT AS write_no, op, lsn, hits::BIGINT AS hits, late::BIGINT AS late, misses::BIGINT AS misses FROM epochs")
def kv_get_hit_miss_expired(spark, d):
    return ttl.epochs(derive.log(spark, d)).select("key", "write_no", "op", "lsn", "hits", "late", "misses")


@query(f"WITH {STATE} SELECT count(*) AS physical, count(*) FILTER ({LIVE}) AS live FROM state, clock")
def kv_size_physical_vs_live(spark, d):
    log = derive.log(spark, d)
    return kv.state(log).agg(F.count("*").alias("physical"), F.count_if(kv.live(clock(log))).alias("live"))


@query(f"WITH {STATE} SELECT key, value FROM state, clock WHERE {LIVE} ORDER BY key")
def kv_export_sorted(spark, d):
    log = derive.log(spark, d)
    return kv.KVTable(log).export(clock(log))


@query(f"WITH {STATE} SELECT key, value, lsn FROM state, clock WHERE {LIVE} AND starts_with(key, 'user_1')")
def kv_prefix_scan(spark, d):
    log = derive.log(spark, d)
    return kv.KVTable(log).prefix("user_1", clock(log)).select("key", "value", "lsn")


@query(f"WITH {STATE} SELECT {SHARD} AS shard, count(*) AS n FROM state GROUP BY 1")
def kv_shard_distribution(spark, d):
    return kv.state(derive.log(spark, d)).groupBy("shard").agg(F.count("*").alias("n"))


COUNTS = "counts AS (SELECT (('0x' || substr(md5(c_custkey::VARCHAR), 1, 8))::BIGINT % 32) AS shard, count(*) AS n FROM customer GROUP BY 1)"


@query(f"""WITH {COUNTS}, base AS (
  SELECT count(*) AS shards, avg(n) AS mean, stddev_pop(n) AS stddev, max(n) AS most, min(n) AS least, sum((n - m) * (n - m) / m) AS chi FROM counts, (SELECT avg(n) AS m FROM counts)
) SELECT shards, mean, round(stddev, 6) AS stddev, round(100 * stddev / mean, 6) AS cv_percent, round(100 * (most - mean) / mean, 6) AS over_percent, round(100 * (mean - least) / mean, 6) AS under_percent,
  most - least AS spread, round(most / least, 6) AS ratio, round(chi, 4) AS chi_square, chi < 1.5 * shards AS chi_passes,
  CASE WHEN 100 * stddev / mean < 5 THEN 'excellent' WHEN 100 * stddev / mean < 10 THEN 'good' WHEN 100 * stddev / mean < 20 THEN 'fair' ELSE 'poor' END AS grade FROM base""")
def kv_uniformity_chi2(spark, d):
    counts = derive.table(spark, d, "customer").groupBy(keys.shard(F.col("c_custkey").cast("string"), SHARDS).alias("shard")).agg(F.count("*").alias("n"))
    u = stats.uniformity(counts)
    for c in ("stddev", "cv_percent", "over_percent", "under_percent", "ratio"):
        u = u.withColumn(c, F.round(c, 6))
    return u.withColumn("chi_square", F.round("chi_square", 4))


@query(f"WITH {LOG}, gone AS (SELECT key, max(lsn) AS removed FROM log WHERE op = 'DELETE' GROUP BY key) SELECT key, count(*) AS counter FROM log LEFT JOIN gone USING (key) WHERE op = 'PUT' AND lsn > coalesce(removed, -1) GROUP BY key")
def kv_counter_rmw(spark, d):
    return kv.counters(derive.log(spark, d))


@query(f"WITH {LOG}, gone AS (SELECT key, max(lsn) AS removed FROM log WHERE op = 'DELETE' GROUP BY key), firsts AS (SELECT key, value, min(lsn) AS lsn FROM log LEFT JOIN gone USING (key) WHERE op = 'PUT' AND lsn > coalesce(removed, -1) GROUP BY ALL) SELECT key, list(value ORDER BY lsn) AS items FROM firsts GROUP BY key")
def kv_list_append_dedupe(spark, d):
    return kv.appended_lists(derive.log(spark, d))


@query(f"""WITH {LOG}, writes AS (SELECT key, lsn, op, value FROM log WHERE op <> 'GET'), reads AS (SELECT lsn AS lookup_id, key, lsn FROM log WHERE op = 'GET')
SELECT r.lookup_id, r.key, r.lsn, CASE WHEN w.op = 'PUT' THEN w.value END AS value, w.lsn AS write_lsn FROM reads r ASOF LEFT JOIN writes w ON r.key = w.key AND r.lsn >= w.lsn""")
def kv_asof_lookup(spark, d):
    log = derive.log(spark, d)
    return kv.as_of(log.where("op = 'GET'").select("key", "lsn", F.col("lsn").alias("lookup_id")), log)


@query(f"WITH {LOG}, mid AS (SELECT max(lsn) // 2 AS m FROM log), latest AS (SELECT key, arg_max(op, lsn) AS op, arg_max(value, lsn) AS value, max(lsn) AS lsn FROM log, mid WHERE op <> 'GET' AND lsn > m GROUP BY key) SELECT key, value, lsn FROM latest WHERE op = 'PUT'")
def kv_clear_epoch(spark, d):
    log = derive.log(spark, d)
    mid = (log.agg(F.max("lsn")).first()[0] or 0) // 2
    clear = spark.createDataFrame([(mid, 0, "CLEAR", "", None, 0)], log.schema)
    return kv.state(log.unionByName(clear)).select("key", "value", "lsn")


@query(f"WITH {LOG}, mid AS (SELECT max(lsn) // 2 AS m FROM log), latest AS (SELECT key, arg_max(op, lsn) AS op, arg_max(value, lsn) AS value, max(lsn) AS lsn FROM log, mid WHERE op <> 'GET' AND lsn <= m GROUP BY key) SELECT key, value, lsn FROM latest WHERE op = 'PUT'")
def kv_point_in_time(spark, d):
    log = derive.log(spark, d)
    return kv.state(log, (log.agg(F.max("lsn")).first()[0] or 0) // 2).select("key", "value", "lsn")


def cleared_log(spark, d):
    """The log with a CLEAR in place of what stands in the middle."""
    log = derive.log(spark, d)
    mid = (log.agg(F.max("lsn")).first()[0] or 0) // 2
    return log.withColumn("op", F.when(F.col("lsn") == mid, "CLEAR").otherwise(F.col("op")))


CLEARED = LOG.replace("log AS (", "plain AS (") + """, mid AS (SELECT max(lsn) // 2 AS m FROM plain), log AS (SELECT * REPLACE (CASE WHEN lsn = m THEN 'CLEAR' ELSE op END AS op) FROM plain, mid)"""


@query(f"""WITH {CLEARED}, writes AS (SELECT key, lsn, op, value FROM log WHERE op IN ('PUT', 'DELETE')), reads AS (SELECT lsn AS lookup_id, key, lsn FROM log WHERE op = 'GET')
SELECT r.lookup_id, r.key, r.lsn, CASE WHEN w.op = 'PUT' AND NOT (w.lsn < m AND r.lsn > m) THEN w.value END AS value, w.lsn AS write_lsn FROM mid, reads r ASOF LEFT JOIN writes w ON r.key = w.key AND r.lsn >= w.lsn""")
def kv_asof_after_clear(spark, d):
    log = cleared_log(spark, d)
    return kv.as_of(log.where("op = 'GET'").select("key", "lsn", F.col("lsn").alias("lookup_id")), log)


@query(f"WITH {STATE}, asked AS (SELECT 'user_' || c_custkey AS key FROM customer) SELECT a.key, s.value FROM asked a LEFT JOIN (SELECT key, value FROM state, clock WHERE {LIVE}) s USING (key)")
def kv_multi_get(spark, d):
    log = derive.log(spark, d)
    asked = derive.table(spark, d, "customer").select(F.concat(F.lit("user_"), F.col("c_custkey")).alias("key"))
    return kv.KVTable(log).multi_get(asked, clock(log))


# Expiry and residency.


@query(f"WITH {STATE} SELECT {SHARD} AS shard, count(*) FILTER (NOT {LIVE}) AS removed FROM state, clock GROUP BY 1")
def ttl_sweep_counts(spark, d):
    log = derive.log(spark, d)
    return ttl.sweep(kv.state(log), clock(log))[1]


@query(f"""WITH {STATE}, rounds AS (SELECT {SHARD} AS round, count(*) FILTER (NOT {LIVE}) AS expired, 0 AS skipped FROM state, clock GROUP BY 1)
SELECT count(*) AS checks, sum(expired)::BIGINT AS expired, sum(skipped)::BIGINT AS skipped, round(coalesce(avg(CASE WHEN expired > 0 THEN expired / (32.0 * 20) END), 0), 9) AS avg_ratio, 100.0::DOUBLE AS avg_check_ms FROM rounds""")
def ttl_sweep_stats(spark, d):
    log = derive.log(spark, d)
    rounds = ttl.sweep(kv.state(log), clock(log))[1].select(F.col("shard").alias("round"), F.col("removed").alias("expired"), F.lit(0).alias("skipped"))
    return ttl.sweep_stats(rounds, SHARDS, 20, 100).withColumn("avg_ratio", F.round("avg_ratio", 9)).withColumn("skipped", F.col("skipped").cast("long"))


INTERVAL = 3_600_000


@query(f"""WITH {LOG}, {READS}, t AS (SELECT min(ts_ms) AS start_ms, (max(ts_ms) - min(ts_ms)) // {INTERVAL} AS rounds FROM log),
times AS (SELECT t.key, t.write_no, t.op, l.ts_ms, CASE WHEN l.ttl_ms > 0 THEN l.ts_ms + l.ttl_ms ELSE 0 END AS dies, lead(l.ts_ms) OVER (PARTITION BY t.key ORDER BY t.write_no) AS next_ms, f.ts_ms AS late_ms
  FROM told t LEFT JOIN log l USING (lsn) LEFT JOIN log f ON f.lsn = t.first_late),
due AS (SELECT {SHARD} AS shard, (dies - start_ms) // {INTERVAL} + 1 AS round, least(next_ms, late_ms) AS ended, start_ms, rounds FROM times, t WHERE op = 'PUT' AND dies > 0),
settled AS (SELECT round + greatest(0, 2 - (round + shard) % 5) AS round, ended, start_ms, rounds FROM due),
gone AS (SELECT round, count(*) AS expired FROM settled WHERE ended IS NULL OR ended > start_ms + round * {INTERVAL} GROUP BY 1),
every AS (SELECT unnest(range(1, rounds + 1)) AS round FROM t),
busy AS (SELECT round, count(*) AS skipped FROM every, range({SHARDS}) s(shard) WHERE (round + shard) % 5 < 2 GROUP BY 1)
SELECT round, coalesce(expired, 0)::BIGINT AS expired, coalesce(skipped, 0)::BIGINT AS skipped FROM every LEFT JOIN gone USING (round) LEFT JOIN busy USING (round)""")
def ttl_sweep_rounds(spark, d):
    """Hourly sweeps; a shard cannot be had in two rounds of five."""
    log = derive.log(spark, d)
    first, last = log.agg(F.min("ts_ms"), F.max("ts_ms")).first()
    rounds = ((last or 0) - (first or 0)) // INTERVAL
    busy = spark.range(1, rounds + 2).select(F.col("id").alias("round"), F.explode(F.sequence(F.lit(0), F.lit(SHARDS - 1))).alias("shard")).where("(round + shard) % 5 < 2")
    return ttl.sweep_rounds(log, busy, SHARDS, INTERVAL)


@query(f"WITH {LOG}, last AS (SELECT key, max(lsn) AS lsn FROM log WHERE op = 'PUT' GROUP BY key), ranked AS (SELECT key, lsn, {SHARD} AS shard, row_number() OVER (PARTITION BY {SHARD} ORDER BY lsn DESC) AS rank FROM last) SELECT key, lsn, shard, rank::INTEGER AS rank FROM ranked WHERE rank <= {CAPACITY}")
def lru_resident_put_only(spark, d):
    return lru.resident_put_only(derive.log(spark, d), CAPACITY, SHARDS)


@query(f"""WITH {LOG}, puts AS (SELECT {SHARD} AS shard, key, lsn, lag(lsn) OVER (PARTITION BY key ORDER BY lsn) AS before FROM log WHERE op = 'PUT'), met AS (
  SELECT shard, key, before IS NULL OR (SELECT count(DISTINCT o.key) FROM puts o WHERE o.shard = p.shard AND o.lsn > p.before AND o.lsn < p.lsn) >= {CAPACITY} AS missed FROM puts p
) SELECT shard, count(*) AS puts, greatest(count(*) FILTER (missed) - {CAPACITY}, 0) AS evictions, least(count(DISTINCT key), {CAPACITY}) AS size FROM met GROUP BY shard""")
def lru_evictions_put_only(spark, d):
    return lru.simulate(derive.log(spark, d).where("op = 'PUT'"), CAPACITY, SHARDS).select("shard", "puts", "evictions", "size")


def lru_sql(log: str) -> str:
    """A shard's cache as a list, the front last, one operation of each shard at a time."""
    return f"""WITH RECURSIVE {log}, each AS (
  SELECT lsn, ts_ms, ttl_ms, key, op, {SHARD} AS shard FROM log WHERE op <> 'CLEAR' UNION ALL SELECT lsn, ts_ms, ttl_ms, key, op, s::INTEGER FROM log, range({SHARDS}) r(s) WHERE op = 'CLEAR'
), turns AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY lsn) AS i FROM each), run AS (
  SELECT DISTINCT shard, 0::BIGINT AS i, []::STRUCT(k VARCHAR, e BIGINT, p BIGINT)[] AS cache, 0::BIGINT AS hits, 0::BIGINT AS misses, 0::BIGINT AS expired, 0::BIGINT AS evictions, 0::BIGINT AS puts, 0::BIGINT AS removes, 0::BIGINT AS peak_size FROM turns
  UNION ALL
  SELECT shard, i, new, hits + (op = 'GET' AND there AND NOT late)::BIGINT, misses + (op = 'GET' AND (late OR NOT there))::BIGINT, expired + (op = 'GET' AND late)::BIGINT,
         evictions + (op = 'PUT' AND NOT there AND len(cache) >= {CAPACITY})::BIGINT, puts + (op = 'PUT')::BIGINT, removes + (op = 'DELETE' AND there)::BIGINT, CASE WHEN op = 'PUT' THEN greatest(peak_size, len(new)) ELSE peak_size END
  FROM (
    SELECT *, CASE WHEN op = 'CLEAR' THEN list_slice(cache, 1, 0) WHEN op = 'GET' AND late OR op = 'DELETE' THEN rest
                   WHEN op = 'GET' AND there AND ts_ms - found.p > 1000 THEN list_append(rest, {{'k': key, 'e': found.e, 'p': ts_ms}})
                   WHEN op = 'PUT' AND there THEN list_append(rest, {{'k': key, 'e': dies, 'p': found.p}})
                   WHEN op = 'PUT' THEN list_append(CASE WHEN len(cache) >= {CAPACITY} THEN list_slice(cache, 2, len(cache)) ELSE cache END, {{'k': key, 'e': dies, 'p': 0::BIGINT}}) ELSE cache END AS new
    FROM (SELECT *, found IS NOT NULL AS there, found IS NOT NULL AND found.e > 0 AND ts_ms > found.e AS late
          FROM (SELECT r.*, t.op, t.key, t.ts_ms, CASE WHEN t.ttl_ms > 0 THEN t.ts_ms + t.ttl_ms ELSE 0 END AS dies, list_filter(r.cache, lambda x: x.k = t.key)[1] AS found, list_filter(r.cache, lambda x: x.k <> t.key) AS rest
                FROM (SELECT * REPLACE (i + 1 AS i) FROM run) r JOIN turns t ON r.shard = t.shard AND r.i = t.i) a) b) c
) SELECT shard, hits, misses, expired, evictions, puts, removes, len(cache)::BIGINT AS size, peak_size FROM run r WHERE i = (SELECT max(i) FROM turns t WHERE t.shard = r.shard)"""


@query(lru_sql(LOG))
def lru_simulate_stats(spark, d):
    return lru.simulate(derive.log(spark, d), CAPACITY, SHARDS)


# Log and recovery.


@query(f"""WITH {LOG} SELECT lsn, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, len(key || value) + 1), lambda i: ascii(substr(key || value, i, 1))::BIGINT)), lambda a, b: (a * 31 + b) % 4294967296) AS checksum FROM log""")
def wal_checksum(spark, d):
    return oplog.with_checksum(derive.log(spark, d)).select("lsn", "checksum")


@query(f"WITH {LOG} SELECT lsn, ts_ms, op, key, value, ttl_ms FROM log WHERE lsn > (SELECT max(lsn) - max(lsn) // 10 FROM log) ORDER BY lsn")
def wal_tail_after_lsn(spark, d):
    log = derive.log(spark, d)
    top = log.agg(F.max("lsn")).first()[0] or 0
    return oplog.tail(log, top - top // 10)


@query(f"WITH {LOG} SELECT sum(33 + octet_length(encode(key)) + coalesce(octet_length(encode(value)), 0))::BIGINT AS bytes FROM log")
def wal_size_bytes(spark, d):
    return oplog.size_bytes(derive.log(spark, d))


@query(f"WITH {LOG} SELECT count(*) AS entries, max(lsn) AS last_lsn FROM log WHERE lsn < (SELECT (max(lsn) * 2) // 3 FROM log)")
def wal_prefix_truncate(spark, d):
    """An entry two thirds along has a wrong checksum: what comes before it is left."""
    log = oplog.with_checksum(derive.log(spark, d))
    bad = (log.agg(F.max("lsn")).first()[0] * 2) // 3
    return oplog.valid_prefix(log.withColumn("checksum", F.col("checksum") + (F.col("lsn") == bad).cast("long"))).agg(F.count("*").alias("entries"), F.max("lsn").alias("last_lsn"))


@query(f"WITH {STATE} SELECT key, value, expiry_ms FROM state")
def recover_snapshot_plus_tail(spark, d):
    """A snapshot at the middle of the log and the log after it give the state of the whole log."""
    log = derive.log(spark, d)
    mid = (log.agg(F.max("lsn")).first()[0] or 0) // 2
    return oplog.recovered(oplog.snapshot_of(log, mid), log, mid).select("key", "value", "expiry_ms")


@query(f"WITH {STATE} SELECT key, value, expiry_ms FROM state")
def recover_bad_header(spark, d):
    """Two thirds of the log are logged and checkpointed, the rest is logged only; a newer header with a wrong checksum
    must not hide it."""
    log = derive.log(spark, d).where("op <> 'GET'")
    top = log.agg(F.max("lsn")).first()[0] or 0
    durable = oplog.DurableTable(spark, tables.fresh_folder(spark, "durable"))
    durable.append(log.where(F.col("lsn") <= top * 2 // 3))
    durable.checkpoint(1)
    durable.append(log.where(F.col("lsn") > top * 2 // 3))
    durable.meta().limit(1).select(F.lit(top).cast("long").alias("snapshot_lsn"), "record_count", "created_ms", "version", F.lit(-1).cast("long").alias("checksum")).write.mode("append").parquet(f"{durable.folder}/meta")
    return durable.recover()[0].select("key", "value", "expiry_ms")


@query("SELECT snapshot_lsn, row_number() OVER (ORDER BY snapshot_lsn DESC) <= 3 AS kept FROM (SELECT DISTINCT event_id // 1000 + 1 AS snapshot_lsn FROM events)")
def snapshot_rotation_keep3(spark, d):
    snapshots = derive.table(spark, d, "events").select((F.floor(F.col("event_id") / 1000) + 1).alias("snapshot_lsn")).distinct()
    return oplog.rotation(snapshots)


@query(f"WITH {LOG} SELECT (max(ts_ms) - min(ts_ms)) // 60000 >= 60 OR sum(33 + octet_length(encode(key)) + octet_length(encode(value))) >= 67108864 AS due FROM log")
def checkpoint_trigger(spark, d):
    log = derive.log(spark, d)
    n = log.agg(F.floor((F.max("ts_ms") - F.min("ts_ms")) / 60000).alias("minutes"), F.sum(checksum.entry_bytes(F.col("key"), F.col("value"))).alias("bytes"))
    return n.select(((F.col("minutes") >= oplog.MAX_MINUTES) | (F.col("bytes") >= oplog.MAX_BYTES)).alias("due"))


def requests(spark, d):
    log = derive.log(spark, d).where("op <> 'GET'")
    return log.select(F.col("key").alias("stream"), F.col("lsn").alias("req_id"), "ts_ms", checksum.entry_bytes(F.col("key"), F.col("value")).alias("bytes"), F.lit(False).alias("sync"))


@query(f"WITH {LOG} SELECT ts_ms // 600000 AS batch, count(*) AS commits, sum(33 + octet_length(encode(key)) + octet_length(encode(value)))::BIGINT AS bytes, min(lsn) AS first_req, max(lsn) AS last_req FROM log WHERE op <> 'GET' GROUP BY 1")
def group_commit_batches(spark, d):
    return group_commit.bucketed(requests(spark, d), 600_000)


COMMITS = f"""{LOG}, req AS (
  SELECT key AS stream, lsn AS req_id, ts_ms, 33 + octet_length(encode(key)) + octet_length(encode(value)) AS bytes, row_number() OVER (PARTITION BY key ORDER BY ts_ms, lsn) AS i FROM log WHERE op <> 'GET'
), run AS (
  SELECT stream, req_id, i, 0::BIGINT AS batch, bytes::BIGINT AS bytes, bytes::BIGINT AS size, ts_ms AS since FROM req WHERE i = 1
  UNION ALL
  SELECT stream, req_id, i, batch + fresh::BIGINT, bytes, CASE WHEN fresh THEN bytes ELSE size + bytes END, CASE WHEN fresh THEN ts_ms ELSE since END
  FROM (SELECT r.stream, r.req_id, r.i, p.batch, r.bytes::BIGINT AS bytes, p.size, p.since, r.ts_ms, p.size >= 4096 OR r.ts_ms - p.since >= 3600000 AS fresh FROM run p JOIN req r ON r.stream = p.stream AND r.i = p.i + 1) s
)"""


@query(f"WITH RECURSIVE {COMMITS}, b AS (SELECT count(*) AS commits, sum(bytes) AS bytes FROM run GROUP BY stream, batch) SELECT sum(commits)::BIGINT AS commits, count(*) AS batches, sum(bytes)::BIGINT AS bytes, round(sum(commits) / count(*), 6) AS commits_per_batch, 3600000.0::DOUBLE AS latency_ms FROM b")
def group_commit_stats(spark, d):
    return group_commit.stats(group_commit.by_batch(group_commit.batches(requests(spark, d), 4096, 3_600_000)), 3_600_000).withColumn("commits_per_batch", F.round("commits_per_batch", 6))


@query(f"WITH RECURSIVE {COMMITS} SELECT stream, req_id, batch, bytes FROM run")
def group_commit_exact(spark, d):
    return group_commit.batches(requests(spark, d), 4096, 3_600_000)


@query(f"""WITH {LOG}, latest AS (SELECT key, arg_max(op, lsn) AS op, arg_max(value, lsn) AS value, max(lsn) AS lsn FROM log WHERE op <> 'GET' GROUP BY key) SELECT key, value, lsn FROM latest WHERE op = 'PUT'""")
def stream_kv_state(spark, d):
    events = derive.table(spark, d, "events")
    stream = derive.as_log(spark.readStream.schema(events.schema).option("pathGlobFilter", "*.parquet").parquet(stream_folder(spark, d)))
    import uuid

    return apply.current(apply.drained(apply.latest(stream), f"kv_{uuid.uuid4().hex}")).select("key", "value", "lsn")


def stream_folder(spark, d: str) -> str:
    """A stream reads a folder: the table itself if it is one, else all files of its name."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/events.parquet")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    return f"{d}/events.parquet" if there else f"{d}/events.parque[t]"


# Vectors. Query vector: that of vec_id 0; query set: the first vector of each label.

Q0 = "q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0)"
L2 = "list_sum(list_transform(list_zip(embedding::DOUBLE[], qv), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"
COS = "CASE WHEN sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(qv, qv)) < 1e-8 THEN 0 ELSE list_cosine_similarity(embedding::DOUBLE[], qv) END"
DOT = "list_dot_product(embedding::DOUBLE[], qv)"


def top(spark, d, metric):
    return similar.top_k(derive.vectors(spark, d), derive.vector_of(spark, d, 0), 10, metric).select("key", F.round("score", 6).alias("score"))


@query(f"WITH {Q0} SELECT 'vec_' || vec_id AS key, round({L2}, 6) AS score FROM embeddings, q ORDER BY {L2}, key LIMIT 10")
def vec_l2sq_topk(spark, d):
    return top(spark, d, "l2")


@query(f"WITH {Q0} SELECT 'vec_' || vec_id AS key, round({COS}, 6) AS score FROM embeddings, q ORDER BY {COS} DESC, key LIMIT 10")
def vec_cosine_topk(spark, d):
    return top(spark, d, "cosine")


@query(f"WITH {Q0} SELECT 'vec_' || vec_id AS key, round({DOT}, 6) AS score FROM embeddings, q ORDER BY {DOT} DESC, key LIMIT 10")
def vec_dot_topk(spark, d):
    return top(spark, d, "dot_product")


@query(f"WITH {Q0} SELECT 'vec_' || vec_id AS key, round(sqrt({L2}), 6) AS distance FROM embeddings, q")
def vec_l2_scores(spark, d):
    return similar.scored(derive.vectors(spark, d), derive.vector_of(spark, d, 0)).select("key", F.round(F.sqrt("score"), 6).alias("distance"))


HEADS = "heads AS (SELECT min(vec_id) AS qid, arg_min(embedding, vec_id)::DOUBLE[] AS qv FROM embeddings GROUP BY label)"


def batch(spark, d, metric):
    return similar.top_k_batch(derive.vectors(spark, d), derive.label_heads(spark, d), 5, metric).select("qid", "key", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {HEADS}, s AS (SELECT qid, 'vec_' || vec_id AS key, {COS} AS score FROM embeddings, heads), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, key) AS rank FROM s) SELECT qid, key, round(score, 6) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 5")
def vec_batch_topk_per_query(spark, d):
    return batch(spark, d, "cosine")


@query(f"WITH {HEADS}, s AS (SELECT qid, 'vec_' || vec_id AS key, {L2} AS score FROM embeddings, heads), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9), key) AS rank FROM s) SELECT qid, key, round(score, 6) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 5")
def vec_batch_l2_topk(spark, d):
    return batch(spark, d, "l2")


@query(f"WITH {Q0} SELECT vec_id, round({COS}, 6) AS similarity FROM embeddings, q")
def vec_batch_cosine(spark, d):
    return derive.vectors(spark, d).select("vec_id", F.round(V.cosine(F.col("embedding"), V.literal(derive.vector_of(spark, d, 0))), 6).alias("similarity"))


@query("SELECT count(*) AS searched FROM embeddings WHERE len(embedding) = 64 AND label < 5")
def vec_dim_mismatch_skip(spark, d):
    """Vectors of the upper labels are cut to half: a search skips them."""
    mixed = derive.vectors(spark, d).withColumn("embedding", F.when(F.col("label") < 5, F.col("embedding")).otherwise(F.slice("embedding", 1, 32)))
    return similar.scored(mixed, derive.vector_of(spark, d, 0)).agg(F.count("*").alias("searched"))


@query("SELECT vec_id, len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AS valid FROM embeddings")
def vec_is_valid(spark, d):
    return derive.vectors(spark, d).select("vec_id", V.is_valid(F.col("embedding")).alias("valid"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))), 6) AS total FROM embeddings")
def vec_normalize(spark, d):
    return derive.vectors(spark, d).select("vec_id", F.round(V.total(V.normalize(F.col("embedding"))), 6).alias("total"))


@query("SELECT 'vec_' || vec_id AS key FROM embeddings WHERE starts_with('vec_' || vec_id, 'vec_2') ORDER BY key")
def vec_index_list_keys(spark, d):
    return similar.VectorIndex(derive.vectors(spark, d)).list_keys("vec_2")


@query("SELECT vec_id, len(embedding)::INTEGER AS dim, 4 * len(embedding)::INTEGER AS bytes, true AS same FROM embeddings")
def vec_codec_round_trip(spark, d):
    v = derive.vectors(spark, d).withColumn("raw", V.encode("embedding"))
    return v.select("vec_id", F.size("embedding").alias("dim"), F.octet_length("raw").alias("bytes"), (V.decode("raw") == F.col("embedding")).alias("same"))


# Graph.

EDGES = """edge_log AS (
  SELECT 'user_' || a.user_id AS src_id, 'user_' || b.user_id AS dst_id, 'follows' AS label, a.value AS weight, a.event_id * 2 AS seq
  FROM events a JOIN events b ON b.event_id = a.event_id + 1 WHERE a.event_type = 'purchase' AND a.value > 60 AND a.user_id <> b.user_id
  UNION ALL
  SELECT 'user_' || user_id, 'item_' || (props::JSON ->> 'k'), event_type, value, event_id * 2 + 1 FROM events WHERE event_type IN ('purchase', 'click')
), edges AS (SELECT src_id, dst_id, label, arg_max(weight, seq) AS weight, min(seq) AS seq FROM edge_log GROUP BY ALL),
nodes AS (SELECT 'user_' || user_id AS node_id FROM events UNION SELECT 'item_' || (props::JSON ->> 'k') FROM events)"""
START = "start AS (SELECT arg_min(src_id, seq) AS node_id FROM edges)"


def walk_sql(seed: str, hops: int) -> str:
    return f"""reach(node_id, hop) AS (
  SELECT node_id, 0 FROM {seed} UNION SELECT e.dst_id, r.hop + 1 FROM reach r JOIN edges e ON e.src_id = r.node_id WHERE r.hop < {hops}
)"""


def first_source(edges: DataFrame) -> DataFrame:
    return edges.agg(F.min_by("src_id", "seq").alias("node_id"))


@query(f"WITH {EDGES} SELECT src_id, dst_id, label, weight, seq FROM edges")
def graph_edge_upsert_latest(spark, d):
    return derive.edges(spark, d)


@query(f"WITH {EDGES}, f AS (SELECT src_id AS node_id, dst_id AS other, min(seq) AS seq FROM edges GROUP BY ALL) SELECT node_id, list(other ORDER BY seq) AS neighbours FROM f GROUP BY node_id")
def graph_out_neighbors(spark, d):
    return G.neighbours(derive.edges(spark, d))


@query(f"WITH {EDGES}, f AS (SELECT dst_id AS node_id, src_id AS other, min(seq) AS seq FROM edges GROUP BY ALL) SELECT node_id, list(other ORDER BY seq) AS neighbours FROM f GROUP BY node_id")
def graph_in_neighbors(spark, d):
    return G.neighbours(derive.edges(spark, d), "in")


@query(f"WITH {EDGES} SELECT src_id, dst_id, count(*) AS n FROM edges GROUP BY ALL")
def graph_edge_counts(spark, d):
    return G.edge_counts(derive.edges(spark, d))


@query(f"WITH {EDGES}, f AS (SELECT src_id AS node_id, dst_id AS other, min(seq) AS seq FROM edges WHERE label <> 'click' GROUP BY ALL) SELECT node_id, list(other ORDER BY seq) AS neighbours FROM f GROUP BY node_id")
def graph_delete_edge_keeps_multilabel(spark, d):
    """All click edges go; an item stays a neighbour where a purchase is left."""
    edges = derive.edges(spark, d)
    return G.neighbours(G.without_edges(edges, edges.where("label = 'click'").select("src_id", "dst_id", "label")))


GONE = "gone AS (SELECT 'user_' || user_id AS node_id FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) >= 15)"


@query(f"""WITH {EDGES}, {GONE} SELECT 'node' AS kind, node_id AS a, '' AS b, '' AS c FROM nodes WHERE node_id NOT IN (SELECT node_id FROM gone)
UNION ALL SELECT 'edge', src_id, dst_id, label FROM edges WHERE src_id NOT IN (SELECT node_id FROM gone) AND dst_id NOT IN (SELECT node_id FROM gone)
UNION ALL SELECT 'vector', 'user_' || vec_id, '', '' FROM embeddings WHERE vec_id IN (SELECT user_id FROM events) AND 'user_' || vec_id NOT IN (SELECT node_id FROM gone)""")
def graph_delete_node_cascade(spark, d):
    """Users with many errors go, with their edges at either end and their vectors."""
    errors = derive.table(spark, d, "events").where("event_type = 'error'").groupBy(F.concat(F.lit("user_"), F.col("user_id")).alias("node_id")).count().where("count >= 15").select("node_id")
    g = derive.graph(spark, d)
    nodes, edges, vectors = G.without_nodes(g.nodes, g.edges, g.vectors, errors)
    none = F.lit("")
    out = nodes.select(F.lit("node").alias("kind"), F.col("node_id").alias("a"), none.alias("b"), none.alias("c"))
    return out.union(edges.select(F.lit("edge"), "src_id", "dst_id", "label")).union(vectors.select(F.lit("vector"), "node_id", none, none))


@query(f"WITH {EDGES}, f AS (SELECT src_id AS node_id, dst_id, min(label) AS label FROM edges GROUP BY ALL) SELECT node_id, list(dst_id ORDER BY dst_id) AS neighbours FROM f GROUP BY node_id")
def graph_rebuild_adjacency(spark, d):
    return G.rebuilt_neighbours(derive.edges(spark, d))


def hop_query(hops: int):
    def run(spark, d):
        edges = G.materialised(derive.edges(spark, d), "edges")
        return G.k_hop(edges, first_source(edges), hops)

    run.__name__ = f"graph_khop_{hops}"
    return query(f"WITH RECURSIVE {EDGES}, {START}, {walk_sql('start', hops)} SELECT node_id, min(hop)::INTEGER AS hop FROM reach GROUP BY node_id HAVING min(hop) > 0")(run)


for _hops in (1, 2, 3):
    hop_query(_hops)


@query(f"WITH RECURSIVE {EDGES}, heads AS (SELECT 'user_' || min(vec_id) AS node_id FROM embeddings GROUP BY label), {walk_sql('heads', 2)} SELECT node_id, min(hop)::INTEGER AS hop FROM reach GROUP BY node_id HAVING min(hop) > 0")
def graph_khop_multi_source(spark, d):
    edges = G.materialised(derive.edges(spark, d), "edges")
    starts = derive.table(spark, d, "embeddings").groupBy("label").agg(F.min("vec_id").alias("v")).select(F.concat(F.lit("user_"), F.col("v")).alias("node_id"))
    return G.k_hop(edges, starts, 2)


def ends(edges: DataFrame) -> tuple[str, str]:
    r = edges.where("label = 'follows'").agg(F.min_by("src_id", "seq"), F.max_by("dst_id", "seq")).first()
    return r[0], r[1]


ENDS = "ends AS (SELECT arg_min(src_id, seq) AS s, arg_max(dst_id, seq) AS t FROM edges WHERE label = 'follows'), start AS (SELECT s AS node_id FROM ends)"


@query(f"WITH RECURSIVE {EDGES}, {ENDS}, {walk_sql('start', 12)} SELECT s AS src_id, t AS dst_id, coalesce((SELECT min(hop) FROM reach WHERE node_id = t), -1)::INTEGER AS hops FROM ends")
def graph_shortest_path_len(spark, d):
    edges = G.materialised(derive.edges(spark, d), "edges")
    src, dst = ends(edges)
    path = G.shortest_path(edges, src, dst)
    return spark.createDataFrame([(src, dst, len(path) - 1)], "src_id string, dst_id string, hops int")


#: At each hop a node keeps the way whose row of seqs is least, which is the one that a queue finds first.
@query(f"""WITH RECURSIVE {EDGES}, {ENDS}, steps AS (SELECT src_id, dst_id, min(seq) AS seq FROM edges GROUP BY ALL), ways(node_id, hop, place, path) AS (
  SELECT s, 0, []::BIGINT[], [s] FROM ends
  UNION ALL
  SELECT node_id, hop, place, path FROM (
    SELECT e.dst_id AS node_id, w.hop + 1 AS hop, list_append(w.place, e.seq::BIGINT) AS place, list_append(w.path, e.dst_id) AS path,
           row_number() OVER (PARTITION BY e.dst_id ORDER BY list_append(w.place, e.seq::BIGINT)) AS r
    FROM ways w JOIN steps e ON e.src_id = w.node_id WHERE w.hop < 12) WHERE r = 1
), found AS (SELECT path FROM ways, ends WHERE node_id = t ORDER BY hop LIMIT 1)
SELECT unnest(range(len(path)))::INTEGER AS place, unnest(path) AS node_id FROM found""")
def graph_shortest_path(spark, d):
    edges = G.materialised(derive.edges(spark, d), "edges")
    path = G.shortest_path(edges, *ends(edges))
    return spark.createDataFrame([(i, n) for i, n in enumerate(path)], "place int, node_id string")


USERS = f"candidates AS (SELECT 'user_' || vec_id AS node_id, embedding FROM embeddings WHERE vec_id IN (SELECT user_id FROM events))"


@query(f"WITH RECURSIVE {EDGES}, {USERS}, {Q0}, top AS (SELECT node_id FROM candidates, q ORDER BY {COS} DESC, node_id LIMIT 3), {walk_sql('top', 2)} SELECT DISTINCT node_id, '{{\"id\":\"' || node_id || '\"}}' AS properties_json FROM reach WHERE node_id IN (SELECT node_id FROM nodes)")
def graph_rag(spark, d):
    g = derive.graph(spark, d)
    g.edges = G.materialised(g.edges, "edges")
    return rag.graph_rag(g, derive.vector_of(spark, d, 0), 3, 2)


@query(f"""WITH RECURSIVE {EDGES}, {USERS}, {HEADS}, ranked AS (SELECT node_id, row_number() OVER (PARTITION BY qid ORDER BY round({COS}, 9) DESC, node_id) AS rank FROM candidates, heads),
top AS (SELECT DISTINCT node_id FROM ranked WHERE rank <= 3), {walk_sql('top', 2)} SELECT DISTINCT node_id FROM reach WHERE node_id IN (SELECT node_id FROM nodes)""")
def graph_rag_batch(spark, d):
    g = derive.graph(spark, d)
    g.edges = G.materialised(g.edges, "edges")
    return rag.graph_rag_batch(g, list(derive.label_heads(spark, d).values()), 3, 2).select("node_id")


@query(f"""WITH RECURSIVE {EDGES}, {USERS}, {Q0}, top AS (SELECT node_id FROM candidates, q ORDER BY {COS} DESC, node_id LIMIT 3), {walk_sql('top', 2)},
expected AS (SELECT DISTINCT label AS query, dst_id AS node_id FROM edges WHERE src_id IN (SELECT node_id FROM top)), found AS (SELECT DISTINCT node_id FROM reach)
SELECT query, count(*) FILTER (node_id IN (SELECT node_id FROM found)) AS found, count(*) AS expected, round(count(*) FILTER (node_id IN (SELECT node_id FROM found)) / count(*), 6) AS recall FROM expected GROUP BY query""")
def graph_rag_recall(spark, d):
    """Of what the entries touch, by label, the share that retrieval returns."""
    g = derive.graph(spark, d)
    g.edges = G.materialised(g.edges, "edges")
    q = derive.vector_of(spark, d, 0)
    top = rag.entries(g, q, 3).select(F.col("node_id").alias("src_id"))
    expected = g.edges.join(top, "src_id", "left_semi").select(F.col("label").alias("query"), F.col("dst_id").alias("node_id")).distinct()
    found = rag.graph_rag(g, q, 3, 2).select("node_id")
    results = expected.join(found, "node_id", "left_semi").select("query", "node_id")
    return rag.recall(results, expected).withColumn("recall", F.round("recall", 6))


ESCAPED = "replace(replace(raw, '\\', '\\\\'), ':', '\\:')"


@query(f"SELECT user_id, event_id, 'n:' || {ESCAPED} AS node_key, raw, 2 AS parts FROM (SELECT *, 'a:' || user_id || '\\' || event_type || ':' AS raw FROM events)")
def graph_escape_keys(spark, d):
    raw = F.concat(F.lit("a:"), F.col("user_id"), F.lit("\\"), F.col("event_type"), F.lit(":"))
    e = derive.table(spark, d, "events").select("user_id", "event_id", keys.node_key(raw).alias("node_key"))
    return e.withColumn("raw", F.get(keys.segments(F.col("node_key")), 1)).withColumn("parts", F.size(keys.segments(F.col("node_key"))))


def escaped(column: str) -> str:
    return ESCAPED.replace("raw", column)


@query(f"""WITH e AS (SELECT event_id, 'u:' || user_id AS src, event_type || '\\' AS dst, coalesce(props, '') AS label FROM events)
SELECT event_id, 'e:' || {escaped('src')} || ':' || {escaped('dst')} || ':' || {escaped('label')} AS edge_key, 'adj:out:' || {escaped('src')} AS out_key, 'adj:in:' || {escaped('dst')} AS in_key,
  'vec:' || {escaped('src')} AS vector_key, 'ec:' || {escaped('src')} || ':' || {escaped('dst')} AS counter_key FROM e""")
def graph_key_builders(spark, d):
    src, dst, label = F.concat(F.lit("u:"), F.col("user_id")), F.concat(F.col("event_type"), F.lit("\\")), F.coalesce("props", F.lit(""))
    return derive.table(spark, d, "events").select(
        "event_id", keys.edge_key(src, dst, label).alias("edge_key"), keys.adjacency_key("out", src).alias("out_key"), keys.adjacency_key("in", dst).alias("in_key"),
        keys.vector_key(src).alias("vector_key"), keys.counter_key(src, dst).alias("counter_key"),
    )


# Statistics and service.


@query(f"""WITH {LOG}, {READS}, n AS (
  SELECT sum(hits)::BIGINT AS hits, sum(misses)::BIGINT AS misses, count(*) FILTER (late > 0) AS expired, count(*) FILTER (op = 'PUT') AS puts, count(*) FILTER (op = 'DELETE' AND was) AS removes,
         count(*) FILTER (op = 'PUT' AND NOT was) - count(*) FILTER (op = 'DELETE' AND was) - count(*) FILTER (op = 'PUT' AND late > 0) AS size FROM told
), t AS (SELECT (max(ts_ms) - min(ts_ms)) // 1000 AS uptime_seconds FROM log)
SELECT hits, misses, expired, puts, removes, size, 3200::BIGINT AS capacity, hits + misses AS total_gets, round(hits / (hits + misses), 6) AS hit_rate, round(misses / (hits + misses), 6) AS miss_rate,
  round(expired / misses, 6) AS expiry_rate, round(size / 3200, 6) AS usage_rate, uptime_seconds, round((hits + misses) / uptime_seconds, 6) AS avg_qps FROM n, t""")
def cache_stats(spark, d):
    s = stats.cache_stats(derive.log(spark, d), 3200)
    for c in ("hit_rate", "miss_rate", "expiry_rate", "usage_rate", "avg_qps"):
        s = s.withColumn(c, F.round(c, 6))
    return s


@query(f"""WITH {LOG}, {READS}, changes AS (
  SELECT lsn, 1 AS delta FROM told WHERE op = 'PUT' AND NOT was UNION ALL SELECT lsn, -1 FROM told WHERE op = 'DELETE' AND was UNION ALL SELECT first_late, -1 FROM told WHERE op = 'PUT' AND late > 0
) SELECT max(total)::BIGINT AS peak_size FROM (SELECT sum(delta) OVER (ORDER BY lsn ROWS UNBOUNDED PRECEDING) AS total FROM changes)""")
def cache_peak_size(spark, d):
    return stats.peak_size(derive.log(spark, d))


@query(f"""WITH RECURSIVE {CLEARED}, turns AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY lsn) AS i FROM (SELECT lsn, ts_ms, ttl_ms, key, op FROM log WHERE op <> 'CLEAR' UNION ALL SELECT c.lsn, c.ts_ms, 0, k.key, 'CLEAR' FROM (SELECT lsn, ts_ms FROM log WHERE op = 'CLEAR') c, (SELECT DISTINCT key FROM log WHERE op <> 'CLEAR') k) x), run AS (
  SELECT DISTINCT key, 0::BIGINT AS i, false AS there, 0::BIGINT AS dies, 0::BIGINT AS hits, 0::BIGINT AS misses, 0::BIGINT AS expired, 0::BIGINT AS puts, 0::BIGINT AS removes FROM turns
  UNION ALL
  SELECT key, i, CASE WHEN op = 'PUT' THEN true WHEN op = 'GET' THEN there AND NOT late ELSE false END, CASE WHEN op = 'PUT' THEN CASE WHEN ttl_ms > 0 THEN ts_ms + ttl_ms ELSE 0 END ELSE dies END,
         hits + (op = 'GET' AND there AND NOT late)::BIGINT, misses + (op = 'GET' AND (late OR NOT there))::BIGINT, expired + (op = 'GET' AND late)::BIGINT, puts + (op = 'PUT')::BIGINT, removes + (op = 'DELETE' AND there)::BIGINT
  FROM (SELECT r.*, t.op, t.ts_ms, t.ttl_ms, r.there AND r.dies > 0 AND t.ts_ms > r.dies AS late FROM (SELECT * REPLACE (i + 1 AS i) FROM run) r JOIN turns t ON r.key = t.key AND r.i = t.i) s
), ends AS (SELECT * FROM run r WHERE i = (SELECT max(i) FROM turns t WHERE t.key = r.key))
SELECT sum(hits)::BIGINT AS hits, sum(misses)::BIGINT AS misses, sum(expired)::BIGINT AS expired, sum(puts)::BIGINT AS puts, sum(removes)::BIGINT AS removes, count(*) FILTER (there) AS size FROM ends""")
def cache_stats_after_clear(spark, d):
    return stats.cache_stats(cleared_log(spark, d), 3200).select("hits", "misses", "expired", "puts", "removes", "size")


@query(lru_sql(CLEARED))
def lru_simulate_after_clear(spark, d):
    return lru.simulate(cleared_log(spark, d), CAPACITY, SHARDS)


@query(f"""WITH {LOG}, {READS}, e AS (SELECT {SHARD} AS shard, * FROM epochs) SELECT shard, sum(hits)::BIGINT AS hits, sum(misses)::BIGINT AS misses, count(*) FILTER (op = 'PUT') AS puts, ((sum(hits) * 100) // (sum(hits) + sum(misses) + 1))::BIGINT AS hit_percent FROM e GROUP BY shard""")
def cache_stats_by_shard(spark, d):
    e = ttl.epochs(derive.log(spark, d)).groupBy(keys.shard(F.col("key"), SHARDS).alias("shard"))
    n = e.agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"), F.count_if(F.col("op") == "PUT").alias("puts"))
    return n.withColumn("hit_percent", stats.hit_percent(F.col("hits"), F.col("misses")))


@query(f"""WITH {LOG}, {READS} SELECT {SHARD} AS shard, sum(hits)::BIGINT AS hits, sum(misses)::BIGINT AS misses, count(*) FILTER (late > 0) AS expired, count(*) FILTER (op = 'PUT') AS puts, count(*) FILTER (op = 'DELETE' AND was) AS removes,
  count(*) FILTER (op = 'PUT' AND NOT was) - count(*) FILTER (op = 'DELETE' AND was) - count(*) FILTER (op = 'PUT' AND late > 0) AS size, 100::BIGINT AS capacity, 3200::BIGINT AS total_capacity FROM told GROUP BY 1""")
def cache_counters_by_shard(spark, d):
    return stats.counters_by_shard(derive.log(spark, d), SHARDS, 100)


@query(f"""WITH {LOG}, {READS}, reset AS (SELECT max(lsn) // 2 AS r FROM log), g AS (
  SELECT count(*) FILTER (there AND NOT late) AS hits, count(*) FILTER (NOT there OR late) AS misses, max(ts_ms) FILTER (there AND NOT late) AS last_hit_ms, max(ts_ms) FILTER (NOT there OR late) AS last_miss_ms FROM reads, reset WHERE lsn > r
), w AS (SELECT count(*) FILTER (op = 'PUT') AS puts, max(ts_ms) FILTER (op = 'GET') AS last_access_ms FROM log, reset WHERE lsn > r),
x AS (SELECT count(*) FILTER (first_late > r) AS expired, count(*) FILTER (op = 'DELETE' AND was AND lsn > r) AS removes FROM told, reset)
SELECT * FROM g, w, x""")
def cache_stats_after_reset(spark, d):
    """Counters since the middle of the log."""
    log = derive.log(spark, d)
    return stats.counters_since(log, (log.agg(F.max("lsn")).first()[0] or 0) // 2)


@query("SELECT event_id, abs(value - round(value, 1)) <= 1e-4 OR abs(value - round(value, 1)) <= 1e-4 * greatest(abs(value), abs(round(value, 1))) AS near FROM events")
def number_approx_equal(spark, d):
    return derive.table(spark, d, "events").select("event_id", V.approx_equal(F.col("value"), F.round("value", 1)).alias("near"))


@query("""WITH m AS (SELECT event_type, max(value) AS single, sum(value) / 4 AS batch, count(*) AS n FROM events GROUP BY 1)
SELECT event_type, round(single * n / batch, 6) AS speedup, round(single / batch, 9) AS efficiency FROM m""")
def perf_speedup(spark, d):
    m = derive.table(spark, d, "events").groupBy("event_type").agg(F.max("value").alias("single"), (F.sum("value") / 4).alias("batch"), F.count("*").alias("n"))
    s = m.select("event_type", stats.speedup(F.col("single"), F.col("batch"), F.col("n")).alias("s"))
    return s.select("event_type", F.round("s.speedup", 6).alias("speedup"), F.round("s.efficiency", 9).alias("efficiency"))


@query("SELECT event_type, list_sort(list(value))[(count(*) * 50) // 100 + 1] AS p50, list_sort(list(value))[(count(*) * 95) // 100 + 1] AS p95, list_sort(list(value))[(count(*) * 99) // 100 + 1] AS p99 FROM events GROUP BY event_type")
def latency_percentiles_nearest_rank(spark, d):
    return stats.percentiles(derive.table(spark, d, "events"), "event_type", "value")


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS avg_value, min(value) AS min_value, max(value) AS max_value, round(count(*) / (sum(value) / 1000), 4) AS qps FROM events GROUP BY event_type")
def latency_summary(spark, d):
    return stats.latency_summary(derive.table(spark, d, "events"), "event_type", "value").withColumn("avg_value", F.round("avg_value", 6)).withColumn("qps", F.round("qps", 4))


@query("WITH m AS (SELECT event_type, count(*)::DOUBLE AS qps FROM events GROUP BY 1) SELECT event_type, qps, round(100 * qps / max(qps) OVER (), 6) AS of_best_percent, round(100 - 100 * qps / max(qps) OVER (), 6) AS drop_percent FROM m")
def perf_relative_to_best(spark, d):
    m = derive.table(spark, d, "events").groupBy("event_type").agg(F.count("*").cast("double").alias("qps"))
    return stats.relative(m, "qps").withColumn("of_best_percent", F.round("of_best_percent", 6)).withColumn("drop_percent", F.round("drop_percent", 6))


@query("""WITH c AS (SELECT l_linenumber AS threads, count(*) FILTER (l_returnflag = 'A') AS base, count(*) FILTER (l_returnflag = 'R') AS variant FROM lineitem GROUP BY 1)
SELECT threads, base, variant, round(variant / base, 6) AS ratio FROM c""")
def perf_group_ratio(spark, d):
    """Counts of two modes side by side by group, with their ratio."""
    p = derive.table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("threads")).pivot("l_returnflag", ["A", "R"]).agg(F.count(F.lit(1)))
    return p.select("threads", F.col("A").alias("base"), F.col("R").alias("variant"), F.round(F.col("R") / F.col("A"), 6).alias("ratio"))


RUNS = f"""o AS (SELECT {SHARD} AS group_id, lsn, op = 'DELETE' AS failed FROM log), i AS (
  SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY lsn) - row_number() OVER (PARTITION BY group_id, failed ORDER BY lsn) AS island FROM o
), runs AS (SELECT group_id, island, count(*) AS run, min(lsn) AS first_lsn, max(lsn) AS last_lsn FROM i WHERE failed GROUP BY ALL), last AS (SELECT group_id, max(lsn) AS lsn FROM o GROUP BY 1)"""


def outcomes(spark, d):
    log = derive.log(spark, d)
    return log.select(keys.shard(F.col("key"), SHARDS).alias("group_id"), "lsn", (F.col("op") == "DELETE").alias("failed"))


@query(f"WITH {LOG}, {RUNS} SELECT group_id, run, first_lsn FROM runs WHERE run >= 5")
def health_disabled_shards(spark, d):
    return G.error_runs(outcomes(spark, d)).where("run >= 5").select("group_id", "run", "first_lsn")


@query(f"""WITH {LOG}, {RUNS}, per AS (SELECT group_id, max(run) AS worst, max(CASE WHEN last_lsn = l.lsn THEN run ELSE 0 END) AS tail FROM runs JOIN last l USING (group_id) GROUP BY 1)
SELECT 32::BIGINT AS total_shards, count(*) FILTER (worst >= 5) AS disabled, (32 - count(*) FILTER (worst >= 5))::BIGINT AS healthy, 32 - count(*) FILTER (worst >= 5) > 16 AS overall_healthy, round(sum(tail) / 160.0, 6) AS error_rate FROM per""")
def health_status(spark, d):
    o = outcomes(spark, d)
    last = o.groupBy("group_id").agg(F.max("lsn").alias("last_lsn"))
    ends_ = o.where("failed").join(last, "group_id").where("lsn = last_lsn").select("group_id", F.lit(True).alias("open"))
    final = G.error_runs(o).groupBy("group_id").agg(F.max_by("run", "first_lsn").alias("final_run")).join(ends_, "group_id", "left")
    runs = G.error_runs(o).join(final, "group_id").withColumn("tail", F.when(F.col("open"), F.col("final_run")).otherwise(F.lit(0)))
    return stats.health(runs, SHARDS).withColumn("error_rate", F.round("error_rate", 6))


@query(f"""WITH {STATE}, {HEADS}, probes AS (SELECT qid, 'user_' || qid AS key, qv FROM heads), live AS (SELECT key, value FROM state, clock WHERE {LIVE}),
exact AS (SELECT qid, 'exact' AS source, p.key, value FROM probes p JOIN live USING (key)),
scored AS (SELECT p.qid, 'user_' || vec_id AS key, {COS} AS score FROM embeddings, probes p WHERE 'user_' || vec_id IN (SELECT key FROM live)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, key) AS rank FROM scored)
SELECT * FROM exact UNION ALL SELECT r.qid, 'semantic', r.key, l.value FROM ranked r JOIN live l USING (key) WHERE rank <= 3 AND qid NOT IN (SELECT qid FROM exact)""")
def memory_recall(spark, d):
    """A live entry under the exact key, else the three live users that are most similar."""
    log = derive.log(spark, d)
    live = kv.state(log).where(kv.live(clock(log))).select("key", "value")
    heads = derive.label_heads(spark, d)
    probes = spark.createDataFrame([(q, f"user_{q}") for q in heads], "qid long, key string")
    exact = probes.join(live, "key").select("qid", F.lit("exact").alias("source"), "key", "value")
    users = derive.table(spark, d, "embeddings").select(F.concat(F.lit("user_"), F.col("vec_id")).alias("key"), "embedding").join(live.select("key"), "key", "left_semi")
    near = similar.top_k_batch(users, heads, 3).join(exact.select("qid"), "qid", "left_anti")
    return exact.unionByName(near.join(live, "key").select("qid", F.lit("semantic").alias("source"), "key", "value"))


@query("SELECT conv_id, turn, 3 AS n_args, 'SET' AS command, role, md5(text) AS text_md5 FROM conversations")
def resp_parse(spark, d):
    c = derive.table(spark, d, "conversations").select("conv_id", "turn", resp.array(F.lit("SET"), F.col("role"), F.col("text")).alias("raw"))
    p = resp.parsed(c, "raw", ["conv_id", "turn"])
    return p.select("conv_id", "turn", F.size("args").alias("n_args"), F.get("args", 0).alias("command"), F.get("args", 1).alias("role"), F.md5(F.get("args", 2).cast("binary")).alias("text_md5"))


@query("SELECT doc_id, octet_length(encode(text))::INTEGER AS text_length, upper(substr(hex(encode(text)), 1, 400)) AS preview_hex FROM documents")
def text_preview(spark, d):
    docs = derive.table(spark, d, "documents")
    return docs.select("doc_id", F.octet_length("text").alias("text_length"), codec.preview_hex(F.col("text")).alias("preview_hex"))


@query("SELECT event_id, user_id::VARCHAR AS id_text, printf('%.6f', value) AS value_text, value AS value_back FROM events")
def number_codec(spark, d):
    e = derive.table(spark, d, "events")
    text: Column = codec.number_text(F.col("value"), "double")
    return e.select("event_id", codec.number_text(F.col("user_id"), "long").alias("id_text"), text.alias("value_text"), codec.number_from(text, "double").alias("value_back"))


@query("SELECT event_id, 'e' || event_id AS src_id, coalesce((props::JSON ->> 'weight')::DOUBLE, 1.0) AS weight, coalesce((props::JSON ->> 'k')::INTEGER, 3) AS k FROM events")
def json_defaults(spark, d):
    body = codec.with_defaults(F.col("props"), "weight DOUBLE, k INT", {"weight": 1.0, "k": 3})
    return derive.table(spark, d, "events").select("event_id", F.concat(F.lit("e"), F.col("event_id")).alias("src_id"), body["weight"].alias("weight"), body["k"].alias("k"))
