"""Row types of the engine's tables; fixed when a table is made."""

from pyspark.sql import types as T


KINDS = {"LONG": T.LongType(), "INT": T.IntegerType(), "FLOAT": T.FloatType(), "STRING": T.StringType(), "ARRAY<FLOAT>": T.ArrayType(T.FloatType())}


def of(fields: str) -> T.StructType:
    """Field names and kinds; read here, as Spark's own DDL parser needs a session."""
    return T.StructType([T.StructField(name, KINDS[kind]) for name, kind in (x.split() for x in fields.split(","))])


KV_LOG = of("lsn LONG, ts_ms LONG, op STRING, key STRING, value STRING, ttl_ms LONG")
KV_STATE = of("key STRING, value STRING, put_ms LONG, expiry_ms LONG, lsn LONG, shard INT")
VECTORS = of("key STRING, embedding ARRAY<FLOAT>, metadata STRING, expiry_ms LONG")
NODES = of("node_id STRING, properties_json STRING")
EDGES = of("src_id STRING, dst_id STRING, label STRING, weight FLOAT, properties_json STRING, seq LONG")
NODE_VECTORS = of("node_id STRING, embedding ARRAY<FLOAT>")
SNAPSHOT_META = of("snapshot_lsn LONG, record_count LONG, created_ms LONG, version INT, checksum LONG")
SNAPSHOT_VERSION = 1
