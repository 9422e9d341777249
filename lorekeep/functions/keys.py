"""Typed key space: escaping, builders and parsers of prefixed keys, and shard routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def escape(id_: Column) -> Column:
    """A backslash before each backslash and colon."""
    return F.replace(F.replace(id_, F.lit("\\"), F.lit("\\\\")), F.lit(":"), F.lit("\\:"))


def unescape(id_: Column) -> Column:
    return F.regexp_replace(id_, r"\\(.)", "$1")


def node_key(id_: Column) -> Column:
    return F.concat(F.lit("n:"), escape(id_))


def vector_key(id_: Column) -> Column:
    return F.concat(F.lit("vec:"), escape(id_))


def edge_key(src: Column, dst: Column, label: Column) -> Column:
    return F.concat_ws(":", F.lit("e"), escape(src), escape(dst), escape(label))


def adjacency_key(direction: str, id_: Column) -> Column:
    return F.concat(F.lit(f"adj:{direction}:"), escape(id_))


def counter_key(src: Column, dst: Column) -> Column:
    return F.concat_ws(":", F.lit("ec"), escape(src), escape(dst))


def segments(key: Column) -> Column:
    """The parts of a key between unescaped colons, unescaped. Empty parts count: a mark is put before each part first,
    so that every match has at least the mark."""
    marked = F.concat(F.lit(":"), key)
    parts = F.regexp_extract_all(marked, F.lit(r"(:(?:[^:\\]|\\.)*)"), F.lit(1))
    return F.transform(parts, lambda p: unescape(F.substring(p, 2, 1 << 30)))


def shard(key: Column, shards: int) -> Column:
    """Routing that any SQL engine can repeat: the first 32 bits of the key's MD5."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(shards)).cast("int")


def fast_shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")
