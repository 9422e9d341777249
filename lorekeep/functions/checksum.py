"""Checksums of log entries and snapshots, over UTF-8 bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = 4294967296  # 2**32
#: Bytes of a log entry besides key and value: length, op, key and value lengths, time, sequence number, checksum.
ENTRY_OVERHEAD = 4 + 1 + 4 + 4 + 8 + 8 + 4


def polynomial(text: Column) -> Column:
    """h = h * 31 + byte, modulo 2**32."""
    bytes_ = F.split(F.decode(F.coalesce(text, F.lit("")).cast("binary"), "ISO-8859-1"), "")  # one pass, a character a byte
    return F.aggregate(bytes_, F.lit(0).cast("long"), lambda h, b: (h * 31 + F.ascii(b)).bitwiseAND(F.lit(MODULUS - 1)))


def entry(key: Column, value: Column) -> Column:
    return polynomial(F.concat(key, F.coalesce(value, F.lit(""))))


def entry_bytes(key: Column, value: Column) -> Column:
    return (F.lit(ENTRY_OVERHEAD) + F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))).cast("long")


def header(version: Column, records: Column, lsn: Column, created_ms: Column) -> Column:
    """The numbers of a snapshot header folded by exclusive or to 32 bits."""
    fold = lambda x: x.cast("long").bitwiseXOR(F.shiftrightunsigned(x.cast("long"), 32))
    mixed = fold(version).bitwiseXOR(fold(records)).bitwiseXOR(fold(lsn)).bitwiseXOR(fold(created_ms))
    return mixed.bitwiseAND(F.lit(MODULUS - 1))
