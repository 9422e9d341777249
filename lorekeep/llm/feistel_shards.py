"""Sharding by a Feistel permutation of global row numbers, in DataFrame expressions only.

Rows are numbered 0 .. N-1 in the order of their id: the numbering is cut to ranges of ids, each range numbers its own
rows, and the ranges before it give its first number. A Feistel network over a grid a x b, with a*b just over N and
keyed by the seed, permutes the numbers; a value that falls outside 0 .. N-1 walks on along its cycle until it is
inside. Place p of the shuffled order is shard ``p mod shards``, slot ``p div shards``: both are computable from a
row number alone, shards differ by one row at most, and slots have no gaps.

Null ids come first, null texts count no bytes. Equal rows take neighbouring numbers and so lie in different places.
An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROUNDS = 6
#: Ranges of ids that number their rows independently; their first numbers are one row each.
RANGES = 256


def mod(a: Column, m: int) -> Column:
    return F.pmod(a, F.lit(m).cast("long"))


def feistel(x: Column, a: int, b: int, seed: int) -> Column:
    """A permutation of 0 .. a*b-1. ``x`` is bound once in each round, so that the expression stays small."""
    halves = F.struct(F.floor(x / F.lit(b)).cast("long").alias("l"), mod(x, b).alias("r"))

    def turn(now: Column, k: Column) -> Column:
        left, right = now["l"], now["r"]
        even = F.struct(mod(left + mod(F.xxhash64(right, k, F.lit(seed)), a), a).alias("l"), right.alias("r"))
        odd = F.struct(left.alias("l"), mod(right + mod(F.xxhash64(left, k, F.lit(seed)), b), b).alias("r"))
        return F.when(k % 2 == 0, even).otherwise(odd)

    return F.aggregate(F.array(*[F.lit(k) for k in range(ROUNDS)]), halves, turn, lambda s: s["l"] * F.lit(b) + s["r"])


def permuted(number: Column, rows: int, seed: int) -> Column:
    """The place of a row number in the shuffled order of ``rows`` rows."""
    a = max(1, math.isqrt(max(rows - 1, 0)) + 1)
    b = max(1, -(-rows // a))
    outside = a * b - rows  # below a: a cycle meets at most so many values outside before it is inside again
    walk = F.sequence(F.lit(0), F.lit(min(outside, 64)))
    inside = F.aggregate(walk, number.cast("long"), lambda p, k: F.when((k > 0) & (p < rows), p).otherwise(feistel(p, a, b, seed)))
    return F.when(inside < rows, inside).otherwise(F.raise_error(F.lit("cycle walking did not end")).cast("long"))


def shard(docs: DataFrame, shards: int = 40, seed: int = 7) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is ``rows``), row_number."""
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    cuts = docs.agg(F.percentile_approx("doc_id", F.lit([i / RANGES for i in range(1, RANGES)]).cast("array<double>"), 20 * RANGES)).first()[0]
    cuts = sorted(set(cuts or []))
    known = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    rows = rows.withColumn("range", F.coalesce(F.size(F.filter(known, lambda c: c < F.col("doc_id"))), F.lit(-1)))
    # Equal rows are one row with a count until they are numbered, so that a hot row is counted before the exchange.
    kinds = rows.groupBy("range", "doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    first = {r["range"]: r["n"] for r in kinds.groupBy("range").agg(F.sum("copies").alias("n")).collect()}  # RANGES rows at most
    starts, total = {}, 0
    for r in sorted(first):
        starts[r], total = total, total + first[r]
    base = F.create_map(*[F.lit(x).cast(t) for r, n in starts.items() for x, t in ((r, "int"), (n, "long"))]) if starts else F.create_map().cast("map<int,bigint>")
    order = Window.partitionBy("range").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
    before = F.coalesce(F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = kinds.withColumn("row_number", base[F.col("range")] + before).withColumn("row_number", F.explode(F.sequence(F.col("row_number"), F.col("row_number") + F.col("copies") - 1)))
    placed = numbered.withColumn("place", permuted(F.col("row_number"), total, seed))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        mod(F.col("place"), shards).cast("int").alias("shard"),
        F.floor(F.col("place") / F.lit(shards)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )
