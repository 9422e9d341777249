"""The array protocol of key-value clients: parsing commands and writing replies."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse(raw: bytes | None) -> list[str] | None:
    """The arguments of the first message; None if it is not a whole array of strings. What follows is ignored."""
    if not raw or raw[:1] != b"*":
        return None

    def number(at: int, mark: bytes) -> tuple[int, int] | None:
        end = raw.find(b"\r\n", at)
        if end < 0 or raw[at : at + 1] != mark:
            return None
        digits = raw[at + 1 : end]
        return (int(digits), end + 2) if digits.lstrip(b"-").isdigit() else None

    head = number(0, b"*")
    if head is None:
        return None
    count, at = head
    out: list[str] = []
    for _ in range(count):
        size = number(at, b"$")
        if size is None or size[0] < 0 or size[1] + size[0] + 2 > len(raw):
            return None
        n, at = size
        out.append(raw[at : at + n].decode("utf-8", "replace"))
        if raw[at + n : at + n + 2] != b"\r\n":
            return None
        at += n + 2
    return out


def parsed(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """``keys`` and the arguments of each message."""
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column(len(keys)).cast(pa.large_binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array([parse(r) for r in raws], pa.list_(pa.string()))], [*keys, "args"])

    return df.select(*keys, column).mapInArrow(step, f"{kinds}, args array<string>")


def bulk(s: Column) -> Column:
    return F.coalesce(F.concat(F.lit("$"), F.octet_length(s).cast("string"), F.lit("\r\n"), s, F.lit("\r\n")), F.lit("$-1\r\n"))


def array(*parts: Column) -> Column:
    return F.concat(F.lit(f"*{len(parts)}\r\n"), *[bulk(p) for p in parts])


def simple(s: Column) -> Column:
    return F.concat(F.lit("+"), s, F.lit("\r\n"))


def error(s: Column) -> Column:
    return F.concat(F.lit("-"), s, F.lit("\r\n"))
