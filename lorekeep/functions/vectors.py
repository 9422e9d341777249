"""Vector expressions over arrays of floats, in double arithmetic."""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = {"cosine": "cosine", "euclidean": "l2", "l2": "l2", "dot_product": "dot", "dot": "dot"}
TINY = 1e-8  # a smaller product of norms counts as zero


def parse_metric(name: str) -> str:
    """An unknown metric is read as L2."""
    return METRICS.get(name.lower(), "l2")


def double(v: Column) -> Column:
    return v.cast("array<double>")


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(np.float32(x))) for x in values]) if values else F.array().cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(double(a), double(b), lambda x, y: x * y))


def l2_squared(a: Column, b: Column) -> Column:
    """0 for empty vectors."""
    return total(F.zip_with(double(a), double(b), lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm vanishes."""
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norms < TINY, F.lit(0.0)).otherwise(dot(a, b) / norms)


def distance(metric: str, a: Column, b: Column) -> Column:
    return {"cosine": cosine, "dot": dot, "l2": l2_squared}[parse_metric(metric)](a, b)


def best_is_large(metric: str) -> bool:
    return parse_metric(metric) != "l2"


def normalize(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm == 0, double(v)).otherwise(F.transform(double(v), lambda x: x / norm))


def is_valid(v: Column) -> Column:
    """Not null, not empty, all numbers finite."""
    return F.coalesce((F.size(v) > 0) & F.forall(double(v), lambda x: ~F.isnan(x) & (F.abs(x) != F.lit(math.inf))), F.lit(False))


def to_bytes(values: list[float]) -> bytes:
    return np.asarray(values, dtype="<f4").tobytes()


def from_bytes(raw: bytes | None) -> list[float] | None:
    """None unless the length is a multiple of four."""
    return np.frombuffer(raw, "<f4").tolist() if raw is not None and len(raw) % 4 == 0 else None


def encode(v: Column | str) -> Column:
    """Vectors as little-endian bytes (made when it is called: workers import this module without a session)."""

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else to_bytes(x))

    return run(v)


def decode(v: Column | str) -> Column:
    @F.pandas_udf("array<float>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(from_bytes)

    return run(v)


def scores(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """Row per query, column per vector."""
    kind = parse_metric(metric)
    products = queries @ rows.T
    if kind == "dot":
        return products
    squares_q, squares_r = (queries**2).sum(1), (rows**2).sum(1)
    if kind == "l2":
        return np.maximum(squares_q[:, None] - 2 * products + squares_r[None], 0)
    norms = np.sqrt(squares_q[:, None] * squares_r[None])
    return np.where(norms < TINY, 0.0, products / np.where(norms < TINY, 1.0, norms))


def partial_top(queries: dict[int, list[float]], k: int, metric: str, block: int = 4096):
    """An Arrow step: of each batch, the k best ids for each query, by one matrix product a block."""
    ids = list(queries)
    matrix = np.array([queries[i] for i in ids], dtype=np.float32).astype(np.float64)
    sign = -1.0 if best_is_large(metric) else 1.0

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                some = batch.slice(at, block)
                names = some.column(0).to_pylist()
                values = some.column(1)
                rows = np.asarray(values.flatten(), dtype=np.float32).reshape(len(names), -1).astype(np.float64)
                found = scores(matrix, rows, metric)
                out: list[tuple] = []
                for q, row in zip(ids, found, strict=True):
                    cut = np.partition(sign * row, k - 1)[k - 1] if len(row) > k else np.inf
                    out += [(q, names[j], float(row[j])) for j in np.flatnonzero(sign * row <= cut + 1e-9)]
                columns = list(zip(*out, strict=True)) if out else [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.float64())], ["qid", "key", "score"])

    return step


def approx_equal(a: Column, b: Column, within: float = 1e-4) -> Column:
    """Near by difference or by difference relative to the larger of the two. NaN is near to nothing, an infinite number
    only to itself; null where either is."""
    larger = F.greatest(F.abs(a), F.abs(b))
    finite = larger < F.lit(math.inf)  # NaN is larger than all numbers
    return (finite & (F.abs(a - b) <= within * F.greatest(larger, F.lit(1.0)))) | (~finite & ~F.isnan(larger) & (a == b))
