"""What the text operators share: tables in the shared folder, words, hashes and Arrow plumbing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but the space and the characters 9 to 13; ``bytes.split()`` cuts UTF-8 at just these.
WORD = r"[^\x20\x09-\x0D]+"
#: The seed of Spark's ``xxhash64``, so that keys made in Python and in the JVM agree.
SPARK_SEED = 42
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is named and all runs in one process
    (as in tests): elsewhere executors would write where nobody else can read."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="lorekeep-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it again: lineage ends here, and a lost executor
    costs a read, not the work. The table goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


KEPT: dict[tuple, object] = {}


def kept_in_worker(make: Callable, *args):
    """``make(*args)``, made once in a Python worker while it works for one operator. Workers live on from stage to stage;
    what the operator before has left (a vocabulary with its cache of words) goes first, so that never two lie there."""
    key = (make.__module__, make.__qualname__, *args)
    if key not in KEPT:
        KEPT.clear()
        KEPT[key] = make(*args)
    return KEPT[key]


def release() -> None:
    KEPT.clear()


def in_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, keeps: bool = False) -> DataFrame:
    """``keeps``: ``fn`` uses ``kept_in_worker``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            release()
        yield from fn(batches)

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The values of a string column as UTF-8 bytes, without decoding them."""
    return column.cast(pa.large_binary()).to_pylist()


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64: a bijection that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64, grown as texts need them."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4096)
            self.up, self.down = (np.concatenate([np.ones(1, U64), np.cumprod(np.full(size - 1, b, dtype=U64))]) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


class Spans:
    """Hashes of any run of words in constant time: a polynomial over word hashes, by prefix sums modulo 2**64."""

    def __init__(self, word_hashes: np.ndarray, powers: Powers) -> None:
        up, self.down = powers.upto(len(word_hashes) + 1)
        self.sums = np.zeros(len(word_hashes) + 1, dtype=U64)
        np.cumsum(word_hashes * up[: len(word_hashes)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def windows(self, width: int) -> np.ndarray:
        """The hash of each run of ``width`` words."""
        n = len(self.sums) - width
        return (self.sums[width:] - self.sums[:n]) * self.down[:n]


def packed(values: list[np.ndarray], dtype: type) -> np.ndarray:
    return np.concatenate(values).astype(dtype, copy=False) if values else np.empty(0, dtype)


def text_or_empty(column: str = "text") -> F.Column:
    return F.coalesce(F.col(column), F.lit(""))
