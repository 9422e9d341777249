"""Substring deduplication by compaction of a De Bruijn graph of token k-mers.

The edges of the graph are k-mers of words, sampled so that every window of ``WINDOW`` words names exactly one of its
k-mers (the one with the least hash, the leftmost of equals); equal windows name equal edges. The windows that name one
occurrence of an edge are neighbours; an edge and the hash of the words that its windows cover are a *node*, so an edge
with several surroundings branches into several nodes. Then

* an edge that occurs once has no repeated window and goes;
* nodes that occur twice or more are linked to what follows them at once in a text. Where all occurrences of a node have
  one successor, and all of that one this predecessor (out and in degree one), the path does not branch, and joins by
  pointer doubling compact it: each round doubles how far a node sees, so a path of n nodes takes log2(n) rounds. A chain
  cannot close to a ring, as the last occurrence in a text has no successor;
* source coordinates (a key of the text and a first window) lead every occurrence of a path back to its words, and the
  whole span counts as repeated only if its 128-bit hash is found twice. If two surroundings had one hash by chance,
  the windows of that path are compared one by one;
* a node that occurs once on an edge with others is compared window by window, by 128-bit hashes of its words, with the
  others of its edge and one witness of each node that is repeated.

Windows are judged on the input, so all copies of a repeated passage go, the first included. Null texts have no words;
texts of fewer words than a window keep all. Equal texts share their coordinates, so a large group of copies is one
entry of the graph. Ties and repeated rows get equal results and an empty table gives no rows. Further columns pass
through, whatever their names; those named ``n_words``, ``n_removed`` or ``kept`` are replaced by the results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPARK_SEED, U64, Powers, Spans, cut, in_arrow, mix, packed, signed

WINDOW, K = 35, 8
#: Bits of the hash of surroundings; fewer only make more paths fail their verification.
AROUND_BITS = 64
FIRST, SECOND = Powers(0x9E3779B97F4A7C15), Powers(0xD1342543DE82EF95)


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=U64, count=len(words))


def edges_of(words: np.ndarray) -> tuple[np.ndarray, ...] | None:
    """Edge hash, neighbourhood hash, first window and number of windows, for each sampled edge of a text."""
    m = len(words) - WINDOW + 1
    if m < 1:
        return None
    spans = Spans(words, FIRST)
    kmers = mix(spans.windows(K))
    at = np.lib.stride_tricks.sliding_window_view(kmers, WINDOW - K + 1).argmin(axis=1) + np.arange(m)
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    count = np.diff(np.append(first, m))
    place = at[first]
    around = mix(spans.of(first, first + count - 1 + WINDOW) ^ ((place - first).astype(U64) << U64(32)) ^ (count.astype(U64) << U64(48)))
    return kmers[place], around, first, count


def edges(docs: DataFrame, text: str, around_bits: int) -> DataFrame:
    """Occurrences of sampled edges. A task reports a text that it meets again once more and then no more: whether
    something occurs twice is all that is asked."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, int] = {}
        for batch in batches:
            rows: list[list[np.ndarray]] = [[], [], [], [], []]
            for raw in batch.column(0).cast(pa.large_binary()).to_pylist():
                words = raw.split() if raw else ()
                if len(words) < WINDOW:
                    continue
                key = xxhash.xxh64_intdigest(raw, seed=SPARK_SEED)
                met[key] = met.get(key, 0) + 1
                if met[key] > 2:
                    continue
                edge, around, first, count = edges_of(hashes_of(words))
                around = around >> U64(64 - around_bits)
                for held, values in zip(rows, (edge, around, np.full(len(edge), key, dtype=U64), first, count), strict=True):
                    held.append(values)
            longs = [pa.array(signed(packed(x, U64))) for x in rows[:3]]
            yield pa.RecordBatch.from_arrays([*longs, *(pa.array(packed(x, np.int32)) for x in rows[3:])], ["edge", "around", "key", "first", "count"])

    return in_arrow(docs.select(text), step, "edge long, around long, key long, first int, count int")


def windows(texts: DataFrame) -> DataFrame:
    """128-bit hashes of source words (texts: key, text, spans): one for a whole span, else one for each window."""
    names = ["one", "two", "key", "first", "count", "path"]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for key, raw, spans in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = hashes_of(raw.split())
                one, two = Spans(words, FIRST), Spans(mix(words), SECOND)
                first, size, path = (np.array([s[c] for s in spans]) for c in ("first", "count", "path"))
                alone = np.array([s["whole"] for s in spans])
                single = np.unique(np.concatenate([np.arange(f, f + c) for f, c in zip(first[~alone], size[~alone], strict=True)])) if (~alone).any() else np.empty(0, np.int64)
                at = np.concatenate([first[alone], single])
                n = np.concatenate([size[alone], np.ones(len(single), np.int64)])
                end = at + n - 1 + WINDOW
                of = np.concatenate([path[alone], np.zeros(len(single), np.int64)])
                for held, values in zip(rows, (one.of(at, end), two.of(at, end), np.full(len(at), key, dtype=np.int64).view(U64), at, n, of), strict=True):
                    held.append(values)
            longs = [pa.array(signed(packed(x, U64))) for x in rows[:3]]
            yield pa.RecordBatch.from_arrays([*longs, *(pa.array(packed(x, np.int32)) for x in rows[3:5]), pa.array(packed(rows[5], np.int64))], names)

    return in_arrow(texts, step, "one long, two long, key long, first int, count int, path long")


def graph(nodes: DataFrame) -> DataFrame:
    """node, windows, previous: for each node the one that it continues without a branch, if there is one (nodes: node,
    key, first, count, each place of a text once)."""
    order = Window.partitionBy("key").orderBy("first")
    after, before = F.lead(F.struct("node", "first")).over(order), F.lag(F.struct("node", "first", "count")).over(order)
    steps = nodes.select("node", "first", "count", after.alias("after"), before.alias("before")).select(
        "node", "count",
        F.when(F.col("after.first") == F.col("first") + F.col("count"), F.col("after.node")).alias("out"),
        F.when(F.col("first") == F.col("before.first") + F.col("before.count"), F.col("before.node")).alias("into"),
    )
    one = lambda c: F.when((F.count(c) == F.count("*")) & (F.min(c) == F.max(c)), F.min(c))
    degrees = cut(steps.groupBy("node").agg(F.max("count").cast("long").alias("windows"), one("out").alias("out"), one("into").alias("into")), "nodes")
    links = degrees.where("out IS NOT NULL").select(F.col("node").alias("previous"), F.col("out").alias("node"))
    own = degrees.join(links, "node", "left").select("node", "windows", F.when(F.col("previous") == F.col("into"), F.col("previous")).alias("previous"))
    return cut(own.groupBy("node").agg(F.max("windows").alias("windows"), F.max("previous").alias("previous")), "graph")


def compacted(own: DataFrame) -> DataFrame:
    """head, windows: the paths of the graph, each by its first node, with the number of windows on it."""
    now = cut(own.where("previous IS NOT NULL").select("node", F.col("previous").alias("head"), F.lit(True).alias("moved")), "path")
    while not now.where("moved").isEmpty():
        far = now.select(F.col("node").alias("head"), F.col("head").alias("farther"))
        now = cut(now.join(far, "head", "left").select("node", F.coalesce("farther", "head").alias("head"), F.col("farther").isNotNull().alias("moved")), "path")
    return own.join(now.select("node", "head"), "node", "left").groupBy(F.coalesce("head", "node").alias("head")).agg(F.sum("windows").cast("int").alias("windows"), F.count("*").alias("nodes"))


def repeated_spans(docs: DataFrame, text: str = "text", around_bits: int = AROUND_BITS) -> DataFrame:
    """key (of a text), spans: runs of window starts (first, count) whose windows occur elsewhere too."""
    occurrences = cut(edges(docs, text, around_bits), "edges")
    repeated = occurrences.groupBy("edge").agg(F.count("*").alias("n"), ((F.min("around") == F.max("around")) & (F.min("count") == F.max("count"))).alias("straight")).where("n > 1").drop("n")
    # Sums by key are tables before they are joined: Spark can then split a join whose key is hot.
    met = cut(occurrences.join(cut(repeated, "repeated"), "edge"), "repeated-edges")
    branching = met.where(~F.col("straight"))
    nodes = branching.groupBy("edge", "around", "count").agg(F.count("*").alias("n"), F.min(F.struct("key", "first")).alias("witness"))
    split = branching.join(cut(nodes, "branches"), ["edge", "around", "count"]).select("edge", "around", "key", "first", "count", "n", (F.col("witness") == F.struct("key", "first")).alias("is_witness"))
    split = cut(split, "split-edges")
    place = ("key", "first", "count")
    node = F.xxhash64("edge", "around", "count").alias("node")
    again = cut(met.where("straight").select(node, *place).unionByName(split.where("n > 1").select(node, *place)).dropDuplicates(["key", "first"]), "repeated-nodes")
    own = graph(again)
    paths = cut(compacted(own), "paths")
    along = again.join(paths.select(F.col("head").alias("node"), "windows"), "node").select("key", "first", F.col("windows").alias("count"), F.lit(True).alias("whole"), F.col("node").alias("path"))
    lone = split.where("n = 1 OR is_witness").select(*place, F.lit(False).alias("whole"), F.lit(0).cast("long").alias("path"))
    texts = docs.select(F.xxhash64(text).alias("key"), F.col(text).alias("text")).where(F.col(text).isNotNull())

    def compared(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Hashed spans, and those that are found twice."""
        asked = cut(spans.groupBy("key").agg(F.collect_set(F.struct("first", "count", "whole", "path")).alias("spans")), "asked")
        found = cut(windows(texts.join(asked, "key")), "windows")
        twice = cut(found.groupBy("one", "two", "count").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "twice")
        return found, found.join(twice, ["one", "two", "count"]).select(*place)

    found, settled = compared(along.unionByName(lone))
    # A path is repeated as a whole, unless two surroundings had one hash: its windows are then compared one by one.
    bad = cut(found.where("path <> 0").groupBy("path", "count").agg(F.min("one").alias("a"), F.max("one").alias("b"), F.min("two").alias("c"), F.max("two").alias("d")).where("a <> b OR c <> d").select("path"), "unequal-paths")
    if not bad.isEmpty():
        settled = settled.unionByName(compared(along.join(bad, "path").withColumn("whole", F.lit(False)).unionByName(lone))[1])
    return settled.groupBy("key").agg(F.collect_set(F.struct("first", "count")).alias("spans"))


def remove_repeats(docs: DataFrame, text: str = "text", around_bits: int = AROUND_BITS) -> DataFrame:
    """The rows of ``docs`` with n_words, n_removed and kept (the words that stay, joined by one space)."""
    spans = cut(repeated_spans(docs, text, around_bits), "spans")
    results = ["n_words", "n_removed", "kept"]
    fields = [f for f in docs.schema if f.name not in results or f.name == text]
    # Columns go by number, so that no name can clash.
    own = docs.select(F.xxhash64(text).alias("key"), F.col(text).alias("own_text"), *(F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(fields)))
    passed = [i for i, f in enumerate(fields) if f.name not in results]
    joined = own.join(spans, "key", "left").select("own_text", "spans", *(f"c{i}" for i in passed))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = [], [], []
            for raw, runs in zip(batch.column(0).cast(pa.large_binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = raw.split() if raw else []
                gone = 0
                if runs:
                    edge = np.zeros(len(words) + 1, dtype=np.int32)
                    first = np.array([s["first"] for s in runs])
                    np.add.at(edge, first, 1)
                    np.add.at(edge, first + np.array([s["count"] for s in runs]) - 1 + WINDOW, -1)
                    stays = np.cumsum(edge[:-1]) == 0
                    gone = len(words) - int(stays.sum())
                counts.append(len(words))
                removed.append(gone)
                kept.append(b" ".join([w for w, s in zip(words, stays.tolist(), strict=True) if s] if gone else words))
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], [*batch.schema.names[2:], *results])

    schema = "".join(f"`c{i}` {fields[i].dataType.simpleString()}, " for i in passed)
    return in_arrow(joined, step, f"{schema}n_words long, n_removed long, kept string").toDF(*(fields[i].name for i in passed), *results)
