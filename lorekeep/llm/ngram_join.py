"""N-gram Jaccard join as a blocked sparse matrix product of documents and n-grams.

Rows of the matrix are the distinct sets of five-word shingles (documents with equal sets are one row), columns are
shingles. A global order of the columns (those met often last, by their frequency) leaves each row its first
``n - ceil(0.8 n) + 1`` entries; two rows with Jaccard likeness of 0.8 share one of them. The product runs over blocks
of columns: a block drops the columns with one entry. Then

1. each row is multiplied with the central row of its columns (a star, linear in the entries), the best of these by
   accumulated overlap is verified on the full sets, and links become components;
2. a column whose rows lie in one component is done. Rows of two components share open entries of both and, from where
   the first entries of one end, what lies behind those. As that may be either, the larger row's rest bounds it: a row's
   open entries and its own rest bound its overlap with rows no larger, and its open entries the sizes of larger ones
   that fit it. Rows that no size in their columns fits go;
3. in what is left, only rows outside a column's largest component meet the others of that column. A pair is made at
   the first column that both have (``SEEN`` earlier ones are looked up), if the entries from there on can reach the
   overlap that the two sizes ask for, and is verified on the full sets.

A pair left out in 1 lies in one component already or is met in 3, so no link between components is lost, while a
group of n near copies costs n products and, as far as its members can be near to others outside their component at
all, not n squared. The columns set last are a bounded list (``frequent``) and decide on the order only, never on the
result; ``seen`` decides only how often a pair is made before repeated ones fall together.

Words are lower-cased in A-Z. A text of one to four words is one shingle; null, empty and blank texts have the empty
set and link with nothing. Ties and repeated rows fall together by their set; an empty table gives no rows; extra
columns are ignored. A null id takes part and is never a component's id unless all ids of the component are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, Powers, Spans, cut, in_arrow, mix, signed
from .graph_spans import hashes_of

N = 5
LEAST = 80  # percent of the union
#: Most columns that are set last; three megabytes in each task.
FREQUENT = 1 << 18
#: Earlier open columns of a row that travel with each of its entries.
SEEN = 12
#: Entries that a task holds before it passes on what it has.
HELD = 1_000_000
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
POWERS = Powers(0xA0761D6478BD642F)


def shingles(raw: bytes | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = raw.translate(LOWER).split() if raw else []
    if not words:
        return np.empty(0, dtype=U64)
    spans = Spans(hashes_of(words), POWERS)
    return np.unique(mix(spans.windows(min(N, len(words))) ^ U64(min(N, len(words)))))


def need(n: np.ndarray | int) -> np.ndarray | int:
    """The least overlap of a set of n with any partner."""
    return (LEAST * n + 99) // 100


def set_key(grams: np.ndarray) -> int:
    return int(signed(mix(mix(grams).sum(dtype=U64, keepdims=True) ^ U64(len(grams))))[0])


def sizes(docs: DataFrame) -> DataFrame:
    """kind 0: a document's id, text key, set key and set size; kind 1: a shingle (in ``key``) that a task has met in
    three sets or more, with their number."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "doc_id", "text_key", "key", "n"]
        held: list[np.ndarray] = []
        seen: set[int] = set()

        def counts() -> pa.RecordBatch:
            grams, n = np.unique(np.concatenate(held) if held else np.empty(0, U64), return_counts=True)
            grams, n = grams[n > 2], n[n > 2]
            empty = pa.nulls(len(grams), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(grams), np.int32)), empty, empty, pa.array(signed(grams)), pa.array(n.astype(np.int32))], names)

        for batch in batches:
            keys, ns = [], []
            for raw in batch.column(2).cast(pa.large_binary()).to_pylist():
                grams = shingles(raw)
                key = set_key(grams)
                keys.append(key)
                ns.append(len(grams))
                if key not in seen:
                    seen.add(key)
                    held.append(grams)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ns), np.int32)), batch.column(0), batch.column(1), pa.array(keys, pa.int64()), pa.array(ns, pa.int32())], names)
            if sum(map(len, held)) > HELD:
                yield counts()
                held, seen = [], set()
        yield counts()

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text"), step, "kind int, doc_id long, text_key long, key long, n int")


ENTRY = np.dtype([("gram", "<u8"), ("key", "<i8"), ("n", "<i4"), ("place", "<i4"), ("more", "i1")])


def entries(docs: DataFrame, frequent: np.ndarray, rank: np.ndarray, blocks: int) -> DataFrame:
    """The first entries of each row by block of columns, packed. A task passes on one entry (the least row) for each of
    its columns; the others of the column are known to be needed and travel in any block. frequent: sorted columns that
    come last, in the order of rank."""
    shared = docs.sparkSession.sparkContext.broadcast((frequent, rank))  # FREQUENT of them at most

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, order_of = shared.value

        def pack(held: list[np.ndarray]) -> pa.RecordBatch:
            rows = np.concatenate(held) if held else np.empty(0, ENTRY)
            rows = rows[np.lexsort((rows["key"], rows["gram"]))]
            head = np.concatenate([[True], rows["gram"][1:] != rows["gram"][:-1]]) if len(rows) else np.empty(0, bool)
            starts = np.flatnonzero(head)
            size = np.diff(np.append(starts, len(rows)))
            leaders, others = rows[head], rows[~head]
            leaders["more"] = size > 1
            others["more"] = 2  # passed through
            block = np.concatenate([(leaders["gram"] % U64(blocks)).astype(np.int32), (np.arange(len(others)) // 512 % blocks).astype(np.int32)])
            rows = np.concatenate([leaders, others])
            order = np.argsort(block, kind="stable")
            rows, block = rows[order], block[order]
            used, at = np.unique(block, return_index=True)
            parts = np.split(rows, at[1:]) if len(used) else []
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["block", "entries"])

        held, count, seen = [], 0, set()
        for batch in batches:
            for raw in batch.column(0).cast(pa.large_binary()).to_pylist():
                grams = shingles(raw)
                n = len(grams)
                if not n or (key := set_key(grams)) in seen:
                    continue
                seen.add(key)
                if len(last):
                    found = np.minimum(np.searchsorted(last, grams), len(last) - 1)
                    late = last[found] == grams
                    grams = np.concatenate([grams[~late], grams[late][np.argsort(order_of[found[late]])]])
                rows = np.zeros(n - need(n) + 1, dtype=ENTRY)
                rows["gram"], rows["key"], rows["n"], rows["place"] = grams[: len(rows)], key, n, np.arange(len(rows))
                held.append(rows)
                count += len(rows)
            if count > HELD:
                yield pack(held)
                held, count, seen = [], 0, set()
        yield pack(held)

    return in_arrow(docs.select("text"), step, "block int, entries binary")


def shared_columns(packed_entries: DataFrame, partitions: int) -> DataFrame:
    """gram, key, n, place: the entries of columns with two rows or more, block by block."""

    def settle(held: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(held)
        through = rows[rows["more"] == 2]
        rows = rows[rows["more"] < 2]
        rows = rows[np.lexsort((rows["key"], rows["gram"]))]
        if len(rows):
            rows = rows[np.concatenate([[True], (rows["gram"][1:] != rows["gram"][:-1]) | (rows["key"][1:] != rows["key"][:-1]) | (rows["more"][1:] != rows["more"][:-1])])]
            same = np.concatenate([rows["gram"][1:] == rows["gram"][:-1], [False]])
            keep = same | np.concatenate([[False], same[:-1]]) | (rows["more"] == 1)
            rows = rows[keep]
        rows = np.concatenate([rows, through])
        names = ["gram", "key", "n", "place"]
        return pa.RecordBatch.from_arrays([pa.array(rows["gram"].copy().view(np.int64)), *(pa.array(rows[c].copy()) for c in names[1:])], names)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if block != now and held:
                    yield settle(held)
                    held = []
                now = block
                held.append(np.frombuffer(raw, dtype=ENTRY))
        if held:
            yield settle(held)

    return in_arrow(packed_entries.repartition(partitions, "block").sortWithinPartitions("block"), step, "gram long, key long, n int, place int").dropDuplicates(["gram", "key"])


def texts_of(keys: DataFrame, rows: DataFrame, docs: DataFrame) -> DataFrame:
    """key, text: a document of each row."""
    source = rows.join(keys.select("key").distinct(), "key").select("key", "source.*")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").where(F.col("text").isNotNull())
    full = texts.join(source, texts["doc_id"].eqNullSafe(source["doc_id"]) & (texts["text_key"] == source["text_key"])).select("key", "text")
    return cut(full.dropDuplicates(["key"]), "candidates")


def verified(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """The pairs (a, b) of rows whose full sets meet the bound; full: key, text of all of them."""
    left = pairs.join(full.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(full.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sets = None, None
        for batch in batches:
            keep = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2).cast(pa.large_binary()).to_pylist(), batch.column(3).cast(pa.large_binary()).to_pylist(), strict=True):
                if a != last:
                    last, sets = a, shingles(x)
                other = shingles(y)
                both_have = len(np.intersect1d(sets, other, assume_unique=True))
                keep.append(100 * both_have >= LEAST * (len(sets) + len(other) - both_have))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return in_arrow(both, step, "a long, b long")


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key")))


def size_fits(x: Column, y: Column) -> Column:
    return 100 * F.least(x, y) >= LEAST * F.greatest(x, y)


def need_of(n: Column) -> Column:
    return F.floor((n * LEAST + 99) / 100)


def overlap_of(x: Column, y: Column) -> Column:
    """The least overlap of two linked sets of these sizes."""
    return F.ceil((x + y) * LEAST / (100 + LEAST))


def open_entries(columns: DataFrame, roots: DataFrame) -> DataFrame:
    """gram, key, n, place, root, home, most, over, large: the entries in columns of several components. ``home``: the row
    is of the column's largest component; ``most``: the largest size of a partner that is no larger than the row;
    ``large``: such a size fits; ``over``: a larger partner's size lies above it. Left are the columns with a large row,
    and in them the rows that are large or may fit a larger one there."""
    placed = cut(columns.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")), "placed")
    by_root = placed.groupBy("gram", "root").agg(F.count("*").alias("rows"))
    spread = by_root.groupBy("gram").agg(F.max_by("root", F.struct("rows", "root")).alias("largest"), F.count("*").alias("roots")).where("roots > 1")
    left = cut(placed.join(cut(spread.drop("roots"), "open"), "gram").withColumn("home", F.col("root") == F.col("largest")).drop("largest"), "open-entries")
    # What two rows share is met in open columns of both, until the first entries of one end; then it lies behind those.
    # Which of the two that is remains open, so the larger one's rest bounds it.
    n = F.col("n")
    bounds = left.groupBy("key", "n").agg(F.count("*").alias("open"))
    bounds = bounds.withColumn("most", most_of(F.col("open") + need_of(n) - 1, n)).withColumn("over", over_of(F.col("open"), n))
    bounds = cut(bounds.select("key", "most", "over", (F.col("most") >= need_of(n)).alias("large")), "bounds")
    left = left.join(bounds, "key")
    wide = cut(left.where("large").groupBy("gram").agg(F.min("n").alias("narrowest"), F.max("n").alias("widest")), "wide")
    fits_larger = (F.col("widest") > F.greatest("n", "over")) & (100 * n >= LEAST * F.col("narrowest"))
    return left.join(wide, "gram").where(F.col("large") | fits_larger).drop("narrowest", "widest")


def most_of(reach: Column, n: Column) -> Column:
    """The largest size of a partner of a set of n that shares ``reach`` with it at most."""
    return F.floor(reach * (100 + LEAST) / LEAST) - n


def over_of(count: Column, n: Column) -> Column:
    """A partner of m >= n that shares ``count`` entries with a set of n, and what lies behind its own first ones, can
    reach the bound only if m is above this."""
    return F.floor((100 * LEAST * n - 100 * (100 + LEAST) * count) / (LEAST * LEAST))


def pairs_across(left: DataFrame, seen: int) -> DataFrame:
    """Pairs (a, b) of rows of different components, a no smaller than b, made at the first open column that both have."""
    row = ["key", "n", "root", "most", "over", "large"]
    each = left.groupBy(*row).agg(F.sort_array(F.collect_list(F.struct("place", "gram", "home"))).alias("own"))
    each = each.withColumn("before", F.transform(F.slice("own", 1, seen), lambda x: x["gram"]))
    dealt = each.select(*row, "before", F.size("own").alias("size"), F.posexplode("own").alias("at", "x"))
    dealt = dealt.select(*row, F.col("x.gram").alias("gram"), F.col("x.home").alias("home"), (F.col("size") - F.col("at")).alias("rest"), F.slice("before", F.lit(1), F.least("at", F.lit(seen))).alias("before"))
    dealt = cut(dealt, "dealt")
    other = dealt.select("gram", *[F.col(c).alias(f"{c}_b") for c in ("key", "n", "root", "over", "large", "home", "rest", "before")])
    once = (F.col("n") > F.col("n_b")) | (F.col("large_b") & (F.col("n") == F.col("n_b")) & (F.col("key") < F.col("key_b")))
    fits = once & (F.col("root") != F.col("root_b")) & size_fits(F.col("n"), F.col("n_b")) & (F.col("n_b") <= F.col("most")) & (F.col("n") > F.col("over_b"))
    fits &= F.least("rest", "rest_b") + need_of(F.col("n")) - 1 >= overlap_of(F.col("n"), F.col("n_b"))
    fits &= ~F.arrays_overlap("before", "before_b")
    # Two rows of the largest component are never joined.
    large = dealt.where("large")
    met = large.where("NOT home").join(other, "gram").where(fits).select("key", "key_b")
    met = met.union(large.where("home").join(other.where("NOT home_b"), "gram").where(fits).select("key", "key_b"))
    return met.select(F.col("key").alias("a"), F.col("key_b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """key, root: the least key of the component, for the keys in links. Large and small stars by turns; each turn is a
    table in the shared folder, and nothing but its size and checksum comes to the driver."""
    now = cut(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u < v").distinct(), "links")
    mark = None
    while True:
        every = now.union(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = every.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = every.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u < v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").where("u != m").select(F.col("u").alias("v"), F.col("m").alias("u")).union(low.select("v", F.col("m").alias("u")))
        now = cut(small.where("u < v").distinct(), "links")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    stars = now.groupBy("v").agg(F.min("u").alias("root")).select(F.col("v").alias("key"), "root")
    return stars.union(now.select(F.col("u").alias("key"), F.col("u").alias("root")).distinct().join(stars.select("key"), "key", "left_anti"))


def jaccard_components(docs: DataFrame, frequent: int = FREQUENT, seen: int = SEEN) -> DataFrame:
    """doc_id, n_shingles, component_id and ``text_key`` (Spark's xxhash64 of the text) of every document."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    read = cut(sizes(docs), "sizes")
    known = read.where("kind = 0")
    often = read.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(frequent)
    met = [(r["key"], r["n"]) for r in often.collect()]
    last = np.array([k for k, _ in met], dtype=np.int64).view(U64)
    order = np.argsort(last)
    rank = np.arange(len(last), dtype=np.int32)[::-1]  # the most frequent comes last of all
    total = known.agg(F.sum(F.col("n") - F.ceil(F.col("n") * LEAST / 100) + 1)).first()[0] or 0
    blocks = max(4 * partitions, int(total) // 500_000)
    columns = cut(shared_columns(entries(docs, last[order], rank[order], blocks), partitions), "columns")
    rows = known.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "text_key")).alias("source"))

    # The row that shares most, as the text that others were edited from does, leads each of its columns.
    shared_by = cut(columns.groupBy("gram").agg(F.count("*").alias("rows")), "frequency")
    weight = cut(columns.join(shared_by, "gram").groupBy("key").agg(F.sum("rows").alias("weight")), "weight")
    lead = columns.join(weight, "key").groupBy("gram").agg(F.max_by(F.struct("key", "n"), F.struct("weight", "key")).alias("lead"))
    lead = cut(lead, "lead")
    star = columns.join(lead, "gram").where((F.col("key") != F.col("lead.key")) & size_fits(F.col("n"), F.col("lead.n")))
    star = star.groupBy("key", F.col("lead.key").alias("a")).agg(F.count("*").alias("overlap"))
    best = cut(star.groupBy("key").agg(F.max_by("a", F.struct("overlap", "a")).alias("a")).select("a", F.col("key").alias("b")), "star-pairs")
    links = cut(verified(best, texts_of(ends_of(best), rows, docs)), "star-links")
    roots = components(links)

    pairs = cut(pairs_across(open_entries(columns, roots), seen), "pairs")
    links = cut(links.union(verified(pairs, texts_of(ends_of(pairs), rows, docs))), "links")
    roots = components(links)

    named = rows.join(roots, "key", "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = named.join(smallest, "root").select("key", "component_id")
    alone = known.where("n = 0").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), "text_key")
    linked = known.where("n > 0").join(ids, "key").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "text_key")
    return linked.union(alone)
