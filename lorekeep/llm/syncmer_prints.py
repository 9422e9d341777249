"""Document fingerprints from closed syncmers of characters, in DataFrame expressions only.

A k-mer is ``K`` characters (code points), its inner strings the runs of ``S`` characters inside; a k-mer whose least
inner hash lies at its first or last place is a closed syncmer. Whether it is one depends on its own characters alone,
so an edit elsewhere moves no anchor, and the anchors of a text may be found part by part: parts of ``PART`` places
bound the memory that a very long text takes, and an edited text reads only what the edit has changed. A fingerprint is
the ``kept`` least anchor hashes (64 bits) of the whole text, each with its first place. Two prints are compared by the
share of common anchors among the least of both, and only those count that lie on one diagonal: whose places differ by
the median shift, within ``slack`` characters.

A text without an anchor (fewer than ``K`` characters, or up to ``K - S`` more) has the hash of the whole text as its
only one. Null and empty texts have the empty print, which is like itself only (1.0). Equal texts have equal prints.
Documents with equal ids follow each other in the order of a hash of the text; null ids come last. An empty table gives
no rows; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K, S, KEPT, SLACK = 12, 6, 64, 64
#: Places of a text whose k-mers are hashed at once.
PART = 1 << 16
#: An inner string at each place: what stands ahead is kept, one code point is passed.
INNER = f"(?s)(?=(.{{{S}}}))."
LAST = (1 << 63) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def least(anchors: Column, kept: int) -> Column:
    """The ``kept`` least anchors in order, each hash at its first place."""
    return let(F.sort_array(anchors), lambda a: F.slice(F.filter(a, lambda x, i: (i == 0) | (x["h"] != F.get(a, i - 1)["h"])), 1, kept))


def anchors(text: Column, start: Column, kept: int) -> Column:
    """The least anchors of a text that stands at ``start`` of a whole one. ``least`` of several parts' is that of all, if
    neighbouring parts overlap by ``K - 1`` characters."""
    wide = K - S

    def part(t: Column, begin: Column, first: Column) -> Column:
        def syncmers(inner: Column) -> Column:
            def anchor(x: Column, i: Column) -> Column:
                last = F.get(inner, i + wide)
                middle = F.least(*(F.get(inner, i + j) for j in range(1, wide)))
                return F.when(F.least(x, last) <= middle, F.struct(F.xxhash64(x, last).alias("h"), (i + first).cast("int").alias("i")))

            return F.array_compact(F.transform(F.slice(inner, 1, F.greatest(F.size(inner) - wide, F.lit(0))), anchor))

        inner = F.regexp_extract_all(F.substring(t, begin + 1, F.lit(PART + K - 1)), F.lit(INNER), F.lit(1))
        return least(let(F.transform(inner, lambda x: F.xxhash64(x)), syncmers), kept)

    parts = lambda t: F.sequence(F.lit(0), F.greatest(F.length(t) - K, F.lit(0)), F.lit(PART))
    return let(text, lambda t: least(F.flatten(F.transform(parts(t), lambda begin: let(begin + start, lambda first: part(t, begin, first)))), kept))


def or_whole(found: Column, text: Column) -> Column:
    whole = F.array(F.struct(F.xxhash64(text).alias("h"), F.lit(0).alias("i")))
    return let(found, lambda a: F.when((F.size(a) > 0) | (F.length(text) == 0), a).otherwise(whole))


def likeness(a: Column, b: Column, kept: int = KEPT, slack: int = SLACK) -> Column:
    """0 to 1: common anchors on one diagonal over the least anchors of both."""

    def compare(both: Column) -> Column:
        x, y, low, at = both["x"], both["y"], both["low"], both["at"]
        common = F.filter(x, lambda v: F.array_contains(low, v["h"]) & F.map_contains_key(at, v["h"]))
        shifts = F.sort_array(F.transform(common, lambda v: v["i"] - at[v["h"]]))
        on_line = let(shifts, lambda s: F.size(F.filter(s, lambda d: F.abs(d - F.get(s, F.floor(F.size(s) / 2).cast("int"))) <= slack)))
        return F.when((F.size(x) == 0) & (F.size(y) == 0), F.lit(1.0)).when(F.size(low) == 0, F.lit(0.0)).otherwise(on_line / F.size(low))

    hashes = lambda z: F.transform(z, lambda v: v["h"])
    low = F.slice(F.sort_array(F.array_union(hashes(a), hashes(b))), 1, kept)
    at = F.map_from_arrays(hashes(b), F.transform(b, lambda v: v["i"]))
    return let(F.struct(a.alias("x"), b.alias("y"), low.alias("low"), at.alias("at")), compare)


def printed(a: Column) -> Column:
    """Hash and place of each anchor, in hexadecimal."""
    return F.array_join(F.transform(a, lambda x: F.concat(F.lpad(F.hex(x["h"]), 16, "0"), F.lit("@"), F.hex(x["i"]))), " ")


def thirds(text: Column) -> tuple[Column, Column]:
    """Characters that the edited text keeps, and the place from which its k-mers may hold others."""
    kept = F.length(text) - F.floor(F.length(text) / 3).cast("int")
    return kept, F.greatest(kept - (K - 1), F.lit(0))


def with_next(docs: DataFrame, kept: int, ranges: int | None = None) -> DataFrame:
    """doc_id, text, first (the anchors of what an edit keeps), marks (all anchors), and text and marks of the next document
    in descending id; after the last comes the first.

    Ranges of ids are dealt out; each also gets the first row of the range after it, so that no range needs another.
    """
    ranges = ranges or min(1024, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    text = F.coalesce("text", F.lit(""))
    own = docs.select(F.col("doc_id"), text.alias("text"), F.coalesce(-F.col("doc_id").cast("long"), F.lit(LAST)).alias("o"), F.xxhash64(text).alias("tie"))
    cuts = sorted(set(own.agg(F.percentile_approx("o", F.lit([i / ranges for i in range(1, ranges)]).cast("array<double>"), 20 * ranges)).first()[0] or []))
    known = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    own = own.withColumn("range", F.size(F.filter(known, lambda c: c < F.col("o"))))
    heads = {r["range"]: (r["head"]["o"], r["head"]["tie"]) for r in own.groupBy("range").agg(F.min(F.struct("o", "tie")).alias("head")).collect()}  # a row for each range
    used = sorted(heads)
    # (place of a head) -> the range before it; the first head also ends the last range.
    before = {heads[r]: used[i - 1] for i, r in enumerate(used)}
    guests = F.array(*[F.struct(F.lit(o).cast("long").alias("o"), F.lit(t).cast("long").alias("tie"), F.lit(r).cast("int").alias("range")) for (o, t), r in before.items()]) if before else None
    ghost = F.filter(guests, lambda g: (g["o"] == F.col("o")) & (g["tie"] == F.col("tie"))) if before else None
    home = F.struct(F.col("range").cast("int").alias("range"), F.lit(0).alias("guest"))
    places = F.concat(F.array(home), F.transform(ghost, lambda g: F.struct(g["range"].alias("range"), F.lit(1).alias("guest")))) if before else F.array(home)
    stays, joint = thirds(F.col("text"))
    dealt = own.withColumn("first", anchors(F.substring("text", F.lit(1), stays), F.lit(0), kept))
    rest = anchors(F.substring("text", joint + 1, F.length("text")), joint, kept)
    dealt = dealt.withColumn("marks", or_whole(least(F.concat("first", rest), kept), F.col("text")))
    dealt = dealt.withColumn("place", F.explode(places)).select("doc_id", "text", "first", "marks", "o", "tie", "place.range", "place.guest")
    order = Window.partitionBy("range").orderBy("guest", "o", "tie")
    return dealt.select("doc_id", "text", "first", "marks", "guest", F.lead("text").over(order).alias("next_text"), F.lead("marks").over(order).alias("next_marks")).where("guest = 0").drop("guest")


def fingerprints(docs: DataFrame, kept: int = KEPT, slack: int = SLACK) -> DataFrame:
    """The prints of each document and of its edited text (the last third replaced by the next document's beginning)."""
    stays, joint = thirds(F.col("text"))
    edited = F.concat(F.substring("text", F.lit(1), stays), F.substring("next_text", F.lit(1), F.length("text") - stays))
    both = with_next(docs, kept).withColumn("edited", edited)
    fresh = anchors(F.substring("edited", joint + 1, F.length("edited")), joint, kept)
    both = both.withColumn("edited_marks", or_whole(least(F.concat("first", fresh), kept), F.col("edited")))
    return both.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("marks")).alias("fingerprint"), printed(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(F.col("marks"), F.col("edited_marks"), kept, slack).alias("near_edited"), likeness(F.col("marks"), F.col("next_marks"), kept, slack).alias("near_next"),
    )
