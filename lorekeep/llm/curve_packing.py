"""Packing along a space-filling curve.

Each document is tokenised once; its tokens are hashed to a vector of fixed size, which a fixed random matrix projects
to three dimensions. Their Hilbert key orders the corpus, so that neighbours on the curve are near in content. The
order is cut to ranges of about equal token counts, four for each shuffle partition; a range's first token has a known
global offset (sums of the ranges before it), so every task lays its documents end to end and cuts them at multiples of
the sequence length with no further exchange. Only the last sequence of all has padding, and that one is padded to a power of two only.

Null and empty texts are documents of the one end id. Added tokens that stand in a text have their own ids, as the
library gives them. Ties on the curve are ordered by a hash of the id, then the id;
equal rows lie next to each other. A text of any length is cut freely over sequences. An empty table gives no pieces.
Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_arrow, kept_in_worker

SEQUENCE = 4096
END_ID = 2
BITS, HASHED, SHOWN = 10, 256, 3
#: A document counts once more in the bounds of the ranges for each so many tokens.
WEIGHED = 512
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_to int"

#: What comes before the merges in the tokeniser whose words are cut here; another one cuts each word by itself.
BEFORE_MERGES = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)
#: Letters that are one code point in NFC and in lower case (I with a dot is two), beside those of ASCII.
LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
SIMPLE = re.compile(f"[!-~{LATIN}]+")
PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LATIN}]+|[0-9]|[^a-z{LATIN}0-9]+")


def byte_letters() -> dict[int, str]:
    """The letter of each byte in the vocabulary, by its place in Latin-1."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return dict(zip([b for b in range(256) if b not in plain], map(chr, range(256, 512)), strict=False))


class WordTokens(dict):
    """Packed ids of white-space separated words, which this tokeniser encodes independently, made when first asked for;
    two bounded generations. It is its own cache, so that nothing but its user refers to it and it goes with them."""

    MOST = 600_000

    def __init__(self, tokenizer_file: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        # Added tokens are cut out of the text as it stands, before all else; what lies between is text of its own, in
        # which other spellings of them, once lower-cased, are plain words.
        self.tokenizer.encode_special_tokens = True
        self.added = {x.content.encode(): np.array([i], dtype="<u2").tobytes() for i, x in self.tokenizer.get_added_tokens_decoder().items()}
        self.cuts = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + b")") if self.added else None
        before = (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)
        self.known = tuple(x and json.loads(x.__getstate__()) for x in before) == BEFORE_MERGES
        self.merges, self.letters = self.tokenizer.model.tokenize, byte_letters()
        self.older: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self.make(word)
        if len(word) <= 64:
            if len(self) >= self.MOST:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found

    def make(self, word: bytes) -> bytes:
        """The ids of a word of simple letters are those of its parts; the merges of a part are the library's, without
        its way to them. Any other word goes through all of the library."""
        if self.known and SIMPLE.fullmatch(text := word.decode().lower()):
            if not text.isalpha() and len(parts := PARTS.findall(text)) > 1:
                return b"".join([self[x.encode()] for x in parts])
            if not text.isascii():
                text = text.encode().decode("latin-1").translate(self.letters)
            ids = [x.id for x in self.merges(text)]
        else:
            ids = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}H", *ids)

    def ids(self, raw: bytes) -> bytes:
        """Little-endian unsigned 16-bit ids: the vocabulary has fewer than 65,536. The tokeniser lower-cases anyway."""
        if self.cuts and len(parts := self.cuts.split(raw)) > 1:
            return b"".join([self.added.get(x) or self.plain(x) for x in parts])
        return self.plain(raw)

    def plain(self, raw: bytes) -> bytes:
        if b"\xcc" in raw or b"\xcd" in raw:
            # A mark of U+0300 to U+037F may compose with a small letter only, and the tokeniser composes first.
            words = [w if b"\xcc" in w or b"\xcd" in w else w.lower() for w in raw.split()]
        else:
            words = raw.lower().split()
        return b"".join(map(self.__getitem__, words))


def word_tokens(tokenizer_file: str) -> WordTokens:
    return kept_in_worker(WordTokens, tokenizer_file)


def projection() -> tuple[np.ndarray, np.ndarray]:
    """The hashed dimension of each token id, and the fixed Gaussian matrix that the hashed vectors are projected by."""
    tokens = np.arange(1 << 16, dtype=np.uint64)
    dimension = ((tokens * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8)
    return dimension, np.random.default_rng(20).standard_normal((HASHED, SHOWN)).astype(np.float32)


def hilbert(axes: list, bits: int = BITS) -> np.ndarray:
    """The places on the Hilbert curve of cells given by their coordinates, one array for each axis (Skilling's transpose
    form)."""
    x, n = [np.asarray(a, dtype=np.int64) for a in axes], len(axes)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            inverted = (x[i] & q) != 0
            t = np.where(inverted, 0, (x[0] ^ x[i]) & low)
            x[0] = x[0] ^ np.where(inverted, low, t)
            if i:
                x[i] = x[i] ^ t
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = t ^ np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | ((x[i] ^ t) >> b & 1)
    return out


def curve_keys(texts: list[bytes], dimension: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Hilbert keys of the document vectors (texts: packed ids); the empty document lies in the middle cell. Each vector
    is projected by itself, so that equal texts of different batches have one key."""
    shown = np.zeros((len(texts), SHOWN), dtype=np.float32)
    for row, ids in zip(shown, texts, strict=True):
        weights = np.log1p(np.bincount(dimension[np.frombuffer(ids, "<u2")], minlength=HASHED)).astype(np.float32)
        row[:] = weights @ matrix / max(float(np.sqrt(weights @ weights)), 1e-9)
    cells = np.clip((0.5 + 0.5 * np.tanh(shown / 2)) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    return hilbert(list(cells.T))


def tokenised(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """doc_id, place on the curve (key and tie-break in one long), token count with the end id, ids."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (dimension, matrix) = word_tokens(tokenizer_file), projection()
        end = np.array([END_ID], dtype="<u2").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                ids = [own.ids(t or b"") for t in some.column(1).cast(pa.large_binary()).to_pylist()]
                keys = curve_keys(ids, dimension, matrix)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(keys, pa.int64()), pa.array([len(x) // 2 + 1 for x in ids], pa.int64()), pa.array([x + end for x in ids], pa.binary())], ["doc_id", "curve", "n", "ids"])

    read = in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), step, "doc_id long, curve long, n long, ids binary", keeps=True)
    return read.withColumn("place", F.shiftleft("curve", 32) + F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))).drop("curve")


def pack(docs: DataFrame, tokenizer_file: str, ranges: int | None = None) -> DataFrame:
    """Pieces of all documents; ``ranges``: along the curve, by default four for each shuffle partition."""
    spark = docs.sparkSession
    tokens = cut(tokenised(docs, tokenizer_file), "tokens")
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # One row comes to the driver, of as many numbers as there are ranges. Any bounds give the same pieces.
    quantiles = [i / ranges for i in range(1, ranges)]
    weighed = tokens.select("place", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / WEIGHED))))
    bounds = sorted(set(weighed.agg(F.percentile_approx("place", F.lit(quantiles).cast("array<double>"), 20 * ranges)).first()[0] or []))
    steps = 1 << (max(len(bounds), 1) - 1).bit_length()
    # Binary search in the bounds, unrolled: the number of bounds below the place.
    padded = F.array(*[F.lit(b) for b in bounds + [(1 << 63) - 1] * (steps - len(bounds))]) if bounds else None
    at = F.lit(0)
    if bounds:
        ladder = [1 << k for k in range(steps.bit_length() - 2, -1, -1)]
        at = F.aggregate(F.array(*[F.lit(k) for k in ladder]) if ladder else F.array().cast("array<int>"), F.lit(0), lambda a, k: F.when(F.get(padded, a + k - 1) < F.col("place"), a + k).otherwise(a))
        at = at + (F.get(padded, at) < F.col("place")).cast("int")
    ranged = tokens.withColumn("range", at)
    totals = {r["range"]: (r["n"], r["docs"]) for r in ranged.groupBy("range").agg(F.sum("n").alias("n"), F.count("*").alias("docs")).collect()}
    base, run = {}, 0
    for r in sorted(totals):
        base[r] = run
        run += totals[r][0]
    last, rest = divmod(run, SEQUENCE)
    short = 1 << max(rest - 1, 0).bit_length()  # what the last sequence is padded to

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, offset = None, 0
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                some, rows = batch.slice(begin, 500), []
                for doc, n, ids, r in zip(some.column("doc_id").to_pylist(), some.column("n").to_pylist(), some.column("ids").to_pylist(), some.column("range").to_pylist(), strict=True):
                    if r != now:
                        now, offset = r, base[r]
                    wide = np.frombuffer(ids, "<u2").astype("<u4")
                    start = 0
                    while start < n:
                        sequence, place = divmod(offset, SEQUENCE)
                        length = min(n - start, SEQUENCE - place)
                        rows.append((doc, start, length, zlib.crc32(wide[start : start + length].tobytes()), n, sequence, place, short if sequence == last else SEQUENCE))
                        start += length
                        offset += length
                kinds = [*[pa.int64()] * 7, pa.int32()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in PIECES.split(", ")])

    dealt = ranged.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "range").sortWithinPartitions("range", "place", "doc_id", "n", F.crc32("ids"))
    return in_arrow(dealt.select("doc_id", "n", "ids", "range"), lay, PIECES)
