"""Quality rules by tokeniser fertility.

Two public vocabularies read each word: a piece vocabulary with byte fallback and a byte-level one for many languages.
A text is measured by characters per token under both, by the share of byte-fallback tokens and by the entropy of its
tokens, which is weighed with the byte-level rate against what is least for their number; a measure outside the band of its language (or, where the language is not named, of its main script) rejects
the text. The counts of the base rules (words, symbols, repeated lines, repeated three-word windows) come first.

Null and empty texts have no words, zero measures and fail the base. Texts of any length are read whole; repeated
rows are judged alike; other columns are ignored. A null or unknown language takes its script's band.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from math import inf

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, kept_in_worker, mix

SYMBOLS = b"#*$%&|<>"
#: Fewer words fail the base.
LEAST_WORDS = 50
#: Least sums are given at these binary logarithms of the number of tokens; between them they are interpolated.
KNOTS = range(6, 14)
#: (least, most) characters per piece token, (least, most) characters per byte-level token, most byte-fallback share,
#: weight of the byte-level rate and, at the knots, the least sum of entropy in bits and weighted rate; most symbols a
#: word. A rate's least lies below the values of prose labelled good, with a margin; a sum's between them and those of
#: tables labelled bad. Languages are told by rates; the bands of scripts, which hold for many, bound the symbols too.
BANDS = {
    "en": ((1.72, 6.0), (1.92, 6.0), 0.10, 1.0, (7.30, 7.77, 8.16, 8.45, 8.64, 8.77, 8.84, 8.90), inf),
    "de": ((1.84, 6.0), (2.00, 6.0), 0.10, 1.0, (7.08, 7.69, 8.03, 8.30, 8.47, 8.56, 8.64, 8.68), inf),
    "fr": ((1.55, 6.0), (1.74, 6.0), 0.10, 1.0, (7.17, 7.46, 7.81, 8.04, 8.20, 8.29, 8.31, 8.42), inf),
    "es": ((1.60, 6.0), (1.85, 6.0), 0.10, 1.0, (7.10, 7.41, 7.73, 8.04, 8.23, 8.31, 8.36, 8.51), inf),
    "latin": ((1.30, 6.0), (1.20, 6.0), 0.15, 0.3, (5.69, 6.13, 6.50, 6.77, 6.96, 7.05, 7.13, 7.19), 0.1),
    "cyrillic": ((1.10, 6.0), (0.80, 6.0), 0.25, 0.0, (4.0,) * 8, 0.1),
    "greek": ((0.60, 6.0), (0.60, 6.0), 0.40, 0.0, (4.0,) * 8, 0.1),
    "cjk": ((0.30, 4.0), (0.30, 4.0), 0.80, 0.0, (4.0,) * 8, 0.1),
    "other": ((0.20, 6.0), (0.20, 6.0), 1.00, 0.0, (3.5,) * 8, 0.1),
}
#: Names of bands that no ``lang`` can choose.
SCRIPTS = frozenset("latin cyrillic greek cjk other".split())
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, piece_chars_per_token double, byte_chars_per_token double, byte_fallback_share double, token_entropy double, band string"


class Fertility:
    """Piece ids, byte-level token counts, lengths and hashes of words; each word is encoded once per worker while it
    stays in a cache of two bounded generations."""

    MOST = 300_000

    def __init__(self, piece_model: str, byte_ranks: str, pattern: str) -> None:
        import sentencepiece
        import tiktoken

        self.piece = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        with open(byte_ranks, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.level = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.words: dict[bytes, tuple] = {}
        self.older: dict[bytes, tuple] = {}

    def learn(self, words: list[bytes]) -> list[tuple]:
        """The entries of the words of a text, after encoding those that are new."""
        if len(self.words) >= self.MOST:
            self.older, self.words = self.words, {}
        known, older = self.words, self.older
        if new := [w for w in set(words) if w not in known]:
            known.update((w, older[w]) for w in new if w in older)
            if new := [w for w in new if w not in older]:
                texts = [w.decode() for w in new]
                for w, s, ids in zip(new, texts, self.piece.encode(texts, num_threads=1), strict=True):
                    known[w] = (array("H", ids).tobytes(), len(self.level.encode_ordinary(" " + s)), len(s), xxhash.xxh64_intdigest(w))
        return [known[w] for w in words]


def fertility(*files: str) -> Fertility:
    return kept_in_worker(Fertility, *files)


def script_of(text: str) -> str:
    """The script of most letters, by code point ranges."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    ranges = {"latin": ((0x41, 0x5B), (0x61, 0x7B), (0xC0, 0x250)), "greek": ((0x370, 0x400),), "cyrillic": ((0x400, 0x530),), "cjk": ((0x3040, 0x3100), (0x3400, 0xA000), (0xAC00, 0xD7B0))}
    found = {k: sum(int(((points >= a) & (points < b)).sum()) for a, b in spans) for k, spans in ranges.items()}
    best = max(found, key=lambda k: found[k])
    return best if found[best] else "other"


def duplicate_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in raw.split(b"\n") if x and x.split()]
    return len(lines) - len(set(lines))


def repeated_words(hashes: np.ndarray) -> int:
    """Words inside three-word windows that are found twice or more in the text."""
    n = len(hashes) - 2
    if n < 2:
        return 0
    windows = mix(hashes[:n]) + np.uint64(3) * mix(hashes[1 : n + 1] + np.uint64(1)) + np.uint64(7) * hashes[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    starts = np.concatenate([order[1:][same], order[:-1][same]])
    hit = np.zeros(n + 2, dtype=bool)
    for k in range(3):
        hit[starts + k] = True
    return int(hit.sum())


def entropy(ids: np.ndarray) -> float:
    if not len(ids):
        return 0.0
    ordered = np.sort(ids)
    counts = np.diff(np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])))
    p = counts / len(ids)
    return float(-(p * np.log2(p)).sum())


def judge(docs: DataFrame, piece_model: str, byte_ranks: str, pattern: str, bands: dict = BANDS, carry: str | None = None) -> DataFrame:
    """Per document the base counts, the measures, the band that was used and the verdict ``kept``; ``carry``: a column
    of ``docs`` that is passed on."""
    more = [carry] if carry else []

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = fertility(piece_model, byte_ranks, pattern)
        for batch in batches:
            rows: list[tuple] = []
            for raw, lang in zip(batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = raw or b""
                words = raw.split()
                parts = own.learn(words)
                ids = np.frombuffer(b"".join([p[0] for p in parts]), dtype=np.uint16)
                chars, level = sum([p[2] for p in parts]), sum([p[1] for p in parts])
                symbols = len(raw) - len(raw.translate(None, SYMBOLS))
                repeated = repeated_words(np.array([p[3] for p in parts], dtype=np.uint64))
                failed = len(words) < LEAST_WORDS or 100 * repeated > 50 * len(words)
                piece_rate, level_rate = chars / max(len(ids), 1), chars / max(level, 1)
                share = float(((ids >= 3) & (ids < 259)).mean()) if len(ids) else 0.0
                bits = entropy(ids)
                band = lang if lang in bands and lang not in SCRIPTS else script_of(raw.decode())
                (a, b), (c, d), most, weight, least, marks = bands[band]
                fits = a <= piece_rate <= b and c <= level_rate <= d and share <= most and symbols <= marks * len(words)
                fits = fits and bits + weight * level_rate >= float(np.interp(np.log2(max(len(ids), 1)), KNOTS, least))
                rows.append((len(words), chars, symbols, duplicate_lines(raw), repeated, failed, not failed and fits, piece_rate, level_rate, share, bits, band))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 12
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 4 + [pa.string()]
            names = re.findall(r"(\w+) \w+", SCHEMA)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), *batch.columns[3:]], [*names, *more])

    carried = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in more)
    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", *more), step, SCHEMA + carried, keeps=True)
