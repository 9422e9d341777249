"""SentencePiece BPE encoding and decoding by a table of prefixes.

For a merge-type vocabulary, the encoding of any text is the one token row in which every token alone encodes to
itself and every neighbouring pair is *compatible*: the pair's joined string encodes to just that pair. So each prefix
of a chunk has one last token. An Aho-Corasick automaton gives the vocabulary tokens that end at a place; the one
that is compatible with the last token of the prefix before it goes into the table; the ids are then read backwards
from the end. Merges cannot cross the border between a visible character and a space mark, nor a character outside
the vocabulary, so a text falls into chunks (space marks and the word after them) which are encoded apart and kept in
a bounded cache.

Null and empty texts have the ids begin and end only and decode to the empty text. A literal U+2581 is read as a
space, as the library does. Repeated rows and further columns are left as they are.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_arrow, kept_in_worker

MARK = "▁"
#: Chunks in one generation of a worker's cache; two are kept, about 220 bytes a chunk.
CACHE = 500_000


class PieceCodec:
    """``encode`` and ``decode`` of one SentencePiece BPE model with byte fallback and identity normalisation."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        self.begin, self.end = model.bos_id(), model.eos_id()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i in range(size) if model.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        hidden = {i for i in range(size) if model.is_control(i) or model.is_unknown(i)}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in hidden and i not in self.byte_of}
        self.score = [model.get_score(i) for i in range(size)]
        self.known = {p for p in self.ids if len(p) == 1}
        self.inner = [p.replace(MARK, " ") for p in self.pieces]  # as decoded
        for i in hidden:
            self.inner[i] = ""
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.line_feed = array("I", [self.byte_id[10]]).tobytes()

    def merged(self, symbols: str) -> list[str]:
        """Merges neighbours while their union is a piece, the best score first and the leftmost of equals: the rule
        that compatibility is judged by, applied to the string of one or two tokens only."""
        row = list(symbols)
        while True:
            best = max(((self.score[i], -k) for k in range(len(row) - 1) if (i := self.ids.get(row[k] + row[k + 1])) is not None), default=None)
            if best is None:
                return row
            k = -best[1]
            row[k : k + 2] = [row[k] + row[k + 1]]

    def stands(self, token: int) -> bool:
        found = self.alone[token] = len(self.merged(self.pieces[token])) == 1
        return found

    def compatible(self, left: int, right: int) -> bool:
        if len(self.pairs) > 4 * CACHE:
            self.pairs.clear()
        found = self.pairs[left << 20 | right] = self.merged(self.pieces[left] + self.pieces[right]) == [self.pieces[left], self.pieces[right]]
        return found

    def run(self, s: str) -> list[int]:
        """The ids of a chunk all of whose characters are in the vocabulary."""
        n = len(s)
        last, reach = [-1] * n, [0] * n  # the prefix table: the last token of each prefix and its length
        pairs, alone = self.pairs, self.alone
        for end, (token, length) in self.automaton.iter(s):
            if last[end] >= 0:
                continue
            before = end - length
            if before < 0:
                if (fits := alone.get(token)) is None:
                    fits = self.stands(token)
            elif (prior := last[before]) < 0:
                continue
            elif (fits := pairs.get(prior << 20 | token)) is None:
                fits = self.compatible(prior, token)
            if fits:
                last[end], reach[end] = token, length
        out, at = [], n - 1
        while at >= 0:
            out.append(last[at])
            at -= reach[at]
        out.reverse()
        return out

    def chunk(self, s: str) -> list[int]:
        if self.known.issuperset(s):
            return self.run(s)
        out: list[int] = []
        known = ""
        for ch in s:
            if ch in self.known:
                known += ch
                continue
            if known:
                out += self.run(known)
                known = ""
            out += [self.byte_id[b] for b in ch.encode()]
        return out + (self.run(known) if known else [])

    def keep(self, key: str, chunk: str) -> bytes:
        if len(self.cache) >= CACHE:
            self.older, self.cache = self.cache, {}
        if (found := self.older.get(key)) is not None:
            self.cache[key] = found
            return found
        if "\n" in chunk:  # a line feed is outside the vocabulary, so lines are encoded apart; no word's key has a space
            lines = [self.cache.get(" " + x) or self.keep(" " + x, x) if x else b"" for x in chunk.split("\n")]
            return self.line_feed.join(lines)
        found = array("I", self.chunk(chunk)).tobytes()
        if len(key) <= 64:
            self.cache[key] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids without begin and end, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        words = text.replace(MARK, " ").split(" ")
        if "" in words:
            marked = MARK + text.replace(" ", MARK)
            words = [x[1:] for x in re.findall(f"{MARK}+[^{MARK}]*", marked)]
        get = self.cache.get
        out = [get(w) or self.keep(w, MARK + w) for w in words]
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """What the library's ``decode`` gives: bytes are joined to characters (bad ones become U+FFFD), begin, end
        and the first space mark go."""
        inner = self.inner
        if self.byte_of.keys().isdisjoint(ids):
            text = "".join([inner[i] for i in ids])
        else:
            parts, held = [], bytearray()
            for i in ids:
                if (b := self.byte_of.get(i)) is not None:
                    held.append(b)
                    continue
                if held:
                    parts.append(held.decode("utf-8", "replace"))
                    held = bytearray()
                parts.append(inner[i])
            parts.append(held.decode("utf-8", "replace"))
            text = "".join(parts)
        first = next((i for i in ids if i not in (self.begin, self.end)), None)
        return text[1:] if first is not None and self.pieces[first].startswith(MARK) else text


def codec(model_file: str) -> PieceCodec:
    return kept_in_worker(PieceCodec, model_file)


def encode_documents(docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, ids (begin and end included, little-endian unsigned 32-bit) and the text decoded from them."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        begin, end = (np.array([i], dtype="<u4").tobytes() for i in (own.begin, own.end))
        for batch in batches:
            ids = [begin + own.encode(t or "") + end for t in batch.column(1).to_pylist()]
            decoded = [own.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], [key, "ids", "decoded"])

    return in_arrow(docs.select(key, text), step, f"{key} {docs.schema[key].dataType.simpleString()}, ids binary, decoded string", keeps=True)


def encode_digests(docs: DataFrame, model_file: str) -> DataFrame:
    """``encode_documents`` reduced to counts and digests inside the Python worker, so that ids and texts stay there."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        begin, end = (np.array([i], dtype="<u4").tobytes() for i in (own.begin, own.end))
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for t in batch.column(1).to_pylist():
                ids = begin + own.encode(t or "") + end
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(own.decode(np.frombuffer(ids, "<u4").tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return in_arrow(docs.select("doc_id", "text"), step, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", keeps=True)
