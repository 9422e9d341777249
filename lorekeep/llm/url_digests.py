"""URL rules in a sorted digest array.

A rule is a host and a path prefix with a verdict; it fits its host and all subdomains. The array holds the 64-bit
xxhash of each rule's ``host + path`` in sorted order, beside the full strings. It is a file that Spark ships to every
executor, memory-mapped there. A URL asks for each suffix of its host with each prefix of its path that has the length
of some rule's path; all questions of a batch are one vectorised binary search, and a hit counts only if the stored
string is the question's (collisions have other strings). The longest fitting rule wins, with the longer host of equals.

A null URL, or one without ``://``, has an empty host and path and no rule; no rule gives the default verdict.
Empty tables give no rows; repeated rows are judged alike; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from .common import in_arrow

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SCHEMA = "page_id long, host string, path string, rule string, verdict string"
ENTRY = np.dtype([("at", "<u8"), ("host", "<u4"), ("path", "<u4"), ("block", "<u4")])


def split_url(url: bytes | None) -> tuple[bytes, bytes]:
    """Host (A-Z lower-cased) and path."""
    _, there, rest = (url or b"").partition(b"://")
    if not there:
        return b"", b""
    host = re.split(rb"[/?#]", rest, maxsplit=1)[0]
    path = re.split(rb"[?#]", rest[len(host) :], maxsplit=1)[0]
    return host.translate(LOWER), path


def write_digests(rules: list[tuple[str, str, str]], folder: str) -> str:
    """Rules (verdict, host, path) as a file: count, sorted keys, entries in the order of the keys, strings."""
    made = {h.encode().translate(LOWER) + b"\0" + p.encode(): (h.encode().translate(LOWER), p.encode(), v == "block") for v, h, p in rules}
    keys, entries, strings = [], [], b""
    for key, (host, path, block) in made.items():
        keys.append(xxhash.xxh64_intdigest(key))
        entries.append((len(strings), len(host), len(path), block))
        strings += host + path
    sorted_keys = np.array(keys, dtype="<u8")
    order = np.argsort(sorted_keys, kind="stable")
    name = f"digests-{uuid.uuid4().hex}.bin"
    with open(os.path.join(folder, name), "wb") as f:
        f.write(np.array([len(order)], dtype="<u8").tobytes() + sorted_keys[order].tobytes() + np.array(entries, dtype=ENTRY)[order].tobytes() + strings)
    return name


class Digests:
    def __init__(self, file: str) -> None:
        whole = np.memmap(file, dtype=np.uint8, mode="r")
        n = int(whole[:8].view("<u8")[0])
        self.keys = whole[8 : 8 + 8 * n].view("<u8")  # searched in the map itself
        self.table = whole[8 + 8 * n : 8 + n * (8 + ENTRY.itemsize)].view(ENTRY)
        self.strings = whole[8 + n * (8 + ENTRY.itemsize) :]
        self.lengths = sorted({int(x) for x in self.table["path"]})

    def judge(self, urls: list[tuple[bytes, bytes]], default: str) -> tuple[list[str | None], list[str]]:
        asked: list[bytes] = []
        owner: list[int] = []
        for i, (host, path) in enumerate(urls):
            suffixes = [host, *(host[m.end() :] for m in re.finditer(rb"\.", host))] if host else []
            for suffix in suffixes:
                for n in self.lengths:
                    if n <= len(path):
                        asked.append(suffix + b"\0" + path[:n])
                        owner.append(i)
        rule: list[str | None] = [None] * len(urls)
        verdict = [default] * len(urls)
        best = [(-1, -1)] * len(urls)
        if not asked or not len(self.keys):
            return rule, verdict
        digests = np.fromiter(map(xxhash.xxh64_intdigest, asked), dtype=np.uint64, count=len(asked))
        low = np.searchsorted(self.keys, digests, "left")
        high = np.searchsorted(self.keys, digests, "right")
        for k in np.flatnonzero(high > low):
            host, _, path = asked[k].partition(b"\0")
            for e in self.table[low[k] : high[k]]:
                at, h, p = int(e["at"]), int(e["host"]), int(e["path"])
                if self.strings[at : at + h].tobytes() == host and self.strings[at + h : at + h + p].tobytes() == path:
                    i, size = owner[k], (h + p, h)
                    if size > best[i]:
                        best[i], rule[i], verdict[i] = size, (host + path).decode("utf-8", "replace"), "block" if e["block"] else "allow"
        return rule, verdict


@lru_cache(maxsize=4)
def digests(name: str) -> Digests:
    return Digests(SparkFiles.get(name))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """page_id, host, path, the winning rule and the verdict. The rules come from the caller's list, so their array
    is as large as that list and does not grow with the pages."""
    folder = tempfile.mkdtemp(prefix="digests-")
    name = write_digests(rules, folder)
    pages.sparkSession.sparkContext.addFile(os.path.join(folder, name))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = digests(name)
        for batch in batches:
            urls = [split_url(u) for u in batch.column(1).cast(pa.large_binary()).to_pylist()]
            rule, verdict = own.judge(urls, default)
            hosts, paths = ([u[k].decode("utf-8", "replace") for u in urls] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.string()) for x in (hosts, paths, rule, verdict))], ["page_id", "host", "path", "rule", "verdict"])

    return in_arrow(pages.select("page_id", "url"), step, SCHEMA)
