"""Values as text and as bytes, for exchange with other stores."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

PREVIEW = 200


def number_text(x: Column, kind: str) -> Column:
    """Whole numbers plainly, floating numbers with six decimals."""
    return F.format_string("%.6f", x.cast("double")) if kind in ("float", "double") else x.cast("string")


def number_from(text: Column, kind: str) -> Column:
    """Fails on text that is no number."""
    return text.cast(kind)


def preview_hex(text: Column) -> Column:
    """The first bytes of a text, as hexadecimal digits (a cut may fall inside a character)."""
    return F.substring(F.hex(F.encode(text, "UTF-8")), 1, 2 * PREVIEW)


def pack(*parts: str) -> bytes:
    """Length-prefixed strings, little-endian 32-bit lengths."""
    return b"".join(struct.pack("<I", len(raw := p.encode())) + raw for p in parts)


def unpack(raw: bytes) -> list[str]:
    out, at = [], 0
    while at < len(raw):
        if at + 4 > len(raw):
            raise ValueError("the buffer ends inside a length")
        (n,) = struct.unpack_from("<I", raw, at)
        if at + 4 + n > len(raw):
            raise ValueError("the buffer ends inside a string")
        out.append(raw[at + 4 : at + 4 + n].decode())
        at += 4 + n
    return out


def pack_node(node_id: str, properties: str) -> bytes:
    return pack(node_id, properties)


def pack_edge(src: str, dst: str, label: str, weight: float, properties: str) -> bytes:
    return pack(src, dst, label) + struct.pack("<f", weight) + pack(properties)


def unpack_edge(raw: bytes) -> tuple[str, str, str, float, str]:
    at, parts = 0, []
    for _ in range(3):
        if at + 4 > len(raw):
            raise ValueError("the buffer ends inside a length")
        (n,) = struct.unpack_from("<I", raw, at)
        if at + 4 + n > len(raw):
            raise ValueError("the buffer ends inside a string")
        parts.append(raw[at + 4 : at + 4 + n].decode())
        at += 4 + n
    if at + 4 > len(raw):
        raise ValueError("the buffer ends inside the weight")
    (weight,) = struct.unpack_from("<f", raw, at)
    (properties,) = unpack(raw[at + 4 :])
    return parts[0], parts[1], parts[2], weight, properties


def with_defaults(body: Column, schema: str, defaults: dict[str, object]) -> Column:
    """A JSON body as a struct, with the defaults of absent fields."""
    read = F.from_json(body, schema)
    names = [part.split()[0] for part in schema.split(",")]
    return F.struct(*[F.coalesce(read[n], F.lit(defaults[n])).alias(n) if n in defaults else read[n].alias(n) for n in names])
