"""Marked files: every gzip member names its own length in an extra field, so that members are listed without inflating them.

A blob is hopped over from member to member, in one task; blobs are dealt out. A blob without a marked member is an error row.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import takewhile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions import labels
from siltworks.operators.codec import reassembled

#: The names of the two kinds of marks in the extra field.
OWN, STANDARD = b"GZ", b"BC"
#: A gzip header up to the extra field's length: deflate, extra field, no time, unknown system.
HEAD = b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff"


def marks(data: bytes, at: int) -> tuple[dict[bytes, bytes], int] | None:
    """(payload of each subfield, byte after the extra field) of the member at ``at``; None without a whole extra field.

    The first subfield of a name with two or four bytes, a length, counts; one without such is there with no payload.
    """
    if data[at : at + 2] != b"\x1f\x8b" or at + 12 > len(data) or not data[at + 3] & 4:
        return None
    here = at + 12
    end = here + int.from_bytes(data[at + 10 : here], "little")
    if end > len(data):
        return None
    found: dict[bytes, bytes] = {}
    while here + 4 <= end:
        size = int.from_bytes(data[here + 2 : here + 4], "little")
        name, fits = data[here : here + 2], size in (2, 4) and here + 4 + size <= end
        found[name] = found.get(name) or (data[here + 4 : here + 4 + size] if fits else b"")
        here += 4 + size
    return found, end


def hops(data: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(start, length, size, start of the packed data) of the marked members from the beginning on, up to the first byte that isn't one."""
    at = 0
    while at + 18 < len(data) and (read := marks(data, at)):
        told, body = read[0].get(OWN, b""), read[1]
        # two bytes hold the length less one, four hold the length
        length = int.from_bytes(told, "little") + (len(told) == 2)
        if not length or at + length > len(data):
            return
        end, flag = at + length, data[at + 3]
        for text in (8, 16):
            if flag & text:
                zero = data.find(b"\0", body, end)
                body = (end if zero < 0 else zero) + 1
        size = int.from_bytes(data[end - 4 : end], "little") if length >= 8 else 0
        yield at, length, size, body + (2 if flag & 2 else 0)
        at = end


def blocks(packed: DataFrame) -> DataFrame:
    """(stream_id, block, start, length, isize, output_offset, data_start, error) of the marked members."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, data in zip(batch["stream_id"], batch["packed"], strict=True):
                n = output = 0
                for start, length, size, body in hops(bytes(data) if data is not None else b""):
                    rows.append((i, n, start, length, size, output, body, None))
                    n, output = n + 1, output + size
                if not n:
                    rows.append((i, n, None, None, None, None, None, "no marked member"))
            made = pd.DataFrame(rows, columns=["stream_id", "block", "start", "length", "isize", "output_offset", "data_start", "error"])
            yield made.astype({c: "Int64" for c in ("start", "length", "isize", "output_offset", "data_start")})

    id_type = packed.schema["stream_id"].dataType.simpleString()
    schema = f"stream_id {id_type}, block long, start long, length long, isize long, output_offset long, data_start long, error string"
    return packed.select("stream_id", "packed").mapInPandas(listed, schema)


def mark(packed: Column, lengths: bool = True) -> Column:
    """marked or marked-standard by the extra field of the first header, else null; without ``lengths`` a subfield that holds none counts too."""

    @F.pandas_udf("string")
    def seen(head: pd.Series) -> pd.Series:
        def one(x: bytes | None) -> str | None:
            found = (marks(bytes(x), 0) or ({}, 0))[0] if x is not None and len(x) >= 18 else {}
            names = {k for k, told in found.items() if told or not lengths}
            return "marked" if OWN in names else "marked-standard" if STANDARD in names else None

        return head.map(one)

    return seen(F.substring(packed, 1, 12 + 65_535 + 2))  # an extra field is never longer


def structure(packed: DataFrame) -> DataFrame:
    """(stream_id, kind, magics): the shape by the first header, and how often the two magic bytes come.

    Magic bytes are looked for every ten bytes at least, also inside packed data, so ``magics`` may be above the number of
    members; ``codec.members`` counts these. Kinds: too small, not gzip, marked, marked-standard, multi-member, single-member.
    """

    magics = F.regexp_count(F.decode("packed", "ISO-8859-1"), F.lit(r"(?s)\x1f\x8b.{0,8}"))
    seen = packed.select("stream_id", "packed", magics.alias("magics"), mark(F.col("packed")).alias("mark"))
    kind = (
        F.when(F.coalesce(F.octet_length("packed"), F.lit(0)) < 2, "too small")
        .when(F.hex(F.substring("packed", 1, 2)) != "1F8B", "not gzip")
        .otherwise(F.coalesce("mark", F.when(F.col("magics") > 1, "multi-member").otherwise("single-member")))
    )
    return seen.select("stream_id", kind.alias("kind"), F.coalesce("magics", F.lit(0)).cast("long").alias("magics"))


def output_estimate(packed: DataFrame) -> DataFrame:
    """(stream_id, bytes): the sizes of the marked members, else that of the last member alone; 0 below 18 bytes."""

    @F.pandas_udf("long")
    def summed(packed: pd.Series) -> pd.Series:
        return packed.map(lambda x: sum(h[2] for h in takewhile(lambda h: h[1] >= 18, hops(bytes(x)))) if x is not None else 0)

    total = summed("packed")
    return packed.select("stream_id", F.when(total > 0, total).otherwise(F.coalesce(labels.isize(F.col("packed")), F.lit(0))).alias("bytes"))


def member(raw: bytes, level: int) -> bytes:
    """A marked gzip member of ``raw``."""
    c = zlib.compressobj(min(level, 9), zlib.DEFLATED, -15)
    body = c.compress(raw) + c.flush()
    length = len(HEAD) + 2 + 8 + len(body) + 8
    return HEAD + struct.pack("<H2sHI", 8, OWN, 4, length) + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def compress(blobs: DataFrame, size: int, level: int = 6) -> DataFrame:
    """(stream_id, packed): each blob as marked members of ``size`` bytes, packed chunk by chunk and put together in order."""

    @F.pandas_udf("binary")
    def packed(part: pd.Series) -> pd.Series:
        return part.map(lambda x: member(bytes(x), level))

    starts = F.expr(f"sequence(0, greatest(octet_length(raw) - 1, 0), {size})")
    cut = blobs.select("stream_id", "raw", F.posexplode(starts).alias("chunk", "at"))
    parts = cut.select("stream_id", "chunk", F.substring("raw", F.col("at") + 1, F.lit(size)).alias("part"))
    return reassembled(parts.select("stream_id", "chunk", packed("part").alias("packed")))
