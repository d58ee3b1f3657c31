"""Seek indexes: checkpoints every so many bytes of output, looked up as of an offset and decoded from there; content-defined cuts."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltworks.operators.batches import SLICE, id_type, slices

INTERVAL = 4 << 20
#: Bytes before it that a place in a stream may refer to.
HISTORY = 32 << 10
#: Bytes handed to the decoder at once.
PIECE = 1 << 16
#: Bytes of input that are tried for the end of a block, one by one, before the blocks are walked.
TRIED = 1 << 10
#: A last block of random bytes, stored: a decoder takes it for these bytes and an end where a block may begin on a whole byte, and nowhere else.
NONCE = os.urandom(16)
PROBE = struct.pack("<BHH", 1, len(NONCE), len(NONCE) ^ 0xFFFF) + NONCE


def may_begin(data: bytes, at: int) -> bool:
    """Whether the first bits of a block could lie at byte ``at``."""
    kind = data[at] >> 1 & 3
    if kind == 0:
        return len(data) >= at + 5 and data[at + 1] ^ data[at + 3] == 0xFF and data[at + 2] ^ data[at + 4] == 0xFF
    return kind == 1 or kind == 2 and data[at] >> 3 < 30 and data[at + 1] & 31 < 30


def begins(probe) -> bool:
    """Whether the decoder awaits a block on a whole byte; it is spent by this."""
    try:
        return probe.decompress(PROBE) == NONCE and probe.eof
    except zlib.error:
        return False


def block_ends(data: bytes, body: int, interval: int) -> Iterator[tuple[int, int]]:
    """(byte after it, bytes of output) of blocks of the stream at byte ``body`` that end on a whole byte and aren't the last one, each the first with ``interval`` bytes of output since the one before.

    The decoder runs to just before as many bytes. From there on it is asked after every byte whether a block may begin; where none does soon, the blocks are walked from
    the end before. Behind the last one comes (byte after the stream, -1). ``data`` is a stream that the codec takes.
    """
    from siltworks.operators.deflate import spans_of, walk

    piece = min(PIECE, max(64, interval))
    d, at, out, base, reached = zlib.decompressobj(-15), body, 0, body, 0
    while True:
        # the byte that would make it enough stays inside, and with it what comes after
        while not d.eof and out < reached + interval - 1:
            part = data[at : at + piece]
            out += len(d.decompress(part, reached + interval - 1 - out))
            at += len(part) - len(d.unconsumed_tail) - len(d.unused_data)
        # at first only what is read already comes out
        part, limit, found = b"", at + TRIED, False
        while not d.eof and not found and at + len(part) < limit:
            out += len(d.decompress(part))
            at += len(part)
            part = data[at : at + 1]
            if at > base and out - reached >= interval and not d.eof and may_begin(data, at):
                found = begins(d.copy())
        if not d.eof and not found:
            made = reached
            for start, head, bits, _, final, _, tokens in walk(data, base):
                made += int(spans_of(tokens).sum())
                end = start + head + bits
                if not final and end % 8 == 0 and made - reached >= interval:
                    found = True
                    break
            end = base + (end + 7) // 8
            while at < end:
                part = data[at : min(at + piece, end)]
                out += len(d.decompress(part))
                at += len(part)
        if d.eof:
            yield at, -1
            return
        yield at, out
        base, reached = at, out


def index_build(packed: DataFrame, interval: int = INTERVAL) -> DataFrame:
    """(stream_id, point, input_at, output_at, window, error): where the decoder may start anew; the first is the start of the data.

    A checkpoint is a place where a block ends on a whole byte, at least ``interval`` bytes of output after the one before. Its window is the
    output since that one, the last 32 KiB of it at most: the windows up to a checkpoint, put together, end in the 32 KiB that its decoder
    needs (``histories``), and all of them hold no more than the output once. Streams of several members are refused, as the error says.
    """
    from siltworks.operators.deflate import header_end

    def rows_of(data: bytes) -> Iterator[tuple]:
        body = header_end(data, 0)
        raw = zlib.decompress(data, 31)
        yield 0, body, 0, b"", None
        reached = 0
        for n, (at, out) in enumerate(block_ends(data, body, interval), 1):
            if out >= 0:
                yield n, at, out, raw[max(reached, out - HISTORY) : out], None
                reached = out
        if at + 8 != len(data):
            raise ValueError("several members")

    def one(data: bytes) -> list[tuple]:
        try:
            return list(rows_of(data))
        except (ValueError, IndexError, zlib.error) as e:
            return [(0, None, None, None, str(e))]

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
        for part in slices(batches, "packed"):
            ids, rows, held = [], [], 0
            for k, data in enumerate(part.column("packed")):
                mine = one(data.as_py() or b"")
                ids += [k] * len(mine)
                rows += mine
                held += sum(len(r[3] or b"") for r in mine)
                if held >= SLICE or k == part.num_rows - 1:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column("stream_id").take(pa.array(ids)), *columns], names=["stream_id", "point", "input_at", "output_at", "window", "error"])
                    ids, rows, held = [], [], 0

    return packed.select("stream_id", "packed").mapInArrow(points, f"stream_id {id_type(packed)}, point long, input_at long, output_at long, window binary, error string")


def as_of(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """``wanted`` (stream_id, offset, size) with the last checkpoint at or before each offset; without one its fields are null."""
    none = lambda frame, cols: F.lit(None).cast(frame.select(F.struct(*cols)).schema[0].dataType)
    fields = ["output_at", "point", "input_at"]
    known = index.where("error is null and stream_id is not null and output_at is not null")
    points = known.select("stream_id", F.col("output_at").alias("at"), F.struct(*fields).alias("p"), none(wanted, wanted.columns).alias("asked"))
    asked = wanted.select("stream_id", F.col("offset").alias("at"), none(index, fields).alias("p"), F.struct(*wanted.columns).alias("asked"))
    # points before what asks for the same place, the highest of equal ones last
    order = Window.partitionBy("stream_id").orderBy("at", F.col("asked").isNotNull(), "p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = points.unionByName(asked).withColumn("p", F.last("p", True).over(order))
    return found.where("asked is not null").select("asked.*", "p.point", "p.input_at", "p.output_at")


def histories(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """``as_of`` of ``wanted`` (stream_id, offset, size) with ``history``, the 32 KiB before the checkpoint, from the windows that reach into them.

    The checkpoints and what asks are sorted by their place once, and each asked place takes its history from the rows before it: the index is read, and moved, once.
    """

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = []
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([*carry, batch]).combine_chunks().to_batches()[0]
            n, ids, window = t.num_rows, t.column("stream_id"), t.column("window")
            here, asked = np.arange(n), t.column("asked").to_numpy(zero_copy_only=False)
            changes = pc.fill_null(pc.not_equal(ids.slice(1), ids.slice(0, n - 1)), True).to_numpy(zero_copy_only=False)
            # the row that a stream begins with, the last checkpoint so far, and the first one that reaches into the 32 KiB before it
            first = np.maximum.accumulate(np.where(np.append(True, changes), here, 0))
            last = np.maximum.accumulate(np.where(asked, -1, here))
            ends = np.cumsum(pc.fill_null(pc.binary_length(window), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            reach = np.maximum(first, np.searchsorted(ends, ends[last] - HISTORY, "right"))
            found, rows, held = [], [], 0
            for k in np.flatnonzero(asked).tolist():
                known = last[k] >= first[k]
                rows.append(k)
                found.append(b"".join(window.slice(reach[k], last[k] + 1 - reach[k]).drop_null().to_pylist())[-HISTORY:] if known else None)
                held += len(found[-1] or b"")
                if held >= SLICE:
                    yield told(t, np.array(rows), last, first, found)
                    found, rows, held = [], [], 0
            if rows:
                yield told(t, np.array(rows), last, first, found)
            points = here[reach[-1] : last[-1] + 1] if last[-1] >= first[-1] else here[:0]
            carry = [t.take(pa.array(points[~asked[points]]))]

    def told(t: pa.RecordBatch, rows: np.ndarray, last: np.ndarray, first: np.ndarray, found: list[bytes | None]) -> pa.RecordBatch:
        own, at = t.take(pa.array(rows)), pa.array(last[rows], mask=last[rows] < first[rows])
        point, input_at, output_at = (t.column(c).take(at) for c in ("point", "input_at", "at"))
        return pa.RecordBatch.from_arrays([*(own.column(c) for c in ("stream_id", "at", "size")), point, input_at, output_at, pa.array(found, pa.binary())], names=names)

    names = ["stream_id", "offset", "size", "point", "input_at", "output_at", "history"]
    none = lambda kind, *cols: [F.lit(None).cast(kind).alias(c) for c in cols]
    known = index.where("error is null and stream_id is not null and output_at is not null")
    points = known.select("stream_id", F.col("output_at").alias("at"), F.lit(False).alias("asked"), *none("long", "size"), "point", "input_at", "window")
    asked = wanted.select("stream_id", F.col("offset").cast("long").alias("at"), F.lit(True).alias("asked"), F.col("size").cast("long").alias("size"), *none("long", "point", "input_at"), *none("binary", "window"))
    # checkpoints before what asks for the same place, the highest of equal ones last
    placed = points.union(asked).repartition("stream_id").sortWithinPartitions("stream_id", "at", "asked", "point", "input_at")
    return placed.mapInArrow(met, f"stream_id {id_type(wanted)}, offset long, size long, point long, input_at long, output_at long, history binary")


def index_seek(packed: DataFrame, index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(stream_id, offset, part, error): ``size`` bytes from each offset on, decoded from the checkpoint before it."""
    met = histories(wanted, index).join(packed.select("stream_id", "packed"), "stream_id", "left")

    def one(data: bytes | None, offset: int, size: int, at: int | None, out: int, history: bytes | None) -> tuple:
        if data is None or at is None:
            return None, "no checkpoint at or before the offset"
        try:
            d = zlib.decompressobj(-15, **({"zdict": history} if history else {}))
            return d.decompress(memoryview(data)[at:], max(1, offset - out + size))[offset - out : offset - out + size], None
        except zlib.error as e:
            return None, str(e)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "packed", "history"):
            plain = [part.column(c).to_pylist() for c in ("packed", "offset", "size", "input_at", "output_at", "history")]
            text, error = zip(*map(one, *plain), strict=True)
            yield pa.RecordBatch.from_arrays([part.column("stream_id"), part.column("offset").cast(pa.int64()), pa.array(text, pa.binary()), pa.array(error, pa.string())], names=["stream_id", "offset", "part", "error"])

    return met.mapInArrow(read, f"stream_id {id_type(packed)}, offset long, part binary, error string")


def check_index(index: DataFrame) -> DataFrame:
    """(stream_id, point, ok): offsets that grow strictly from point to point."""
    w = Window.partitionBy("stream_id").orderBy("point")
    grows = lambda c: F.coalesce(F.col(c) > F.lag(c).over(w), F.lit(True))
    return index.where("error is null").select("stream_id", "point", (grows("input_at") & grows("output_at")).alias("ok"))


#: Rolling window, mask of the trigger, and bounds of a block.
WINDOW, MASK, LEAST, MOST = 8192, 0x1FFFF, 32 << 10, 512 << 10


def rolling_cuts(blobs: DataFrame, window: int = WINDOW, mask: int = MASK, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(stream_id, block, start, size): content-defined blocks, cut where the sum of the last ``window`` bytes has all bits of ``mask``."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, raw in zip(batch["stream_id"], batch["raw"], strict=True):
                b = np.frombuffer(bytes(raw), np.uint8)
                total = np.cumsum(b, dtype=np.uint32)
                sums = total.copy()
                sums[window:] -= total[:-window] if len(total) > window else 0
                hits, start, n = np.flatnonzero(sums & mask == mask), 0, 0
                while len(b) > least and len(b) - start >= least:
                    k = int(np.searchsorted(hits, start + least - 1))
                    end = min(int(hits[k]) + 1 if k < len(hits) else start + most, start + most)
                    if end > len(b):
                        break
                    rows.append((i, n, start, end - start))
                    start, n = end, n + 1
                if start < len(b) or not len(b):
                    rows.append((i, n, start, len(b) - start))
            yield pd.DataFrame(rows, columns=["stream_id", "block", "start", "size"])

    id_type = blobs.schema["stream_id"].dataType.simpleString()
    return blobs.select("stream_id", "raw").mapInPandas(cut, f"stream_id {id_type}, block long, start long, size long")
