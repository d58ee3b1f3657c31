"""Greedy single-probe LZ77 analysis of blobs: matches as rows, then coverage, histograms, labels and verdicts as columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.functions.labels import DISTANCE_ENDS, LENGTH_ENDS, bar, bucket, cover_label, entropy_label, outlook, verdict
from siltworks.operators.batches import id_type, slices
from siltworks.operators.bytestats import content_type, entropy

WINDOW, LONGEST = 32 * 1024, 258
#: Multiplier and bits of the three-byte hash.
FACTOR, BITS = 0x1E35A7BD, 15


def matches_of(raw: bytes) -> list[tuple[int, int, int]]:
    """(position, length, distance) of the matches. A place is looked up, and remembered, only where no match covers it."""
    n, out = len(raw), []
    if n < 3:
        return out
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    with np.errstate(over="ignore"):
        slots = ((((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) * np.uint32(FACTOR)) >> np.uint32(32 - BITS)).tolist()
    seen: dict[int, int] = {}
    i = 0
    while i + 2 < n:
        p = seen.get(slots[i])
        seen[slots[i]] = i
        if p is not None and 3 <= i - p < WINDOW and raw[p : p + 3] == raw[i : i + 3]:
            most, length = min(LONGEST, n - i), 3
            while length < most and raw[p + length] == raw[i + length]:
                length += 1
            out.append((i, length, i - p))
            i += length
        else:
            i += 1
    return out


def lz_matches(blobs: DataFrame) -> DataFrame:
    """(stream_id, pos, length, distance) of every match."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "raw", most=1 << 18):
            per_row = [matches_of(x.as_py() or b"") for x in part.column("raw")]
            rows = np.array([m for ms in per_row for m in ms], np.int64).reshape(-1, 3)
            ids = part.column("stream_id").take(pa.array(np.repeat(np.arange(len(per_row)), [len(ms) for ms in per_row])))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c) for c in rows.T)], names=["stream_id", "pos", "length", "distance"])

    return blobs.select("stream_id", "raw").mapInArrow(found, f"stream_id {id_type(blobs)}, pos long, length long, distance long")


def summary(blobs: DataFrame) -> DataFrame:
    """(stream_id, bytes, matches, match_bytes, cover, mean_length, mean_distance, peak, length_buckets, distance_buckets)."""
    m = lz_matches(blobs)
    lengths = [F.count_if(bucket(F.col("length"), LENGTH_ENDS) == k) for k in range(len(LENGTH_ENDS) + 1)]
    distances = [F.count_if(bucket(F.col("distance"), DISTANCE_ENDS) == k) for k in range(len(DISTANCE_ENDS) + 1)]
    by = m.groupBy("stream_id").agg(
        F.count("*").alias("matches"),
        F.sum("length").alias("match_bytes"),
        F.sum("distance").alias("distances"),
        F.max("length").alias("peak"),
        F.array(*lengths).alias("length_buckets"),
        F.array(*distances).alias("distance_buckets"),
    )
    sized = blobs.select("stream_id", F.octet_length("raw").cast("long").alias("bytes"))
    got = sized.join(by, "stream_id", "left").na.fill(0, ["matches", "match_bytes", "distances", "peak"])
    per = lambda c: F.when(F.col("matches") > 0, F.col(c) / F.col("matches")).otherwise(0.0)
    none = lambda ends: F.array_repeat(F.lit(0).cast("long"), len(ends) + 1)
    return got.select(
        "stream_id",
        "bytes",
        "matches",
        "match_bytes",
        (F.col("match_bytes") / F.greatest("bytes", F.lit(1))).alias("cover"),
        per("match_bytes").alias("mean_length"),
        per("distances").alias("mean_distance"),
        "peak",
        F.coalesce("length_buckets", none(LENGTH_ENDS)).alias("length_buckets"),
        F.coalesce("distance_buckets", none(DISTANCE_ENDS)).alias("distance_buckets"),
    )


def analysis_card(blobs: DataFrame, packed_bytes: DataFrame | None = None) -> DataFrame:
    """One row for each blob: sizes, entropy, coverage, matches, labels, the ratio seen (``packed_bytes``: stream_id, packed) or expected, and the verdict."""
    card = summary(blobs).join(entropy(blobs).select("stream_id", "entropy"), "stream_id").join(content_type(blobs), "stream_id")
    card = card.join(packed_bytes, "stream_id", "left") if packed_bytes is not None else card.withColumn("packed", F.lit(None).cast("long"))
    said = verdict(F.col("entropy"), F.col("cover"), F.col("matches"), F.col("mean_distance"), F.col("peak"))
    return card.withColumns(
        {
            "entropy_label": entropy_label(F.col("entropy")),
            "cover_label": cover_label(F.col("cover")),
            "outlook": outlook(F.col("cover"), F.col("packed"), F.col("bytes")),
            "verdict": said,
            "bar": bar(F.col("entropy"), 8.0, 10),
        }
    )
