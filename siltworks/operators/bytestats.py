"""Byte statistics: histogram, entropy, content type, canvas. The payload is dropped at the first step, the rest is built-in expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.functions.labels import backend, buffer_size, chunk_size, entropy_label, thread_count
from siltworks.operators.batches import id_type, slices

SAMPLE = 8192


def byte_hist(blobs: DataFrame, sample: int | None = None) -> DataFrame:
    """(stream_id, byte, n): counts of the bytes that occur, of the first ``sample`` bytes or of all.

    Each blob is counted where it lies, at most 256 rows come of it and nothing is shuffled; exploding the bytes into rows
    costs several times as much.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "raw"):
            counts = np.array([np.bincount(np.frombuffer(x.as_py() or b"", np.uint8), minlength=256) for x in part.column("raw")])
            row, byte = np.nonzero(counts)
            columns = [part.column("stream_id").take(pa.array(row)), pa.array(byte.astype(np.int32)), pa.array(counts[row, byte].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["stream_id", "byte", "n"])

    raw = blobs.select("stream_id", F.substring("raw", 1, sample).alias("raw") if sample else F.col("raw"))
    return raw.mapInArrow(counted, f"stream_id {id_type(raw)}, byte int, n long")


def entropy(blobs: DataFrame) -> DataFrame:
    """(stream_id, bytes, distinct, entropy, label): order-0 bits a byte, to six digits; an empty blob has 0."""
    h = byte_hist(blobs)
    bits = F.sum(F.col("n") * F.log2("n"))
    sums = h.groupBy("stream_id").agg(F.sum("n").alias("bytes"), F.count("*").alias("distinct"), bits.alias("bits"))
    value = F.round(F.log2("bytes") - F.col("bits") / F.col("bytes"), 6)
    all_ids = blobs.select("stream_id")
    out = all_ids.join(sums, "stream_id", "left").select(
        "stream_id",
        F.coalesce("bytes", F.lit(0)).alias("bytes"),
        F.coalesce("distinct", F.lit(0)).alias("distinct"),
        F.coalesce(F.abs(value), F.lit(0.0)).alias("entropy"),
    )
    return out.withColumn("label", entropy_label(F.col("entropy")))


def content_type(blobs: DataFrame) -> DataFrame:
    """(stream_id, content, random_like) by the first 8 KiB: text, binary or random."""
    h = byte_hist(blobs, SAMPLE)
    b, n = F.col("byte"), F.col("n")
    printable = b.between(0x20, 0x7E) | b.isin(9, 10, 13) | b.between(0x80, 0xF7)
    control = b.between(0, 8) | b.isin(11, 12) | b.between(14, 31)
    s = h.groupBy("stream_id").agg(
        F.sum("n").alias("total"),
        F.coalesce(F.sum(F.when(printable, n)), F.lit(0)).alias("text"),
        F.coalesce(F.sum(F.when(control, n)), F.lit(0)).alias("control"),
        F.sum(n * n).alias("squares"),
        F.count("*").alias("kinds"),
        F.max("n").alias("most"),
    )
    # the variance is over all 256 values, those that don't occur too
    mean = F.col("total") / 256.0
    variance = F.col("squares") / 256.0 - mean * mean
    random_like = (F.col("total") >= 256) & (variance < mean * 1.5) & (F.col("kinds") / 256.0 > 0.8) & (F.col("most") / F.col("total") < 0.1)
    content = (
        F.when((F.col("text") / F.col("total") > 0.8) & (F.col("control") / F.col("total") < 0.1), "text")
        .when((F.col("text") / F.col("total") < 0.3) & random_like, "random")
        .otherwise("binary")
    )
    told = s.select("stream_id", content.alias("content"), random_like.alias("random_like"))
    return blobs.select("stream_id").join(told, "stream_id", "left").select(
        "stream_id", F.coalesce("content", F.lit("binary")).alias("content"), F.coalesce("random_like", F.lit(False)).alias("random_like")
    )


def canvas(blobs: DataFrame, cells: int = 64) -> DataFrame:
    """(stream_id, cell, bytes, mean_byte): the whole-number mean of each of up to ``cells`` equal stretches."""
    sized = blobs.select("stream_id", F.greatest(F.ceil(F.octet_length("raw") / cells), F.lit(1)).alias("per_cell"), F.hex("raw").alias("digits"))
    cut = sized.select(
        "stream_id",
        F.posexplode(
            F.expr("transform(sequence(0, greatest(length(digits) div 2 - 1, 0), per_cell), s -> substring(digits, int(2 * s + 1), int(2 * per_cell)))")
        ).alias("cell", "part"),
    ).where("part <> ''")
    total = F.aggregate(F.regexp_extract_all("part", F.lit("(..)"), F.lit(1)), F.lit(0).cast("long"), lambda t, p: t + F.conv(p, 16, 10).cast("long"))
    size = F.floor(F.length("part") / 2)
    return cut.select("stream_id", "cell", size.alias("bytes"), F.floor(total / size).alias("mean_byte"))


def tuning(blobs: DataFrame, requested: int = 8, cpus: int = 8, level: int = 6) -> DataFrame:
    """(stream_id, bytes, content, threads, buffer, backend, chunk): what a compressor would choose."""
    sized = blobs.select("stream_id", F.octet_length("raw").cast("long").alias("bytes"))
    threads = thread_count(F.lit(requested), F.lit(cpus), F.col("bytes"), F.lit(level))
    known = sized.join(content_type(blobs).select("stream_id", "content"), "stream_id")
    return known.select(
        "stream_id",
        "bytes",
        "content",
        threads.alias("threads"),
        buffer_size(F.col("bytes"), F.col("content")).alias("buffer"),
        backend(F.col("bytes"), threads).alias("backend"),
        chunk_size(F.col("bytes"), threads).alias("chunk"),
    )


def chunk_grid(blobs: DataFrame, threads: int = 8) -> DataFrame:
    """(stream_id, chunk, start, size): the stretches that are compressed side by side."""
    sized = blobs.select("stream_id", F.octet_length("raw").cast("long").alias("bytes"))
    sized = sized.withColumn("per_chunk", chunk_size(F.col("bytes"), F.lit(threads))).where("bytes > 0")
    starts = sized.select("*", F.posexplode(F.expr("sequence(0L, bytes - 1, per_chunk)")).alias("chunk", "start"))
    return starts.select("stream_id", "chunk", "start", F.least("per_chunk", F.col("bytes") - F.col("start")).alias("size"))
