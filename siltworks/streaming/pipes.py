"""Pipe mode as Structured Streaming: files that arrive are unpacked, tested or profiled as they come, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.operators import codec

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """(stream_id, packed, length, modified) of files as they arrive below a folder."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(path)
    return files.select(F.col("path").alias("stream_id"), F.col("content").alias("packed"), "length", F.col("modificationTime").alias("modified"))


def unpacked(files: DataFrame) -> DataFrame:
    """Each file unpacked, an error row if it can't be."""
    return codec.decompress(files)


def tested(files: DataFrame) -> DataFrame:
    return codec.test(files)


def write(stream: DataFrame, path: str, checkpoint: str, once: bool = True):
    """A query that appends the rows as Parquet, exactly once by its checkpoint; ``once``: all that is there, then it ends."""
    out = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if once else out).start()
