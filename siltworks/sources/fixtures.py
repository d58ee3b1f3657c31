"""Seeded byte fixtures as DataFrames: kinds of data, and a grid of entropy, period, alphabet and records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("text", "tabular", "binary", "noise")


def make(kind: str, size: int, seed: int) -> bytes:
    """Deterministic bytes of a kind; a shorter one is the beginning of a longer one."""
    r = np.random.Generator(np.random.Philox(seed))
    if kind == "noise":
        return r.integers(0, 256, size, np.uint8).tobytes()
    out = bytearray()
    n = 0
    while len(out) < size:
        if kind == "text":
            out += b" ".join(bytes(97 + r.integers(0, 26, int(k), np.uint8) % 7) for k in r.integers(2, 9, 12)) + b".\n"
        elif kind == "tabular":
            if not n:
                out += b"id,timestamp,region,status,value,flag\n"
            out += b"%d,%d,r%d,%s,%d.%02d,%d\n" % (n, 1_700_000_000 + 7 * n, r.integers(0, 8), (b"ok", b"late", b"lost")[r.integers(0, 3)], *r.integers(0, 100, 2), r.integers(0, 2))
        else:
            out += n.to_bytes(4, "little") + bytes(8) + r.integers(0, 256, 4, np.uint8).tobytes()
        n += 1
    return bytes(out[:size])


def blobs(spark: SparkSession, size: int = 1 << 20, seed: int = 1) -> DataFrame:
    """(stream_id, raw): one blob of each kind."""

    @F.pandas_udf("binary")
    def made(kind: pd.Series) -> pd.Series:
        return kind.map(lambda k: make(k, size, seed))

    names = spark.createDataFrame([(k,) for k in KINDS], "stream_id string").repartition(len(KINDS))
    return names.select("stream_id", made("stream_id").alias("raw"))


def surface(spark: SparkSession, size: int = 1 << 16, seed: int = 1) -> DataFrame:
    """(stream_id, entropy_bits, period, alphabet, raw) over a grid: symbols of an alphabet that repeat after a period with random ones in between."""
    axis = lambda name, values: spark.createDataFrame([(v,) for v in values], f"{name} int")
    grid = axis("entropy_bits", (2, 4, 6, 8)).crossJoin(axis("period", (16, 128, 1024, 8192))).withColumn("alphabet", F.pow(F.lit(2), F.col("entropy_bits")).cast("int"))

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raws = []
            for bits, period, alphabet in zip(batch["entropy_bits"], batch["period"], batch["alphabet"], strict=True):
                r = np.random.Generator(np.random.Philox(seed * 1000 + bits * 100 + int(period).bit_length()))
                base = np.resize(r.integers(0, alphabet, period), size)
                fresh = r.random(size) < bits / 32
                raws.append(np.where(fresh, r.integers(0, alphabet, size), base).astype(np.uint8).tobytes())
            yield batch.assign(raw=raws)

    named = grid.withColumn("stream_id", F.concat_ws("-", "entropy_bits", "period"))
    return named.select("stream_id", "entropy_bits", "period", "alphabet").mapInPandas(made, "stream_id string, entropy_bits int, period int, alphabet int, raw binary")
