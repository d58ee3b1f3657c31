"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables, exact cosine, connected components.

* Equal vectors are one item, weighted by their number, so exact copies cost one row.
* Each item gets a code of ``bits`` signs in each table. The number of bits follows the number of items (about
  ``per_bucket`` items a bucket), that of tables follows from the bits: a pair right at the threshold shares a
  bucket with probability ``recall`` at least, closer pairs with more.
* Within buckets, all pairs are compared by cosine in double precision, block by block (see ``blocks``).

Results in odd cases: a vector that is null, empty, zero, or holds null or non-finite components, or has a null id,
links with nothing and is its own component. Vectors of different lengths never link. Each repeated row counts
as a vector of its own. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.blocks import links
from siltworks.llm.common import components, cut, hot_join


@dataclass(frozen=True)
class Params:
    threshold: float = 0.9
    recall: float = 0.999  # of pairs right at the threshold
    per_bucket: int = 64
    seed: int = 11


def plan(n: int, p: Params) -> tuple[int, int]:
    """Bits of a code and number of tables for n items."""
    bits = min(31, max(4, math.ceil(math.log2(max(n, 2) / p.per_bucket)))) if n > p.per_bucket else 4
    share = (1 - math.acos(p.threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - p.recall) / math.log1p(-share)))


def near_pairs(threshold: float):
    """A linker of float32 or float64 vectors (first byte: 4 or 8) by cosine in double precision."""

    def unit(payload: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(x) for x in payload])
        width = int(sizes.max())
        # zero bytes at the end of a shorter vector are zeros
        raw = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in payload), np.uint8).reshape(len(payload), width)
        out = np.ascontiguousarray(raw[:, 1:]).view(np.float32 if payload[0][0] == 4 else np.float64).astype(np.float64)
        out /= np.abs(out).max(axis=1, keepdims=True)
        out /= np.sqrt((out * out).sum(axis=1, keepdims=True))
        return out, sizes

    def link(a: list[bytes], b: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        x, nx = unit(a)
        y, ny = (x, nx) if a is b else unit(b)
        width = max(x.shape[1], y.shape[1])
        x, y = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, y))
        return np.nonzero((x @ y.T >= threshold) & (nx[:, None] == ny[None, :]))

    return link


def classes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(every row with the keys k1, k2 of its class and whether it is ok, one row for each class of equal vectors)."""
    fine = (
        F.col("vec_id").isNotNull()
        & (F.coalesce(F.size("embedding"), F.lit(0)) > 0)
        & F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    )
    keyed = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        "embedding",
        fine.alias("ok"),
        F.xxhash64("embedding").alias("k1"),
        F.xxhash64(F.lit("second"), "embedding").alias("k2"),
    )
    rows = keyed.select("vec_id", "ok", "k1", "k2")
    least = F.min_by("embedding", "vec_id").alias("embedding")
    return rows, keyed.where("ok").groupBy("k1", "k2").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"), least)


def coded(classes: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """Items (id, weight, payload, codes) of the classes."""
    wide = classes.schema["embedding"].dataType.elementType.simpleString() == "double"
    kind, mark = (np.float64, b"\x08") if wide else (np.float32, b"\x04")

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            codes, payload = [], []
            for v in batch["embedding"]:
                v = np.asarray(v, kind)
                if len(v) not in planes:
                    planes[len(v)] = np.random.default_rng((seed, len(v))).standard_normal((len(v), bits * tables))
                signs = ((v.astype(np.float64) / np.abs(v).max()) @ planes[len(v)] >= 0).reshape(tables, bits)
                codes.append((signs @ (1 << np.arange(bits, dtype=np.int64))).astype(np.int32))
                payload.append(mark + v.tobytes())
            yield pd.DataFrame({"id": batch["id"], "weight": batch["weight"], "payload": payload, "codes": codes})

    schema = "id long, weight long, payload binary, codes array<int>"
    return classes.select("id", "weight", "embedding").mapInPandas(code, schema)


def near_duplicates(vectors: DataFrame, p: Params = Params()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding)."""
    rows, classes = classes_of(vectors)
    classes = cut(classes)
    bits, tables = plan(classes.count(), p)
    found = cut(links(coded(classes, bits, tables, p.seed), near_pairs(p.threshold), lean=False))
    linked = found.groupBy("id").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    told = (
        classes.select("k1", "k2", "id", "weight")
        .join(linked, "id", "left")
        .join(roots, "id", "left")
        .select("k1", "k2", F.lit(True).alias("ok"), "weight", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("root", "id").alias("root"))
    )
    return hot_join(rows, cut(told), ["k1", "k2", "ok"], "weight", rows.count(), "left").select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("root", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("root", "vec_id"), F.lit(True)).alias("kept"),
    )
