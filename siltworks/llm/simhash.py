"""Document fingerprints: SimHash with permuted block tables.

The terms of a text are its runs of ``width`` words (lower-cased runs of letters and digits; a shorter text is one term),
weighted by how often they occur. Each term's 128-bit hash votes with its weight for or against each bit; the
fingerprint is the signs. Two fingerprints are alike by the share of equal bits.

``neighbours_of`` finds all fingerprints within ``radius`` bits: the bits are permuted into radius + k blocks, of which two
such fingerprints share k at least; each choice of k blocks is a table, k the least number that leaves buckets of a few
items, however many there are. The candidates of a bucket are compared in full, block by block of bounded size (see ``blocks``). Equal fingerprints are one item, weighted by their number.

``compared`` needs each document next to its successor: ids alone are cut into ranges of about as many code points as
one task should read, then each text moves once, deflated, to the task of its range.

Results in odd cases: a null text is an empty one; texts without words have the fingerprint of zeros and link with nothing but
count as equal to each other in ``likeness``. Rows that repeat an id and text are documents of their own. Null ids come
first in the order of ids; among equal ids the smaller hash of the text comes first. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.llm.blocks import links
from siltworks.llm.common import cut, hot_join
from siltworks.llm.words import mix, shingle_hashes, word_hashes

BITS = 128

#: Code points of the texts that one task compares with their successors, about.
PER_TASK = 1 << 25

#: Documents in the order of their ids, null ids first.
ORDER = ("some", "doc_id", "h")


@dataclass(frozen=True)
class Params:
    width: int = 5
    radius: int = 6
    seed: int = 5
    per_bucket: int = 16


_SIGNS = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) * 2.0 - 1).astype(np.float64)


def fingerprint(text: str | None, width: int) -> bytes:
    """The votes of all terms as 16 bytes; zeros without words."""
    terms = shingle_hashes(word_hashes(text), width)
    if not len(terms):
        return bytes(BITS // 8)
    half = BITS // 16
    votes = np.zeros((BITS // 8, 256))
    place = np.arange(half) * 256
    for part, seed in ((0, 70), (1, 71)):
        octets = mix(terms, seed).view(np.uint8).reshape(len(terms), half)
        votes[part * half : (part + 1) * half] = np.bincount((octets + place).ravel(), minlength=half * 256).reshape(half, 256)
    return np.packbits(votes @ _SIGNS > 0, axis=1).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    return 1 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / BITS


def tables(n: int, p: Params) -> list[np.ndarray]:
    """The bits of each table for n items: all choices of k of radius + k blocks."""
    order = np.random.default_rng(p.seed).permutation(BITS)
    for k in range(1, p.radius + 2):
        blocks = np.array_split(order, p.radius + k)
        bits = k * (BITS // (p.radius + k))
        if n <= p.per_bucket << bits or bits > 48:
            break
    return [np.concatenate(c) for c in combinations(blocks, k)]


def neighbours_of(fingerprints: DataFrame, p: Params) -> DataFrame:
    """(fp, weight, n_near): by distinct fingerprint (fp binary, weight long) the weight of the others within the radius, and its own less one."""
    items = cut(fingerprints.select(F.monotonically_increasing_id().alias("id"), "fp", "weight"))
    chosen = tables(items.count(), p)

    def tabled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bits = np.unpackbits(np.frombuffer(b"".join(batch["fp"]), np.uint8).reshape(-1, BITS // 8), axis=1).astype(np.int64)
            codes = np.stack([bits[:, b] @ (1 << np.arange(len(b), dtype=np.int64)) for b in chosen], axis=1)
            yield pd.DataFrame({"id": batch["id"], "weight": batch["weight"], "payload": batch["fp"], "codes": list(codes)})

    def close(a: list[bytes], b: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        x, y = (np.frombuffer(b"".join(m), np.uint64).reshape(len(m), 2) for m in (a, b))
        apart = sum(np.bitwise_count(x[:, None, k] ^ y[None, :, k]).astype(np.int64) for k in range(2))
        return np.nonzero(apart <= p.radius)

    worded = items.where(F.col("fp") != F.lit(bytes(BITS // 8)))
    found = links(worded.mapInPandas(tabled, "id long, weight long, payload binary, codes array<long>"), close)
    near = found.groupBy("id").agg(F.sum("n").alias("n"))
    return items.join(near, "id", "left").select(
        "fp", "weight", F.when(F.col("fp") == F.lit(bytes(BITS // 8)), F.lit(0)).otherwise(F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_near")
    )


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n/2) code points replaced by the first as many of ``following``, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def ranges(docs: DataFrame) -> list[tuple]:
    """The first row (id is not null, id, hash of the text) of each range of documents, in order.

    Ids and hashes alone are sorted for it. A range is for one task: its length follows from ``PER_TASK`` code points,
    so the driver gets three numbers for each so many.
    """
    keys = docs.select(*_order(), F.length("text").cast("long").alias("n"))
    parts = max(1, math.ceil((keys.agg(F.sum("n")).head()[0] or 0) / PER_TASK))
    if parts > 1:
        keys = keys.repartitionByRange(parts, *ORDER)
    first = keys.groupBy(F.spark_partition_id().alias("part") if parts > 1 else F.lit(0).alias("part")).agg(F.min(F.struct(*ORDER)).alias("m"))
    return sorted(tuple(r["m"]) for r in first.collect())


def _order() -> list[Column]:
    doc_id = F.col("doc_id").cast("long")
    return [doc_id.isNotNull().alias("some"), F.coalesce(doc_id, F.lit(0)).alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")]


def packed(docs: DataFrame, p: Params, first: list[tuple]) -> DataFrame:
    """(part, halo, some, doc_id, h, n_chars, fp, body): each document once, fingerprinted and its text deflated, in the range it belongs to.

    The first document of a range comes a second time, as the ``halo`` that follows the range before it (the last one, for the very first).
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for some, doc_id, h, text in zip(batch["some"], batch["doc_id"], batch["h"], batch["text"], strict=True):
                key = (bool(some), int(doc_id), int(h))
                part = bisect_right(first, key) - 1
                row = (*key, len(text), fingerprint(text, p.width), zlib.compress(text.encode("utf-8", "surrogatepass")))
                out.append((part, False, *row))
                if key == first[part]:
                    out.append(((part or len(first)) - 1, True, *row))
            yield pd.DataFrame(out, columns=["part", "halo", "some", "doc_id", "h", "n_chars", "fp", "body"])

    rows = docs.select(*_order(), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(pack, "part int, halo boolean, some boolean, doc_id long, h long, n_chars long, fp binary, body binary")


def compared(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next) for every document, by the one after it in the order of ids."""
    first = ranges(docs)
    rows = packed(docs, p, first).repartitionById(max(1, len(first)), "part").sortWithinPartitions("part", "halo", *ORDER)

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: tuple | None = None  # (id, text, fingerprint) of the row before
        for batch in batches:
            out = []
            for halo, some, doc_id, fp, body in zip(batch["halo"], batch["some"], batch["doc_id"], batch["fp"], batch["body"], strict=True):
                text = zlib.decompress(body).decode("utf-8", "surrogatepass")
                if waiting is not None:
                    i, before, own = waiting
                    changed = edited(before, text)
                    efp = fingerprint(changed, p.width)
                    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((i, len(before), digest, own, efp, likeness(own, efp), likeness(own, fp)))
                waiting = None if halo else (doc_id if some else None, text, fp)
            made = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "near_edited", "near_next"])
            yield made.assign(doc_id=made["doc_id"].astype("Int64"))

    return rows.mapInPandas(told, "doc_id long, n_chars long, edited_sha256 string, fp binary, edited_fp binary, near_edited double, near_next double")


def report(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``compared`` with the fingerprints as hex and ``n_near``, the number of other documents within the radius."""
    rows = cut(compared(docs, p))
    near = cut(neighbours_of(rows.groupBy("fp").agg(F.count("*").alias("weight")), p))
    return hot_join(rows, near, ["fp"], "weight", rows.count()).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.lower(F.hex("fp")).alias("fingerprint"),
        F.lower(F.hex("edited_fp")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        F.col("n_near").cast("long").alias("n_near"),
    )
