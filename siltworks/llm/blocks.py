"""Links between items that share a bucket, found in bounded blocks and given back in linear size.

A bucket of any size is cut into blocks of at most about ``BLOCK`` items, and each pair of blocks is one unit of
work, so a hot bucket spreads over many tasks. A unit never emits its pairs: each item comes back with its
number of new links and the root of a spanning forest of them. A pair that shares several buckets is counted in
the first of its tables alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import cut, maybe_broadcast

BLOCK = 1024

#: Payloads of two blocks to the index arrays (rows of the first, rows of the second) of the linked pairs.
Linker = Callable[[list[bytes], list[bytes]], tuple[np.ndarray, np.ndarray]]


def forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the edges (u, v)."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, u, root[v])
        np.minimum.at(low, v, root[u])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def deal(rows: DataFrame, keys: list[str], block: int = BLOCK, lean: bool = True) -> DataFrame:
    """``rows`` by bucket (``keys``) and unit: ``bi``, ``bj`` and ``side`` come in place of a hot bucket's size.

    ``side`` is 0 for items of block ``bi`` and 1 for those of block ``bj``; within ``bi = bj`` it is 0. Lean rows
    are (id, keys) alone: buckets of one item go, and of buckets with the same items only the first stays. Rows that
    carry more are not moved for that.
    """
    seen = [F.count("*").alias("in_bucket")]
    if lean:
        seen += [F.min("id").alias("least"), F.bit_xor(F.xxhash64("id")).alias("x1"), F.bit_xor(F.xxhash64(F.lit("x"), "id")).alias("x2")]
    sizes = rows.groupBy(*keys).agg(*seen).where(F.col("in_bucket") > (1 if lean else block))
    if lean:
        first = F.min(F.struct(*keys)).alias("first")
        sizes = sizes.groupBy("in_bucket", "least", "x1", "x2").agg(first).select("first.*", "in_bucket")
    sizes = cut(sizes.select(*keys, F.ceil(F.col("in_bucket") / block).cast("int").alias("parts")))
    met = rows.join(maybe_broadcast(sizes, sizes.count()), keys, "inner" if lean else "left")
    parts = F.coalesce(F.col("parts"), F.lit(1))
    own = F.pmod(F.xxhash64(F.lit("block"), F.col("id")), parts.cast("long")).cast("int")
    met = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return met.select(
        *rows.columns,
        F.least("own", "other").alias("bi"),
        F.greatest("own", "other").alias("bj"),
        F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"),
    )


def groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of rows that come sorted by ``keys``; a group spans batches but is never larger than two blocks."""
    kept: pd.DataFrame | None = None
    for batch in batches:
        if kept is not None:
            batch = pd.concat([kept, batch], ignore_index=True)
        if not len(batch):
            continue
        change = np.zeros(len(batch), bool)
        for k in keys:
            col = batch[k].to_numpy()
            change[1:] |= col[1:] != col[:-1]
        cuts = [0, *np.flatnonzero(change)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.iloc[a:b]
        kept = batch.iloc[cuts[-1] :]
    if kept is not None and len(kept):
        yield kept


def links(items: DataFrame, link: Linker, block: int = BLOCK, lean: bool = True) -> DataFrame:
    """Rows (id, root, n) by item and unit: n is the weight of the items newly linked to it, root an item it is connected to.

    ``items``: id long (unique), weight long, payload binary, codes array of integers with the item's bucket in each table.
    Summing n by id gives each item's links; the edges (id, root) connect what the links connect. ``lean``: find the
    buckets that matter by their ids first and join the payloads to these only; for buckets of which few are shared.
    """
    bucket = F.posexplode("codes").alias("t", "code")
    early = F.slice("codes", F.lit(1), F.col("t"))  # a row carries the codes of the tables before its own
    if lean:
        dealt = deal(items.select("id", bucket), ["t", "code"], block).join(items, "id").withColumn("codes", early)
    else:
        each = items.select("id", "weight", "payload", "codes", bucket).withColumn("codes", early)
        dealt = deal(each, ["t", "code"], block, False)
    unit = ["t", "code", "bi", "bj"]
    dealt = dealt.repartition(*unit).sortWithinPartitions(*unit)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(batches, unit):
            t, same = int(g["t"].iloc[0]), g["bi"].iloc[0] == g["bj"].iloc[0]
            side = g["side"].to_numpy()
            a = np.flatnonzero(side == 0)
            b = a if same else np.flatnonzero(side == 1)
            if not len(a) or not len(b):
                continue
            payload = g["payload"].tolist()
            first = [payload[k] for k in a]
            i, j = link(first, first if same else [payload[k] for k in b])
            if same:
                i, j = (x[i < j] for x in (i, j))
            u, v = a[i], b[j]
            if t and len(u):
                early = np.zeros(len(u), bool)
                table = np.stack([np.asarray(x[:t], np.int64) for x in g["codes"]])
                for k in range(t):
                    early |= table[u, k] == table[v, k]
                u, v = u[~early], v[~early]
            if not len(u):
                continue
            weight = g["weight"].to_numpy()
            n = np.bincount(u, weight[v], len(g)) + np.bincount(v, weight[u], len(g))
            ids, root = g["id"].to_numpy(), forest(len(g), u, v)
            at = np.flatnonzero(n)
            yield pd.DataFrame({"id": ids[at], "root": ids[root[at]], "n": n[at].astype(np.int64)})

    return dealt.mapInPandas(find, "id long, root long, n long")
