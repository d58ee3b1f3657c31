"""MinHash near-dedup with BagMinHash: weighted-Jaccard signatures of shingle multisets, banded and verified.

A document is the multiset of its runs of ``width`` words (lower-cased runs of letters and digits; a shorter text is
one shingle). A shingle that occurs c times stands for the weights up to c, discretised into dyadic intervals
(0,1], (1,2], (2,4], ... Each interval is a Poisson process whose points carry a time, a register and a weight level;
points above c are thinned out. Each register keeps its earliest point, so two signatures agree in a register with
a probability of exactly their weighted Jaccard similarity.

* Equal word sequences are one item, however many copies there are.
* Items that share a band and agree in enough registers form candidate groups; these are compared by exact multiset
  overlap, block by block (see ``blocks``), and linked at ``threshold`` or more.
* The classes are the connected components of the links.

Results in odd cases: a text that is null, empty or without words links with nothing, as does a row with a null id
(its class is null). Every row of the input gives a row; rows that repeat an id, with the same text or another one, are documents of
their own that share its id. ``keep_one`` leaves one row of a class all the same, of the smallest id the one with the smallest hash of its text, and
keeps rows without words or id. An empty table gives no rows. Other columns are not read.
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
from siltworks.llm.common import components, cut, hot_join, maybe_broadcast
from siltworks.llm.words import mix, sequence_hash, shingle_hashes, word_hashes


@dataclass(frozen=True)
class Params:
    width: int = 5
    threshold: float = 0.8
    bands: int = 25
    rows: int = 5
    margin: float = 3.5  # standard deviations below the threshold at which signatures still make candidates


def bag_min_hash(shingles: np.ndarray, registers: int) -> np.ndarray:
    """The earliest point of each register, as 64-bit integers; the earliest times until every register has one."""
    element, count = np.unique(shingles, return_counts=True)
    seed, rate, low, top = [mix(element, 10)], [np.ones(len(element))], [np.zeros(len(element), np.int64)], [count]
    j = 0
    while (above := count > 1 << j).any():  # the interval (2^j, 2^(j+1)]
        seed.append(mix(element[above], 11 + j))
        rate.append(np.full(int(above.sum()), float(1 << j)))
        low.append(np.full(int(above.sum()), 1 << j, np.int64))
        top.append(count[above])
        j += 1
    seed, rate, low, top = map(np.concatenate, (seed, rate, low, top))
    limit = registers * (math.log(registers) + 4) / len(shingles)  # leaves a register empty once in 50 texts
    while not np.isfinite(least := _points(seed, rate, low, top, j > 0, registers, limit)).all():
        limit *= 2
    return least.view(np.uint64)


def _points(seed: np.ndarray, rate: np.ndarray, low: np.ndarray, top: np.ndarray, several: bool, registers: int, limit: float) -> np.ndarray:
    """The time of each register's earliest point up to ``limit`` of the processes; infinite without one."""
    least, time, drawn = np.full(registers, np.inf), np.zeros(len(seed)), 0
    ahead = max(4, min(64, 4096 // len(seed)))  # points of a process drawn at once
    seed, rate = seed[:, None], rate[:, None]
    low, top = low[:, None], top[:, None]
    while len(seed):
        k = np.arange(drawn + 1, drawn + ahead + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            r = mix(seed + k * np.uint64(0xA24BAED4963EE407), 40)
        x = np.log1p((r >> np.uint64(20)) * -(2.0**-44))
        if several:
            x /= rate
        x = np.cumsum(np.concatenate((time[:, None], -x), axis=1), axis=1)[:, 1:]  # added in order: the same however many are drawn at once
        now = x <= limit
        if several:  # where in its interval of weights a point lies
            level = low + 1 + ((mix(r, 41) >> np.uint64(32)) * rate * 2.0**-32).astype(np.int64)
            now &= level <= top
        register = ((r[now] & np.uint64(0xFFFFF)) * np.uint64(registers)) >> np.uint64(20)
        np.minimum.at(least, register.astype(np.int64), x[now])
        more = x[:, -1] <= limit
        time, seed, drawn = x[more, -1], seed[more], drawn + ahead
        if several:
            rate, low, top = rate[more], low[more], top[more]
    return least


def features(docs: DataFrame, p: Params) -> DataFrame:
    """(doc_id, h, s1, s2, payload, codes): the text's hash, the word sequence's hash, 8 bits of each register, and a bucket for each band. Null without words."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                words = word_hashes(text)
                if not len(words):
                    rows.append((None, None, None, None))
                    continue
                sig = bag_min_hash(shingle_hashes(words, p.width), p.bands * p.rows)
                with np.errstate(over="ignore"):
                    band = np.zeros(p.bands, np.uint64)
                    for k in range(p.rows):
                        band = mix(band ^ sig.reshape(p.bands, p.rows)[:, k], 50 + k)
                rows.append((*sequence_hash(words), mix(sig, 60).astype(np.uint8).tobytes(), band.view(np.int64)))
            s1, s2, payload, codes = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "h": batch["h"], "s1": pd.array(s1, "Int64"), "s2": pd.array(s2, "Int64"), "payload": payload, "codes": codes})

    schema = "doc_id long, h long, s1 long, s2 long, payload binary, codes array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text").mapInPandas(make, schema)


def alike(least: int):
    """A linker of signatures that agree in ``least`` registers or more."""

    def link(a: list[bytes], b: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        x, y = (np.frombuffer(b"".join(m), np.uint8).reshape(len(m), -1).T.copy() for m in (a, b))
        same = np.zeros((x.shape[1], y.shape[1]), np.uint8)
        for u, v in zip(x, y, strict=True):
            same += u[:, None] == v[None, :]
        return np.nonzero(same >= least)

    return link


def overlapping(threshold: float, chunk: int = 4096):
    """A linker of sorted 64-bit shingles by exact multiset Jaccard similarity."""

    def link(a: list[bytes], b: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sets = [np.frombuffer(x, np.uint64) for x in (*a, *b)]
        size = np.array([len(x) for x in sets])
        row = np.repeat(np.arange(len(sets)), size)
        value = np.concatenate(sets)
        # the k-th copy of a shingle in a document is a feature of its own
        start = np.concatenate(([True], (value[1:] != value[:-1]) | (row[1:] != row[:-1])))
        first = np.maximum.accumulate(np.where(start, np.arange(len(value)), 0))
        nth = np.arange(len(value)) - first
        with np.errstate(over="ignore"):
            value = value + nth.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
        _, feature, df = np.unique(value, return_inverse=True, return_counts=True)
        shared = df[feature] > 1
        order = np.argsort(feature[shared], kind="stable")
        row, feature = row[shared][order], feature[shared][order]
        column = np.cumsum(np.concatenate(([0], feature[1:] != feature[:-1]))) if len(feature) else feature
        both = np.zeros((len(a), len(b)), np.float32)
        at, columns = 0, int(column[-1]) + 1 if len(column) else 0
        for low in range(0, columns, chunk):
            end = np.searchsorted(column, low + chunk)
            m = np.zeros((len(sets), min(chunk, columns - low)), np.float32)
            m[row[at:end], column[at:end] - low] = 1
            both += m[: len(a)] @ m[len(a) :].T
            at = end
        either = size[: len(a), None] + size[None, len(a) :] - both
        return np.nonzero(both >= threshold * either - 1e-9)

    return link


def shingled(docs: DataFrame, chosen: DataFrame, rows: int, p: Params, repeats: bool) -> DataFrame:
    """Items (id, weight, payload, codes) of the chosen (id, root, weight, d, dh): the root is the bucket, the sorted shingles are the payload.

    The text is that of the document d whose text has the hash dh; ``repeats`` says that a row of docs may come several times.
    """

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            payload = [np.sort(shingle_hashes(word_hashes(x), p.width)).tobytes() for x in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "weight": batch["weight"], "payload": payload, "codes": [[x] for x in batch["root"]]})

    texts = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("dh"), "text").where("d is not null and text is not null")
    met = texts.join(maybe_broadcast(chosen, rows), ["d", "dh"])
    if repeats:
        met = met.groupBy("id", "weight", "root").agg(F.first("text").alias("text"))
    return met.mapInPandas(make, "id long, weight long, payload binary, codes array<long>")


def classed(docs: DataFrame, p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """(a row for every document: doc_id, h, n_links, component_id, rep; the (doc_id, h) of several rows with words).

    ``h`` is the hash of the text, ``rep`` the (doc_id, h) of the row that stands for the class; both last ones are null without words or id.
    """
    made = cut(features(docs, p))
    worded = made.where("doc_id is not null and s1 is not null")
    twice = cut(worded.groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "h"))
    copies = worded.groupBy("s1", "s2").agg(
        F.min(F.struct("doc_id", "h")).alias("rep"), F.count("*").alias("weight"), F.first("payload").alias("payload"), F.first("codes").alias("codes")
    )
    items = cut(copies.select(F.monotonically_increasing_id().alias("id"), "*"))  # fixed once written
    registers = p.bands * p.rows
    deviation = math.sqrt(p.threshold * (1 - p.threshold) / registers)
    found = links(items.select("id", "weight", "payload", "codes"), alike(math.floor(registers * (p.threshold - p.margin * deviation))))
    groups = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    named = items.select("id", "s1", "s2", "weight", "rep")
    chosen = cut(groups.join(named, "id").select("id", "root", "weight", F.col("rep.doc_id").alias("d"), F.col("rep.h").alias("dh")))
    exact = cut(links(shingled(docs, chosen, chosen.count(), p, bool(twice.head(1))), overlapping(p.threshold), block=256, lean=False))
    linked = exact.groupBy("id").agg(F.sum("n").alias("n"))
    roots = components(exact.select(F.col("id").alias("a"), F.col("root").alias("b")))
    least = roots.join(named.select("id", "rep"), "id").groupBy("root").agg(F.min("rep").alias("least"), F.count("*").alias("of"))
    least = hot_join(roots, cut(least), ["root"], "of", items.count()).select("id", "least")
    told = named.join(linked, "id", "left").join(least, "id", "left").select(
        "s1", "s2", "weight", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("least", "rep").alias("rep")
    )
    rows = made.select("doc_id", "h", F.when(F.col("doc_id").isNotNull(), F.col("s1")).alias("s1"), "s2")
    met = hot_join(rows, cut(told), ["s1", "s2"], "weight", made.count(), "left").select(
        "doc_id", "h", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("rep.doc_id", "doc_id").alias("component_id"), "rep"
    )
    return met, twice


def near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, n_links, component_id, kept) for every document of ``docs`` (doc_id, text)."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return classed(docs, p)[0].select("doc_id", "n_links", "component_id", kept.alias("kept"))


def keep_one(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of ``docs``, all columns, but one of each class. Rows with a null id or without words stay."""
    told, twice = classed(docs, p)
    gone = told.where((F.col("doc_id") != F.col("rep.doc_id")) | (F.col("h") != F.col("rep.h")))
    gone = cut(gone.select(F.col("doc_id").alias("d"), F.col("h").alias("dh")).distinct())
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("dh"))
    kept = rows.join(maybe_broadcast(gone, gone.count()), ["d", "dh"], "left_anti")
    if twice.head(1):
        again = maybe_broadcast(twice.toDF("d", "dh"), twice.count())
        once = kept.join(again, ["d", "dh"], "left_semi").groupBy("d", "dh").agg(F.first("row").alias("row")).select(*kept.columns)
        kept = kept.join(again, ["d", "dh"], "left_anti").unionByName(once)
    return kept.select("row.*")
