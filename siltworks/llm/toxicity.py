"""Toxicity: cumulative-link ordinal regression of a severity grade on sparse text features.

Features are hashed words and word beginnings of 4 to 7 characters; each has two values, the logarithms of one plus its
count and of one plus its rate in 100 words. Those that go with the labels by a G-test over the training sample are learned. One weight vector is shared by all thresholds: P(grade >= k) is the logistic of w.x - theta_k with ordered
theta. Weights are trained by FTRL-proximal with an l1 and l2 penalty, thresholds by AdaGrad on the first and the
logarithms of the gaps.

Labels say toxic or not. Grade 0 is not toxic; toxic training documents are graded 1 to ``grades`` by quantiles of how
dense the terms are in them that the labels mark as toxic. The training sample is bounded: ``per_class`` labelled
documents of each class at most, by the hashes of id and text, none whose crc32 of the id is 0 modulo 5 (these are for measuring).
The thresholds are then moved so that the first has the best F1 on the sample, weighted to the share of toxic labels. Every whole text is scored where it
lies; nothing is shuffled for it.

Results in odd cases: a text that is null, empty or without words has severity 0, grade 0 and isn't toxic. Labels that are
null or name no document teach nothing; a document with several labels counts as toxic if one says so. Without labels of
both classes every severity is 0. Repeated rows get equal results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import crc_mod5, hash_sample
from siltworks.llm.words import mix, powers
from siltworks.llm.words import _alnum as alnum


@dataclass(frozen=True)
class Params:
    bits: int = 18
    beginnings: tuple[int, ...] = (4, 5, 6, 7)
    per_class: int = 1500
    grades: int = 3
    epochs: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 1e-3
    least_g: float = 15.0  # G-statistic from which a feature is learned, and its least share of the sample's size
    least_share: float = 0.02
    marked: float = 10.0  # how much more frequent among toxic documents a marked term is


@dataclass
class Model:
    params: Params
    known: np.ndarray  # by feature: is it learned
    weights: np.ndarray  # by feature, of counts and then of rates
    theta: np.ndarray


def text_features(text: str | None, p: Params) -> tuple[np.ndarray, np.ndarray, int]:
    """(features, counts, number of words) of the lower-cased text."""
    none = np.empty(0, np.int64)
    if not text:
        return none, none, 0
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = alnum()[codes]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(start):
        return none, none, 0
    up, down = powers(len(codes))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
        hashes = [mix((sums[end] - sums[start]) * down[start], 20)]
        for n in p.beginnings:
            s = start[end - start >= n]
            hashes.append(mix((sums[s + n] - sums[s]) * down[s], 20 + n))
    feature, count = np.unique(np.concatenate(hashes) >> np.uint64(64 - p.bits), return_counts=True)
    return feature.astype(np.int64), count, len(start)


def _plain(x: object) -> object:
    return bytes(x) if isinstance(x, bytearray) else x


def training_sample(docs: DataFrame, labels: DataFrame, p: Params) -> tuple[list[tuple], float]:
    """Sampled (toxic, words, features, counts), ordered by content, and the share of toxic labels."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(crc_mod5() != 0)
    sizes = {r["toxic"]: r["n"] for r in known.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return [], 0.0
    ids = known.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    chosen = hash_sample(ids, "toxic", ["doc_id"], p.per_class)  # 2 x per_class ids of a few bytes at most, whatever the size of the labels

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for toxic, text in zip(batch["toxic"], batch["text"], strict=True):
                f, c, n = text_features(text, p)
                rows.append((toxic, n, f.astype(np.int32).tobytes(), np.minimum(c, 2**31 - 1).astype(np.int32).tobytes()))
            yield pd.DataFrame(rows, columns=["toxic", "words", "feature", "n"])

    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    texts = hash_sample(texts, "toxic", ["doc_id", "text"], p.per_class).select("toxic", "text")  # an id may be that of many rows
    # copies teach once
    got = sorted({tuple(map(_plain, r)) for r in texts.mapInPandas(make, "toxic int, words long, feature binary, n binary").collect()})
    return [(t, n, np.frombuffer(f, np.int32), np.frombuffer(c, np.int32)) for t, n, f, c in got if n], sizes[1] / (sizes[0] + sizes[1])


def values(f: np.ndarray, c: np.ndarray, words: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The learned features of a text, by how often they come and, behind these, by how often in 100 words; a text without any has the score 0."""
    f, c = f[known[f]], c[known[f]]
    return np.concatenate((f, f + len(known))), np.concatenate((np.log1p(c), np.log1p(c * (100 / words))))


def associated(sample: list[tuple], p: Params) -> np.ndarray:
    """Which features' presence goes with the label, either way, by a G-test of two by two cells."""
    seen = np.zeros((2, 1 << p.bits))
    for toxic, _, feature, _ in sample:
        seen[toxic, feature] += 1
    n = np.array([[sum(1 for t, *_ in sample if t == k)] for k in (0, 1)])
    cells, total = np.stack((seen, n - seen)), n.sum()
    expected = cells.sum(axis=1, keepdims=True) * n[None] / total
    g = 2 * (cells * np.log(np.maximum(cells, 1e-12) / np.maximum(expected, 1e-12))).sum(axis=(0, 1))
    return g >= max(p.least_g, p.least_share * total)


def severity_grades(sample: list[tuple], p: Params) -> np.ndarray:
    """Grades of the sample: 0, or by the quantile of the density of marked terms among toxic documents."""
    seen = np.zeros((2, 1 << p.bits))
    for toxic, _, feature, _ in sample:
        seen[toxic, feature] += 1
    n = np.array([sum(1 for t, *_ in sample if t == k) for k in (0, 1)])
    rate = (seen + 0.5) / (n[:, None] + 1)
    marked = (rate[1] > p.marked * rate[0]) & (seen[1] >= max(5, 0.01 * n[1]))
    density = np.array([c[marked[f]].sum() / w for _, w, f, c in sample])
    toxic = np.array([t for t, *_ in sample])
    cuts = np.quantile(density[toxic == 1], np.arange(1, p.grades) / p.grades)
    return np.where(toxic == 1, 1 + np.searchsorted(cuts, density, side="right"), 0)


def sigmoid(z: np.ndarray | float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def slopes(score: float, theta: np.ndarray, g: int) -> tuple[float, np.ndarray]:
    """The derivatives of -log P(grade = g) by the score and by each threshold."""
    tail = sigmoid(score - theta)  # P(grade >= 1), ...
    edge = np.concatenate(([1.0], tail, [0.0]))
    slope = np.concatenate(([0.0], tail * (1 - tail), [0.0]))
    chance = max(edge[g] - edge[g + 1], 1e-9)
    dt = np.zeros(len(theta))
    if g:
        dt[g - 1] += slope[g] / chance
    if g < len(theta):
        dt[g] -= slope[g + 1] / chance
    return -(slope[g] - slope[g + 1]) / chance, dt


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    sample, share = training_sample(docs, labels, p)
    if len({t for t, *_ in sample}) < 2:
        return Model(p, np.zeros(1 << p.bits, bool), np.zeros(2 << p.bits), np.full(p.grades, np.inf))
    y = severity_grades(sample, p)
    known = associated(sample, p)
    xs = [values(f, c, w, known) for _, w, f, c in sample]
    z, n = np.zeros(2 << p.bits), np.zeros(2 << p.bits)
    free, past = np.concatenate(([1.0], np.zeros(p.grades - 1))), np.full(p.grades, 1e-6)  # first threshold, log gaps
    order = np.random.default_rng(3)
    for _ in range(p.epochs):
        for i in order.permutation(len(sample)):
            (f, x), g = xs[i], int(y[i])
            w = -np.sign(z[f]) * np.maximum(np.abs(z[f]) - p.l1, 0) / ((p.beta + np.sqrt(n[f])) / p.alpha + p.l2)
            ds, dt = slopes(w @ x, np.cumsum(np.concatenate((free[:1], np.exp(free[1:])))), g)
            after = np.cumsum(dt[::-1])[::-1]  # a gap moves every threshold from its own on
            grad = after * np.concatenate(([1.0], np.exp(free[1:])))
            past += grad * grad
            free -= 0.1 * grad / np.sqrt(past)
            gw = ds * x
            sigma = (np.sqrt(n[f] + gw * gw) - np.sqrt(n[f])) / p.alpha
            z[f] += gw - sigma * w
            n[f] += gw * gw
    weights = -np.sign(z) * np.maximum(np.abs(z) - p.l1, 0) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2)
    theta = np.cumsum(np.concatenate((free[:1], np.exp(free[1:]))))
    scores = np.array([x @ weights[f] for f, x in xs])
    return Model(p, known, weights, theta - theta[0] + best_cut(scores, y > 0, share))


def best_cut(scores: np.ndarray, toxic: np.ndarray, share: float) -> float:
    """The score from which calling a text toxic has the best F1 on the sample, its classes weighted to the share of toxic labels."""
    order = np.argsort(-scores, kind="stable")
    own, hit, s = toxic.mean(), toxic[order], scores[order]
    found = np.cumsum(hit) * share / own
    called = found + np.cumsum(~hit) * (1 - share) / (1 - own)
    f1 = 2 * found / (called + share * len(s))
    f1[:-1][s[:-1] == s[1:]] = 0  # equal scores go together
    k = int(f1.argmax())
    return float((s[k] + s[min(k + 1, len(s) - 1)]) / 2)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, severity, grade, p_toxic, toxic) for every row of ``docs``: the expected and the most likely grade, and whether it is over 0 rather than not."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of features
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            tails = np.zeros((len(batch), m.params.grades))
            for k, text in enumerate(batch["text"]):
                f, c, n = text_features(text, m.params)
                if n and np.isfinite(m.theta[0]):
                    at, x = values(f, c, n, m.known)
                    tails[k] = sigmoid(x @ m.weights[at] - m.theta)
            chance = -np.diff(np.hstack((np.ones((len(batch), 1)), tails, np.zeros((len(batch), 1)))), axis=1)
            out = {"severity": tails.sum(axis=1), "grade": chance.argmax(axis=1), "p_toxic": tails[:, 0], "toxic": tails[:, 0] >= 0.5}
            yield pd.DataFrame({"doc_id": batch["doc_id"]} | out)

    return docs.select("doc_id", "text").mapInPandas(score, f"doc_id {id_type}, severity double, grade long, p_toxic double, toxic boolean")


def grade(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """Fit on the labelled part of ``docs`` and predict all of it."""
    return predict(docs, fit(docs, labels, p))
