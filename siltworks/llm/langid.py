"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Training is follow-the-regularised-leader (FTRL-proximal) with elastic-net penalties, then one temperature
is fitted on training documents that the weights have not seen.

* N-gram document frequencies are counted over every training document of the table.
* The weights are fitted on a bounded sample: ``Params.per_label`` documents of each label at most, those with
  the smallest hashes of id and text. Their n-gram counts, not their texts, come to the driver.
* Every whole text is scored where it lies; nothing is shuffled for it.

Results in odd cases: a text that is null or holds no letter gets ``und`` with score 0. Rows with a null id are
scored like others. A table with no labelled training document gives ``und`` and score 0 throughout. Repeated
rows get equal results, once each. Columns besides the id, the text and (for training) the label are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import crc_mod5, hash_sample

UND = "und"


@dataclass(frozen=True)
class Params:
    bits: int = 15  # n-grams are hashed to 2**bits features
    longest: int = 3  # n-grams of 1 to so many characters
    per_label: int = 400  # bound of the training sample, for each label
    epochs: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.3
    l2: float = 1e-4
    reject_below: float = 0.4  # a filter rejects documents that score less


@dataclass
class Model:
    params: Params
    labels: list[str]
    idf: np.ndarray  # by feature
    weights: np.ndarray  # feature x label
    bias: np.ndarray
    temperature: float


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngram_counts(text: str | None, p: Params) -> np.ndarray | None:
    """Counts of the hashed n-grams of the lower-cased text, letters only (a run of anything else is one gap); None without letters."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, 0)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = np.concatenate(([0], codes[keep], [0])).astype(np.uint32)
    shift, h, grams = np.uint32(32 - p.bits), np.zeros(len(codes), np.uint32), []
    with np.errstate(over="ignore"):
        for n in range(1, min(p.longest, len(codes)) + 1):
            h = (h[: len(codes) - n + 1] ^ codes[n - 1 :]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            grams.append((h * np.uint32(0x85EBCA6B)) >> shift)
    return np.bincount(np.concatenate(grams).astype(np.int64), minlength=1 << p.bits)


def _tfidf(counts: np.ndarray, at: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf[at]
    return x / max(np.sqrt((x * x).sum()), 1e-12)


def document_frequencies(train: DataFrame, p: Params) -> tuple[int, np.ndarray]:
    """Training documents with letters, and in how many of them each feature occurs. Each task sends one count a feature."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, df = 0, np.zeros(1 << p.bits, np.int64)
        for batch in batches:
            for text in batch["text"]:
                if (c := ngram_counts(text, p)) is not None:
                    n, df = n + 1, df + (c > 0)
        if n:
            at = np.flatnonzero(df)
            yield pd.DataFrame({"feature": np.append(at, -1), "n": np.append(df[at], n)})

    rows = train.select("text").mapInPandas(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    got = dict(map(tuple, rows.collect()))  # at most 2**bits + 1 rows
    n = got.pop(-1, 0)
    df = np.zeros(1 << p.bits)
    df[list(got.keys())] = list(got.values())
    return n, df


def training_sample(train: DataFrame, p: Params) -> DataFrame:
    """``per_label`` documents of each label at most, those of the smallest hashes of id and text, as sparse counts; repeated rows are one."""
    chosen = hash_sample(train.withColumn("part", crc_mod5()), "label", ["doc_id", "text"], p.per_label)

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for label, part, text in zip(batch["label"], batch["part"], batch["text"], strict=True):
                if (c := ngram_counts(text, p)) is not None:
                    at = np.flatnonzero(c)
                    rows.append((label, part, at.astype(np.int32).tobytes(), np.minimum(c[at], 2**31 - 1).astype(np.int32).tobytes()))
            yield pd.DataFrame(rows, columns=["label", "part", "feature", "n"])

    return chosen.select("label", "part", "text").mapInPandas(counts, "label string, part long, feature binary, n binary")


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(xs: list[tuple[np.ndarray, np.ndarray]], ys: list[int], labels: int, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases after ``epochs`` passes. The last feature of the state is the bias, without penalties."""
    d = 1 << p.bits
    z, n = np.zeros((d + 1, labels)), np.zeros((d + 1, labels))
    l1, l2 = np.full((d + 1, 1), p.l1), np.full((d + 1, 1), p.l2)
    l1[d] = l2[d] = 0

    def solve(at: np.ndarray | slice) -> np.ndarray:
        zz = z[at]
        shrunk = np.sign(zz) * np.maximum(np.abs(zz) - l1[at], 0)
        return -shrunk / ((p.beta + np.sqrt(n[at])) / p.alpha + l2[at])

    order = np.random.default_rng(7)
    for _ in range(p.epochs):
        for i in order.permutation(len(xs)):
            at, x = np.append(xs[i][0], d), np.append(xs[i][1], 1.0)
            w = solve(at)
            g = softmax(x @ w)
            g[ys[i]] -= 1
            g = x[:, None] * g
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / p.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = solve(slice(None))
    return w[:d], w[d]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the least log loss, by golden-section search over its logarithm.

    Targets are smoothed by 1 / (n + 2), so that a set without a mistake doesn't ask for a temperature of zero.
    """
    if not len(y):
        return 1.0
    off = 1 / (len(y) + 2)
    target = np.full(logits.shape, off / max(1, logits.shape[1] - 1))
    target[np.arange(len(y)), y] = 1 - off
    loss = lambda t: -(target * np.log(softmax(logits / np.exp(t)) + 1e-12)).sum(axis=1).mean()
    lo, hi, r = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(docs: DataFrame, p: Params = Params()) -> Model:
    """Learn from the text and the label (``lang``) of documents whose crc32 of the id is not 0 modulo 5."""
    train = docs.where("lang is not null").where(crc_mod5() != 0).select("doc_id", "text", F.col("lang").alias("label"))
    n, df = document_frequencies(train, p)
    idf = np.log((1 + n) / (1 + df)) + 1
    # rows come in any order from the tasks: order them by content, so that reruns agree
    got = sorted(tuple(r) for r in training_sample(train, p).collect())
    labels = sorted({label for label, *_ in got})
    xs = [(f, _tfidf(c, f, idf)) for f, c in ((np.frombuffer(f, np.int32), np.frombuffer(c, np.int32)) for *_, f, c in got)]
    ys, part = np.array([labels.index(r[0]) for r in got], int), np.array([r[1] for r in got], int)
    fitted = [i for i in range(len(ys)) if part[i] != 4] if len(set(ys[part != 4])) == len(labels) else list(range(len(ys)))
    rest = [i for i in range(len(ys)) if part[i] == 4]
    w, bias = ftrl([xs[i] for i in fitted], [int(ys[i]) for i in fitted], len(labels), p)
    logits = np.array([x @ w[f] + bias for f, x in (xs[i] for i in rest)]).reshape(len(rest), len(labels))
    return Model(p, labels, idf, w, bias, fit_temperature(logits, ys[rest]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, lang_pred, score) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of features and one column a label
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            names, scores = [], []
            for text in batch["text"]:
                c = ngram_counts(text, m.params) if m.labels else None
                if c is None:
                    names.append(UND), scores.append(0.0)
                    continue
                at = np.flatnonzero(c)
                q = softmax((_tfidf(c[at], at, m.idf) @ m.weights[at] + m.bias) / m.temperature)
                names.append(m.labels[k := int(q.argmax())]), scores.append(float(q[k]))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": names, "score": scores})

    return docs.select("doc_id", "text").mapInPandas(score, f"doc_id {id_type}, lang_pred string, score double")


def identify(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Fit on ``docs`` and predict all of it: (doc_id, held_out, lang_pred, score)."""
    return predict(docs, fit(docs, p)).select("doc_id", (crc_mod5() == 0).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of ``docs``, all columns, but those without letters (or text) and those that score below ``reject_below``."""
    m = fit(docs, p)
    shared = docs.sparkSession.sparkContext.broadcast(m)

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        m, out = shared.value, []
        for text in texts:
            c = ngram_counts(text, m.params) if m.labels else None
            if c is None:
                out.append(False)
                continue
            at = np.flatnonzero(c)
            q = softmax((_tfidf(c[at], at, m.idf) @ m.weights[at] + m.bias) / m.temperature)
            out.append(bool(q.max() >= m.params.reject_below))
        return pd.Series(out, dtype=bool)

    return docs.where(known("text"))
