"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over which words and word beginnings a text has, trained in numpy from confirmed
toxic examples and unlabelled text. The risk is corrected by the class prior pi,

    R = pi R+(positives) + max(0, R-(unlabelled) - pi R-(positives)),

and where the second part turns negative the step is taken against it, so it can't be fitted below
zero. Confirmed clean examples are used as unlabelled text; pi is the toxic share of labelled rows
times the unlabelled rows' share of that pool. It is fitted on a bounded sample, hashed by id
(max_positive and max_unlabelled documents); every document is scored over its whole text.

Defined cases: null and empty texts score as the bias says; ids that repeat are scored row by row,
and of repeated labels any toxic one counts, and one of the rows is learnt from; null ids are neither learnt from nor held out; without
positives or without unlabelled text all scores are 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, documents
from .poisson_mix import unit_hash
from .textbytes import words_of

BEGINNINGS = (4, 5, 6)
MEMO = 150_000


def features_of(word: str) -> list[int]:
    """32-bit hashes of a word and its beginnings."""
    parts = [word + "$", *(word[:k] for k in BEGINNINGS if len(word) >= k)]
    return [xxhash.xxh32_intdigest(p) for p in parts]


@dataclass
class Classifier:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float

    def table(self) -> dict[int, float]:
        return dict(zip(self.features.tolist(), self.weights.tolist(), strict=True))


def choose(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, least: int = 4, most: int = 8192) -> np.ndarray:
    """Features that positives have significantly more often than unlabelled texts (z score), and of which
    at least half of the texts that have them are positive by Bayes' rule with the class prior."""
    names, p = np.unique(np.concatenate(positive), return_counts=True)
    names, p = names[p >= least], p[p >= least]
    u = np.zeros(len(names), np.int64)
    for own in unlabelled:
        u[columns(own, names)] += 1
    share_p, share_u = p / len(positive), (u + 0.5) / (len(unlabelled) + 1)
    both = (p + u) / (len(positive) + len(unlabelled))
    z = (share_p - share_u) / np.sqrt(both * (1 - both) * (1 / len(positive) + 1 / len(unlabelled)) + 1e-12)
    good = np.flatnonzero((z > 3.5) & (prior * share_p > 0.5 * share_u))
    return np.sort(names[good[np.argsort(-z[good], kind="stable")[:most]]])


def columns(features: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Where distinct features stand among sorted names, those that do."""
    at = np.searchsorted(names, features)
    at[at == len(names)] = 0
    return at[names[at] == features] if len(names) else at[:0]


def rows_and_columns(docs: list[np.ndarray], names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = [columns(d, names) for d in docs]
    return np.repeat(np.arange(len(docs)), [len(x) for x in found]), np.concatenate(found)


def risk_of(model: Classifier, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> tuple[float, float]:
    """The two parts of the risk, with the logistic loss: pi R+(positives), and R-(unlabelled) - pi R-(positives)."""

    def scores(docs: list[np.ndarray]) -> np.ndarray:
        row, col = rows_and_columns(docs, model.features)
        return np.bincount(row, weights=model.weights[col], minlength=len(docs)) + model.bias

    z_p, z_u = scores(positive), scores(unlabelled)
    return prior * np.logaddexp(0, -z_p).mean(), np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = 400, rate: float = 0.05, decay: float = 1e-4) -> Classifier:
    """Minimise the non-negative PU risk with the logistic loss by full-batch Adam."""
    names = choose(positive, unlabelled, prior)
    if not len(names):
        return Classifier(names, np.zeros(0), float(np.log(prior / (1 - prior))))
    (pr, pc), (ur, uc) = rows_and_columns(positive, names), rows_and_columns(unlabelled, names)
    n_p, n_u, k = len(positive), len(unlabelled), len(names)
    theta = np.zeros(k + 1)
    theta[k] = -2.0
    m, s = np.zeros(k + 1), np.zeros(k + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, epochs + 1):
        z_p = np.bincount(pr, weights=theta[pc], minlength=n_p) + theta[k]
        z_u = np.bincount(ur, weights=theta[uc], minlength=n_u) + theta[k]
        back = lambda g, r, c: np.append(np.bincount(c, weights=g[r], minlength=k), g.sum())
        plus = prior * back(-sigmoid(-z_p) / n_p, pr, pc)
        minus = back(sigmoid(z_u) / n_u, ur, uc) - prior * back(sigmoid(z_p) / n_p, pr, pc)
        risk = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
        g = plus + minus if risk >= 0 else -minus
        g[:k] += decay * theta[:k]
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return Classifier(names, theta[:k], float(theta[k]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_positive: int = 6000, max_unlabelled: int = 13000) -> Classifier | None:
    """Learn from docs and the labels that they have; nothing but text enters the features."""
    truth = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = docs.select(F.col(id_col).alias("doc_id")).filter("doc_id is not null").distinct().join(truth, "doc_id", "left")
    n = ids.agg(F.count_if(F.col("toxic") == 1).alias("p"), F.count_if(F.col("toxic") == 0).alias("c"), F.count_if(F.col("toxic").isNull()).alias("u")).first()
    if not n.p or not n.c + n.u:
        return None
    prior = min(0.5, max(0.005, n.p / (n.p + n.c) * n.u / (n.u + n.c)))
    share = F.when(F.col("toxic") == 1, max_positive / n.p).otherwise(max_unlabelled / (n.c + n.u))
    picked = ids.filter(unit_hash(F.concat(F.lit("toxicity|"), F.col("doc_id").cast("string"))) < share).select("doc_id", (F.coalesce("toxic", F.lit(0)) == 1).alias("p"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            out = [np.unique(np.array([f for w in set(words_of(t or "")) for f in features_of(w)], np.uint32)).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("p"), pa.array(out, pa.binary())], ["doc_id", "p", "f"])

    def learn(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: dict[bool, list[bytes]] = {True: [], False: []}
        for batch in parts:
            for p, f in zip(batch.column("p").to_pylist(), batch.column("f").to_pylist(), strict=True):
                sides[p].append(f)
        if sides[True] and sides[False]:
            own = [[np.frombuffer(f, np.uint32) for f in sorted(sides[k])] for k in (True, False)]
            model = fit(*own, prior)
            yield pa.RecordBatch.from_arrays([pa.array([model.features.astype("<u4").tobytes()], pa.binary()), pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias])], ["f", "w", "bias"])

    sample = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "doc_id")  # about max_positive + max_unlabelled ids
    # of rows that repeat an id one is learnt from, so the ids bound the sample, and it fits a task
    features = sample.select("doc_id", "p", "text").mapInArrow(run, "doc_id long, p boolean, f binary").groupBy("doc_id", "p").agg(F.min("f").alias("f"))
    found = features.select("p", "f").repartition(1).mapInArrow(learn, "f binary, w binary, bias double").first()
    return Classifier(np.frombuffer(found.f, "<u4"), np.frombuffer(found.w, float), found.bias) if found else None


class Scorer:
    def __init__(self, model: Classifier):
        self.table, self.bias, self.memo = model.table(), model.bias, {}

    def known(self, word: str) -> tuple[int, ...] | None:
        """The classifier's features that a word has."""
        return tuple(f for f in features_of(word) if f in self.table) or None

    def score(self, text: str | None) -> float:
        memo, found = self.memo, set()
        if len(memo) > MEMO:
            memo.clear()
        for w in set(words_of(text or "")):
            try:
                has = memo[w]
            except KeyError:
                has = memo[w] = self.known(w)
            if has:
                found.update(has)
        z = self.bias + sum(self.table[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-min(40.0, max(-40.0, z)))))


def scored(docs: DataFrame, model: Classifier | None, id_col: str = "doc_id", text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with a column of scores behind all others."""
    if model is None:
        return docs.withColumn(name, F.lit(0.0))

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Scorer(model)
        for texts in parts:
            yield pd.Series([own.score(t) for t in texts], dtype=float)

    return docs.withColumn(name, score(F.col(text_col)))


def learnable(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.filter(crc_fold(id_col, 5) != 0)


def op1_toxicity_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(learnable(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scored(docs, model)
    return out.select("doc_id", F.coalesce(crc_fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
