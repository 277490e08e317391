"""Language identification by segmentation-marginalised unigrams.

Each language has its own probabilities over the pieces of a fixed public vocabulary; a text's
likelihood under a language is the sum over all segmentations of its words (forward algorithm). The
probabilities are fitted by expectation-maximisation on a bounded sample of labelled documents,
hashed by id (sample_docs per language, a parameter); every text is scored whole. A worker keeps
the scores of words that it has met, up to MEMO of them.

Defined cases: null texts and texts without a letter are `und` with score 0; rows without a
language or id don't train; without any training row all are `und`; null ids are not held out.
"""

from __future__ import annotations

import functools
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, documents
from .lattice import Arcs, batches, load_pieces, normalised, scores_as_weights
from .poisson_mix import unit_hash
from .textbytes import words_of

MEMO = 250_000


def letters_in(text: str | None) -> bool:
    return bool(text) and (text.isalpha() or any(map(str.isalpha, text)))


def piece_model(counts: pd.DataFrame, rounds: int = 3) -> tuple[np.ndarray, float]:
    """Fit piece probabilities to words with counts."""
    pieces = load_pieces()
    words, weight = [w.encode() for w in counts["word"]], counts["n"].to_numpy(float)
    total = max(1.0, weight.sum())
    logp, end = normalised(pieces, scores_as_weights(pieces) * total, total)
    for _ in range(rounds):
        expected = sum((Arcs(pieces, words[a:b]).expected(logp, weight[a:b])[0] for a, b in batches(words)), np.zeros(len(pieces.names)))
        logp, end = normalised(pieces, expected, total)
    return logp, end


def train(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 1500) -> list[tuple[str, float, np.ndarray, float]]:
    """(language, share, piece log probabilities, end log probability) of each language."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("i is not null and lang is not null")
    n = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    if not n:
        return []
    share = F.create_map(*[F.lit(x) for k, v in n.items() for x in (k, sample_docs / v)])
    picked = rows.filter(unit_hash(F.concat(F.lit("language-id|"), F.col("i").cast("string"))) < share[F.col("lang")])

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            seen: Counter[tuple[str, str]] = Counter()
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                seen.update((lang, w) for w in words_of(text or ""))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"])

    def fit(key: tuple[str], table: pd.DataFrame) -> pd.DataFrame:
        logp, end = piece_model(table.sort_values("word"))
        return pd.DataFrame({"lang": [key[0]], "logp": [logp.tobytes()], "end": [end]})

    words = picked.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    found = words.groupBy("lang").applyInPandas(fit, "lang string, logp binary, end double").collect()  # a row per language
    total = sum(n.values())
    return sorted((r.lang, n[r.lang] / total, np.frombuffer(r.logp, float), r.end) for r in found)


class Scorer:
    """Posterior of languages for texts; remembers word scores."""

    def __init__(self, models: list[tuple[str, float, np.ndarray, float]]):
        self.langs = [m[0] for m in models]
        self.prior = np.log([m[1] for m in models])
        self.logp, self.end = np.stack([m[2] for m in models], axis=1), np.array([m[3] for m in models])
        self.memo: dict[str, int] = {}
        self.vectors = np.zeros((1024, len(models)))

    def learn(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        need = len(self.memo) + len(words)
        if need > len(self.vectors):
            self.vectors = np.concatenate((self.vectors, np.zeros((max(need, 2 * len(self.vectors)) - len(self.vectors), len(self.langs)))))
        for a, b in batches(raw):
            arcs = Arcs(load_pieces(), raw[a:b])
            at = len(self.memo)
            self.vectors[at : at + b - a] = arcs.forward(self.logp)[arcs.goal] + self.end
            self.memo.update(zip(words[a:b], range(at, at + b - a), strict=True))

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if len(self.memo) > MEMO:
            self.memo.clear()
        split = [words_of(t) if letters_in(t) else [] for t in texts]
        new = sorted({w for ws in split for w in ws if w not in self.memo})
        if new:
            self.learn(new)
        langs, scores = [], []
        for ws in split:
            if not ws:
                langs.append("und")
                scores.append(0.0)
                continue
            log = self.vectors[[self.memo[w] for w in ws]].sum(axis=0) + self.prior
            # words are not independent: the posterior of a long text is tempered by the root of its length
            z = (log - log.max()) / len(ws) ** 0.5
            p = np.exp(z)
            best = int(np.argmax(log))
            langs.append(self.langs[best])
            scores.append(float(p[best] / p.sum()))
        return langs, scores


@functools.lru_cache(2)
def scorer(key: str, load) -> Scorer:
    return Scorer(load())


class _Loader:
    """Hashes alike, so that a worker builds a model's scorer once."""

    def __init__(self, shared):
        self.shared = shared

    def __call__(self):
        return self.shared.value

    def __hash__(self) -> int:
        return 0

    def __eq__(self, other) -> bool:
        return isinstance(other, _Loader)


def predict(docs: DataFrame, models: list[tuple[str, float, np.ndarray, float]], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score) and the columns in keep for each row; models grow with languages only."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(models)
    key = uuid.uuid4().hex  # of this call's models, in whichever worker

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer(key, _Loader(shared)) if models else None
        for batch in parts:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                langs, scores = own.score(b.column("text").to_pylist()) if own else (["und"] * b.num_rows, [0.0] * b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(b.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", *keep, "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *keep)
    kept = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in keep)
    return rows.mapInArrow(run, f"doc_id long, {kept}lang_pred string, score double")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", F.coalesce(crc_fold("doc_id", 4) == 2, F.lit(False)))
    models = train(docs.filter("not held_out"))
    return predict(docs, models, keep=("held_out",)).select("doc_id", "held_out", "lang_pred", "score")
