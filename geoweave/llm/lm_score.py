"""Language-model scores from a subword lattice.

A word is spelled by the pieces of an existing unigram vocabulary: S(w) is the sum over all its
segmentations of the product of the pieces' weights, by a forward recursion in log space. The
weights start from the vocabulary's own scores, which for the public vocabulary at hand are ranks and
no log probabilities, and are re-estimated on all distinct training words by expectation-maximisation.
lattice_score is the marginal probability of a document under the pieces alone,

    P(end) * prod over its words of (1 - P(end)) S(w).

score is that of the whole model, which also has an arc over each whole word that the corpus has,

    P(w) = max(c(w) - D, 0) / N + D V / N * S(w),

with c, N, V the counts over training words and D the absolute discount n1 / (n1 + 2 n2), and in which
a document's words are scored with a document-specific mix whose weights are integrated out (a
Dirichlet with mean P and strength mu), so a word that the document has used already is likelier:

    P(doc) = P(end) (1 - P(end))^n * Gamma(mu) / Gamma(mu + n) * prod over w of Gamma(mu P(w) + tf) / Gamma(mu P(w)).

P and S are distributions over all words, so both scores are of proper distributions over texts.

What is gathered grows with the corpus: counts of all distinct words, in a table that texts are
joined to. The words with c >= N / HOT, so at most HOT whatever the corpus, are broadcast, and no
frequent word is a join key; the rest meet their counts in a shuffle of one row per word and task.

Defined cases: null and empty texts are the end token alone; null ids are not held out and train;
repeated ids and rows are scored (and train) row by row; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, documents, staged
from .lattice import Arcs, batches, load_pieces, normalised, scores_as_weights

#: The end token in the table of words; no word is empty.
END = b""
HOT, STRENGTH, ROUNDS, FLUSH = 300_000, 1000.0, 2, 200_000
LN10 = float(np.log(10.0))


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased (bytes.lower and bytes.split do just that)."""
    return (text or "").encode().lower().split()


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x > 0: eight steps of the recurrence, then Stirling's series."""
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8.0
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def word_counts(docs: DataFrame, text_col: str = "text", train_col: str = "train") -> DataFrame:
    """(word, c): every distinct word of all texts with its count in training texts; the end token under the empty word."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])

        for batch in parts:
            for text, train in zip(batch.column("text"), batch.column("train").to_pylist(), strict=True):
                ws = tokens(text.as_py())
                if train:
                    seen.update(ws)
                    seen[END] += 1
                else:
                    for w in set(ws):
                        seen.setdefault(w, 0)
                    seen.setdefault(END, 0)
                if len(seen) > FLUSH:
                    yield out()
                    seen.clear()
        yield out()

    rows = docs.select(F.col(text_col).alias("text"), F.col(train_col).alias("train"))
    return rows.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def expected_pieces(words: DataFrame, logp: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over the distinct words, each once."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load_pieces()
        total = np.zeros(len(pieces.names))
        for batch in parts:
            own = batch.column("word").to_pylist()
            for a, b in batches(own):
                total += Arcs(pieces, own[a:b]).expected(logp, np.ones(b - a))[0]
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["piece", "n"])

    rows = words.select("word").mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()  # a row per piece of the vocabulary
    out = np.zeros(len(logp))
    for r in rows:
        out[r.piece] = r.n
    return out


def lattice_scores(words: DataFrame, logp: np.ndarray, end: float, n: int, v: int, discount: float) -> DataFrame:
    """(word, c, lp, ls): the logarithms of P and S of each word, from n training words of v kinds; the end token has neither."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load_pieces()
        for batch in parts:
            own, c = batch.column("word").to_pylist(), batch.column("c").to_numpy().astype(float)
            log = np.zeros(len(own))
            for a, b in batches(own):
                arcs = Arcs(pieces, own[a:b])
                log[a:b] = arcs.forward(logp)[arcs.goal] + end
            with np.errstate(divide="ignore"):
                whole = np.log(np.maximum(c - discount, 0) / n) if n else np.full(len(own), -np.inf)
            spelled = log + (np.log(discount * v / n) if n else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(np.logaddexp(whole, spelled)), pa.array(log)], ["word", "c", "lp", "ls"])

    return words.select("word", "c").mapInArrow(run, "word binary, c long, lp double, ls double")


def postings(docs: DataFrame, hot: dict[bytes, tuple[int, float, float]], n: int, v: int, strength: float, held_col: str = "held_out") -> DataFrame:
    """A row per text with the sums over its frequent words, and a row per other word and task with the texts that have it."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    schema = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, lattice double, word binary, uids array<long>, tfs array<int>"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        index = {w: i for i, w in enumerate(own)}
        c, lp, ls = (np.array([x[k] for x in own.values()], float) for k in (0, 1, 2))
        base, prior, known = np.log10((c + 1) / (n + v + 1)), strength * np.exp(lp), c > 0
        rest: dict[bytes, tuple[list[int], list[int]]] = {}

        def others() -> pa.RecordBatch:
            k = len(rest)
            none = [pa.nulls(k, t) for t in (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())]
            return pa.RecordBatch.from_arrays([*none, pa.array(list(rest), pa.binary()), pa.array([x[0] for x in rest.values()], pa.list_(pa.int64())), pa.array([x[1] for x in rest.values()], pa.list_(pa.int32()))], names)

        names = [x.split()[0] for x in schema.split(", ")]
        for batch in parts:
            ids, sizes, tf, which, row = batch.column("uid").to_pylist(), [], [], [], []
            for k, text in enumerate(batch.column("text")):
                ws = tokens(text.as_py())
                sizes.append(len(ws))
                for w, m in Counter(ws).items():
                    i = index.get(w)
                    if i is None:
                        at = rest.setdefault(w, ([], []))
                        at[0].append(ids[k])
                        at[1].append(m)
                    else:
                        tf.append(m)
                        which.append(i)
                        row.append(k)
                if len(rest) > FLUSH:
                    yield others()
                    rest.clear()
            m, i, r, size = np.array(tf, float), np.array(which, int), np.array(row, int), np.array(sizes, float)
            add = lambda x: np.bincount(r, weights=x, minlength=batch.num_rows).astype(float)  # of no words it would be int  # noqa: E731, B023
            score = add(np.where(m == 1, np.log(prior[i]), log_gamma(prior[i] + m) - log_gamma(prior[i]))) if len(m) else np.zeros(len(size))
            score += log_gamma(np.full(len(size), strength)) - log_gamma(size + strength)
            nulls = [pa.nulls(batch.num_rows, t) for t in (pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))]
            values = [pa.array((size + 1).astype(np.int64)), pa.array(add(m * known[i]).astype(np.int64)), pa.array(add(m * base[i])), pa.array(score), pa.array(add(m * ls[i]))]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("doc_id"), batch.column("held"), *values, *nulls], names)
        yield others()

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col(held_col).alias("held"), "text")
    return rows.mapInArrow(run, schema)


def rising(a: Column, m: Column) -> Column:
    """ln(a (a + 1) ... (a + m - 1))."""
    return F.when(m == 1, F.log(a)).otherwise(F.aggregate(F.sequence(F.lit(0), m - 1), F.lit(0.0), lambda s, i: s + F.log(a + i)))


def lm_scores(docs: DataFrame, held_col: str = "held_out", strength: float = STRENGTH, rounds: int = ROUNDS) -> DataFrame:
    """Scores of all rows of docs (doc_id, text, held_col); rows that are not held out are learnt from."""
    words = staged(word_counts(docs.withColumn("train", ~F.col(held_col))), "lm-words")
    is_word = F.col("word") != F.lit(bytearray(END))
    s = words.agg(*[F.coalesce(x, F.lit(0)).alias(k) for k, x in {"n": F.sum("c"), "v": F.count_if(F.col("c") > 0), "n1": F.count_if(F.col("c") == 1), "n2": F.count_if(F.col("c") == 2), "end": F.max(F.when(~is_word, F.col("c")))}.items()]).first()
    n, v = int(s["n"]), int(s["v"])
    discount = min(0.95, max(0.1, s["n1"] / (s["n1"] + 2 * s["n2"]) if s["n1"] else 0.5))
    pieces = load_pieces()
    c_end = int(s["end"])
    kinds = v - int(c_end > 0)  # distinct training words, n - c_end of them in all
    learnt, types = words.filter(is_word & (F.col("c") > 0)), float(max(1, kinds))
    logp, end = normalised(pieces, scores_as_weights(pieces) * types, types)
    for _ in range(rounds):
        logp, end = normalised(pieces, expected_pieces(learnt, logp), types)
    scored = staged(lattice_scores(words.filter(is_word), logp, end, n - c_end, kinds, discount), "lm-scores")
    hot = {bytes(r.word): (r.c, r.lp, r.ls) for r in scored.filter((F.col("c") >= F.lit(n / HOT)) & (F.col("c") > 0)).collect()}  # counts sum to n: at most HOT rows
    both = staged(postings(docs, hot, n, v, strength, held_col), "lm-postings")
    cold = both.filter("word is not null").select("word", "uids", "tfs").join(scored.filter((F.col("c") < F.lit(n / HOT)) | (F.col("c") == 0)), "word")
    cold = cold.select("c", "lp", "ls", F.explode(F.arrays_zip("uids", "tfs")).alias("x")).select("c", "lp", "ls", F.col("x.uids").alias("uid"), F.col("x.tfs").alias("m"))
    cold = cold.groupBy("uid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("k"), F.sum(F.col("m") * F.log10((F.col("c") + 1) / F.lit(float(n + v + 1)))).alias("b"), F.sum(rising(F.exp("lp") * strength, F.col("m"))).alias("s"), F.sum(F.col("m") * F.col("ls")).alias("l")
    )
    p_end = (c_end + 1) / (n + 2)
    ends = (F.col("n_tokens") - 1) * float(np.log1p(-p_end)) + float(np.log(p_end))
    out = both.filter("word is null").join(cold, "uid", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + zero("k") + int(c_end > 0)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("b") + float(np.log10((c_end + 1) / (n + v + 1)))).alias("base_score"),
        ((F.col("score") + zero("s") + ends) / LN10).alias("score"),
        ((F.col("lattice") + zero("l") + ends) / LN10).alias("lattice_score"),
    )


def op3_lm_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("held_out", F.coalesce(crc_fold("doc_id", 7) == 2, F.lit(False)))
    return lm_scores(docs)
