"""Best-fit packing of tokenised documents by the sum-of-squares rule.

A document is its token ids and an end id, cut into pieces only where it is longer than a sequence
(the first piece takes the remainder). A piece goes where the sum over gaps of (open bins with that
gap)^2 becomes smallest; bins without a gap are closed and don't count.

Pieces of one length are interchangeable, so the rule runs on the table of counts by length (at
most 2048 rows, in one short task). It places as many pieces of a length at once as would go to one
gap in turn, and never less than a 256th of that length's pieces, so the number of steps has a bound
that does not grow with the corpus; lengths of up to 256 pieces are placed just as one by one. Bins
with the same gap are kept as ranges of sequence numbers. Every piece then finds its place by its
rank within its length. Ranks are taken in buckets of a length whose number grows with its pieces.

Token ids are those of the library's byte_bpe_50k.json; the encoder is a faster one for the same
vocabulary (byte_bpe_50k.tiktoken), and special strings inside texts become their id, as there. A
text that the faster one rejects (its pattern engine has a bounded stack, which a million blanks in
a row exceed) is encoded by the library itself.

Defined cases: null and empty texts are the end id alone; repeated ids and rows are pieces of
their own, told apart by the column row; null ids are kept; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bytebpe import DEFAULT, tokenizer_path
from .common import documents, staged

CAPACITY, END_ID = 2048, 0
#: Steps that a length's pieces take at least, where it has as many; least buckets of a length, pieces of a bucket.
STEPS, BUCKETS, BUCKET_ROWS = 256, 256, 20_000
#: Blocks of a length's ranks, by which pieces meet their ranges.
RANK_BLOCKS = 4096
PLAN = "length long, first long, n long, sequence_id long, offset long"

_encoders: dict[tuple[str, ...], object] = {}


def encoder(ranks_path: str, json_path: str):
    """An encoder over the ranks file whose special strings are those of the .json file."""
    key = ranks_path, json_path
    if key not in _encoders:
        import json

        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(json_path, encoding="utf-8") as f:
            special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        _encoders[key] = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _encoders[key]


def library(json_path: str):
    if (json_path,) not in _encoders:
        from tokenizers import Tokenizer

        _encoders[json_path,] = Tokenizer.from_file(json_path)
    return _encoders[json_path,]


def token_ids(text: str, ranks_path: str, json_path: str) -> list[int]:
    """The library's ids of a text, without added special tokens."""
    try:
        return encoder(ranks_path, json_path).encode(text, allowed_special="all")
    except ValueError:
        return library(json_path).encode(text, add_special_tokens=False).ids


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, name: str = DEFAULT) -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32); row numbers the rows of docs, so repeated ids stay apart. To be stored before use."""
    ranks, spec = tokenizer_path(f"{name}.tiktoken"), tokenizer_path(f"{name}.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, row, text in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), batch.column("text"), strict=True):
                ids = np.array([*token_ids(text.as_py() or "", ranks, spec), end_id], "<u4")
                at, cut = 0, len(ids) % capacity or capacity
                for k in range(-(-len(ids) // capacity)):
                    rows.append((doc, row, k, at, cut - at, zlib.crc32(ids[at:cut].tobytes())))
                    at, cut = cut, cut + capacity
            names = ["doc_id", "row", "piece", "start", "length", "ids_crc32"]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            cols = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names)

    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", "monotonically_increasing_id() row", f"`{text_col}` text")
    return rows.mapInArrow(run, "doc_id long, row long, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Open bins by gap, as ranges of sequence numbers, and the sum-of-squares rule over them."""

    def __init__(self, capacity: int):
        self.capacity, self.made = capacity, 0
        self.count = np.zeros(capacity + 1, np.int64)  # open bins by gap
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # (first sequence, bins)

    def best(self, s: int) -> tuple[int, int]:
        """The gap (capacity: a fresh bin) for a piece of size s, and how many such pieces in a row would take it.

        Leaving gap g changes the sum by 1 - 2 N(g), entering h = g - s by 1 + 2 N(h), nothing for h = 0. Each
        piece adds 4 to its gap's change (2 to a fresh bin's) and takes at most 2 from that of any other.
        """
        n, c = self.count, self.capacity
        change = 2 - 2 * n[s:] + 2 * n[: c + 1 - s]  # by gap from s on; the last is that of a fresh bin
        change[0] = 1 - 2 * n[s]
        after = change.copy()  # as if no gap were empty: one that fills up now may be next
        change[n[s:] == 0] = np.iinfo(np.int64).max // 2
        change[c - s] = 1 + 2 * n[c - s] if s < c else 0
        k = int(np.argmin(change))
        own, change[k] = int(change[k]), np.iinfo(np.int64).max // 2
        second = int(change.min())
        if k >= s and k - s < len(after):
            second = min(second, int(after[k - s]))  # the gap that the piece leaves behind
        return k + s, max(1, (second - own + 5) // 6)

    def take(self, gap: int, n: int) -> list[tuple[int, int]]:
        """Ranges of n bins with that gap, which are no longer open."""
        if gap == self.capacity:
            self.made += n
            return [(self.made - n, n)]
        out, self.count[gap] = [], self.count[gap] - n
        while n:
            first, m = self.ranges[gap].pop()
            if m > n:
                self.ranges[gap].append((first + n, m - n))
                m = n
            out.append((first, m))
            n -= m
        return out

    def put(self, gap: int, ranges: list[tuple[int, int]]) -> None:
        if gap:
            self.ranges[gap] += ranges
            self.count[gap] += sum(n for _, n in ranges)


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> pd.DataFrame:
    """Places for the pieces of each length, longest first. A row: its pieces with ranks from first on, n of
    them, lie at offset in the sequences from sequence_id on, one each."""
    bins, rows = Bins(capacity), []
    for s, n in sorted(counts.items(), reverse=True):
        first, least = 0, -(-n // steps)
        while first < n:
            gap, m = bins.best(s)
            m = min(n - first, max(m, least), n if gap == capacity else int(bins.count[gap]))
            ranges = bins.take(gap, m)
            for sequence, k in ranges:
                rows.append((s, first, k, sequence, capacity - gap))
                first += k
            bins.put(gap - s, ranges)
    names = [x.split()[0] for x in PLAN.split(", ")]
    return pd.DataFrame(rows, columns=names).astype("int64")


def packed(parts: DataFrame, capacity: int = CAPACITY, steps: int = STEPS) -> DataFrame:
    """Add sequence_id and offset to pieces; parts is read more than once and should be a stored table."""

    def plan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [x for x in frames if len(x)]
        if found:
            table = pd.concat(found)
            yield packing_plan(dict(zip(table["length"].tolist(), table["n"].tolist(), strict=True)), capacity, steps)

    lengths = staged(parts.groupBy("length").agg(F.count("*").alias("n")), "packing-lengths")  # at most 2048 rows
    places = staged(lengths.coalesce(1).mapInPandas(plan, PLAN), "packing-plan")
    shares = lengths.select("length", F.greatest(F.lit(BUCKETS), F.ceil(F.col("n") / BUCKET_ROWS)).alias("buckets"), F.ceil(F.col("n") / RANK_BLOCKS).alias("block"))
    bucket = F.pmod(F.xxhash64("doc_id", "row", "piece"), F.col("buckets"))
    parts_ = parts.join(F.broadcast(shares), "length").withColumn("bucket", bucket).drop("buckets")  # a row per length
    by_bucket = parts_.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = by_bucket.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    local = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "row", "piece")) - 1
    ranked = parts_.withColumn("local", local).join(before, ["length", "bucket"]).withColumn("rank", F.col("local") + F.col("before"))
    ranked = ranked.withColumn("nth", F.floor(F.col("rank") / F.col("block")))
    blocks = F.sequence(F.floor(F.col("first") / F.col("block")), F.floor((F.col("first") + F.col("n") - 1) / F.col("block")))
    ranges = places.join(F.broadcast(shares.drop("buckets")), "length").select("length", "first", F.col("n").alias("many"), "sequence_id", "offset", F.explode(blocks).alias("nth"))
    found = ranked.join(ranges, ["length", "nth"]).filter("rank >= first and rank < first + many")
    return found.select(*parts.columns, (F.col("sequence_id") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, name: str = DEFAULT) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset, row) of every piece of every document."""
    out = packed(staged(pieces(docs, id_col, text_col, capacity, end_id, name), "pieces"), capacity)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "row")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
