"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest. A batch is reduced to one row per digest
(map-side first, so a group of copies never meets in one task), joined to the index with an
anti-join that does not shuffle the index, and the digests that are new are appended under the
batch's name. Only DataFrame and SQL functions are used. One writer at a time.

Defined cases: null text counts as empty; null ids rank below all others; rows that repeat an id
and a text are one group, of which exactly one row is kept; an empty batch changes nothing; a batch
that is delivered again is known to the index, so none of its rows stay.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import ascii_lower, documents, staged

SCHEMA = T.StructType([T.StructField("digest", T.StringType()), T.StructField("keep_id", T.LongType()), T.StructField("batch", T.StringType())])


#: Batches that op4 delivers the table in.
BATCHES = 2


def digest(text: str) -> F.Column:
    return F.sha2(ascii_lower(F.col(text)).cast("binary"), 256)


class DigestIndex:
    """A table of the digests seen so far, one row each with the id that stays for it."""

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None):
        self.spark, self.table = spark, table
        if spark.catalog.tableExists(table):
            spec = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}
            self.buckets = int(spec["Num Buckets"])
        else:
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            self._append(spark.createDataFrame([], SCHEMA))

    def _append(self, rows: DataFrame) -> None:
        # dealt by the bucket key, so that each task writes one file of one bucket
        out = rows.repartition(self.buckets, "digest")
        out.write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Add a batch; return a row (digest, id, n) for each text and id of it, n being how often it occurs."""
        ids = docs.select(F.col(id_col).cast("long").alias("id"), digest(text_col).alias("digest"))
        ids = staged(ids.groupBy("digest", "id").agg(F.count("*").alias("n")), "dedup-ids")
        # a table of its own: else the anti-join moves below the aggregate, and a hot digest's rows meet in one task
        best = staged(ids.groupBy("digest").agg(F.max("id").alias("keep_id")), "dedup-best")
        new = best.join(self.read().hint("merge").select("digest"), "digest", "left_anti")
        self._append(new.withColumn("batch", F.lit(batch or uuid.uuid4().hex)))
        return ids

    def decide(self, ids: DataFrame) -> DataFrame:
        """A row per row of ids, of one batch or the union of several: id, keep_id, group_size (among them), kept, digest."""
        # the digests with what the index has of them, stored without buckets: joined to it by
        # plain exchanges, the partition of a hot digest can be split
        known = staged(ids.groupBy("digest").agg(F.sum("n").alias("group_size")).join(self.read().hint("merge").select("digest", "keep_id"), "digest"), "dedup-known")
        found = ids.join(known, "digest").withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("n"))))
        return found.select(F.col("id"), "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), "digest")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def new_index(spark: SparkSession, name: str = "digest_index") -> DigestIndex:
    return DigestIndex(spark, f"{name}_{uuid.uuid4().hex}")


def deduplicated(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, all columns: of equal texts the row with the largest id, if the index did not know the text."""
    batch = uuid.uuid4().hex
    index.ingest(docs, id_col, text_col, batch)
    key = lambda d, i: F.concat_ws("|", d, F.coalesce(i.cast("string"), F.lit("null"))).alias("__key")
    won = staged(index.read().filter(F.col("batch") == batch).select(key(F.col("digest"), F.col("keep_id"))), "dedup-won")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), key(digest(text_col), F.col(id_col).cast("long")))
    # one row of an id and text; combined in the map tasks first, so that rows without ids don't meet
    kept = rows.groupBy("__key").agg(F.any_value("__row").alias("__row")).join(won.hint("merge"), "__key", "left_semi")
    return kept.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its decision. The table comes in BATCHES batches, those with the largest ids first,
    each deduplicated against the index that the ones before have left; the index lies in the warehouse and goes at the end."""
    docs, index, batches = documents(spark, sf_dir).select("doc_id", "text"), new_index(spark), []
    cuts = docs.agg(F.percentile_approx("doc_id", [k / BATCHES for k in range(BATCHES - 1, 0, -1)])).first()[0] or []
    above = None
    for low in [*dict.fromkeys(cuts), None]:
        part = docs if low is None else docs.filter(F.col("doc_id") > low)
        if above is not None:
            part = part.filter((F.col("doc_id") <= above) | F.col("doc_id").isNull())
        batches.append(index.ingest(part))
        above = low
    out = index.decide(functools.reduce(DataFrame.union, batches))
    index.drop()  # decide has stored what it took from it
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
