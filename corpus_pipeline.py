"""The corpus pipeline: documents are filtered, deduplicated, mixed and packed into sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; its result is
written as Parquet and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweave.llm import exact_dedup, ngram_join, packing, poisson_mix, toxicity
from geoweave.llm.common import new_folder
from geoweave.session import workers_find_package

#: Near duplicates: words of a shingle and least Jaccard similarity in percent (op9 has its own contract, 3 and 90).
NEAR_WIDTH, NEAR_PERCENT = 5, 80


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5 stay; the classifier learns as in op1."""
    workers_find_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(toxicity.learnable(docs), labels)
    name = f"toxicity_{uuid.uuid4().hex}"  # no column of docs
    return toxicity.scored(docs, model, name=name).filter(F.col(name) < 0.5).drop(name)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    index = exact_dedup.new_index(spark, "pipeline_digests")
    out = exact_dedup.deduplicated(docs, index)
    index.drop()  # what out needs of it is stored
    return out


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one with the smallest id stays; rows without an id stay."""
    workers_find_package(spark)
    gone = ngram_join.near_components(docs, width=NEAR_WIDTH, percent=NEAR_PERCENT).filter("doc_id <> component_id").select("doc_id")
    return docs.alias("d").join(gone.alias("gone"), F.col("d.doc_id") == F.col("gone.doc_id"), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replicas of documents, shares of sources as the root of their size, shuffled globally."""
    return poisson_mix.poisson_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all replicas with their places in sequences."""
    workers_find_package(spark)
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_filter),
    ("exact_dedup", exact),
    ("near_duplicates", near),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL can express neither the classifier nor the packing; tests compare the stages with brute force, all but the classifier's scores.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.schema(docs.schema).parquet(f"{folder}/{k}-{name}")
    return docs
