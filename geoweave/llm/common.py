"""Shared plumbing of the training-data operators: staged tables, text and id columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import new_folder, staged

__all__ = ["ascii_lower", "crc_fold", "documents", "new_folder", "staged"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; null becomes the empty string."""
    return F.translate(F.coalesce(c, F.lit("")), UPPER, LOWER)


def crc_fold(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids get null."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % modulus


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
