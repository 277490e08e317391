"""Sinks: Turtle, geometry side tables, query results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..prefixes import Prefixes


def turtle_lines(triples: DataFrame) -> DataFrame:
    return triples.select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("value"))


def write_turtle(triples: DataFrame, path: str, prefixes: Prefixes | None = None, compression: str = "bzip2") -> int:
    """Write triples as lines into a folder, prefixes (unless None) as a part of their own that sorts first.

    Returns the number of triples written, prefixes not counted.
    """
    spark, seen = triples.sparkSession, Observation()
    turtle_lines(triples).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").text(path, compression=compression)
    if prefixes is not None:
        head = spark.createDataFrame([(line,) for line in prefixes.lines()], "value string")
        head.coalesce(1).write.mode("append").text(path, compression=compression)
    return seen.get["n"]


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o) of what write_turtle has written, a triple a line; prefixes are left out."""
    line = r"(?s)^(\S+) (\S+) (.*) \.$"
    rows = spark.read.text(path).filter(~F.col("value").startswith("@prefix"))
    return rows.select(*[F.regexp_extract("value", line, i + 1).alias(c) for i, c in enumerate("spo")])


def write_aux_geometries(geometries: DataFrame, path: str) -> None:
    """(subject, wkt) as tab-separated text."""
    geometries.write.mode("overwrite").csv(path, sep="\t", quote="", escapeQuotes=False)


def write_result(df: DataFrame, path: str, kind: str = "tsv") -> None:
    """A query result as tab-separated text with a header, or as JSON lines."""
    if kind == "tsv":
        df.write.mode("overwrite").csv(path, sep="\t", header=True)
    elif kind == "json":
        df.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown kind of result: {kind}")


def read_result(spark: SparkSession, path: str, typed: bool = False) -> DataFrame:
    """A result read back; typed: as TSV results of SPARQL, with IRIs and quoted literals turned into plain values,
    and columns whose every value is a number into doubles."""
    out = spark.read.csv(path, sep="\t", header=True, inferSchema=False, quote="")
    if not typed:
        return out
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, r'^<(.*)>$', "$1"), r'(?s)^"(.*)"(?:\^\^\S+|@[\w-]+)?$', "$1")
    out = out.toDF(*[c.lstrip("?") for c in out.columns])
    out = out.select(*[plain(F.col(f"`{c}`")).alias(c) for c in out.columns])
    odd = out.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast("double").isNull()).alias(c) for c in out.columns]).first()
    return out.select(*[F.col(f"`{c}`").cast("double").alias(c) if not odd[c] else F.col(f"`{c}`") for c in out.columns])
