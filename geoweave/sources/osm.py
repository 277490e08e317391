"""Points of map exports: tab-separated text with an id, tags and coordinates, merged by id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_points(points: DataFrame, path: str) -> None:
    """Tab-separated text with a header, osm_id first."""
    points.write.csv(path, sep="\t", header=True)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """(osm_id, tags..., lon, lat): tags as strings, in the file's order."""
    raw = spark.read.csv(path, sep="\t", header=True)
    kinds = {"osm_id": "long", "lon": "double", "lat": "double"}
    return raw.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in raw.columns])


def merged_by_id(*exports: DataFrame) -> DataFrame:
    """A row per id: that of the first export that has it; tags that an export lacks are null.

    Ids are unique within an export. Rows are combined in the map tasks before they are shuffled.
    """
    parts = [df.withColumn("__place", F.lit(i)) for i, df in enumerate(exports)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    cols = [c for c in every.columns if c not in ("osm_id", "__place")]
    best = every.groupBy("osm_id").agg(F.min_by(F.struct(*cols), "__place").alias("__row"))
    return best.select("osm_id", "__row.*")
