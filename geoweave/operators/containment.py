"""Point and polygon relations by a grid of bounding-box cells and exact ray casting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import on_boundary, point_in_polygon

# Codes of relations in relation tables.
RELATIONS = {"intersects": 1, "contains": 2, "covers": 3, "touches": 4, "equals": 5, "overlaps": 6, "crosses": 7}


def related(polygons: DataFrame, points: DataFrame, cell_degrees: float = 0.5, polygon_id: str = "polygon_id", rings: str = "rings", point_id: str = "point_id", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """(left_id, right_id, inside, edge) of polygons and the points in or on them.

    A polygon's id and box are repeated for the cells of the box and joined to points by cell, so it is an
    equi-join; rings meet only the points in the box, and the exact test runs on those.
    """
    outer = F.col(rings)[0]
    xs, ys = F.transform(outer, lambda p: p["lon"]), F.transform(outer, lambda p: p["lat"])
    box = polygons.select(F.col(polygon_id).alias("left_id"), F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))
    cell = lambda c: F.floor(c / cell_degrees).cast("long")
    box = box.filter("x0 is not null").withColumn("__cx", F.explode(F.sequence(cell(F.col("x0")), cell(F.col("x1"))))).withColumn("__cy", F.explode(F.sequence(cell(F.col("y0")), cell(F.col("y1")))))
    at = points.select(F.col(point_id).alias("right_id"), F.col(lon).alias("__lon"), F.col(lat).alias("__lat")).withColumns({"__cx": cell(F.col("__lon")), "__cy": cell(F.col("__lat"))})
    near = box.join(at, ["__cx", "__cy"]).filter(F.col("__lon").between(F.col("x0"), F.col("x1")) & F.col("__lat").between(F.col("y0"), F.col("y1")))
    near = near.select("left_id", "right_id", "__lon", "__lat").join(polygons.select(F.col(polygon_id).alias("left_id"), F.col(rings).alias("__rings")), "left_id")
    edge = on_boundary(F.col("__lon"), F.col("__lat"), F.col("__rings"))
    near = near.withColumn("edge", edge).withColumn("inside", point_in_polygon(F.col("__lon"), F.col("__lat"), F.col("__rings")) & ~F.col("edge"))
    return near.filter("inside or edge").select("left_id", "right_id", "inside", "edge")


def relation_table(pairs: DataFrame) -> DataFrame:
    """(left_id, relation, right_id) as in precomputed tables: a polygon intersects and covers what is in or on it,
    contains what is inside, touches what is on its edge."""
    codes = lambda *names: [F.lit(RELATIONS[n]).cast("short") for n in names]
    inside = F.array(*codes("intersects", "contains", "covers"))
    edge = F.array(*codes("intersects", "covers", "touches"))
    return pairs.select("left_id", F.explode(F.when(F.col("inside"), inside).otherwise(edge)).alias("relation"), "right_id")


def with_relation(relations: DataFrame, name: str) -> DataFrame:
    return relations.filter(F.col("relation") == RELATIONS[name]).select("left_id", "right_id")


def read_relations(spark, path: str) -> DataFrame:
    """A relation table from space-separated text."""
    return spark.read.csv(path, sep=" ", schema="left_id long, relation short, right_id long")
