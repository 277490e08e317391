"""KML and KMZ: placemarks with one geometry each, as rows and as triples."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import geometry_wkt, polygon_text, ring_text
from ..functions.literals import literal
from ..staging import new_folder

COORDS = "struct<coordinates string>"
RING = "struct<LinearRing: struct<coordinates string>>"
GEOMETRY = f"Point array<{COORDS}>, LineString array<{COORDS}>, Track array<struct<coord array<string>>>, Polygon array<struct<outerBoundaryIs {RING}, innerBoundaryIs array<{RING}>>>"
SCHEMA = f"_id string, name string, description string, {GEOMETRY}, MultiGeometry array<struct<{GEOMETRY}>>"


def unpacked(spark: SparkSession, path: str) -> str:
    """A folder with the only .kml of a KMZ file, taken out by a task; other paths as they are."""
    if not path.lower().endswith(".kmz"):
        return path

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for content in batch.column("content"):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    names = [n for n in z.namelist() if n.lower().endswith(".kml")]
                    if len(names) != 1:
                        raise ValueError(f"{path}: {len(names)} .kml files, one expected")
                    yield pa.RecordBatch.from_arrays([pa.array([z.read(names[0]).decode("utf-8-sig")])], ["value"])

    folder = f"{new_folder(spark, 'kmz')}/kml"
    spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "value string").write.text(folder)
    return folder


def _point(text: Column, separator: str = ",") -> Column:
    part = F.split(F.trim(text), separator)
    p = F.struct(F.get(part, F.lit(0)).try_cast("double").alias("lon"), F.get(part, F.lit(1)).try_cast("double").alias("lat"))
    return F.when(p["lon"].between(-180, 180) & p["lat"].between(-90, 90), p)


def _list(texts: Column, separator: str = ",") -> Column:
    return F.filter(F.transform(texts, lambda t: _point(t, separator)), lambda p: p.isNotNull())


def _line(text: Column) -> Column:
    return _list(F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != ""))


def _lines(some: Column) -> Column:
    return F.filter(some, lambda x: F.size(x) >= 2)


def _empty(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(kind))


POINT = "struct<lon: double, lat: double>"


def members(g: Column | None = None) -> tuple[Column, Column, Column]:
    """Points, lines and polygons that are direct children; lines of one point and polygons without an outer ring go."""
    f = lambda n: F.col(n) if g is None else g[n]
    points = F.filter(F.transform(f("Point"), lambda p: _point(p["coordinates"])), lambda p: p.isNotNull())
    lines = F.concat(_empty(F.transform(f("LineString"), lambda x: _line(x["coordinates"])), f"array<array<{POINT}>>"), _empty(F.transform(f("Track"), lambda x: _list(x["coord"], r"\s+")), f"array<array<{POINT}>>"))
    ring = lambda r: _line(r["LinearRing"]["coordinates"])
    rings = lambda x: F.concat(F.array(ring(x["outerBoundaryIs"])), _lines(_empty(F.transform(x["innerBoundaryIs"], ring), f"array<array<{POINT}>>")))
    polygons = F.filter(F.transform(f("Polygon"), rings), lambda x: F.coalesce(F.size(x[0]) >= 2, F.lit(False)))
    return _empty(points, f"array<{POINT}>"), _lines(lines), _empty(polygons, f"array<array<array<{POINT}>>>")


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, description, points, lines, polygons, wkt) of placemarks at any depth with a valid geometry.

    A placemark has one geometry at most; more raise an error when it is read.
    """
    path = unpacked(spark, path)
    raw = spark.read.format("xml").schema(SCHEMA).option("rowTag", "Placemark").option("ignoreNamespace", True).load(path)
    own = raw.withColumns(dict(zip(("points", "lines", "polygons"), members(), strict=True)))
    multi = F.col("MultiGeometry")[0]
    p, n, g = members(multi)
    own = own.withColumns({"mp": p, "ml": n, "mg": g})
    single = F.when(F.size("points") > 0, F.concat(F.lit("POINT("), F.concat_ws(" ", F.col("points")[0]["lon"], F.col("points")[0]["lat"]), F.lit(")")))
    single = single.when(F.size("lines") > 0, F.concat(F.lit("LINESTRING"), ring_text(F.col("lines")[0]))).when(F.size("polygons") > 0, F.concat(F.lit("POLYGON"), polygon_text(F.col("polygons")[0])))
    count = F.size("points") + F.size("lines") + F.size("polygons") + F.when(multi.isNotNull(), 1).otherwise(0)
    own = own.withColumn("wkt", F.coalesce(single, geometry_wkt(F.col("mp"), F.col("ml"), F.col("mg"))))
    own = own.filter((F.assert_true(count <= 1, "a placemark has more than one geometry").isNull()) & F.col("wkt").isNotNull())
    return own.select(F.col("_id").alias("id"), "name", "description", F.concat("points", "mp").alias("points"), F.concat("lines", "ml").alias("lines"), F.concat("polygons", "mg").alias("polygons"), "wkt")


def kml_triples(df: DataFrame, dataset: str, prefix: str, parent: str | None = None) -> DataFrame:
    """(s, p, o) of placemarks: type, parent, id, label, description, geometry and its text."""
    df = df.withColumn("__s", F.concat(F.lit(prefix), F.monotonically_increasing_id().cast("string")))
    s, geo = F.col("__s"), F.concat("__s", F.lit("_geo"))
    opt = lambda c: F.when(F.col(c).isNotNull(), literal(F.col(c)))
    rows = [(s, "rdf:type", F.lit(f"{prefix.split(':')[0]}:{dataset}")), (s, "rdfs:member", F.lit(parent)), (s, "dct:identifier", opt("id")), (s, "rdfs:label", opt("name")), (s, "dct:description", opt("description")), (s, "geo:hasGeometry", geo), (geo, "geo:asWKT", F.concat(F.lit('"'), F.col("wkt"), F.lit('"^^geo:wktLiteral')))]
    parts = F.array(*[F.struct(a.alias("s"), F.lit(b).alias("p"), c.cast("string").alias("o")) for a, b, c in rows])
    return df.select(F.explode(parts).alias("t")).select("t.*").filter("o is not null")


def aux_geometries(triples: DataFrame) -> DataFrame:
    """(subject, wkt) of each geometry, for a side table."""
    text = triples.filter("p = 'geo:asWKT'").select(F.col("s").alias("geo"), F.regexp_extract("o", '^"(.*)"', 1).alias("wkt"))
    return triples.filter("p = 'geo:hasGeometry'").join(text, F.col("o") == F.col("geo")).select(F.col("s").alias("subject"), "wkt")
