"""Points, distances and well-known text as column expressions.

Coordinates are degrees (lon, lat) in plain DOUBLE columns; distances are kilometres on a sphere of
the mean earth radius; thresholds named max_distance_m are metres.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
NUMBER = r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?"
WKT_POINT = rf"(?i)^\s*POINT\s*\(\s*({NUMBER})\s+({NUMBER})\s*\)"


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), half)))


def haversine_sql(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    """The same expression as SQL text."""
    return f"(2 * {EARTH_KM} * asin(sqrt(least(1.0, pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))))"


def wkt_lon(wkt: Column) -> Column:
    return F.regexp_extract(wkt, WKT_POINT, 1).try_cast("double")


def wkt_lat(wkt: Column) -> Column:
    return F.regexp_extract(wkt, WKT_POINT, 2).try_cast("double")


def wkt_point(lon: Column, lat: Column) -> Column:
    return F.concat(F.lit("POINT("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")"))


def valid_point(lon: Column, lat: Column) -> Column:
    return F.coalesce(lon.between(-180, 180) & lat.between(-90, 90), F.lit(False))


def _text(p: Column) -> Column:
    return F.concat_ws(" ", p["lon"], p["lat"])


def ring_text(points: Column) -> Column:
    """Coordinates of an array of points as in WKT: (x y, x y)."""
    return F.concat(F.lit("("), F.array_join(F.transform(points, _text), ", "), F.lit(")"))


def polygon_text(rings: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(F.transform(rings, ring_text), ", "), F.lit(")"))


def geometry_wkt(points: Column, lines: Column, polygons: Column) -> Column:
    """WKT of one geometry's members: arrays of points, of lines and of polygons (outer ring first).

    A single member is printed as itself, several of a kind as MULTI..., mixed ones as a collection.
    """
    p, n_l, g = F.size(points), F.size(lines), F.size(polygons)
    one = F.transform(points, lambda x: F.concat(F.lit("("), _text(x), F.lit(")")))
    bodies = F.concat(one, F.transform(lines, ring_text), F.transform(polygons, polygon_text))
    named = F.concat(F.transform(one, lambda x: F.concat(F.lit("POINT"), x)), F.transform(lines, lambda x: F.concat(F.lit("LINESTRING"), ring_text(x))), F.transform(polygons, lambda x: F.concat(F.lit("POLYGON"), polygon_text(x))))
    kind = F.when(p > 0, F.lit("POINT")).when(n_l > 0, F.lit("LINESTRING")).otherwise(F.lit("POLYGON"))
    kinds = (p > 0).cast("int") + (n_l > 0).cast("int") + (g > 0).cast("int")
    return F.when(kinds == 0, F.lit(None)).when(kinds > 1, F.concat(F.lit("GEOMETRYCOLLECTION("), F.array_join(named, ", "), F.lit(")"))).otherwise(F.concat(F.lit("MULTI"), kind, F.lit("("), F.array_join(bodies, ", "), F.lit(")")))


def crosses_ray(lon: Column, lat: Column, ring: Column) -> Column:
    """How often a ray to the east from a point crosses a ring; the ring is closed if it isn't."""
    n = F.size(ring)
    edges = F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    hit = lambda e: ((e["a"]["lat"] > lat) != (e["b"]["lat"] > lat)) & (lon < (e["b"]["lon"] - e["a"]["lon"]) * (lat - e["a"]["lat"]) / (e["b"]["lat"] - e["a"]["lat"]) + e["a"]["lon"])
    return F.aggregate(edges, F.lit(0), lambda acc, e: acc + F.coalesce(hit(e), F.lit(False)).cast("int"))


def on_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Whether a point lies on a ring's edge."""
    n = F.size(ring)
    edges = F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    on = lambda e: (((e["b"]["lon"] - e["a"]["lon"]) * (lat - e["a"]["lat"]) == (e["b"]["lat"] - e["a"]["lat"]) * (lon - e["a"]["lon"])) & lon.between(F.least(e["a"]["lon"], e["b"]["lon"]), F.greatest(e["a"]["lon"], e["b"]["lon"])) & lat.between(F.least(e["a"]["lat"], e["b"]["lat"]), F.greatest(e["a"]["lat"], e["b"]["lat"])))
    return F.exists(edges, on)


def point_in_polygon(lon: Column, lat: Column, rings: Column) -> Column:
    """Even-odd rule over all rings, so holes are outside."""
    return F.aggregate(rings, F.lit(0), lambda acc, r: acc + crosses_ray(lon, lat, r)) % 2 == 1


def on_boundary(lon: Column, lat: Column, rings: Column) -> Column:
    return F.exists(rings, lambda r: on_ring(lon, lat, r))


def ring_centroid(ring: Column) -> Column:
    """Area-weighted centroid of a ring as a struct (lon, lat); the mean of its points where it has no area."""
    n = F.size(ring)
    edges = F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(acc: Column, e: Column) -> Column:
        c = e["a"]["lon"] * e["b"]["lat"] - e["b"]["lon"] * e["a"]["lat"]
        return F.struct((acc["s"] + c).alias("s"), (acc["x"] + (e["a"]["lon"] + e["b"]["lon"]) * c).alias("x"), (acc["y"] + (e["a"]["lat"] + e["b"]["lat"]) * c).alias("y"))

    t = F.aggregate(edges, zero, add)
    mean = lambda k: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[k]) / n
    pick = lambda k, m: F.when(t["s"] != 0, t[k] / (3 * t["s"])).otherwise(mean(m))
    return F.struct(pick("x", "lon").alias("lon"), pick("y", "lat").alias("lat"))


def ring_area(ring: Column) -> Column:
    """Area of a ring in square degrees, without sign."""
    n = F.size(ring)
    after = F.concat(F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.abs(F.aggregate(F.zip_with(ring, after, lambda a, b: a["lon"] * b["lat"] - b["lon"] * a["lat"]), F.lit(0.0), lambda s, x: s + x)) / 2


def _weighted(parts: Column) -> Column:
    """The mean (lon, lat) of structs (w, lon, lat) by weight; null without weight."""
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x["w"])
    mean = lambda k: F.aggregate(parts, F.lit(0.0), lambda s, x: s + x["w"] * x[k]) / total
    return F.when(total != 0, F.struct(mean("lon").alias("lon"), mean("lat").alias("lat")))


def _part(w: Column, lon: Column, lat: Column) -> Column:
    return F.struct(w.cast("double").alias("w"), lon.alias("lon"), lat.alias("lat"))


def geometry_centroid(points: Column, lines: Column, polygons: Column) -> Column:
    """The centroid (lon, lat) of a geometry's members: polygons by area, holes taken off; without any with an area,
    lines by length; without any with a length, the mean of all points. In degrees, as on a plane."""

    def by_area(rings: Column) -> Column:
        return F.transform(rings, lambda r, i: _part(F.when(i == 0, ring_area(r)).otherwise(-ring_area(r)), ring_centroid(r)["lon"], ring_centroid(r)["lat"]))

    def by_length(line: Column) -> Column:
        steps = F.zip_with(F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0))), F.slice(line, 2, F.size(line)), lambda a, b: _part(F.hypot(b["lon"] - a["lon"], b["lat"] - a["lat"]), (a["lon"] + b["lon"]) / 2, (a["lat"] + b["lat"]) / 2))
        return steps

    every = F.concat(points, F.flatten(lines), F.flatten(F.flatten(polygons)))
    return F.coalesce(_weighted(F.flatten(F.transform(polygons, by_area))), _weighted(F.flatten(F.transform(lines, by_length))), _weighted(F.transform(every, lambda p: _part(F.lit(1.0), p["lon"], p["lat"]))))
