"""Spatial search joins: pairs within a distance, nearest neighbours, or both.

Strategies give equal results with different plans:

nested_loop  every pair, then the exact condition; the plain form, as a check; a distance is tested by the
             angle's cosine first, and rows are dealt out evenly, as its work grows with the product of sizes;
bbox         latitude bands as join key, longitudes by difference, then the exact condition;
grid         latitude bands cut into cells; the right side has one cell, the left side is repeated for
             the cells that its circle may touch, so it is an ordinary equi-join that Spark can hash,
             sort or split where skewed; right across the antimeridian and at the poles;
bounded      nearest neighbours: any k right points of the smallest of the nested cells around a left
             row that holds as many bound the distance to its k-th neighbour, so one equi-join on a grid
             whose cells fit that bound finds them. The root cell holds all, so no row is left over.

Left rows without a partner vanish. Ties of distance go to the smaller right id. Rows without valid
coordinates on either side are dropped. Ids must be unique on the right, and on the left for k.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM, haversine_km, valid_point
from ..staging import staged

#: How much higher the cells of a level are than those of the level below.
GROWTH = 3
ALL = "<all>"
#: Tasks a core of a join of all pairs.
PARTS = 4
#: Right rows that such a join tests at a time.
PACK = 8


def prepared(df: DataFrame, id_col: str, lon: str, lat: str, prefix: str, payload: Sequence[str] | str | None) -> DataFrame:
    """The side of a join with its keys renamed; payload: other columns to carry, <all> for every one."""
    extra = [c for c in df.columns if c not in (id_col, lon, lat)] if payload == ALL else list(payload or ())
    out = df.select(F.col(id_col).alias(f"{prefix}_id"), F.col(lon).cast("double").alias(f"{prefix}_lon"), F.col(lat).cast("double").alias(f"{prefix}_lat"), *extra)
    return out.filter(valid_point(F.col(f"{prefix}_lon"), F.col(f"{prefix}_lat")))


def distance(dist_col: str) -> Column:
    return haversine_km(F.col("left_lon"), F.col("left_lat"), F.col("right_lon"), F.col("right_lat")).alias(dist_col)


def band_height(km: float) -> float:
    """Degrees of latitude that a distance covers at most, a little more for rounding."""
    return min(180.0, math.degrees(km / EARTH_KM) * (1 + 1e-9) + 1e-9)


def cells_in_band(band: Column, height: float | Column) -> Column:
    """Cells around the earth in a latitude band, each about as wide as the band is high where it is narrowest."""
    low, high = band * height - 90, (band + 1) * height - 90
    far = F.least(F.greatest(F.abs(low), F.abs(high)), F.lit(90.0))
    return F.greatest(F.lit(1), F.floor(F.lit(360.0) / height * F.cos(F.radians(far)))).cast("long")


def band_of(lat: Column, height: float | Column) -> Column:
    return F.floor((lat + 90) / height).cast("long")


def cell_of(lon: Column, n: Column) -> Column:
    return F.least(F.floor((lon + 180) / 360 * n), n - 1).cast("long")


def reach_degrees(lat: Column, km: float | Column) -> Column:
    """Degrees of longitude to either side that a circle covers; 180 where it holds a pole."""
    r = (km if isinstance(km, Column) else F.lit(float(km))) / EARTH_KM * (1 + 1e-9)
    inner = F.least(F.lit(1.0), F.sin(r) / F.cos(F.radians(lat)))
    whole = (r >= math.pi / 2) | (F.abs(lat) + F.degrees(r) >= 89.999999)
    return F.when(whole, F.lit(180.0)).otherwise(F.degrees(F.asin(inner)) + 1e-9)


def with_cell(right: DataFrame, height: float | Column) -> DataFrame:
    keyed = right.withColumn("__band", band_of(F.col("right_lat"), height))
    return keyed.withColumn("__cell", cell_of(F.col("right_lon"), cells_in_band(F.col("__band"), height)))


def with_cells(left: DataFrame, height: float | Column, km: float | Column) -> DataFrame:
    """A row per cell that the circle around a left row may touch; a band is at least as high as the radius."""
    own = band_of(F.col("left_lat"), height)
    top = F.floor(F.lit(180.0) / height).cast("long")
    spread = left.withColumn("__band", F.explode(F.sequence(F.greatest(own - 1, F.lit(0).cast("long")), F.least(own + 1, top))))
    n, reach = cells_in_band(F.col("__band"), height), reach_degrees(F.col("left_lat"), km)
    first = F.floor((F.col("left_lon") + 180 - reach) / 360 * n).cast("long")
    last = F.floor((F.col("left_lon") + 180 + reach) / 360 * n).cast("long")
    cells = F.sequence(first, F.least(last, first + n - 1))
    # lon = 180 lies in the last cell, but in the first one once wrapped; the right side uses the last
    return spread.withColumn("__cell", F.explode(F.transform(cells, lambda c: F.pmod(c, n))))


def grid_pairs(left: DataFrame, right: DataFrame, km: float, dist_col: str) -> DataFrame:
    """Pairs within km. A cell is at least as wide as the reach over most of a band, so a left row has few cells."""
    h = band_height(km)
    near = with_cells(left, h, km).join(with_cell(right, h), ["__band", "__cell"])
    return near.withColumn(dist_col, distance(dist_col)).filter(F.col(dist_col) <= km).drop("__band", "__cell")


def bbox_pairs(left: DataFrame, right: DataFrame, km: float, dist_col: str) -> DataFrame:
    h = band_height(km)
    keyed = right.withColumn("__band", band_of(F.col("right_lat"), h))
    own = band_of(F.col("left_lat"), h)
    spread = left.withColumn("__band", F.explode(F.sequence(own - 1, own + 1)))
    gap = F.abs(F.col("left_lon") - F.col("right_lon"))
    near = (F.least(gap, 360 - gap) <= reach_degrees(F.col("left_lat"), km)) & (F.abs(F.col("left_lat") - F.col("right_lat")) <= h)
    return spread.join(keyed, "__band").filter(near).withColumn(dist_col, distance(dist_col)).filter(F.col(dist_col) <= km).drop("__band")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly: work on all pairs doesn't follow the bytes by which files are split."""
    return df.repartition(PARTS * df.sparkSession.sparkContext.defaultParallelism)


def all_pairs(left: DataFrame, right: DataFrame, dist_col: str) -> DataFrame:
    return spread(left).crossJoin(spread(right)).withColumn(dist_col, distance(dist_col))


def vector(lon: Column, lat: Column) -> Column:
    """The point on the unit sphere as a struct (x, y, z)."""
    lon, lat = F.radians(lon), F.radians(lat)
    return F.struct((F.cos(lat) * F.cos(lon)).alias("x"), (F.cos(lat) * F.sin(lon)).alias("y"), F.sin(lat).alias("z"))


def all_pairs_within(left: DataFrame, right: DataFrame, km: float, dist_col: str) -> DataFrame:
    """Every pair is compared by the cosine of its angle, three products; the distance is computed where that is near enough.

    The slack is far above the rounding of the cosine and of the distance, so no pair within km is lost. Right rows
    come in packs, whose vectors are columns that can't be null: so the loop over pairs reads few rows and tests no nulls.
    """
    least = math.cos(min(math.pi, km / EARTH_KM)) - 1e-12
    cosine = lambda at: F.col("__x") * at("x") + F.col("__y") * at("y") + F.col("__z") * at("z")
    axes = lambda at, name: [F.coalesce(at[axis], F.lit(0.0)).alias(f"{name}{axis}") for axis in "xyz"]
    own = spread(left).select(*left.columns, *axes(vector(F.col("left_lon"), F.col("left_lat")), "__"))
    row = F.struct(*right.columns, vector(F.col("right_lon"), F.col("right_lat")).alias("__at")).alias("__row")
    # sorted, so that a task that is run again packs its rows as before
    packs = right.sortWithinPartitions("right_id").select(F.floor(F.monotonically_increasing_id() / PACK).alias("__pack"), row)
    packs = packs.groupBy("__pack").agg(F.collect_list("__row").alias("__rows"))
    packs = spread(packs.select("__rows", *[c for i in range(PACK) for c in axes(F.get("__rows", F.lit(i))["__at"], f"__{i}_")]))
    some = functools.reduce(Column.__or__, [cosine(lambda axis, i=i: F.col(f"__{i}_{axis}")) >= least for i in range(PACK)])
    near = own.crossJoin(packs).filter(some).select(*left.columns, "__x", "__y", "__z", F.explode("__rows").alias("__row"))
    near = near.filter(cosine(lambda axis: F.col("__row")["__at"][axis]) >= least).select(*left.columns, *[F.col("__row")[c].alias(c) for c in right.columns])
    return near.withColumn(dist_col, distance(dist_col)).filter(F.col(dist_col) <= km)


def nearest_of(pairs: DataFrame, k: int, dist_col: str, *by: str) -> DataFrame:
    """The k nearest partners of each left row."""
    w = Window.partitionBy("left_id", *by).orderBy(dist_col, "right_id")
    return pairs.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= k).drop("__rank")


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage with a table in the shared folder."""
    return staged(df, "spatial")


def cell_heights(right: DataFrame) -> tuple[dict[str, int], list[float]]:
    """Right rows by set, and heights of cells in degrees: from about one row a cell to one cell for all, times GROWTH."""
    of = right.groupBy("__set").agg(F.count("*").alias("n"), F.min("right_lon").alias("x0"), F.max("right_lon").alias("x1"), F.min("right_lat").alias("y0"), F.max("right_lat").alias("y1")).collect()  # a row per set
    if not of:
        return {}, [360.0 * GROWTH]
    area = (max(r.x1 for r in of) - min(r.x0 for r in of)) * (max(r.y1 for r in of) - min(r.y0 for r in of))
    heights = [min(60.0, max(1e-4, math.sqrt(area * len(of) / sum(r.n for r in of))))]
    while heights[-1] <= 360:
        heights.append(heights[-1] * GROWTH)
    return {r["__set"]: r.n for r in of}, heights


def bounded_nearest(left: DataFrame, right: DataFrame, k: int, dist_col: str) -> DataFrame:
    """The k nearest of each set of the right side (column __set) for each left row, in one pass."""
    sets, heights = cell_heights(right)
    if not sets:
        return left.join(right, F.lit(False)).withColumn(dist_col, F.lit(0.0))
    levels = F.array(*[F.lit(x) for x in range(len(heights))])
    want = F.create_map(*[F.lit(x) for s, n in sets.items() for x in (s, min(k, n))])
    y, x = (lambda c, add: F.floor((c + add) / heights[0]).cast("long")), (lambda c: F.floor(c / F.pow(F.lit(float(GROWTH)), "__level")).cast("long"))
    # nested cells of the right side with k of their points each; ranks are limited in the map tasks first
    nested = right.select("__set", "right_id", "right_lon", "right_lat", F.explode(levels).alias("__level")).withColumns({"__y": x(y(F.col("right_lat"), 90)), "__x": x(y(F.col("right_lon"), 180))})
    rank = F.row_number().over(Window.partitionBy("__set", "__level", "__y", "__x").orderBy("right_id"))
    some = nested.withColumn("__rank", rank).filter(F.col("__rank") <= k)
    some = some.groupBy("__set", "__level", "__y", "__x").agg(F.collect_list(F.struct(F.col("right_lon").alias("lon"), F.col("right_lat").alias("lat"))).alias("__some")).filter(F.size("__some") >= want[F.col("__set")])
    # the smallest such cell around each occupied cell of the left side
    keyed = left.withColumns({"__y0": y(F.col("left_lat"), 90), "__x0": y(F.col("left_lon"), 180)})
    around = keyed.select("__y0", "__x0").distinct().withColumn("__level", F.explode(levels)).withColumns({"__y": x(F.col("__y0")), "__x": x(F.col("__x0"))})
    chosen = around.join(some, ["__level", "__y", "__x"]).groupBy("__y0", "__x0", "__set").agg(F.min_by("__some", "__level").alias("__some"))
    far = F.array_max(F.transform("__some", lambda p: haversine_km(F.col("left_lon"), F.col("left_lat"), p["lon"], p["lat"])))
    ringed = keyed.join(chosen, ["__y0", "__x0"]).withColumn("__km", far * (1 + 1e-9) + 1e-6).drop("__some", "__y0", "__x0")
    needed = F.least(F.lit(180.0), F.degrees(F.col("__km") / EARTH_KM) * (1 + 1e-9) + 1e-9)
    level = F.greatest(F.lit(0), F.ceil(F.log(needed / heights[0]) / math.log(GROWTH) + 1e-9)).cast("int")
    height = F.element_at(F.array(*map(F.lit, heights)), F.col("__level") + 1)
    spread = with_cells(ringed.withColumn("__level", F.least(level, F.lit(len(heights) - 1))), height, F.col("__km"))
    cells = with_cell(right.withColumn("__level", F.explode(levels)), height)
    near = spread.join(cells, ["__set", "__level", "__band", "__cell"]).withColumn(dist_col, distance(dist_col)).filter(F.col(dist_col) <= F.col("__km"))
    return nearest_of(near.drop("__level", "__band", "__cell", "__km"), k, dist_col, "__set")


def spatial_join(
    left: DataFrame,
    right: DataFrame,
    k: int | None = None,
    max_distance_m: float | None = None,
    left_id: str = "left_id",
    right_id: str = "right_id",
    left_point: tuple[str, str] = ("lon", "lat"),
    right_point: tuple[str, str] = ("lon", "lat"),
    payload: Sequence[str] | str | None = None,
    left_columns: Sequence[str] | str | None = ALL,
    dist_col: str = "dist_km",
    strategy: str = "auto",
) -> DataFrame:
    """left_id, left_lon, left_lat, the left's columns, right_id, right_lon, right_lat, the payload, and the distance in km.

    k: the nearest k partners; max_distance_m: partners within it, inclusive; both: both hold.
    """
    if not (k and k > 0) and not (max_distance_m is not None and max_distance_m > 0):
        raise ValueError("k or max_distance_m must be positive")
    if strategy not in ("auto", "nested_loop", "grid", "bbox", "bounded"):
        raise ValueError(f"unknown strategy: {strategy}")
    a, b = prepared(left, left_id, *left_point, "left", left_columns), prepared(right, right_id, *right_point, "right", payload)
    km = None if max_distance_m is None else max_distance_m / 1000
    if strategy == "nested_loop":
        pairs = all_pairs(a, b, dist_col) if km is None else all_pairs_within(a, b, km, dist_col)
    elif km is None:
        return bounded_nearest(a, b.withColumn("__set", F.lit("")), k, dist_col).drop("__set")
    else:
        pairs = (bbox_pairs if strategy == "bbox" else grid_pairs)(a, b, km, dist_col)
    return nearest_of(pairs, k, dist_col) if k else pairs


def multi_nearest(left: DataFrame, rights: dict[str, DataFrame], left_id: str = "left_id", right_id: str = "right_id", group_size: int | None = None, left_point: tuple[str, str] = ("lon", "lat"), right_point: tuple[str, str] = ("lon", "lat")) -> DataFrame:
    """The nearest partner's distance from each of several right sets, a column dist_<name> each.

    The sets go through one join, told apart by a tag. Left rows without a partner in some set vanish. With
    group_size, sets are joined in chunks whose results are stored between, which bounds the size of one plan.
    """
    own = prepared(left, left_id, *left_point, "left", None)
    names, out = list(rights), None
    for at in range(0, len(names), group_size or len(names)):
        group = names[at : at + (group_size or len(names))]
        tagged = [prepared(rights[n], right_id, *right_point, "right", None).withColumn("__set", F.lit(n)) for n in group]
        near = bounded_nearest(own, functools.reduce(DataFrame.unionByName, tagged), 1, "__d")
        near = near.groupBy("left_id").agg(*[F.max(F.when(F.col("__set") == n, F.col("__d"))).alias(f"dist_{n}") for n in group]).dropna()
        out = near if out is None else out.join(near, "left_id")
        if at + len(group) < len(names):
            out = stored(out)
    return out
