"""Structured Streaming forms of row-wise operators; the batch operators work on streams where Spark allows it."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.spatial_join import grid_pairs, prepared


def near_static(stream: DataFrame, static: DataFrame, max_distance_m: float, stream_id: str = "id", static_id: str = "id", payload=None, dist_col: str = "dist_km") -> DataFrame:
    """Pairs of a stream of points with a static set within a distance: a stateless stream-static equi-join by grid cell."""
    a, b = prepared(stream, stream_id, "lon", "lat", "left", "<all>"), prepared(static, static_id, "lon", "lat", "right", payload)
    return grid_pairs(a, b, max_distance_m / 1000, dist_col)
