"""Connected components of an edge table, distributed: union-find inside tasks, then large-star and small-star."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def contracted(edges: DataFrame) -> DataFrame:
    """Each task's edges (a, b) replaced by (node, smallest node connected to it there); connectivity is kept."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = parent.setdefault(p, p)
                x = parent[x]
            return x

        def out() -> pa.RecordBatch:
            pairs = [(x, root(x)) for x in parent]
            pairs = [p for p in pairs if p[0] != p[1]]
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

        for batch in parts:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > 500_000:  # bounded memory: what is known so far goes out
                yield out()
                parent.clear()
        yield out()

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: every node's (large: larger, else: smaller) neighbours are linked to its smallest neighbour."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = both.join(least, "a")
    if large:
        moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id that has an edge (a, b)."""
    seen, edges = None, staged(contracted(edges.filter("a <> b")), "edges")
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
        seen, edges = now, staged(star(star(edges, True), False), "edges")


def popcounts(x: np.ndarray) -> np.ndarray:
    """Set bits in each row of an array of uint64."""
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int64)
