"""Graph-pattern algebra on solution tables (one column per variable)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in right.columns]


def natural(left: DataFrame, right: DataFrame, cross: bool = False) -> DataFrame:
    """Inner join on all shared variables, bag semantics; without any, an error unless cross allows all pairs."""
    on = shared(left, right)
    if not on and not cross:
        raise ValueError(f"no shared variable: {left.columns} and {right.columns}")
    return left.join(right, on, "inner") if on else left.crossJoin(right)


def _compatible(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Join where each shared variable is equal or unbound on a side. The equal keys that are never
    unbound should be given to the plain joins: this one compares all pairs of what is left."""
    r = right.select(*[F.col(c).alias(f"__r_{c}" if c in on else c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [left[c].isNull() | r[f"__r_{c}"].isNull() | (left[c] == r[f"__r_{c}"]) for c in on])
    out = left.join(r, cond, how)
    return out.select(*[F.coalesce(left[c], r[f"__r_{c}"]).alias(c) if c in on else left[c] for c in left.columns], *[r[c] for c in right.columns if c not in on])


def optional(left: DataFrame, right: DataFrame, maybe_unbound: bool = False) -> DataFrame:
    """Left outer join on shared variables; with maybe_unbound an unbound variable fits anything and is filled in."""
    on = shared(left, right)
    return _compatible(left, right, on, "left") if maybe_unbound else left.join(right, on, "left")


def minus(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left rows without a right row that agrees on the shared variables; duplicates stay. Without shared variables, all."""
    on = shared(left, right)
    return left.join(right.select(*on), on, "left_anti") if on else left


def except_distinct(left: DataFrame, right: DataFrame) -> DataFrame:
    """Set difference: distinct rows."""
    return left.subtract(right)


def exists(left: DataFrame, right: DataFrame) -> DataFrame:
    on = shared(left, right)
    return left.join(right.select(*on), on, "left_semi")


def union(*parts: DataFrame) -> DataFrame:
    """Bag union; variables that a part lacks are unbound."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def values(spark: SparkSession, variables: Sequence[str], rows: Iterable[Sequence[object]], schema: str | None = None) -> DataFrame:
    """An inline table."""
    return spark.createDataFrame([tuple(r) for r in rows], schema or ", ".join(f"{v} string" for v in variables))


def path(first: DataFrame, *steps: DataFrame) -> DataFrame:
    """A sequence path over edge tables (s, o): (s, o) of both ends, nodes between projected away, multiplicity kept."""
    out = first.select("s", "o")
    for step in steps:
        nxt = step.select(F.col("s").alias("__m"), F.col("o").alias("__o"))
        out = out.join(nxt, out["o"] == nxt["__m"]).select("s", F.col("__o").alias("o"))
    return out


def with_table_count(df: DataFrame, name: str) -> DataFrame:
    """Add the number of rows of the table to each row, by a join with a one-row count, not a global window."""
    return df.crossJoin(F.broadcast(df.agg(F.count("*").alias(name))))


def any_of(columns: Sequence[str], wanted: Sequence[str]) -> Column:
    """OR over tag columns: one row per entity however many of its tags fit."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c).isin(list(wanted)), F.lit(False)) for c in columns])


def any_predicate(df: DataFrame, id_col: str, columns: Sequence[str], wanted: Sequence[str]) -> DataFrame:
    """Variable-predicate match on a wide table: a row per tag that fits, so an entity may come several times."""
    long = df.unpivot([id_col], list(columns), "p", "o")
    return long.filter(F.col("o").isin(list(wanted)))


def centred(df: DataFrame, keys: Sequence[str], weight: str, value: str, mean: str, spread: str) -> DataFrame:
    """Per group the weighted sum m of value and the weighted sum of (value - m)^2.

    The second refers to the first, a sibling aggregate: the means, a row per group, are joined back, so
    differences are squared as they are and large values lose no digits.
    """
    w, x = F.col(weight), F.col(value)
    means = df.groupBy(*keys).agg(F.sum(w * x).alias("__m"), F.sum(w).alias("__w"))
    both = df.select(*keys, w.alias("__weight"), x.alias("__value")).join(means, list(keys))
    out = both.groupBy(*keys).agg(F.min("__m").alias(mean), F.sum(F.col("__weight") * F.pow(F.col("__value") - F.col("__m"), 2)).alias(spread), F.min("__w").alias("__w"))
    return out.select(*keys, mean, spread, (1 - F.col("__w")).alias("other"))
