"""Descriptive statistics, correlation and linear models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Values of a group that are ranked one by one in any case, and the share of ranks on either side of a point beyond.
WHOLE, MARGIN = 100_000, 0.001


def exclusive_quantile(df: DataFrame, value: str, keys: Sequence[str], points: dict[str, float]) -> DataFrame:
    """Quantiles at p (n + 1) by interpolation (the exclusive method), the ends beyond the data extended.

    Ranks are counted over distinct values, pre-aggregated. Of groups with more than WHOLE values only those
    between the quantiles that a mergeable sketch gives a little below and above each point are ranked one by
    one; how many lie below them is counted exactly. The sketch's error is a tenth of that margin.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    margins = [min(1.0, max(0.0, p + e)) for p in points.values() for e in (-MARGIN, MARGIN)]
    sketch = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.percentile_approx("__v", margins, int(10 / MARGIN)).alias("__q"))
    joined = rows.join(sketch, list(keys)) if keys else rows.crossJoin(F.broadcast(sketch))  # a row per group
    near = F.lit(False)
    for i in range(len(points)):
        near |= F.col("__v").between(F.col("__q")[2 * i], F.col("__q")[2 * i + 1])
    # values that aren't near a point are counted by which of the ranges they lie before
    place = sum((F.col("__v") > F.col("__q")[2 * i + 1]).cast("int") for i in range(len(points)))
    kept = F.when((F.col("__n") <= WHOLE) | near, F.col("__v"))
    counted = joined.groupBy(*keys, "__n", place.alias("__place"), kept.alias("__v")).agg(F.count("*").alias("__c"))
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("__place", F.col("__v").asc_nulls_first())
    ranked = counted.withColumn("__hi", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__lo", F.col("__hi") - F.col("__c") + 1)
    out = []
    for name, p in points.items():
        # the interval of ranks j, j + 1 around p (n + 1), kept within 1 to n
        j = F.greatest(F.lit(1), F.least(F.floor(F.lit(p) * (F.col("__n") + 1)), F.col("__n") - 1))
        frac = F.lit(p) * (F.col("__n") + 1) - j
        at = lambda r: F.max(F.when((F.col("__lo") <= r) & (r <= F.col("__hi")), F.col("__v")))
        low, high = at(j), at(F.least(j + 1, F.col("__n")))
        out.append((low + (high - low) * F.max(frac)).alias(name))
    return ranked.groupBy(*keys).agg(*out)


def time_summary(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """n, min, q1, median, q3, max, mean and sample deviation of a column."""
    v = F.col(value)
    plain = df.groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("stdev"))
    quant = exclusive_quantile(df, value, keys, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return plain.join(quant, list(keys)) if keys else plain.crossJoin(quant)


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r, r2) of each pair of columns, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    parts = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(parts).alias("x")).select("x.a", "x.b", "x.r", (F.col("x.r") * F.col("x.r")).alias("r2"))


def min_max(df: DataFrame, columns: Sequence[str], suffix: str = "_norm") -> DataFrame:
    """Columns scaled to 0..1 by a join with one row of bounds."""
    bounds = df.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    scale = lambda c: F.try_divide(F.col(c) - F.col(f"__lo_{c}"), F.col(f"__hi_{c}") - F.col(f"__lo_{c}"))
    out = df.crossJoin(F.broadcast(bounds))
    return out.select(*df.columns, *[scale(c).alias(c + suffix) for c in columns])


def linear_model(df: DataFrame, response: str, terms: Sequence[str]) -> dict:
    """Least squares with standard errors, p values, r2, adjusted r2 and F. Rows with nulls are left out."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = df.select(F.col(response).cast("double").alias("__y"), *[F.col(t).cast("double") for t in terms]).dropna()
    data = VectorAssembler(inputCols=list(terms), outputCol="__x").transform(rows)
    s = LinearRegression(featuresCol="__x", labelCol="__y", solver="normal").fit(data)
    t = s.summary
    n, k = t.numInstances, len(terms)
    f = (t.r2 / k) / ((1 - t.r2) / (n - k - 1)) if n > k + 1 and t.r2 < 1 else float("inf")
    names = [*terms, "(intercept)"]
    table = {x: {"estimate": e, "std_error": se, "p": p} for x, e, se, p in zip(names, [*s.coefficients, s.intercept], t.coefficientStandardErrors, t.pValues, strict=True)}
    return {"terms": table, "n": n, "r2": t.r2, "r2_adjusted": t.r2adj, "f": f}


def full_merge(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "full") -> DataFrame:
    return left.join(right, list(on), how)

