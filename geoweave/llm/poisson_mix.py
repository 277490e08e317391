"""Mixing sources to target weights by Poisson replication.

Each source s gets a mean repetition rate r(s) = target share(s) * N / n(s). A document's count is
the inverse of the Poisson(r) distribution function at u (the places where it is below u), a number
in (0, 1) hashed from seed and id; the document is exploded by its count and the copies are sorted by
a second hash, which shuffles them globally. DataFrame functions only.

Defined cases: null source is a source of its own; rows that repeat an id share one u (they get the
same count); a row without an id is hashed by its columns and, among rows that are alike, its number;
ties of the second hash are broken by id, copy and row, so that no key grows; rate 0 or an empty table
gives no rows. No count is capped: the distribution is summed in log space up to where u must lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, staged

SEED = "mix-1"


def unit_hash(key: Column) -> Column:
    """(h + 0.5) / 2^48 of the first 12 hex digits of md5: in (0, 1), the same in any SQL engine."""
    return (F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)


def with_cdf(rates: DataFrame) -> DataFrame:
    """Rows (__source, __rate) with __cdf: Poisson(__rate) at 0, 1, ... as an array, up to where it is 1 in doubles.

    The pmf is exp(k ln r - r - ln k!); ln k! and the pmf are summed along k, a row per source and k.
    """
    rate, k = F.col("__rate"), F.col("__k")
    top = F.when(rate > 0, F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")).otherwise(0)
    along = Window.partitionBy("__source").orderBy("__k").rowsBetween(Window.unboundedPreceding, 0)
    rows = rates.withColumn("__k", F.explode(F.sequence(F.lit(0), top)))
    rows = rows.withColumn("__lf", F.sum(F.log(F.greatest(k, F.lit(1)).cast("double"))).over(along))
    rows = rows.withColumn("__p", F.when(rate > 0, F.exp(k * F.log(rate) - rate - F.col("__lf"))).otherwise(1.0))
    rows = rows.withColumn("__c", F.sum("__p").over(along))
    pairs = F.array_sort(F.collect_list(F.struct("__k", "__c")))
    return rows.groupBy("__source", "__rate").agg(F.transform(pairs, lambda x: x["__c"]).alias("__cdf"))


def source_rates(docs: DataFrame, source_col: str, targets: dict[str, float] | None = None, alpha: float = 0.5) -> DataFrame:
    """(source, rate, cdf), stored. targets: share by source; without it shares go as n(s)^alpha, which lifts small sources."""
    n = docs.groupBy(F.col(source_col).alias("__source")).agg(F.count("*").alias("__n"))
    if targets is None:
        want = F.pow(F.col("__n").cast("double"), F.lit(float(alpha)))
    else:
        table = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in targets.items()], "__source string, __w double")
        n = n.join(table, n["__source"].eqNullSafe(table["__source"]), "left").select(n["__source"], "__n", "__w")
        want = F.coalesce(F.col("__w"), F.lit(0.0))
    n = n.withColumn("__want", want)
    total = n.agg(F.sum("__want").alias("__all_want"), F.sum("__n").alias("__all_n"))
    rates = n.crossJoin(F.broadcast(total)).select("__source", (F.col("__want") / F.col("__all_want") * F.col("__all_n") / F.col("__n")).alias("__rate"))  # total: one row
    # stored, so that its size is known: Spark broadcasts it where it is small, else splits skewed sources
    return staged(with_cdf(rates), "mix-rates")


def replicated(docs: DataFrame, rates: DataFrame, id_col: str = "doc_id", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """(__doc, __name, __rate, __u, __count, __copy, __key, __row): a row per copy of a row of docs, in no order.

    __doc is the row; it is kept in one column, so no name clashes.
    """
    doc, name = F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.col(f"`{id_col}`").cast("string")
    whole = docs.select(doc.alias("__doc"), name.alias("__name"), F.col(f"`{source_col}`").alias("__from"))
    # rows without an id: equal ones are counted in the map tasks first, then numbered
    alike = whole.filter("__name is null").groupBy("__doc", "__from").agg(F.count("*").alias("__many"))
    nth = alike.withColumn("__nth", F.explode(F.sequence(F.lit(1), F.col("__many").cast("int"))))
    unnamed = nth.select("__doc", F.concat(F.lit("null-"), F.xxhash64("__doc").cast("string"), F.lit("-"), F.col("__nth").cast("string")).alias("__name"), "__from")
    out = whole.filter("__name is not null").union(unnamed).join(rates, F.col("__from").eqNullSafe(F.col("__source")))
    out = out.withColumn("__u", unit_hash(F.concat_ws("|", F.lit(seed), F.col("__name"))))
    out = out.withColumn("__count", F.size(F.filter("__cdf", lambda c: c < F.col("__u")))).filter("__count > 0").drop("__cdf", "__source", "__from")
    out = out.withColumn("__row", F.monotonically_increasing_id()).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__count"))))
    order = F.concat_ws("|", F.lit(seed + "-order"), F.col("__name"), F.col("__copy").cast("string"))
    return out.withColumn("__key", F.conv(F.substring(F.md5(order), 1, 12), 16, 10).cast("long"))


def poisson_mix(docs: DataFrame, targets: dict[str, float] | None = None, alpha: float = 0.5, id_col: str = "doc_id", source_col: str = "source", seed: str = SEED, extra: bool = False) -> DataFrame:
    """The mixed corpus in shuffled order, with the columns of docs (and with extra the working columns)."""
    rates = source_rates(docs.select(source_col), source_col, targets, alpha)
    out = replicated(docs, rates, id_col, source_col, seed).orderBy("__key", "__name", "__copy", "__row")
    return out.select(*[F.col("__doc").getField(c).alias(c) for c in docs.columns], *["__rate", "__u", "__count", "__copy", "__key"] * extra)


def op6_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per replica of a document, shares of sources going as the root of their size, in shuffled order.

    The mixed corpus is stored with all columns of documents, in shuffled order; the rows returned are read from it.
    """
    out = staged(poisson_mix(documents(spark, sf_dir), extra=True), "mix-corpus").orderBy("__key", "doc_id", "__copy")
    return out.select("doc_id", "source", F.round("__rate", 9).alias("rate"), F.col("__count").cast("long").alias("n_copies"), F.col("__copy").cast("long").alias("copy_no"), F.col("__key").alias("shuffle_key"))


ORACLE = """
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
r AS (SELECT source, sqrt(n) / sum(sqrt(n)) OVER () * sum(n) OVER () / n AS rate FROM n),
d AS (SELECT doc_id, d.source, rate, (('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12))::BIGINT + 0.5) / 281474976710656.0 AS u
      FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
k AS (SELECT unnest(range(0, (SELECT CAST(ceil(max(rate) + 12 * sqrt(max(rate)) + 31) AS BIGINT) FROM r))) AS k),
pmf AS (SELECT DISTINCT rate, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p FROM (SELECT DISTINCT rate FROM r), k WHERE k <= ceil(rate + 12 * sqrt(rate) + 30)),
cdf AS (SELECT rate, k, sum(p) OVER (PARTITION BY rate ORDER BY k) AS c FROM pmf),
c AS (SELECT rate, list(c ORDER BY k) AS cs FROM cdf GROUP BY 1),
m AS (SELECT d.doc_id, d.source, d.rate, len(list_filter(c.cs, lambda x: x < d.u)) AS n_copies FROM d JOIN c ON d.rate = c.rate)
SELECT doc_id, source, round(rate, 9) AS rate, n_copies, copy_no,
  ('0x' || substr(md5('mix-1-order|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || copy_no), 1, 12))::BIGINT AS shuffle_key
FROM (SELECT *, unnest(range(1, n_copies + 1)) AS copy_no FROM m WHERE n_copies > 0)
"""
