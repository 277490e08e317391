"""Registered queries: each operator over the test tables, with the same query in DuckDB SQL.

The tables have no coordinates; points are derived from keys by the same arithmetic on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import evaluation
from .functions.geo import geometry_centroid, haversine_km, haversine_sql, wkt_lat, wkt_lon, wkt_point
from .functions.literals import after, literal_type, literal_value, local_name, substituted
from .operators import containment, relational, stats, triples
from .operators.spatial_join import multi_nearest, spatial_join
from .plans.casestudy import manifesto_name, polarisation
from .plans.compose import ProvidedValues, QueryConfig
from .sources import gtfs
from .staging import new_folder

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        FOUND[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def points(df: DataFrame, key: str, *more: str) -> DataFrame:
    k = F.col(key)
    return df.select(k.cast("long").alias("id"), (6 + ((k * 104729) % 10009) / 10009.0 * 9).alias("lon"), (47 + ((k * 7919) % 10007) / 10007.0 * 8).alias("lat"), *more)


def points_sql(table_: str, key: str, more: str = "", where: str = "") -> str:
    return f"(SELECT CAST({key} AS BIGINT) AS id, 6 + (({key} * 104729) % 10009) / 10009e0 * 9 AS lon, 47 + (({key} * 7919) % 10007) / 10007e0 * 8 AS lat{more} FROM {table_}{where})"


CUSTOMERS, SUPPLIERS = points_sql("customer", "c_custkey"), points_sql("supplier", "s_suppkey")
LR = haversine_sql("l.lon", "l.lat", "r.lon", "r.lat")
BERLIN = (13.383333, 52.516667)


def customers(s: SparkSession, d: str, *more: str) -> DataFrame:
    return points(table(s, d, "customer"), "c_custkey", *more)


def suppliers(s: SparkSession, d: str, *more: str) -> DataFrame:
    return points(table(s, d, "supplier"), "s_suppkey", *more)


# --- distances and spatial joins ---


@query(f"SELECT round(avg({haversine_sql('lon', 'lat', str(BERLIN[0]), str(BERLIN[1]))}), 6) AS avg_km, count(*) AS n FROM {CUSTOMERS} WHERE id % 5 <> 0")
def dist_to_point_avg(s, d):
    """Points without a longitude are unbound and left out."""
    lon, lat = BERLIN
    some = customers(s, d).withColumn("lon", F.when(F.col("id") % 5 != 0, F.col("lon")))
    return some.filter(F.col("lon").isNotNull()).agg(r6(F.avg(haversine_km(F.col("lon"), F.col("lat"), F.lit(lon), F.lit(lat)))).alias("avg_km"), F.count("*").alias("n"))


NN = f"SELECT l.id, min({LR}) AS km FROM {CUSTOMERS} l, {SUPPLIERS} r GROUP BY l.id"


@query(f"SELECT round(avg(km), 6) AS avg_km, count(*) AS n FROM ({NN})")
def nn_avg_dist(s, d):
    return spatial_join(customers(s, d), suppliers(s, d), k=1, left_id="id", right_id="id").agg(r6(F.avg("dist_km")).alias("avg_km"), F.count("*").alias("n"))


@query(f"SELECT round(avg(km), 6) AS avg_km, count(*) AS n FROM (SELECT l.id, min({LR}) AS km FROM {points_sql('supplier', 's_suppkey')} l, {points_sql('nation', 'n_nationkey')} r GROUP BY l.id)")
def nn_nested_loop(s, d):
    left, right = suppliers(s, d), points(table(s, d, "nation"), "n_nationkey")
    return spatial_join(left, right, k=1, left_id="id", right_id="id", strategy="nested_loop").agg(r6(F.avg("dist_km")).alias("avg_km"), F.count("*").alias("n"))


K3 = f"SELECT * FROM (SELECT l.id AS left_id, r.id AS right_id, {LR} AS km, row_number() OVER (PARTITION BY l.id ORDER BY {LR}, r.id) AS rank FROM {CUSTOMERS} l, {SUPPLIERS} r) WHERE rank <= 3"


@query(f"SELECT left_id, right_id, round(km, 6) AS km FROM ({K3})")
def nn_k3(s, d):
    return spatial_join(customers(s, d), suppliers(s, d), k=3, left_id="id", right_id="id").select("left_id", "right_id", r6("dist_km").alias("km"))


@query(f"SELECT left_id, right_id, round(km, 6) AS km FROM ({K3}) WHERE km <= 25")
def nn_k3_maxdist(s, d):
    return spatial_join(customers(s, d), suppliers(s, d), k=3, max_distance_m=25_000, left_id="id", right_id="id").select("left_id", "right_id", r6("dist_km").alias("km"))


@query(f"SELECT left_id, right_id, round(km, 6) AS km, s_name, s_nationkey FROM ({K3}) JOIN supplier ON s_suppkey = right_id WHERE rank = 1")
def nn_payload(s, d):
    return spatial_join(customers(s, d), suppliers(s, d, "s_name", "s_nationkey"), k=1, left_id="id", right_id="id", payload="<all>").select("left_id", "right_id", r6("dist_km").alias("km"), "s_name", "s_nationkey")


PAIRS = f"SELECT count(*) AS n, round(sum(km), 3) AS total_km FROM (SELECT {LR} AS km FROM {CUSTOMERS} l, {SUPPLIERS} r) WHERE km <= 20"


@query(PAIRS)
def maxdist_grid(s, d):
    return spatial_join(customers(s, d), suppliers(s, d), max_distance_m=20_000, left_id="id", right_id="id").agg(F.count("*").alias("n"), F.round(F.sum("dist_km"), 3).alias("total_km"))


@query(PAIRS)
def maxdist_bbox(s, d):
    return spatial_join(customers(s, d), suppliers(s, d), max_distance_m=20_000, left_id="id", right_id="id", strategy="bbox").agg(F.count("*").alias("n"), F.round(F.sum("dist_km"), 3).alias("total_km"))


@query(PAIRS)
def maxdist_cartesian(s, d):
    return spatial_join(customers(s, d), suppliers(s, d), max_distance_m=20_000, left_id="id", right_id="id", strategy="nested_loop").agg(F.count("*").alias("n"), F.round(F.sum("dist_km"), 3).alias("total_km"))


@query(f"SELECT round(avg(n), 6) AS avg_n FROM (SELECT l.id, count(*) AS n FROM {SUPPLIERS} l, {SUPPLIERS} r WHERE {LR} <= 50 GROUP BY l.id)")
def maxdist_avg_count(s, d):
    """Mean number of set members within reach of a member, itself included."""
    pairs = spatial_join(suppliers(s, d), suppliers(s, d), max_distance_m=50_000, left_id="id", right_id="id")
    return pairs.groupBy("left_id").agg(F.count("*").alias("n")).agg(r6(F.avg("n")).alias("avg_n"))


@query(f"SELECT l.id AS a, r.id AS b, round({LR}, 6) AS km FROM {points_sql('nation', 'n_nationkey')} l, {points_sql('nation', 'n_nationkey')} r WHERE l.id < r.id ORDER BY {LR} DESC, a, b LIMIT 1")
def farthest_pair(s, d):
    n = points(table(s, d, "nation"), "n_nationkey")
    a, b = n.select(F.col("id").alias("a"), F.col("lon").alias("x1"), F.col("lat").alias("y1")), n.select(F.col("id").alias("b"), F.col("lon").alias("x2"), F.col("lat").alias("y2"))
    out = a.join(b, F.col("a") < F.col("b")).withColumn("d", haversine_km(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))
    return out.orderBy(F.desc("d"), "a", "b").limit(1).select("a", "b", r6("d").alias("km"))


def _nearest_sql(name: str, where: str) -> str:
    return f"(SELECT l.id, min({LR}) AS {name} FROM {CUSTOMERS} l, {points_sql('supplier', 's_suppkey', where=where)} r GROUP BY l.id)"


@query(
    f"SELECT round(avg(d0), 6) AS avg_low, round(stddev_samp(d0), 6) AS sd_low, round(avg(d1), 6) AS avg_mid, round(stddev_samp(d1), 6) AS sd_mid, round(avg(d2), 6) AS avg_high, round(stddev_samp(d2), 6) AS sd_high "
    f"FROM {_nearest_sql('d0', ' WHERE s_nationkey < 8')} JOIN {_nearest_sql('d1', ' WHERE s_nationkey >= 8 AND s_nationkey < 16')} USING (id) JOIN {_nearest_sql('d2', ' WHERE s_nationkey >= 16')} USING (id)"
)
def multi_nn_avg_sd(s, d):
    n = suppliers(s, d, "s_nationkey")
    sets = {"low": n.filter("s_nationkey < 8"), "mid": n.filter("s_nationkey >= 8 and s_nationkey < 16"), "high": n.filter("s_nationkey >= 16")}
    near = multi_nearest(customers(s, d), sets, left_id="id", right_id="id")
    return near.agg(*[r6(f(f"dist_{k}")).alias(f"{a}_{k}") for k in sets for a, f in (("avg", F.avg), ("sd", F.stddev_samp))])


@query(f"SELECT c_mktsegment, round(avg(km), 6) AS avg_dist_suppliers, count(*) AS n_suppliers FROM ({NN}) q JOIN customer ON c_custkey = q.id GROUP BY c_mktsegment")
def composed_search(s, d):
    """A JSON configuration run as one plan."""
    shards = {"customers": lambda: customers(s, d, "c_mktsegment"), "suppliers": lambda: suppliers(s, d)}
    config = {"keys": ["c_mktsegment"], "spatial_searches": [{"left": ["customers"], "right": [{"file": "suppliers"}], "spatial_search_config": {"algorithm": "s2", "numNearestNeighbors": 1}, "group_size": 10, "name_template": "%RIGHT%", "selectors": {"avg_dist_%NAME%": "round(avg(%DIST%), 6)", "n_%NAME%": "count(%DIST%)"}}]}
    return QueryConfig.load(config).to_dataframe(shards)


BOXES = "(SELECT r_regionkey AS area, 6 + r_regionkey * 1.8 AS x0, 6 + r_regionkey * 1.8 + 1.5 AS x1, 48.0 AS y0, 54.0 AS y1 FROM region)"


@query(f"SELECT area, count(*) AS n FROM {BOXES} JOIN {CUSTOMERS} ON lon > x0 AND lon < x1 AND lat > y0 AND lat < y1 GROUP BY area")
def contains_points(s, d):
    k = F.col("r_regionkey")
    x0, x1 = 6 + k * F.lit(1.8), 6 + k * F.lit(1.8) + F.lit(1.5)
    p = lambda x, y: F.struct(x.alias("lon"), F.lit(y).alias("lat"))
    boxes = table(s, d, "region").select(k.alias("polygon_id"), F.array(F.array(p(x0, 48.0), p(x1, 48.0), p(x1, 54.0), p(x0, 54.0), p(x0, 48.0))).alias("rings"))
    found = containment.related(boxes, customers(s, d).withColumnRenamed("id", "point_id"))
    pairs = containment.with_relation(containment.relation_table(found), "contains")
    return pairs.groupBy(F.col("left_id").alias("area")).agg(F.count("*").alias("n"))


@query(f"SELECT c_mktsegment, round(avg(coalesce(t, 0)), 6) AS avg_trips, count(*) AS n FROM customer LEFT JOIN (SELECT l.id, sum(r.w) AS t FROM {CUSTOMERS} l, {points_sql('supplier', 's_suppkey', ', s_nationkey AS w')} r WHERE {LR} <= 15 GROUP BY l.id) q ON q.id = c_custkey GROUP BY c_mktsegment")
def reach_default_zero(s, d):
    """Sum over partners within reach, zero where there is none, then the mean per group."""
    reach = spatial_join(customers(s, d), suppliers(s, d, "s_nationkey"), max_distance_m=15_000, left_id="id", right_id="id", payload=["s_nationkey"])
    t = reach.groupBy(F.col("left_id").alias("c_custkey")).agg(F.sum("s_nationkey").alias("t"))
    own = relational.optional(table(s, d, "customer").select("c_custkey", "c_mktsegment"), t)
    return own.groupBy("c_mktsegment").agg(r6(F.avg(F.coalesce("t", F.lit(0)))).alias("avg_trips"), F.count("*").alias("n"))


# --- scalar functions ---


@query(f"SELECT c_custkey, round(6 + ((c_custkey * 104729) % 10009) / 10009e0 * 9, 6) AS lon, round(47 + ((c_custkey * 7919) % 10007) / 10007e0 * 8, 6) AS lat FROM customer")
def wkt_round_trip(s, d):
    w = customers(s, d).withColumn("w", wkt_point(F.col("lon"), F.col("lat")))
    return w.select(F.col("id").alias("c_custkey"), r6(wkt_lon(F.col("w"))).alias("lon"), r6(wkt_lat(F.col("w"))).alias("lat"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(p_type, 'STEEL|TIN', 'METAL', 'g'), 'PROMO', 'SALE', 'g') AS kind, regexp_matches(p_type, '^STANDARD|BRASS$') AS plain, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS size_class FROM part")
def regex_replace_if(s, d):
    t = F.col("p_type")
    return table(s, d, "part").select("p_partkey", F.regexp_replace(F.regexp_replace(t, "STEEL|TIN", "METAL"), "PROMO", "SALE").alias("kind"), t.rlike("^STANDARD|BRASS$").alias("plain"), F.when(F.col("p_size") > 25, "big").otherwise("small").alias("size_class"))


@query("SELECT c_custkey, CASE WHEN strpos(c_name, '#') > 0 THEN substr(c_name, strpos(c_name, '#') + 1) ELSE '' END AS number, concat(c_mktsegment, '-', c_nationkey) AS code, starts_with(c_mktsegment, 'B') AS b FROM customer")
def string_functions(s, d):
    return table(s, d, "customer").select("c_custkey", after(F.col("c_name"), "#").alias("number"), F.concat("c_mktsegment", F.lit("-"), F.col("c_nationkey").cast("string")).alias("code"), F.col("c_mktsegment").startswith("B").alias("b"))


@query("SELECT o_orderkey, round(ln(o_totalprice), 6) AS log_price, round(pow(o_totalprice / 1000, 2), 6) AS squared, TRY_CAST(regexp_extract(o_orderpriority, '^([0-9]+)', 1) AS INTEGER) AS priority, o_totalprice <= 100000 AS cheap FROM orders WHERE o_totalprice > 0")
def math_and_casts(s, d):
    p = F.col("o_totalprice")
    return table(s, d, "orders").filter(p > 0).select("o_orderkey", r6(F.ln(p)).alias("log_price"), r6(F.pow(p / 1000, 2)).alias("squared"), F.regexp_extract("o_orderpriority", "^([0-9]+)", 1).try_cast("int").alias("priority"), (p <= 100000).alias("cheap"))


LITERALS = "CASE c_custkey % 8 WHEN 0 THEN CAST(c_custkey AS VARCHAR) WHEN 1 THEN '-' || c_nationkey || '.50' WHEN 2 THEN '01.02.2024' WHEN 3 THEN '2024/02/01' WHEN 4 THEN '2024-02-01T10:00:00Z' WHEN 5 THEN 'POINT(7.5 48)' WHEN 6 THEN ' 5' ELSE c_mktsegment END"


@query(
    f"SELECT c_custkey, CASE WHEN regexp_matches(t, '^-?[0-9]+$') THEN 'xsd:integer' WHEN regexp_matches(t, '^-?[0-9]+([.][0-9]+)?$') THEN 'xsd:decimal' WHEN regexp_matches(t, '^[0-9]{{2}}[.][0-9]{{2}}[.][0-9]{{4}}$') OR regexp_matches(t, '^[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}}$') THEN 'xsd:date' WHEN t LIKE '____-__-__T%Z' THEN 'xsd:dateTime' WHEN t LIKE 'POINT(%' THEN 'geo:wktLiteral' END AS kind, "
    f"trim(regexp_replace(t, '^([0-9]{{2}})[.]([0-9]{{2}})[.]([0-9]{{4}})$', '\\3/\\2/\\1')) AS value FROM (SELECT c_custkey, {LITERALS} AS t FROM customer)"
)
def literal_typing(s, d):
    t = F.expr(LITERALS.replace("VARCHAR", "STRING"))
    return table(s, d, "customer").select("c_custkey", t.alias("t")).select("c_custkey", literal_type(F.col("t")).alias("kind"), literal_value(F.col("t")).alias("value"))


@query("SELECT c_custkey, regexp_replace(regexp_replace(c_name || ' ' || c_mktsegment, '#', '0x000023', 'g'), ' ', '0x000020', 'g') AS name FROM customer")
def local_names(s, d):
    return table(s, d, "customer").select("c_custkey", local_name(F.concat("c_name", F.lit(" "), "c_mktsegment")).alias("name"))


# --- relational algebra ---


@query("SELECT p_brand AS label, count(*) AS n, 'part' AS source FROM part GROUP BY p_brand UNION ALL SELECT o_orderstatus, count(*), 'orders' FROM orders GROUP BY o_orderstatus UNION ALL SELECT NULL, count(*), 'nation' FROM nation")
def union_bag(s, d):
    part = table(s, d, "part").groupBy(F.col("p_brand").alias("label")).agg(F.count("*").alias("n")).withColumn("source", F.lit("part"))
    orders = table(s, d, "orders").groupBy(F.col("o_orderstatus").alias("label")).agg(F.count("*").alias("n")).withColumn("source", F.lit("orders"))
    nation = table(s, d, "nation").agg(F.count("*").alias("n")).withColumn("source", F.lit("nation"))
    return relational.union(part, orders, nation)


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(s, d):
    return table(s, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(s, d, "supplier").select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect_distinct(s, d):
    return table(s, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(s, d, "supplier").select("s_nationkey"))


@query("SELECT p_type AS label, count(p_partkey) AS n FROM part WHERE p_size <= 30 GROUP BY p_type ORDER BY n DESC, label LIMIT 10")
def top_values(s, d):
    return table(s, d, "part").filter("p_size <= 30").groupBy(F.col("p_type").alias("label")).agg(F.count("p_partkey").alias("n")).orderBy(F.desc("n"), "label").limit(10)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
def minus_keeps_duplicates(s, d):
    gone = table(s, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return relational.minus(table(s, d, "orders").select("o_orderkey", "o_custkey"), gone)


@query("SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def except_distinct(s, d):
    return relational.except_distinct(table(s, d, "orders").select("o_custkey"), table(s, d, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def semi_join(s, d):
    own = table(s, d, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("k"))
    return relational.exists(own, table(s, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("k"))).drop("k")


@query("SELECT c_custkey, coalesce(n, 0) AS n_orders, n IS NOT NULL AS bound FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def optional_default(s, d):
    n = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    out = relational.optional(table(s, d, "customer").select("c_custkey"), n)
    return out.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.col("n").isNotNull().alias("bound"))


@query("WITH l AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_regionkey END AS k FROM nation), r AS (SELECT r_regionkey AS k, r_name AS name FROM region) SELECT l.id, coalesce(l.k, r.k) AS k, r.name FROM l LEFT JOIN r ON l.k IS NULL OR r.k IS NULL OR l.k = r.k")
def optional_unbound(s, d):
    left = table(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_regionkey")).alias("k"))
    return relational.optional(left, table(s, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")), maybe_unbound=True)


@query("SELECT p, count(*) AS n FROM (SELECT 'p_size' AS p, CAST(p_size AS VARCHAR) AS o FROM part UNION ALL SELECT 'p_brand', p_brand FROM part) WHERE o IN ('1', '2', '3', 'Brand#11', 'Brand#12') GROUP BY p")
def values_variable_predicate(s, d):
    part = table(s, d, "part").select("p_partkey", F.col("p_size").cast("string").alias("p_size"), "p_brand")
    return relational.any_predicate(part, "p_partkey", ["p_size", "p_brand"], ["1", "2", "3", "Brand#11", "Brand#12"]).groupBy("p").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM part WHERE CAST(p_size AS VARCHAR) IN ('1', '2', '3', 'Brand#11', 'Brand#12') OR p_brand IN ('1', '2', '3', 'Brand#11', 'Brand#12')")
def values_or_columns(s, d):
    part = table(s, d, "part").select(F.col("p_size").cast("string").alias("p_size"), "p_brand")
    return part.filter(relational.any_of(["p_size", "p_brand"], ["1", "2", "3", "Brand#11", "Brand#12"])).agg(F.count("*").alias("n"))


@query("SELECT n_name, v.note FROM nation JOIN (VALUES ('0', 'first'), ('1', 'second'), ('1', 'again')) v(k, note) ON CAST(n_regionkey AS VARCHAR) = v.k")
def values_inline(s, d):
    inline = relational.values(s, ["k", "note"], [("0", "first"), ("1", "second"), ("1", "again")])
    return relational.natural(table(s, d, "nation").select("n_name", F.col("n_regionkey").cast("string").alias("k")), inline).drop("k")


@query("SELECT r_name, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
def path_sequence(s, d):
    edge = lambda t, a, b: table(s, d, t).select(F.col(a).cast("string").alias("s"), F.col(b).cast("string").alias("o"))
    ends = relational.path(edge("orders", "o_orderkey", "o_custkey"), edge("customer", "c_custkey", "c_nationkey"), edge("nation", "n_nationkey", "n_regionkey"), edge("region", "r_regionkey", "r_name"))
    return ends.groupBy(F.col("o").alias("r_name")).agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, n_name, (SELECT count(*) FROM nation) AS n_nations FROM nation")
def table_size_bind(s, d):
    return relational.with_table_count(table(s, d, "nation").select("n_nationkey", "n_name"), "n_nations")


@query("SELECT count(*) AS n, count(DISTINCT a) AS d FROM (SELECT a.n_nationkey AS a, b.r_regionkey AS b FROM nation a CROSS JOIN region b)")
def cross_product(s, d):
    return table(s, d, "nation").select(F.col("n_nationkey").alias("a")).crossJoin(table(s, d, "region").select("r_regionkey")).agg(F.count("*").alias("n"), F.countDistinct("a").alias("d"))


@query("SELECT coalesce(c_nationkey, s_nationkey) AS k, n, avg_bal, s FROM (SELECT c_nationkey, count(*) AS n, round(avg(c_acctbal), 6) AS avg_bal FROM customer WHERE c_nationkey < 15 GROUP BY 1) FULL JOIN (SELECT s_nationkey, round(sum(s_acctbal), 4) AS s FROM supplier WHERE s_nationkey >= 10 GROUP BY 1) ON c_nationkey = s_nationkey")
def full_merge(s, d):
    """Keys of either side only stay."""
    a = table(s, d, "customer").filter("c_nationkey < 15").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"), r6(F.avg("c_acctbal")).alias("avg_bal"))
    b = table(s, d, "supplier").filter("s_nationkey >= 10").groupBy(F.col("s_nationkey").alias("k")).agg(F.round(F.sum("s_acctbal"), 4).alias("s"))
    return stats.full_merge(a, b, ["k"])


# --- triples ---


def nation_triples(s: SparkSession, d: str) -> DataFrame:
    iri = lambda stem, c: F.concat(F.lit(stem), F.col(c).cast("string"))
    nation = table(s, d, "nation").withColumn("in", iri("ex:region_", "n_regionkey"))
    region = table(s, d, "region")
    return triples.unpivoted(nation, iri("ex:nation_", "n_nationkey"), {"n_name": "rdfs:label", "in": "ex:in"}, "ex:Nation").union(triples.unpivoted(region, iri("ex:region_", "r_regionkey"), {"r_name": "rdfs:label"}, "ex:Region"))


@query("SELECT 'ex:nation_' || n_nationkey AS s, 'rdf:type' AS p, 'ex:Nation' AS o FROM nation UNION ALL SELECT 'ex:nation_' || n_nationkey, 'rdfs:label', n_name FROM nation UNION ALL SELECT 'ex:nation_' || n_nationkey, 'ex:in', 'ex:region_' || n_regionkey FROM nation UNION ALL SELECT 'ex:region_' || r_regionkey, 'rdf:type', 'ex:Region' FROM region UNION ALL SELECT 'ex:region_' || r_regionkey, 'rdfs:label', r_name FROM region")
def unpivot_triples(s, d):
    return nation_triples(s, d)


@query("SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name LIKE 'A%'")
def triple_bgp_join(s, d):
    found = triples.bgp(nation_triples(s, d), [("?n", "a", "ex:Nation"), ("?n", "rdfs:label", "?nation"), ("?n", "ex:in", "?r"), ("?r", "rdfs:label", "?region")])
    return found.filter(F.col("region").startswith("A")).select("nation", "region")


@query("SELECT p, count(*) AS n FROM (SELECT 'rdfs:label' AS p FROM nation UNION ALL SELECT 'ex:in' FROM nation UNION ALL SELECT 'rdf:type' FROM nation) GROUP BY p")
def triple_variable_predicate(s, d):
    t = nation_triples(s, d)
    return relational.natural(triples.pattern(t, "?n", "a", "ex:Nation"), triples.pattern(t, "?n", "?p", "[]")).groupBy("p").agg(F.count("*").alias("n"))


@query("SELECT user_id AS shape_id, 'LINESTRING(' || string_agg(event_type || ' ' || event_id, ', ' ORDER BY event_id) || ')' AS wkt FROM events GROUP BY user_id")
def line_assembly(s, d):
    """Points of a shape as a line, in order of their number."""
    e = table(s, d, "events")
    return gtfs.shape_lines(e.select(F.col("user_id").alias("shape_id"), F.col("event_id").cast("string").alias("shape_pt_sequence"), F.col("event_type").alias("shape_pt_lon"), F.col("event_id").cast("string").alias("shape_pt_lat")))


# --- aggregation and statistics ---

VOTES = "(SELECT s_nationkey AS area, l_returnflag AS party, sum(l_quantity) / 100000 AS votes, min(length(l_returnflag || l_linestatus) + ascii(l_returnflag) - 70) AS rile FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)"


@query(f"WITH v AS {VOTES}, m AS (SELECT area, sum(votes * rile) AS pasysav FROM v GROUP BY area) SELECT v.area, round(min(pasysav), 6) AS pasysav, round(sum(votes * pow(rile - pasysav, 2)), 6) AS polarization, round(1 - sum(votes), 6) AS other_votes FROM v JOIN m USING (area) GROUP BY v.area")
def polarization(s, d):
    rile = F.length(F.concat("l_returnflag", "l_linestatus")) + F.ascii("l_returnflag") - 70
    joined = table(s, d, "lineitem").join(table(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    votes = joined.groupBy(F.col("s_nationkey").alias("area_no"), F.col("l_returnflag").alias("party")).agg((F.sum("l_quantity") / 100000).alias("votes"), F.min(rile).alias("rile"))
    votes = votes.withColumns({"election": F.lit("e"), "area_name": F.lit("a"), "body": F.lit("BT")})
    return polarisation(votes).select(F.col("area_no").alias("area"), *[r6(c).alias(c) for c in ("pasysav", "polarization", "other_votes")])


@query("SELECT o_orderpriority AS k, count(*) AS n, min(o_totalprice) AS lo, round(sum(o_totalprice) / 100, 4) AS total, round(avg(o_totalprice), 6) AS mean, round(stddev_samp(o_totalprice), 6) AS sd, round(count(*) / 7, 6) AS weekly FROM orders GROUP BY 1")
def grouped_aggregates(s, d):
    p = F.col("o_totalprice")
    return table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(F.count("*").alias("n"), F.min(p).alias("lo"), F.round(F.sum(p) / 100, 4).alias("total"), r6(F.avg(p)).alias("mean"), r6(F.stddev_samp(p)).alias("sd"), r6(F.count("*") / 7).alias("weekly"))


@query("SELECT round(avg(n), 6) AS avg_orders FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def nested_aggregates(s, d):
    return table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).agg(r6(F.avg("n")).alias("avg_orders"))


RANKED = "SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL"


def _quantile_sql(p: float, name: str) -> str:
    j = f"greatest(1, least(floor({p} * (n + 1)), n - 1))"
    return f"max(CASE WHEN r = {j} THEN value END) + (max(CASE WHEN r = least({j} + 1, n) THEN value END) - max(CASE WHEN r = {j} THEN value END)) * max({p} * (n + 1) - {j}) AS {name}"


@query(f"SELECT event_type, n, round(lo, 6) AS min, round(hi, 6) AS max, round(mean, 6) AS mean, round(sd, 6) AS stdev, round(q1, 6) AS q1, round(q2, 6) AS median, round(q3, 6) AS q3 FROM (SELECT event_type, count(value) AS n, min(value) AS lo, max(value) AS hi, avg(value) AS mean, stddev_samp(value) AS sd FROM events GROUP BY 1) JOIN (SELECT event_type, {_quantile_sql(0.25, 'q1')}, {_quantile_sql(0.5, 'q2')}, {_quantile_sql(0.75, 'q3')} FROM ({RANKED}) GROUP BY 1) USING (event_type)")
def time_stats(s, d):
    out = stats.time_summary(table(s, d, "events"), "value", ["event_type"])
    return out.select("event_type", "n", *[r6(c).alias(c) for c in ("min", "max", "mean", "stdev", "q1", "median", "q3")])


@query("SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS r, round(pow(corr(l_quantity, l_extendedprice), 2), 6) AS r2 FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6), round(pow(corr(l_quantity, l_discount), 2), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6), round(pow(corr(l_extendedprice, l_discount), 2), 6) FROM lineitem")
def correlation(s, d):
    return stats.correlations(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).select("a", "b", r6("r").alias("r"), r6("r2").alias("r2"))


@query("SELECT s_suppkey, round((s_acctbal - lo) / (hi - lo), 6) AS s_acctbal_norm FROM supplier, (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier)")
def min_max_norm(s, d):
    return stats.min_max(table(s, d, "supplier").select("s_suppkey", "s_acctbal"), ["s_acctbal"]).select("s_suppkey", r6("s_acctbal_norm").alias("s_acctbal_norm"))


OLS = "(SELECT count(*) AS n, regr_r2(l_extendedprice, l_quantity) AS r2, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy, sum(l_quantity * l_quantity) AS q FROM lineitem)"
OLS_FIT = "round(r2, 6) AS r2, round(1 - (1 - r2) * (n - 1) / (n - 2), 6) AS r2_adjusted, round(r2 / (1 - r2) * (n - 2), 2) AS f"


@query(f"SELECT 'l_quantity' AS term, round(b, 4) AS estimate, round(sqrt((1 - r2) * syy / (n - 2) / sxx), 4) AS std_error, {OLS_FIT} FROM {OLS} UNION ALL SELECT '(intercept)', round(a, 4), round(sqrt((1 - r2) * syy / (n - 2) / sxx * q / n), 4), {OLS_FIT} FROM {OLS}")
def linear_model(s, d):
    m = stats.linear_model(table(s, d, "lineitem"), "l_extendedprice", ["l_quantity"])
    fit = [round(float(m[k]), n) for k, n in (("r2", 6), ("r2_adjusted", 6), ("f", 2))]
    return s.createDataFrame([(k, round(float(v["estimate"]), 4), round(float(v["std_error"]), 4), *fit) for k, v in m["terms"].items()], "term string, estimate double, std_error double, r2 double, r2_adjusted double, f double")


@query("SELECT c_custkey, regexp_replace(regexp_replace(c_mktsegment, '^(BUILDING|MACHINERY)$', '\\1-$1'), 'HOUSE(HOLD)', '\\1ER') AS party FROM customer")
def value_mapping(s, d):
    """Python-dialect rules one after the other; a dollar sign is literal."""
    rules = [("^(?P<what>BUILDING|MACHINERY)$", r"\g<what>-$1"), ("HOUSE(HOLD)", r"\1ER")]
    return table(s, d, "customer").select("c_custkey", substituted(F.col("c_mktsegment"), rules).alias("party"))


PARTY = "CASE n_nationkey % 4 WHEN 0 THEN 'CDU' WHEN 1 THEN 'CSU' WHEN 2 THEN 'DIE LINKE' ELSE 'BÜNDNIS GRÜNE' END"


@query(f"SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'CDU/CSU' WHEN 1 THEN 'CDU/CSU' WHEN 2 THEN 'LINKE' ELSE 'BÜNDNIS 90/Greens' END AS party, row_number() OVER (PARTITION BY n_regionkey ORDER BY {PARTY} DESC, n_nationkey) AS pos FROM nation")
def party_names(s, d):
    name = F.expr(PARTY)
    pos = F.row_number().over(Window.partitionBy("n_regionkey").orderBy(name.desc(), "n_nationkey"))
    return table(s, d, "nation").select("n_nationkey", manifesto_name(name).alias("party"), pos.alias("pos"))


@query("SELECT source, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source")
def source_sizes(s, d):
    return table(s, d, "documents").groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("chars"))


# --- chains, polygons, the case study, streams ---

def _near_part(k: int) -> str:
    return f"(SELECT l.id, min({LR}) AS km FROM {CUSTOMERS} l, {points_sql('part', 'p_partkey', where=f' WHERE p_partkey % 13 = {k}')} r GROUP BY l.id)"


THIRTEEN = " UNION ALL ".join(f"SELECT {k} AS k, round(avg(km), 6) AS avg_km, round(stddev_samp(km), 6) AS sd_km FROM {_near_part(k)}" for k in range(13))


@query(THIRTEEN)
def multi_nn_13_sets(s, d):
    """Thirteen sets in groups of five, stored between."""
    n = points(table(s, d, "part"), "p_partkey")
    near = multi_nearest(customers(s, d), {f"s{k}": n.filter(F.col("id") % 13 == k) for k in range(13)}, left_id="id", right_id="id", group_size=5)
    row = near.agg(*[f(f"dist_s{k}").alias(f"{a}_{k}") for k in range(13) for a, f in (("avg", F.avg), ("sd", F.stddev_samp))])
    rows = F.array(*[F.struct(F.lit(k).alias("k"), r6(F.col(f"avg_{k}")).alias("avg_km"), r6(F.col(f"sd_{k}")).alias("sd_km")) for k in range(13)])
    return row.select(F.explode(rows).alias("x")).select("x.*")


@query(f"SELECT c_mktsegment, round(avg(a), 6) AS avg_low, round(avg(b), 6) AS avg_high, round(avg(c), 6) AS avg_all FROM customer JOIN {_nearest_sql('a', ' WHERE s_nationkey < 12')} x ON x.id = c_custkey JOIN {_nearest_sql('b', ' WHERE s_nationkey >= 12')} y ON y.id = c_custkey JOIN {_nearest_sql('c', '')} z ON z.id = c_custkey GROUP BY c_mktsegment")
def composed_groups(s, d):
    """A configuration whose right shards are split into groups."""
    n = suppliers(s, d, "s_nationkey")
    shards = {"customers": lambda: customers(s, d, "c_mktsegment"), "low": lambda: n.filter("s_nationkey < 12"), "high": lambda: n.filter("s_nationkey >= 12"), "all": lambda: n}
    search = {"left": ["customers"], "right": [{"file": x} for x in ("low", "high", "all")], "spatial_search_config": {"algorithm": "s2", "numNearestNeighbors": 1}, "group_size": 2, "name_template": "%RIGHT%", "selectors": {"avg_%NAME%": "round(avg(%DIST%), 6)"}}
    return QueryConfig.load({"keys": ["c_mktsegment"], "spatial_searches": [search]}).to_dataframe(shards)


#: An L with a hole, and points on whole degrees, many of them on edges and corners.
SHELL, HOLE = ((0, 0), (10, 0), (10, 10), (5, 10), (5, 5), (0, 5), (0, 0)), ((6, 1), (8, 1), (8, 3), (6, 3), (6, 1))
EDGE = "(y = 0 AND x BETWEEN 0 AND 10) OR (x = 10 AND y BETWEEN 0 AND 10) OR (y = 10 AND x BETWEEN 5 AND 10) OR (x = 5 AND y BETWEEN 5 AND 10) OR (y = 5 AND x BETWEEN 0 AND 5) OR (x = 0 AND y BETWEEN 0 AND 5) OR (y IN (1, 3) AND x BETWEEN 6 AND 8) OR (x IN (6, 8) AND y BETWEEN 1 AND 3)"
INSIDE = "((x > 0 AND x < 10 AND y > 0 AND y < 5) OR (x > 5 AND x < 10 AND y >= 5 AND y < 10)) AND NOT (x BETWEEN 6 AND 8 AND y BETWEEN 1 AND 3)"
LATTICE = "(SELECT c_custkey AS id, r_regionkey AS area, c_custkey % 13 - 1 AS x, c_custkey // 13 % 13 - 1 AS y FROM customer, region)"


@query(f"SELECT area AS left_id, CAST(relation AS SMALLINT) AS relation, id AS right_id FROM (SELECT *, unnest(CASE WHEN edge THEN [1, 3, 4] WHEN inside THEN [1, 2, 3] ELSE [] END) AS relation FROM (SELECT *, ({EDGE}) AS edge, ({INSIDE}) AS inside FROM {LATTICE}))")
def polygon_relations(s, d):
    """Concave polygons with holes and points in them, on their edges, in the holes and outside, as a relation table."""
    k = F.col("r_regionkey")
    ring = lambda pts: F.array(*[F.struct((x + 20 * k).cast("double").alias("lon"), F.lit(float(y)).alias("lat")) for x, y in ((F.lit(a), b) for a, b in pts)])
    areas = table(s, d, "region").select(k.alias("polygon_id"), F.array(ring(SHELL), ring(HOLE)).alias("rings"))
    c = F.col("c_custkey")
    every = table(s, d, "customer").crossJoin(F.broadcast(table(s, d, "region")))  # five regions
    pts = every.select(c.alias("point_id"), k.alias("own"), (c % 13 - 1 + 20 * k).cast("double").alias("lon"), (F.floor(c / 13) % 13 - 1).cast("double").alias("lat"))
    found = containment.related(areas, pts.withColumn("point_id", F.struct("point_id", "own")))
    return containment.relation_table(found).select("left_id", "relation", F.col("right_id.point_id").alias("right_id"))


PARTIES = (("CDU", "CDU/CSU", -8.5), ("DIE LINKE", "LINKE", 30.25), ("GRÜNE", "90/Greens", 12.0), ("SPD", "SPD", 3.5), ("XYZ", None, None))
STUDY_VOTES = " UNION ALL ".join(f"SELECT n_nationkey AS area_no, n_name AS area_name, ((n_nationkey * 7 + {i} * 13) % 30 + 5) / 1e2 AS votes, {r}e0 AS rile FROM nation" for i, (_, m, r) in enumerate(PARTIES) if m)
STATE = "CASE n_regionkey WHEN 0 THEN 'Sachsen-Anhalt' WHEN 1 THEN 'Bayern' WHEN 2 THEN 'Mecklenburg-Vorpommern' WHEN 3 THEN 'Hessen' ELSE 'Brandenburg' END"
STUDY = f"""
WITH v AS ({STUDY_VOTES}), m AS (SELECT area_no, min(area_name) AS area_name, sum(votes * rile) AS pasysav, 1 - sum(votes) AS other_votes FROM v GROUP BY 1),
p AS (SELECT area_no, sum(votes * pow(rile - pasysav, 2)) AS polarization FROM v JOIN m USING (area_no) GROUP BY 1),
i AS (SELECT c_nationkey AS area_no, count(*) AS n, avg(a) AS al, stddev_samp(a) AS sl, avg(b) AS ah FROM customer JOIN {_nearest_sql('a', ' WHERE s_nationkey < 8')} x ON x.id = c_custkey JOIN {_nearest_sql('b', ' WHERE s_nationkey >= 8')} y ON y.id = c_custkey GROUP BY 1),
t AS (SELECT c_nationkey AS area_no, avg(coalesce(w, 0)) AS trips FROM customer LEFT JOIN (SELECT l.id, sum(r.w) AS w FROM {CUSTOMERS} l, {points_sql('supplier', 's_suppkey', ', s_nationkey AS w')} r WHERE {LR} <= 15 GROUP BY l.id) q ON q.id = c_custkey GROUP BY 1)
SELECT 'E' AS election_name, area_no, area_name, round(pasysav, 6) AS pasysav, round(polarization, 3) AS polarization, round(other_votes, 6) AS other_votes, round(ln(n_nationkey * 10 + 1), 6) AS log_pop_density, n_nationkey + 9.5e0 AS age_over60, n_regionkey NOT IN (1, 3) AS east, n AS count_buildings, round(al, 6) AS avg_dist_low, round(sl, 6) AS sd_dist_low, round(ah, 6) AS avg_dist_high, round(trips, 6) AS avg_trips
FROM m JOIN p USING (area_no) JOIN nation ON n_nationkey = area_no LEFT JOIN i USING (area_no) LEFT JOIN t USING (area_no)
"""


@query(STUDY)
def case_study(s, d):
    """Polarisation of districts with their structure, distances of buildings and trips within reach."""
    from .plans import casestudy

    k = F.col("n_nationkey")
    rows = [F.struct(F.lit(p).alias("candidate_name"), ((k * 7 + i * 13) % 30 + 5).cast("double").alias("votes_percent")) for i, (p, _, _) in enumerate(PARTIES)]
    results = table(s, d, "nation").select(F.lit("e").alias("election"), k.alias("area_no"), F.col("n_name").alias("area_name"), F.lit("BT").alias("body"), F.lit("Partei").alias("candidate_type"), F.lit("Wahlkreis").alias("area_type"), F.explode(F.array(F.lit(1), F.lit(2))).alias("vote_type"), F.array(*rows).alias("r"))
    results = results.select("*", F.explode("r").alias("x")).select("*", "x.*").drop("r", "x")
    elections = s.createDataFrame([("e", "2021/09/26", "Land", "E")], "election string, date string, countryname string, label string")
    manifesto = s.createDataFrame([("e", "2021/09/26", "Land", m, float(r)) for _, m, r in PARTIES if m], "election string, edate string, countryname string, partyabbrev string, rile double")
    structural = table(s, d, "nation").select(F.lit("e").alias("election"), k.alias("area_no"), F.expr(STATE).alias("state"), (k * 10.0 + 1).alias("pop_density"), (k + 4.5).alias("age_60_74"), F.lit(5.0).alias("age_over74"))
    buildings = customers(s, d, F.lit("e").alias("election"), F.col("c_nationkey").alias("area_no"))
    n = suppliers(s, d, F.col("s_nationkey").alias("n_trips"))
    infra = casestudy.infrastructure(buildings, {"low": n.filter("n_trips < 8"), "high": n.filter("n_trips >= 8")}, right_id="id")
    out = casestudy.case_study(results, elections, manifesto, structural, infra, casestudy.transit(buildings, n, 15_000))
    rounded = ("pasysav", "other_votes", "log_pop_density", "avg_dist_low", "sd_dist_low", "avg_dist_high", "avg_trips")
    return out.select("election_name", "area_no", "area_name", "east", "age_over60", "count_buildings", F.round("polarization", 3).alias("polarization"), *[r6(c).alias(c) for c in rounded])


@query(f"SELECT id, name, lon, lat FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY place) AS r FROM (SELECT s_suppkey AS id, s_name AS name, 1 AS place, 0.5 AS lon, 1.5 AS lat FROM supplier UNION ALL SELECT c_custkey, c_name, 2, 2.5, 3.5 FROM customer)) WHERE r = 1")
def points_merged_by_id(s, d):
    """Points of two exports; an id that is there already is not inserted again."""
    from .sources import osm

    folder = new_folder(s, "osm")
    of = lambda t, k, n, x, y: osm.write_points(table(s, d, t).select(F.col(k).alias("osm_id"), F.col(n).alias("name"), F.lit(x).alias("lon"), F.lit(y).alias("lat")), f"{folder}/{t}") or osm.read_points(s, f"{folder}/{t}")
    merged = osm.merged_by_id(of("supplier", "s_suppkey", "s_name", 0.5, 1.5), of("customer", "c_custkey", "c_name", 2.5, 3.5))
    return merged.select(F.col("osm_id").alias("id"), "name", "lon", "lat")


@query(PAIRS)
def stream_near_static(s, d):
    """A stream of points against a static set."""
    from .streaming import near_static

    folder = new_folder(s, "stream")
    customers(s, d).repartition(4).write.parquet(f"{folder}/in")
    stream = s.readStream.schema("id long, lon double, lat double").option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    pairs = near_static(stream, suppliers(s, d), 20_000).select("left_id", "right_id", "dist_km")
    sink = pairs.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
    sink.awaitTermination()
    return s.read.schema(pairs.schema).parquet(f"{folder}/out").agg(F.count("*").alias("n"), F.round(F.sum("dist_km"), 3).alias("total_km"))


# --- centroids, flags, provided values, evaluation ---

K1 = "(n_nationkey + 1e0)"


@query(
    f"SELECT n_nationkey, round(CASE n_nationkey % 3 WHEN 0 THEN ({K1} * {K1} / 2 + 2 * {K1}) / ({K1} + 2) WHEN 1 THEN (16 * 2e0 - 1.5 + {K1} * {K1} * (10 + {K1} / 2)) / (15 + {K1} * {K1}) ELSE ({K1} + 4) / 2 END, 6) AS lon, "
    f"round(CASE n_nationkey % 3 WHEN 0 THEN 2 / ({K1} + 2) WHEN 1 THEN (16 * 2e0 - 1.5 + {K1} * {K1} * {K1} / 2) / (15 + {K1} * {K1}) ELSE 1.5 END, 6) AS lat FROM nation"
)
def geometry_centroids(s, d):
    """Lines by length, polygons by area without holes, points by number."""
    k = F.col("n_nationkey") + F.lit(1.0)
    p = lambda x, y: F.struct((x if isinstance(x, Column) else F.lit(float(x))).alias("lon"), (y if isinstance(y, Column) else F.lit(float(y))).alias("lat"))
    ring = lambda *at: F.array(*[p(*x) for x in (*at, at[0])])
    kind = F.col("n_nationkey") % 3
    line = F.array(F.array(p(0, 0), p(k, 0), p(k, 2)))
    areas = F.array(F.array(ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((1, 1), (2, 1), (2, 2), (1, 2))), F.array(ring((10, 0), (10 + k, 0), (10 + k, k), (10, k))))
    both = F.array(p(k, 1), p(4, 2))
    pick = lambda i, x: F.when(kind == i, x).otherwise(F.slice(x, 1, 0))
    c = geometry_centroid(pick(2, both), pick(0, line), pick(1, areas))
    return table(s, d, "nation").select("n_nationkey", r6(c["lon"]).alias("lon"), r6(c["lat"]).alias("lat"))


@query("SELECT CAST(n_nationkey % 4 AS VARCHAR) AS code, count_if(n_nationkey % 4 = 1) AS yes, count_if(n_nationkey % 4 = 0) AS no, count_if(n_nationkey % 4 > 1) AS neither FROM nation GROUP BY 1")
def typed_flags(s, d):
    """Objects that are typed booleans, as a column of flags; others have none."""
    code = (F.col("n_nationkey") % 4).cast("string")
    o = F.when(code == "0", F.lit('"false"^^xsd:boolean')).when(code == "1", F.lit('"true"^^xsd:boolean')).when(code == "2", F.lit('"true"')).otherwise(F.lit("ex:true"))
    t = triples.typed(table(s, d, "nation").select(code.alias("s"), F.lit("ex:flag").alias("p"), o.alias("o")))
    return t.groupBy(F.col("s").alias("code")).agg(F.count_if(F.col("flag")).alias("yes"), F.count_if(~F.col("flag")).alias("no"), F.count_if(F.col("flag").isNull()).alias("neither"))


@query("SELECT c_mktsegment AS q1_segment_, count(*) AS n FROM customer JOIN (VALUES ('BUILDING'), ('MACHINERY'), ('MACHINERY'), ('NONE')) v(x) ON x = c_mktsegment GROUP BY 1")
def provided_values(s, d):
    """Values given from outside to a variable that is renamed for the query."""
    given = ProvidedValues("segment", ("BUILDING", "MACHINERY", "MACHINERY", "NONE"))
    own = given.applied(table(s, d, "customer").select(F.col("c_mktsegment").alias("segment")), "q1")
    return own.groupBy("q1_segment_").agg(F.count("*").alias("n"))


SIZES = "(SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'supplier', count(*) FROM supplier)"


@query(f'SELECT l.name AS "left", r.name AS "right", form, CAST(l.n * r.n AS BIGINT) AS pairs FROM {SIZES} l, {SIZES} r, (VALUES (\'grid\'), (\'bbox\'), (\'nested_loop\')) f(form) WHERE l.name <> r.name AND (form <> \'nested_loop\' OR l.n * r.n <= 5000)')
def task_matrix(s, d):
    """Which forms of a search run on which pairs of sets: those of all pairs only up to a product of sizes."""
    sizes = evaluation.set_sizes({t: table(s, d, t) for t in ("customer", "nation", "supplier")})
    return s.createDataFrame([(t.left, t.right, t.form, t.pairs) for t in evaluation.tasks(sizes, most_pairs=5000)], "left string, right string, form string, pairs long")


@query(f"SELECT 'f' || l.f AS feed, form, count(*) AS n FROM {points_sql('supplier', 's_suppkey', ', s_nationkey % 4 AS f')} l JOIN {points_sql('supplier', 's_suppkey', ', s_nationkey % 4 AS f')} r ON l.f = r.f, (VALUES ('grid'), ('bbox'), ('nested_loop')) v(form) WHERE {LR} <= 80 GROUP BY ALL")
def feed_matrix(s, d):
    """Stops within reach of stops, by feed, in three forms."""
    out = []
    n = suppliers(s, d, (F.col("s_nationkey") % 4).alias("f"))
    for k in range(4):
        own = n.filter(F.col("f") == k).drop("f")
        for form in evaluation.FORMS:
            pairs = spatial_join(own, own, max_distance_m=80_000, left_id="id", right_id="id", left_columns=(), strategy=form)
            out.append(pairs.agg(F.count("*").alias("n")).filter("n > 0").select(F.lit(f"f{k}").alias("feed"), F.lit(form).alias("form"), "n"))
    return reduce(DataFrame.union, out)


@query("SELECT * FROM (VALUES ('grid', false), ('bbox', false), ('nested_loop', true)) v(form, all_pairs)")
def captured_plans(s, d):
    """Which forms compare all pairs, read off their plans."""
    a, b = customers(s, d), suppliers(s, d)
    plans = {f: evaluation.plan_text(spatial_join(a, b, max_distance_m=20_000, left_id="id", right_id="id", strategy=f)) for f in evaluation.FORMS}
    return s.createDataFrame([(f, any(x in t for x in ("BroadcastNestedLoopJoin", "CartesianProduct"))) for f, t in plans.items()], "form string, all_pairs boolean")


@query("SELECT event_type, count(value) AS n, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def statistics_files(s, d):
    """Statistics written as CSV and JSON, both read back and merged."""
    path = f"{new_folder(s, 'stats')}/events"
    evaluation.write_stats(stats.time_summary(table(s, d, "events"), "value", ["event_type"]), path)
    from_csv = s.read.csv(f"{path}/csv", header=True, inferSchema=True).select("event_type", F.col("n").cast("long"), r6("min").alias("min"), r6("max").alias("max"))
    return from_csv.join(s.read.json(f"{path}/json").select("event_type", r6("mean").alias("mean")), "event_type")


@query(f"SELECT 'l_quantity' AS term, round(b, 4) AS estimate, round(r2, 6) AS r2 FROM {OLS} UNION ALL SELECT '(intercept)', round(a, 4), round(r2, 6) FROM {OLS}")
def model_file(s, d):
    path = f"{new_folder(s, 'model')}/model"
    evaluation.write_model(s, stats.linear_model(table(s, d, "lineitem"), "l_extendedprice", ["l_quantity"]), path)
    return s.read.csv(path, header=True, inferSchema=True).select("term", F.round("estimate", 4).alias("estimate"), r6("r2").alias("r2"))


def queries() -> dict[str, Query]:
    return dict(FOUND)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
