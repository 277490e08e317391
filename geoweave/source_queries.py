"""Registered queries of sources and sinks.

Each writes files made of the test tables' rows into the shared folder, reads them with a source, and gives rows or
triples; the SQL makes the same from the tables themselves. Subjects that are numbers of rows are shown as N.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .prefixes import Prefixes
from .queries import query, table
from .sources import gtfs, kml, sinks
from .sources.bundle import Bundle
from .sources.tables import TableSpec, read_table, table_triples
from .staging import new_folder


def text_file(spark: SparkSession, path: str, *parts: DataFrame | str) -> str:
    """One text file of lines: strings, and frames of one column."""
    out = None
    for x in parts:
        df = spark.createDataFrame([(x,)], "value string") if isinstance(x, str) else x.toDF("value")
        out = df if out is None else out.union(df)
    out.coalesce(1).write.text(path)
    return path


def csv_file(df: DataFrame, path: str, sep: str = ",", quote: str = '"') -> str:
    df.write.csv(path, header=True, sep=sep, quote=quote, escape=quote, emptyValue="")
    return path


def sql_triples(source: str, subject: str, *pairs: tuple[str, str]) -> str:
    """Triples of rows: (predicate, object as SQL; null is none)."""
    return " UNION ALL ".join(f"SELECT {subject} AS s, '{p}' AS p, {o} AS o FROM {source} WHERE ({o}) IS NOT NULL" for p, o in pairs)


def sql_text(x: str) -> str:
    return f"'\"' || {x} || '\"'"


def sql_int(x: str) -> str:
    return f"'\"' || {x} || '\"^^xsd:integer'"


def sql_dec(x: str) -> str:
    return f"'\"' || {x} || '\"^^xsd:decimal'"


def counted(triples: DataFrame, stem: str) -> DataFrame:
    """Triples whose numbered subjects are N, with how often each occurs."""
    n = lambda c: F.regexp_replace(c, rf"^({stem})\d+", "$1N")
    return triples.select(n("s").alias("s"), "p", n("o").alias("o")).groupBy("s", "p", "o").agg(F.count("*").alias("n"))


def sql_counted(triples: str) -> str:
    return f"SELECT s, p, o, count(*) AS n FROM ({triples}) GROUP BY ALL"


# --- delimited text ---

CUSTOMER = sql_triples(
    "customer", "'ex:c_' || c_custkey",
    ("rdf:type", "'ex:customer'"), ("rdfs:member", "'ex:all'"), ("dct:identifier", sql_int("c_custkey")), ("rdfs:label", sql_text("c_name")), ("ex:nation", "'ex:n_' || c_nationkey"),
    ("ex:balance", sql_dec("c_acctbal")),
)
SPEC = TableSpec("customer", "ex:c_", "c_custkey", {"c_custkey": "dct:identifier", "c_name": "rdfs:label", "c_nationkey": "nation", "c_acctbal": "balance", "c_mktsegment": None}, {"nation": ([(r"^(?P<n>\d+)$", r"ex:n_\g<n>")], False)}, parent="ex:all")


def customer_triples(s: SparkSession, d: str, spec: TableSpec = SPEC) -> DataFrame:
    path = csv_file(table(s, d, "customer"), f"{new_folder(s, 'csv')}/customer.csv", ";")
    return table_triples(read_table(s, path, ";"), spec)


@query(CUSTOMER)
def csv_triples(s, d):
    """Renamed and dropped columns, a key, typed literals, a foreign key by rule, a parent."""
    return customer_triples(s, d)


@query(sql_counted(sql_triples("customer", "'ex:row_N'", ("rdf:type", "'ex:customer'"), ("ex:c_mktsegment", sql_text("c_mktsegment")), ("ex:c_nationkey", sql_int("c_nationkey")))))
def csv_numbered_subjects(s, d):
    spec = TableSpec("customer", "ex:row", None, {"c_custkey": None, "c_name": None, "c_acctbal": None})
    return counted(customer_triples(s, d, spec), "ex:row_")


@query("SELECT p_partkey AS k, p_name || ';\"x\"' || chr(10) || p_type AS cell FROM part")
def csv_quoted_cells(s, d):
    """Cells with separators, doubled quotes and newlines."""
    part = table(s, d, "part").select(F.col("p_partkey").alias("k"), F.concat("p_name", F.lit(';"x"\n'), "p_type").alias("cell"))
    return read_table(s, csv_file(part, f"{new_folder(s, 'csv')}/part.csv", ";"), ";").select(F.col("k").cast("long"), "cell")


@query("SELECT s_suppkey AS k, s_name || '|*' AS cell, 'é' AS more FROM supplier")
def csv_separator_and_quote(s, d):
    own = table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.concat("s_name", F.lit("|*")).alias("cell"), F.lit("é").alias("more"))
    return read_table(s, csv_file(own, f"{new_folder(s, 'csv')}/s.csv", "|", "*"), "|", "*").select(F.col("k").cast("long"), "cell", "more")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS nr, n_name || '; x' AS name, (1000 + n_nationkey) || '.5' AS share FROM nation UNION ALL SELECT 'nr', 'name', 'share' FROM region")
def csv_preamble_decimal_comma(s, d):
    """Lines before the header, thousands and decimal marks; rows that look like the header are data."""
    k = F.col("n_nationkey")
    rows = table(s, d, "nation").select(F.concat(k, F.lit(';"'), "n_name", F.lit('; x";1.'), F.lpad(k.cast("string"), 3, "0"), F.lit(",5")))
    again = table(s, d, "region").select(F.lit("nr;name;share"))
    path = text_file(s, f"{new_folder(s, 'csv')}/n.csv", "A title", "; second line", "nr;name;share", rows, again)
    return read_table(s, path, ";", skip_lines=2, decimal_comma=True)


@query(
    sql_triples("customer", "'ex:c_' || CASE WHEN c_custkey < 10 THEN '0' ELSE '' END || c_custkey || CASE WHEN c_custkey >= 1000 THEN 'k' ELSE '' END",
                ("rdf:type", "'ex:x'"), ("ex:id", "CASE WHEN c_custkey < 10 THEN '0' ELSE '' END || c_custkey || CASE WHEN c_custkey >= 1000 THEN 'k' ELSE '' END"), ("ex:seg", sql_text("replace(c_mktsegment, 'BUILDING', 'B-HOUSE')")))
)
def csv_value_rules(s, d):
    """Substitutions one after the other, on the key too; texts put as they are."""
    spec = TableSpec("x", "ex:c_", "c_custkey", {"c_custkey": "id", "c_name": None, "c_nationkey": None, "c_acctbal": None, "c_mktsegment": "seg"}, {"id": ([(r"^(\d)$", r"0\1"), (r"^(\d{4,})$", r"\1k")], False), "seg": ([("BUILD", "B-BUILD"), (r"B-BUILDING", "B-HOUSE")], True)})
    return customer_triples(s, d, spec)


DATES = sql_triples("orders", "'ex:o_' || o_orderkey", ("rdf:type", "'ex:order'"), ("ex:day", "'\"' || strftime(o_orderdate, '%Y/%m/%d') || '\"^^xsd:date'"), ("ex:time", "'\"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') || '\"^^xsd:dateTime'"), ("ex:at", "'\"POINT(' || (o_orderkey % 180) || ' -1.5)\"^^geo:wktLiteral'"))


@query(DATES)
def csv_typed_literals(s, d):
    t = F.col("o_orderdate")
    own = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.date_format(t, "dd.MM.yyyy").alias("day"), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), F.concat(F.lit("POINT("), F.col("o_orderkey") % 180, F.lit(" -1.5)")).alias("at"))
    return table_triples(read_table(s, csv_file(own, f"{new_folder(s, 'csv')}/o.csv")), TableSpec("order", "ex:o_", "id", {"id": None}))


POINTS = ("  POINT(1 2)", "POINT (1  2)", "point( -1.5 2 )", "POINT(+1 2)", "POINT(1 2) x", "POINT(1,2)", "POINT(1 2", "xPOINT(1 2)", "1\n", "é\"\\")
POINTS_SQL = " ".join("WHEN {} THEN '{}'".format(i, x.replace("\n", "' || chr(10) || '")) for i, x in enumerate(POINTS))


@query(f"SELECT s_suppkey, CASE WHEN regexp_matches(t, '^\\s*[Pp][Oo][Ii][Nn][Tt]\\s*\\(\\s*-?[0-9]+([.][0-9]+)?\\s+-?[0-9]+([.][0-9]+)?\\s*\\)') THEN 'geo:wktLiteral' WHEN t = '1' || chr(10) THEN 'xsd:integer' END AS kind, trim(t, ' ' || chr(10)) AS value, CASE WHEN t LIKE 'é%' THEN '\"\\u00e9\\\"\\\\\"' END AS json FROM (SELECT s_suppkey, CASE s_suppkey % 10 {POINTS_SQL} END AS t FROM supplier)")
def literal_points(s, d):
    """Which texts are points: white space and case are free, a sign only minus, what follows doesn't matter."""
    from .functions.literals import literal, literal_type, literal_value

    t = F.element_at(F.array(*map(F.lit, POINTS)), (F.col("s_suppkey") % 10 + 1).cast("int"))
    own = table(s, d, "supplier").select("s_suppkey", t.alias("t"))
    return own.select("s_suppkey", literal_type(F.col("t")).alias("kind"), literal_value(F.col("t")).alias("value"), F.when(F.col("t").startswith("é"), literal(F.col("t"))).alias("json"))


# --- KML ---


def kml_file(s: SparkSession, rows: DataFrame, namespace: str = "http://www.opengis.net/kml/2.2") -> str:
    return text_file(s, f"{new_folder(s, 'kml')}/doc.kml", f'<?xml version="1.0" encoding="UTF-8"?><kml xmlns="{namespace}" xmlns:gx="http://www.google.com/kml/ext/2.2"><Document><Folder><Folder>', rows, "</Folder></Folder></Document></kml>")


def marks(s: SparkSession, d: str, body: Column | str, head: Column | str = "", which: str = "true") -> DataFrame:
    of = lambda x: F.expr(x) if isinstance(x, str) and x else F.lit("") if isinstance(x, str) else x
    return table(s, d, "nation").filter(which).select(F.concat(F.lit('<Placemark id="n'), "n_nationkey", F.lit('">'), of(head), of(body), F.lit("</Placemark>")))


def wkt_rows(s: SparkSession, rows: DataFrame, **more) -> DataFrame:
    return kml.read_kml(s, kml_file(s, rows, **more)).select("id", "wkt")


XY = "concat(n_nationkey, '.5,', n_nationkey, ',7')"


@query("SELECT 'n' || n_nationkey AS id, 'POINT(' || n_nationkey || '.5 ' || n_nationkey || '.0)' AS wkt FROM nation WHERE n_nationkey < 20")
def kml_points(s, d):
    """Points with height; those out of range aren't there, nor placemarks without a geometry. An older namespace."""
    inside = marks(s, d, f"concat('<Point><coordinates> ', {XY}, ' </coordinates></Point>')", which="n_nationkey < 20")
    outside = marks(s, d, "'<Point><coordinates>181,2</coordinates></Point>'", which="n_nationkey between 20 and 22")
    return wkt_rows(s, inside.union(outside).union(marks(s, d, "", which="n_nationkey > 22")), namespace="http://earth.google.com/kml/2.2")


@query("SELECT 'n' || n_nationkey AS id, 'LINESTRING(' || n_nationkey || '.5 ' || n_nationkey || '.0, 1.0 2.0, 3.0 4.0)' AS wkt FROM nation WHERE n_nationkey <> 0")
def kml_lines_and_tracks(s, d):
    """Lines and tracks; a line of one point is none."""
    line = marks(s, d, f"concat('<LineString><coordinates>', {XY}, '\n1,2   3,4</coordinates></LineString>')", which="n_nationkey between 1 and 12")
    track = marks(s, d, "concat('<gx:Track><gx:coord>', n_nationkey, '.5 ', n_nationkey, ' 7</gx:coord><gx:coord>1 2 0</gx:coord><gx:coord>3 4 0</gx:coord></gx:Track>')", which="n_nationkey > 12")
    return wkt_rows(s, line.union(track).union(marks(s, d, f"concat('<LineString><coordinates>', {XY}, '</coordinates></LineString>')", which="n_nationkey = 0")))


RING = "<LinearRing><coordinates>0,0 10,0 10,10 0,0</coordinates></LinearRing>"
HOLE = "concat('<innerBoundaryIs><LinearRing><coordinates>1,1 2,1 2,', 1 + n_nationkey, ' 1,1</coordinates></LinearRing></innerBoundaryIs>')"


@query("SELECT 'n' || n_nationkey AS id, 'POLYGON((0.0 0.0, 10.0 0.0, 10.0 10.0, 0.0 0.0), (1.0 1.0, 2.0 1.0, 2.0 ' || (1 + n_nationkey) || '.0, 1.0 1.0))' AS wkt FROM nation WHERE n_nationkey > 0")
def kml_polygons_with_holes(s, d):
    """A polygon without an outer ring is none."""
    own = marks(s, d, f"concat('<Polygon><outerBoundaryIs>{RING}</outerBoundaryIs>', {HOLE}, '</Polygon>')", which="n_nationkey > 0")
    return wkt_rows(s, own.union(marks(s, d, "'<Polygon></Polygon>'", which="n_nationkey = 0")))


MULTI = "concat('<MultiGeometry><Point><coordinates>', n_nationkey, ',1</coordinates></Point><Point><coordinates>3,4</coordinates></Point></MultiGeometry>')"


@query("SELECT 'n' || n_nationkey AS id, 'MULTIPOINT((' || n_nationkey || '.0 1.0), (3.0 4.0))' AS wkt FROM nation")
def kml_multi_geometry(s, d):
    return wkt_rows(s, marks(s, d, MULTI))


NAMED = "concat('<name>', n_name, '</name><description>d &amp; ', n_nationkey, '</description>')"
KML_SQL = sql_counted(
    sql_triples("nation", "'ex:place_N'", ("rdf:type", "'ex:place'"), ("rdfs:member", "'ex:all'"), ("dct:identifier", sql_text("'n' || n_nationkey")), ("rdfs:label", sql_text("n_name")), ("dct:description", sql_text("'d & ' || n_nationkey")), ("geo:hasGeometry", "'ex:place_N_geo'"))
    + " UNION ALL " + sql_triples("nation", "'ex:place_N_geo'", ("geo:asWKT", "'\"POINT(' || n_nationkey || '.5 ' || n_nationkey || '.0)\"^^geo:wktLiteral'"))
)


def place_triples(s: SparkSession, path: str) -> DataFrame:
    return kml.kml_triples(kml.read_kml(s, path), "place", "ex:place_", "ex:all")


@query(KML_SQL)
def kml_triples(s, d):
    return counted(place_triples(s, kml_file(s, marks(s, d, f"concat('<Point><coordinates>', {XY}, '</coordinates></Point>')", NAMED))), "ex:place_")


@query(KML_SQL)
def kmz_triples(s, d):
    """The same from a zip with one .kml and other files."""
    text = kml_file(s, marks(s, d, f"concat('<Point><coordinates>', {XY}, '</coordinates></Point>')", NAMED))
    return counted(place_triples(s, zip_file(s, {"doc.kml": text}, "a.kmz")), "ex:place_")


def zip_file(s: SparkSession, files: dict[str, str], name: str) -> str:
    """A zip in the shared folder of text files, by Hadoop's file system."""
    import io
    import zipfile

    path, data = f"{new_folder(s, 'zip')}/{name}", io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("readme.md", "other")
        for inner, at in files.items():
            z.writestr(inner, "\n".join(r.value for r in s.read.text(at).collect()) + "\n")
    from .staging import file_system

    fs, where = file_system(s, path)
    out = fs.create(where)
    out.write(bytearray(data.getvalue()))
    out.close()
    return path


@query("SELECT 'n' || n_nationkey AS label, 'POINT(' || n_nationkey || '.5 ' || n_nationkey || '.0)' AS wkt FROM nation")
def aux_geometry_table(s, d):
    """The side table of geometries, written as tab-separated text and read back."""
    t = place_triples(s, kml_file(s, marks(s, d, f"concat('<Point><coordinates>', {XY}, '</coordinates></Point>')")))
    path = f"{new_folder(s, 'aux')}/geo.tsv"
    sinks.write_aux_geometries(kml.aux_geometries(t), path)
    ids = t.filter("p = 'dct:identifier'").select(F.col("s").alias("subject"), F.regexp_extract("o", '"(.*)"', 1).alias("label"))
    return s.read.csv(path, sep="\t", schema="subject string, wkt string", quote="").join(ids, "subject").select("label", "wkt")


# --- GTFS ---

#: By table: the source, and its columns as SQL that both engines read.
FEED = {
    "agency": ("region", {"agency_id": "concat('a ', r_regionkey)", "agency_name": "r_name", "agency_url": "'http://x/'", "agency_timezone": "'Europe/Berlin'", "agency_lang": "'de'", "agency_phone": "concat('+49 ', r_regionkey)"}),
    "calendar": ("nation", {"service_id": "concat('w', n_nationkey)", "monday": "CAST(n_nationkey % 2 AS VARCHAR(9))", "sunday": "CAST(n_nationkey % 3 AS VARCHAR(9))", "start_date": "'20240520'", "end_date": "CASE WHEN n_nationkey % 2 = 0 THEN '20241231' ELSE '2024' END"}),
    "calendar_dates": ("nation", {"service_id": "concat('w', n_nationkey)", "date": "'20240521'", "exception_type": "CAST(1 + n_nationkey % 2 AS VARCHAR(9))"}),
    "feed_info": ("region", {"feed_publisher_name": "r_name", "feed_publisher_url": "'http://x/'", "feed_lang": "'de'", "feed_start_date": "'20240101'", "feed_end_date": "'20241231'", "feed_version": "'v 1'"}),
    "frequencies": ("nation", {"trip_id": "concat('t-', n_nationkey)", "start_time": "'06:00:00'", "end_time": "'24:30:00'", "headway_secs": "'600'", "exact_times": "'0'"}),
    "routes": ("nation", {"route_id": "concat('r', n_nationkey)", "agency_id": "concat('a ', n_regionkey)", "route_short_name": "n_name", "route_long_name": "''", "route_type": "CASE WHEN n_nationkey < 8 THEN CAST(n_nationkey AS VARCHAR(9)) ELSE '99' END"}),
    "stops": ("supplier", {"stop_id": "concat('S-', s_suppkey)", "stop_name": "s_name", "stop_lat": "concat('4', s_suppkey % 10, '.50')", "stop_lon": "concat('7.', s_suppkey)", "parent_station": "CASE WHEN s_suppkey % 3 = 0 THEN concat('P ', s_nationkey) ELSE '' END", "level_id": "''"}),
    "stop_times": ("orders", {"trip_id": "concat('t-', o_custkey)", "arrival_time": "'10:00:00'", "stop_id": "concat('S-', o_orderkey % 100)", "stop_sequence": "CAST(o_orderkey % 7 AS VARCHAR(9))", "pickup_type": "CAST(o_orderkey % 4 AS VARCHAR(9))", "drop_off_type": "CAST(o_orderkey % 5 AS VARCHAR(9))"}),
    "transfers": ("nation", {"from_stop_id": "concat('S-', n_nationkey)", "to_stop_id": "concat('S-', n_regionkey)", "transfer_type": "CAST(n_nationkey % 6 AS VARCHAR(9))", "min_transfer_time": "'120'"}),
    "trips": ("customer", {"trip_id": "concat('t-', c_custkey)", "route_id": "concat('r', c_nationkey)", "service_id": "concat('w', c_nationkey)", "trip_headsign": "c_mktsegment", "direction_id": "CAST(c_custkey % 2 AS VARCHAR(9))", "shape_id": "concat('x', c_nationkey)"}),
    "shapes": ("customer", {"shape_id": "concat('x ', c_nationkey)", "shape_pt_lat": "concat('4', c_custkey % 10, '.0')", "shape_pt_lon": "concat('7.', c_custkey)", "shape_pt_sequence": "CAST(c_custkey AS VARCHAR(9))"}),
}


def feed_folder(s: SparkSession, d: str, *tables: str) -> str:
    folder = new_folder(s, "gtfs")
    for t in tables:
        source, columns = FEED[t]
        csv_file(table(s, d, source).select(*[F.expr(x).alias(c) for c, x in columns.items()]), f"{folder}/{t}.txt")
    return folder


def feed_query(name: str, stem: str | None, pairs: list[tuple[str, str]], more: str = "") -> None:
    """Register gtfs_<table>: the triples of one table. stem: of numbered subjects, else the subject's SQL is the first pair's."""
    source, columns = FEED[name]
    rows = f"(SELECT {', '.join(f'{x} AS {c}' for c, x in columns.items())} FROM {source})"
    subject = f"'gtfs:{stem}_f_N'" if stem else pairs.pop(0)[1]
    sql = sql_triples(rows, subject, *pairs) + (" UNION ALL " + more.format(rows=rows) if more else "")

    def run(s: SparkSession, d: str) -> DataFrame:
        t = gtfs.feed_triples(gtfs.read_feed(s, feed_folder(s, d, name)), "f")
        return counted(t, f"gtfs:{stem or name}_f_") if stem else counted(t, "gtfs:none_f_")

    run.__name__ = f"gtfs_{name}"
    query(sql_counted(sql))(run)


def _local(x: str) -> str:
    return f"replace(replace({x}, '-', '0x00002d'), ' ', '0x000020')"


def _flag(x: str) -> str:
    return f"CASE {x} WHEN '0' THEN '\"false\"^^xsd:boolean' WHEN '1' THEN '\"true\"^^xsd:boolean' ELSE {x} END"


def _day(x: str) -> str:
    return f"CASE WHEN length({x}) = 8 THEN '\"' || substr({x}, 1, 4) || '/' || substr({x}, 5, 2) || '/' || substr({x}, 7, 2) || '\"^^xsd:date' ELSE '\"' || {x} || '\"' END"


def _temporal(stem: str, a: str, b: str) -> str:
    return sql_triples("{rows}", f"'gtfs:{stem}_f_N_temporal'", ("schema:startDate", _day(a)), ("schema:endDate", _day(b)))


def _boarding(x: str) -> str:
    return f"CASE {x} WHEN '0' THEN 'gtfs:Regular' WHEN '1' THEN 'gtfs:NotAvailable' WHEN '2' THEN 'gtfs:MustPhone' WHEN '3' THEN 'gtfs:MustCoordinateWithDriver' ELSE {x} END"


def _point(subject: str, lon: str, lat: str) -> str:
    return sql_triples("{rows}", subject, ("geo:hasGeometry", f"{subject} || '_geo'"), ("geo:hasCentroid", f"{subject} || '_geo'")) + " UNION ALL " + sql_triples("{rows}", f"{subject} || '_geo'", ("geo:asWKT", f"'\"POINT(' || {lon} || ' ' || {lat} || ')\"^^geo:wktLiteral'"))


VEHICLES = " ".join(f"WHEN '{i}' THEN 'gtfs:{v}'" for i, v in gtfs.CODES["vehicle"].items())
TRANSFERS = " ".join(f"WHEN '{i}' THEN 'gtfs:{v}'" for i, v in gtfs.CODES["transfer"].items())
STOP, SHAPE = f"'gtfs:stop_f_' || {_local('stop_id')}", f"'gtfs:shape_f_' || {_local('shape_id')}"

feed_query("agency", None, [("", f"'gtfs:agency_f_' || {_local('agency_id')}"), ("rdf:type", "'gtfs:Agency'"), ("dct:identifier", sql_text(_local("agency_id"))), ("foaf:name", sql_text("agency_name")), ("foaf:page", sql_text("agency_url")), ("gtfs:timeZone", sql_text("agency_timezone")), ("dct:language", sql_text("agency_lang")), ("foaf:phone", sql_text("agency_phone"))])
feed_query("calendar", "calendar", [("rdf:type", "'gtfs:CalendarRule'"), ("gtfs:service", "'gtfs:service_f_' || service_id"), ("gtfs:monday", _flag("monday")), ("gtfs:sunday", _flag("sunday")), ("schema:startDate", sql_int("start_date")), ("schema:endDate", sql_int("end_date")), ("dct:temporal", "'gtfs:calendar_f_N_temporal'")], _temporal("calendar", "start_date", "end_date"))
feed_query("calendar_dates", "calendar_date", [("rdf:type", "'gtfs:CalendarDateRule'"), ("gtfs:service", "'gtfs:service_f_' || service_id"), ("dct:date", sql_int("date")), ("gtfs:dateAddition", "CASE exception_type WHEN '1' THEN '\"true\"^^xsd:boolean' ELSE '\"false\"^^xsd:boolean' END")])
feed_query("feed_info", "feed", [("rdf:type", "'gtfs:Feed'"), ("rdf:type", "'dcat:Dataset'"), ("rdfs:label", sql_text("feed_publisher_name")), ("dct:publisher", sql_text("feed_publisher_url")), ("dct:language", sql_text("feed_lang")), ("schema:startDate", sql_int("feed_start_date")), ("schema:endDate", sql_int("feed_end_date")), ("schema:version", sql_text("feed_version")), ("dct:temporal", "'gtfs:feed_f_N_temporal'")], _temporal("feed", "feed_start_date", "feed_end_date"))
feed_query("frequencies", "frequency", [("rdf:type", "'gtfs:Frequency'"), ("gtfs:trip", f"'gtfs:trip_f_' || {_local('trip_id')}"), ("gtfs:startTime", sql_text("start_time")), ("gtfs:endTime", sql_text("end_time")), ("gtfs:headwaySeconds", sql_int("headway_secs")), ("gtfs:exactTimes", sql_int("exact_times"))])
feed_query("routes", None, [("", "'gtfs:route_f_' || route_id"), ("rdf:type", "'gtfs:Route'"), ("dct:identifier", sql_text("route_id")), ("gtfs:agency", f"'gtfs:agency_f_' || {_local('agency_id')}"), ("gtfs:shortName", sql_text("route_short_name")), ("gtfs:routeType", f"CASE route_type {VEHICLES} ELSE '\"' || route_type || '\"' END")])
feed_query("stops", None, [("", STOP), ("rdf:type", "'gtfs:Stop'"), ("dct:identifier", sql_text(_local("stop_id"))), ("foaf:name", sql_text("stop_name")), ("geo:lat", sql_dec("stop_lat")), ("geo:long", sql_dec("stop_lon")), ("gtfs:parentStation", f"CASE WHEN parent_station <> '' THEN 'gtfs:station_f_' || {_local('parent_station')} END")], _point(STOP, "stop_lon", "stop_lat") + f" UNION ALL SELECT 'gtfs:station_f_' || {_local('parent_station')}, 'rdf:type', 'gtfs:Station' FROM {{rows}} WHERE parent_station <> ''")
feed_query("stop_times", "stop_time", [("rdf:type", "'gtfs:StopTime'"), ("gtfs:trip", f"'gtfs:trip_f_' || {_local('trip_id')}"), ("gtfs:arrivalTime", sql_text("arrival_time")), ("gtfs:stop", STOP), ("gtfs:stopSequence", sql_int("stop_sequence")), ("gtfs:pickupType", _boarding("pickup_type")), ("gtfs:dropOffType", _boarding("drop_off_type"))])
feed_query("transfers", "transfer_rule", [("rdf:type", "'gtfs:TransferRule'"), ("gtfs:originStop", f"'gtfs:stop_f_' || {_local('from_stop_id')}"), ("gtfs:destinationStop", f"'gtfs:stop_f_' || {_local('to_stop_id')}"), ("gtfs:transferType", f"CASE transfer_type {TRANSFERS} END"), ("gtfs:minimumTransferTime", sql_int("min_transfer_time"))])
feed_query("trips", None, [("", f"'gtfs:trip_f_' || {_local('trip_id')}"), ("rdf:type", "'gtfs:Trip'"), ("dct:identifier", sql_text(_local("trip_id"))), ("gtfs:route", "'gtfs:route_f_' || route_id"), ("gtfs:service", "'gtfs:service_f_' || service_id"), ("gtfs:headsign", sql_text("trip_headsign")), ("gtfs:direction", _flag("direction_id")), ("gtfs:shape", "'gtfs:shape_f_' || shape_id")])
feed_query("shapes", "shapepoint", [("rdf:type", "'gtfs:ShapePoint'"), ("geo:lat", sql_dec("shape_pt_lat")), ("geo:long", sql_dec("shape_pt_lon")), ("gtfs:pointSequence", sql_int("shape_pt_sequence"))], _point("'gtfs:shapepoint_f_N'", "shape_pt_lon", "shape_pt_lat") + " UNION ALL " + sql_triples("{rows}", SHAPE, ("rdf:type", "'gtfs:Shape'"), ("gtfs:shapePoint", "'gtfs:shapepoint_f_N'")))


@query("SELECT 'gtfs:shape_f_x0x000020' || c_nationkey || '_geo' AS s, '\"LINESTRING(' || string_agg('7.' || c_custkey || ' 4' || (c_custkey % 10) || '.0', ', ' ORDER BY c_custkey) || ')\"^^geo:wktLiteral' AS o FROM customer GROUP BY c_nationkey")
def gtfs_zip_lines(s, d):
    """Shapes of a zipped feed as lines, points by number (not as texts)."""
    folder = feed_folder(s, d, "shapes", "agency")
    lines = {f"{t}.txt": f"{folder}/{t}.txt" for t in ("agency",)}
    whole = text_file(s, f"{folder}/one-shapes", "shape_id,shape_pt_lat,shape_pt_lon,shape_pt_sequence", read_table(s, f"{folder}/shapes.txt").select(F.concat_ws(",", "shape_id", "shape_pt_lat", "shape_pt_lon", "shape_pt_sequence")))
    feed = gtfs.read_feed(s, zip_file(s, lines | {"shapes.txt": whole}, "feed.zip"), exclude=("agency",))
    return gtfs.feed_triples(feed, "f", True).filter("p = 'geo:asWKT' and o like '%LINESTRING%'").select("s", "o")


# --- sinks, bundles ---


@query(f"SELECT s, p, o FROM ({CUSTOMER}) UNION ALL SELECT 'written', 'count', CAST(count(*) AS VARCHAR) FROM ({CUSTOMER})")
def turtle_round_trip(s, d):
    """Compressed Turtle lines and their number, read back."""
    path = f"{new_folder(s, 'turtle')}/out"
    n = sinks.write_turtle(customer_triples(s, d), path, Prefixes())
    return sinks.read_turtle(s, path).union(s.createDataFrame([("written", "count", str(n))], "s string, p string, o string"))


@query("SELECT s_suppkey * 1e0 AS k, s_name AS name, 'ex:n_' || s_nationkey AS nation, s_acctbal AS balance FROM supplier")
def typed_tsv_read(s, d):
    """A result of IRIs and literals as tab-separated text, read with plain values and numbers."""
    path, q = f"{new_folder(s, 'tsv')}/result.tsv", lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    own = table(s, d, "supplier").select(F.concat(q(F.col("s_suppkey").cast("string")), F.lit("^^xsd:integer")).alias("?k"), q(F.col("s_name")).alias("?name"), F.concat(F.lit("<ex:n_"), "s_nationkey", F.lit(">")).alias("?nation"), F.col("s_acctbal").alias("?balance"))
    own.write.csv(path, sep="\t", header=True, quote="", escapeQuotes=False)
    return sinks.read_result(s, path, typed=True)


@query("SELECT n_nationkey, n_name FROM nation")
def json_result(s, d):
    path = f"{new_folder(s, 'json')}/result"
    sinks.write_result(table(s, d, "nation").select("n_nationkey", "n_name"), path, "json")
    return s.read.json(path, schema="n_nationkey int, n_name string")


BUNDLE = (
    "SELECT 'election:N' AS s, p, o FROM (VALUES ('rdf:type', 'election:election'), ('rdfs:label', '\"E\"'), ('election:wikidata', 'wd:Q1'), ('election:countryname', '\"Land\"'), ('election:date', '\"2021/09/26\"^^xsd:date'), ('election:year', '\"2021\"^^xsd:integer')) v(p, o) UNION ALL "
    + sql_triples("nation", "'election:e_' || n_nationkey", ("rdf:type", "'election:result'"), ("rdfs:member", "'election:N'"), ("election:area_no", sql_int("n_nationkey")), ("election:area_name", sql_text("n_name")))
    + " UNION ALL " + sql_triples("nation", "'ex:N'", ("rdf:type", "'ex:place'"), ("rdfs:member", "'election:N'"), ("dct:identifier", sql_text("'n' || n_nationkey")), ("geo:hasGeometry", "'ex:N_geo'"))
    + " UNION ALL " + sql_triples("nation", "'ex:N_geo'", ("geo:asWKT", "'\"POINT(' || n_nationkey || '.5 ' || n_nationkey || '.0)\"^^geo:wktLiteral'"))
)


@query(sql_counted(BUNDLE))
def bundle_triples(s, d):
    """A described bundle of a table and placemarks, all members of the election that the description is of."""
    folder = new_folder(s, "bundle")
    csv_file(table(s, d, "nation").select(F.col("n_nationkey").alias("nr"), F.col("n_name").alias("name"), F.lit("x").alias("no")), f"{folder}/r.csv", ";")
    mark = kml_file(s, marks(s, d, f"concat('<Point><coordinates>', {XY}, '</coordinates></Point>')"))
    s.read.text(mark).coalesce(1).write.text(f"{folder}/d.kml")
    raw = {
        "election": {"label": "E", "countryname": "Land", "wikidata": "Q1", "osm": None, "year": 2021, "date": "2021/09/26", "id_prefix": "e_"}, "prefixes": [{"prefix": "election", "iri": "http://e.org/e/"}, {"prefix": "ex", "iri": "http://e.org/x/"}],
        "csv": [{"dataset": "result", "primary_prefix": "election", "primary_col": "nr", "store_filename": "r.csv", "csv_separator": ";", "column_mapping": {"nr": "area_no", "name": "area_name", "no": None}}], "kml": [{"dataset": "place", "primary_prefix": "ex", "store_filename": "d.kml"}],
    }
    text_file(s, f"{folder}/c.json", json.dumps(raw))
    t = Bundle.load(s, f"{folder}/c.json").triples(s)
    me = lambda c: F.regexp_replace(c, "^election:e_[0-9a-f]{32}", "election:N")
    return counted(t.select(me("s").alias("s"), "p", me("o").alias("o")), "ex:")


@query("SELECT c_custkey AS left_id, CAST(1 + c_nationkey % 7 AS SMALLINT) AS relation, c_custkey * 3 AS right_id FROM customer")
def relation_file(s, d):
    """A relation table from space-separated text."""
    from .operators.containment import read_relations

    path = f"{new_folder(s, 'relations')}/r.csv"
    table(s, d, "customer").select(F.concat_ws(" ", "c_custkey", 1 + F.col("c_nationkey") % 7, F.col("c_custkey") * 3)).write.text(path)
    return read_relations(s, path)
