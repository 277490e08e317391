"""GTFS feeds: tables, triples of the linked vocabulary, shapes as line strings."""

from __future__ import annotations

import io
import itertools
import warnings
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.literals import local_name
from ..staging import file_system, new_folder
from .tables import TableSpec, Triples, read_table, table_triples

# By table its class, stem of subjects and key; by column its predicate and the rule of its value.
TABLES: dict[str, tuple[str, str, str | None, dict[str, tuple[str | None, str | None]]]] = {
    "agency": ("Agency", "agency", "agency_id", {
        "agency_id": ("dct:identifier", "name"),
        "agency_name": ("foaf:name", None),
        "agency_url": ("foaf:page", None),
        "agency_timezone": ("gtfs:timeZone", None),
        "agency_lang": ("dct:language", None),
        "agency_phone": ("foaf:phone", None),
    }),
    "calendar": ("CalendarRule", "calendar", None, {
        "service_id": ("gtfs:service", "service"),
        "monday": ("gtfs:monday", "flag"),
        "tuesday": ("gtfs:tuesday", "flag"),
        "wednesday": ("gtfs:wednesday", "flag"),
        "thursday": ("gtfs:thursday", "flag"),
        "friday": ("gtfs:friday", "flag"),
        "saturday": ("gtfs:saturday", "flag"),
        "sunday": ("gtfs:sunday", "flag"),
        "start_date": ("schema:startDate", None),
        "end_date": ("schema:endDate", None),
    }),
    "calendar_dates": ("CalendarDateRule", "calendar_date", None, {
        "service_id": ("gtfs:service", "service"),
        "date": ("dct:date", None),
        "exception_type": ("gtfs:dateAddition", "addition"),
    }),
    "feed_info": ("Feed", "feed", None, {
        "feed_publisher_url": ("dct:publisher", None),
        "feed_lang": ("dct:language", None),
        "feed_version": ("schema:version", None),
        "feed_contact_mail": ("dcat:contactPoint", None),
        "feed_publisher_name": ("rdfs:label", None),
        "feed_start_date": ("schema:startDate", None),
        "feed_end_date": ("schema:endDate", None),
    }),
    "frequencies": ("Frequency", "frequency", None, {
        "trip_id": ("gtfs:trip", "trip"),
        "start_time": ("gtfs:startTime", None),
        "end_time": ("gtfs:endTime", None),
        "headway_secs": ("gtfs:headwaySeconds", None),
        "exact_times": ("gtfs:exactTimes", None),
    }),
    "routes": ("Route", "route", "route_id", {
        "route_id": ("dct:identifier", "name"),
        "agency_id": ("gtfs:agency", "agency"),
        "route_short_name": ("gtfs:shortName", None),
        "route_long_name": ("gtfs:longName", None),
        "route_type": ("gtfs:routeType", "vehicle"),
        "route_color": ("gtfs:color", None),
        "route_text_color": ("gtfs:textColor", None),
        "route_desc": ("dct:description", None),
    }),
    "shapes": ("ShapePoint", "shapepoint", None, {
        "shape_id": (None, None),
        "shape_pt_lat": ("geo:lat", None),
        "shape_pt_lon": ("geo:long", None),
        "shape_pt_sequence": ("gtfs:pointSequence", None),
    }),
    "stops": ("Stop", "stop", "stop_id", {
        "stop_id": ("dct:identifier", "name"),
        "stop_code": ("gtfs:code", None),
        "stop_name": ("foaf:name", None),
        "stop_desc": ("dct:description", None),
        "stop_lat": ("geo:lat", None),
        "stop_lon": ("geo:long", None),
        "parent_station": ("gtfs:parentStation", "station"),
        "wheelchair_boarding": ("gtfs:wheelchairAccessible", None),
        "platform_code": ("gtfs:platform", None),
    }),
    "stop_times": ("StopTime", "stop_time", None, {
        "trip_id": ("gtfs:trip", "trip"),
        "arrival_time": ("gtfs:arrivalTime", None),
        "departure_time": ("gtfs:departureTime", None),
        "stop_id": ("gtfs:stop", "stop"),
        "stop_sequence": ("gtfs:stopSequence", None),
        "pickup_type": ("gtfs:pickupType", "boarding"),
        "drop_off_type": ("gtfs:dropOffType", "boarding"),
        "stop_headsign": ("gtfs:headsign", None),
    }),
    "transfers": ("TransferRule", "transfer_rule", None, {
        "from_stop_id": ("gtfs:originStop", "stop"),
        "to_stop_id": ("gtfs:destinationStop", "stop"),
        "transfer_type": ("gtfs:transferType", "transfer"),
        "min_transfer_time": ("gtfs:minimumTransferTime", None),
        "from_route_id": ("gtfs:originRoute", "route"),
        "to_route_id": ("gtfs:destinationRoute", "route"),
        "from_trip_id": ("gtfs:originTrip", "trip"),
        "to_trip_id": ("gtfs:destinationTrip", "trip"),
    }),
    "trips": ("Trip", "trip", "trip_id", {
        "route_id": ("gtfs:route", "route"),
        "service_id": ("gtfs:service", "service"),
        "trip_id": ("dct:identifier", "name"),
        "trip_headsign": ("gtfs:headsign", None),
        "trip_short_name": ("gtfs:shortName", None),
        "direction_id": ("gtfs:direction", "flag"),
        "block_id": ("gtfs:block", None),
        "shape_id": ("gtfs:shape", "shape"),
        "wheelchair_accessible": ("gtfs:wheelchairAccessible", "flag"),
        "bikes_allowed": ("gtfs:bikesAllowed", "flag"),
    }),
}
# What coded values stand for. Codes of transfers are replaced wherever they occur.
CODES = {
    "flag": {"0": '"false"^^xsd:boolean', "1": '"true"^^xsd:boolean'},
    "addition": {"1": '"true"^^xsd:boolean', "2": '"false"^^xsd:boolean'},
    "boarding": {"0": "gtfs:Regular", "1": "gtfs:NotAvailable", "2": "gtfs:MustPhone", "3": "gtfs:MustCoordinateWithDriver"},
    "vehicle": {"0": "LightRail", "1": "Subway", "2": "Rail", "3": "Bus", "4": "Ferry", "5": "CableCar", "6": "Gondola", "7": "Funicular"},
    "transfer": {"0": "RecommendedTransfer", "1": "EnsuredTransfer", "2": "MinimumTimeTransfer", "3": "NoTransfer", "4": "InSeatTransfer", "5": "NoInSeatTransfer"},
}
ENTITIES = {"agency", "route", "service", "shape", "station", "stop", "trip"}


def _coded(kind: str):
    def rule(c: Column) -> Column:
        if kind == "transfer":
            for code, name in CODES[kind].items():
                c = F.regexp_replace(c, str(code), f"gtfs:{name}")
            return c
        out = F.when(c.rlike(r"(?U)^\d+$"), F.concat(F.lit('"'), c, F.lit('"'))).otherwise(c) if kind == "vehicle" else c
        for code, name in CODES[kind].items():
            out = F.when(c == str(code), F.lit(f"gtfs:{name}" if kind == "vehicle" else name)).otherwise(out)
        return out

    return rule


def _date(c: Column) -> Column:
    parts = F.concat(F.lit('"'), F.substring(c, 1, 4), F.lit("/"), F.substring(c, 5, 2), F.lit("/"), F.substring(c, 7, 2), F.lit('"^^xsd:date'))
    return F.when(F.length(c) == 8, parts).otherwise(F.concat(F.lit('"'), F.coalesce(c, F.lit("")), F.lit('"')))


def _temporal(s: Column, start: Column, end: Column) -> Triples:
    node = F.concat(s, F.lit("_temporal"))
    return [(s, F.lit("dct:temporal"), node), (node, F.lit("schema:startDate"), _date(start)), (node, F.lit("schema:endDate"), _date(end))]


def _point(s: Column, lon: str, lat: str) -> Triples:
    geo = F.concat(s, F.lit("_geo"))
    return [(s, F.lit("geo:hasGeometry"), geo), (s, F.lit("geo:hasCentroid"), geo), (geo, F.lit("geo:asWKT"), F.format_string('"POINT(%s %s)"^^geo:wktLiteral', F.col(lon), F.col(lat)))]


def _shape(feed: str) -> Column:
    return F.concat(F.lit(f"gtfs:shape_{feed}_"), local_name(F.col("shape_id")))


def _extra(table: str, feed: str):
    def triples(df: DataFrame, s: Column) -> Triples:
        if table == "calendar":
            return _temporal(s, F.col("start_date"), F.col("end_date"))
        if table == "feed_info":
            return [(s, F.lit("rdf:type"), F.lit("dcat:Dataset")), *_temporal(s, F.col("feed_start_date"), F.col("feed_end_date"))]
        if table == "shapes":
            return [(_shape(feed), F.lit("rdf:type"), F.lit("gtfs:Shape")), (_shape(feed), F.lit("gtfs:shapePoint"), s), *_point(s, "shape_pt_lon", "shape_pt_lat")]
        if table == "stops":
            out = _point(s, "stop_lon", "stop_lat")
            if "parent_station" in df.columns:
                has = F.col("parent_station").isNotNull() & (F.col("parent_station") != "")
                out.append((F.concat(F.lit(f"gtfs:station_{feed}_"), local_name(F.col("parent_station"))), F.lit("rdf:type"), F.when(has, F.lit("gtfs:Station"))))
            return out
        return []

    return triples


def table_specs(feed: str) -> dict[str, TableSpec]:
    """The specs of the supported tables of a feed, by file stem."""
    out: dict[str, TableSpec] = {}
    for table, (cls, stem, key, fields) in TABLES.items():
        values: dict[str, tuple] = {}
        for predicate, rule in fields.values():
            if rule == "name":
                values[predicate] = (local_name, True)
            elif rule in ENTITIES:
                values[predicate] = ((lambda c, stem=f"gtfs:{rule}_{feed}_": F.concat(F.lit(stem), local_name(c))), False)
            elif rule:
                values[predicate] = (_coded(rule), False)
        columns = {c: predicate for c, (predicate, _) in fields.items()}
        out[table] = TableSpec(cls, f"gtfs:{stem}_{feed}_", key, columns, values, extra=_extra(table, feed))
    return out


def unzipped(spark: SparkSession, path: str) -> str:
    """The text files of a zip, taken out by a task into a shared folder, a folder of parts for each."""

    def lines(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for content in batch.column("content"):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for name in (n for n in z.namelist() if n.endswith(".txt")):
                        with z.open(name) as f, io.TextIOWrapper(f, "utf-8-sig", newline="") as text:
                            while some := list(itertools.islice(text, 10_000)):
                                yield pa.RecordBatch.from_arrays([pa.array([PurePosixPath(name).stem] * len(some)), pa.array([x.removesuffix("\n").removesuffix("\r") for x in some])], ["table", "value"])

    folder = new_folder(spark, "feed")
    content = spark.read.format("binaryFile").load(path).select("content")
    content.mapInArrow(lines, "table string, value string").write.partitionBy("table").text(f"{folder}/tables")
    return f"{folder}/tables"


def read_feed(spark: SparkSession, path: str, exclude: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The supported tables of a feed, by name. path: a folder of text files, or a zip of them, on any file system;
    unknown tables are warned of, missing and excluded ones left out."""
    specs = table_specs("feed")
    if path.lower().endswith(".zip"):
        path = unzipped(spark, path)
    fs, where = file_system(spark, path)
    names = {f.getPath().getName(): f.getPath().toString() for f in fs.listStatus(where)}
    found = {n.removeprefix("table=").removesuffix(".txt"): p for n, p in names.items() if n.endswith(".txt") or n.startswith("table=")}
    if unknown := sorted(set(found) - set(specs)):
        warnings.warn(f"tables not supported: {', '.join(unknown)}", stacklevel=2)
    return {t: read_table(spark, p) for t, p in found.items() if t in specs and t not in exclude}


def shape_lines(shapes: DataFrame) -> DataFrame:
    """(shape_id, wkt): points of each shape in order of number, longitude and latitude texts, as one line."""
    point = F.struct(F.col("shape_pt_sequence").cast("long").alias("seq"), F.col("shape_pt_lon").alias("lon"), F.col("shape_pt_lat").alias("lat"))
    points = F.array_sort(F.collect_list(point))
    text = F.array_join(F.transform(points, lambda x: F.concat_ws(" ", x["lon"], x["lat"])), ", ")
    return shapes.groupBy("shape_id").agg(F.concat(F.lit("LINESTRING("), text, F.lit(")")).alias("wkt"))


def feed_triples(tables: dict[str, DataFrame], feed: str, add_linestrings: bool = False) -> DataFrame:
    """(s, p, o) of all tables of a feed, duplicates kept."""
    specs, out = table_specs(feed), None
    for table, df in tables.items():
        part = table_triples(df, specs[table])
        out = part if out is None else out.union(part)
    if add_linestrings and "shapes" in tables:
        lines = shape_lines(tables["shapes"]).withColumn("s", _shape(feed))
        geo = F.concat("s", F.lit("_geo"))
        rows = F.array(F.struct("s", F.lit("geo:hasGeometry").alias("p"), geo.alias("o")), F.struct(geo.alias("s"), F.lit("geo:asWKT").alias("p"), F.concat(F.lit('"'), F.col("wkt"), F.lit('"^^geo:wktLiteral')).alias("o")))
        out = out.union(lines.select(F.explode(rows).alias("t")).select("t.*"))
    return out
