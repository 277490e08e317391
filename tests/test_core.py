import json
import random

import pytest
from pyspark.sql import functions as F

from geoweave import evaluation
from geoweave.functions import geo, literals
from geoweave.operators import relational, spatial_join, stats, triples
from geoweave.plans.compose import ProvidedValues, QueryConfig, ReplaceRule, SearchLimits, Template, chunks, indented
from geoweave.prefixes import Prefix, Prefixes
from geoweave.sources import bundle, gtfs, kml, sinks, tables


def test_literals(spark):
    cases = {"1": '"1"^^xsd:integer', "-4.5": '"-4.5"^^xsd:decimal', "01.01.2024": '"2024/01/01"^^xsd:date', "2024/01/02": '"2024/01/02"^^xsd:date', "2024-01-02T03:04:05Z": '"2024-01-02T03:04:05Z"^^xsd:dateTime', "POINT(1 2)": '"POINT(1 2)"^^geo:wktLiteral', " 5": '"5"', 'a"ü': '"a\\"\\u00fc"', "5:49:00": '"5:49:00"', None: '""'}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.o for r in df.select("t", literals.literal(F.col("t")).alias("o")).collect()} == cases
    out = spark.createDataFrame([("05.20", "a-ü_ b")], "a string, b string").select(literals.substituted(F.col("a"), [(r"^0(?P<n>.*)$", r"\g<n>")]), literals.local_name(F.col("b"))).first()
    assert tuple(out) == ("5.20", "a0x00002dü_0x000020b")


def test_prefixes():
    assert Prefixes().add(Prefix("ex", "http://ex.org/a")).lines()[-1].startswith("@prefix xsd:")
    for bad in (("a b", "http://x.org/"), ("a", "ftp://x.org/"), ("a", "http://x.org")):
        with pytest.raises(ValueError):
            Prefix(*bad)
    with pytest.raises(ValueError):
        Prefixes().add(Prefix("xsd", "http://other.org/"))


def test_csv_to_turtle(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a;b;c\n1;"x;y";01.01.2024\n\n2;;z\n', encoding="utf-8-sig")
    df = tables.read_table(spark, str(tmp_path / "t.csv"), ";")
    spec = tables.TableSpec("thing", "ex:", "a", {"a": "dct:identifier", "b": None, "c": "when"}, parent="ex:p")
    got = {tuple(r) for r in tables.table_triples(df, spec).collect()}
    assert got == {(f"ex:{k}", p, o) for k, p, o in [("1", "rdf:type", "ex:thing"), ("2", "rdf:type", "ex:thing"), ("1", "rdfs:member", "ex:p"), ("2", "rdfs:member", "ex:p"), ("1", "dct:identifier", '"1"^^xsd:integer'), ("2", "dct:identifier", '"2"^^xsd:integer'), ("1", "ex:when", '"2024/01/01"^^xsd:date'), ("2", "ex:when", '"z"')]}
    assert sinks.write_turtle(tables.table_triples(df, spec), str(tmp_path / "out"), Prefixes()) == 8
    assert any(p.suffix == ".bz2" for p in (tmp_path / "out").iterdir())


def test_kml(spark, tmp_path):
    mark = lambda body, more="": f"<Placemark{more}>{body}</Placemark>"
    body = mark("<name>P</name><Point><coordinates>8,48,3</coordinates></Point>", ' id="p1"') + mark("<LineString><coordinates>1,2 3,4</coordinates></LineString>") + mark("<LineString><coordinates>1,2</coordinates></LineString>") + mark("<MultiGeometry><Point><coordinates>1,2</coordinates></Point><Point><coordinates>3,4</coordinates></Point></MultiGeometry>")
    body += mark("<Polygon><outerBoundaryIs><LinearRing><coordinates>0,0 0,1 1,1 0,0</coordinates></LinearRing></outerBoundaryIs></Polygon>")
    (tmp_path / "a.kml").write_text(f'<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><Folder>{body}</Folder></Document></kml>')
    df = kml.read_kml(spark, str(tmp_path / "a.kml"))
    assert sorted(r.wkt for r in df.collect()) == ["LINESTRING(1.0 2.0, 3.0 4.0)", "MULTIPOINT((1.0 2.0), (3.0 4.0))", "POINT(8.0 48.0)", "POLYGON((0.0 0.0, 0.0 1.0, 1.0 1.0, 0.0 0.0))"]
    t = kml.kml_triples(df, "place", "ex:place")
    assert t.filter("p = 'rdf:type'").count() == 4 and t.filter("p = 'rdfs:label'").first().o == '"P"'
    assert kml.aux_geometries(t).count() == 4


def test_gtfs(spark, tmp_path):
    (tmp_path / "stops.txt").write_text("stop_id,stop_name,stop_lat,stop_lon,parent_station,level_id\nS-1,One,48.10,7.5,P 1,\n")
    (tmp_path / "calendar.txt").write_text("service_id,monday,start_date,end_date\nW,1,20240520,2024\n")
    (tmp_path / "shapes.txt").write_text("shape_id,shape_pt_lat,shape_pt_lon,shape_pt_sequence\nx,2,1,10\nx,4,3,9\n")
    (tmp_path / "routes.txt").write_text("route_id,agency_id,route_type\nr,a,3\nq,a,99\n")
    got = {tuple(r) for r in gtfs.feed_triples(gtfs.read_feed(spark, str(tmp_path)), "f", True).collect()}
    for t in [("gtfs:stop_f_S0x00002d1", "geo:lat", '"48.10"^^xsd:decimal'), ("gtfs:stop_f_S0x00002d1_geo", "geo:asWKT", '"POINT(7.5 48.10)"^^geo:wktLiteral'), ("gtfs:station_f_P0x0000201", "rdf:type", "gtfs:Station"), ("gtfs:route_f_r", "gtfs:routeType", "gtfs:Bus"), ("gtfs:route_f_q", "gtfs:routeType", '"99"'), ("gtfs:route_f_r", "gtfs:agency", "gtfs:agency_f_a"), ("gtfs:shape_f_x_geo", "geo:asWKT", '"LINESTRING(3 4, 1 2)"^^geo:wktLiteral')]:
        assert t in got, t
    by = {(p, o) for _, p, o in got}
    assert {("gtfs:monday", '"true"^^xsd:boolean'), ("schema:startDate", '"20240520"^^xsd:integer'), ("schema:startDate", '"2024/05/20"^^xsd:date'), ("schema:endDate", '"2024"'), ("gtfs:service", "gtfs:service_f_W")} <= by


def test_bundle(spark, tmp_path):
    (tmp_path / "r.csv").write_text("nr,votes\n05,1.5\n")
    raw = {"election": {"label": "E", "countryname": "Land", "wikidata": "Q1", "osm": None, "year": 2021, "date": "2021/09/26", "id_prefix": "e_"}, "prefixes": [{"prefix": "election", "iri": "http://e.org/e/"}], "csv": [{"dataset": "result", "primary_prefix": "election", "primary_col": "nr", "store_filename": "r.csv", "column_mapping": {"nr": "area_no"}}]}
    (tmp_path / "c.json").write_text(json.dumps(raw))
    t = bundle.Bundle.load(spark, str(tmp_path / "c.json")).triples(spark)
    assert t.filter("p = 'election:area_no'").first().o == '"05"^^xsd:integer' and t.filter("p = 'rdfs:member'").count() == 1
    raw["prefixes"] = []
    (tmp_path / "d.json").write_text(json.dumps(raw))
    with pytest.raises(ValueError):
        bundle.Bundle.load(spark, str(tmp_path / "d.json"))


@pytest.mark.parametrize("box", [(-180, 180, -90, 90), (170, 190, 60, 70), (5, 9, 47, 49)])
def test_spatial_strategies_agree(spark, box):
    rng = random.Random(str(box))
    wrap = lambda x: (x + 180) % 360 - 180
    make = lambda n: spark.createDataFrame([(i, wrap(rng.uniform(*box[:2])), rng.uniform(*box[2:])) for i in range(n)] + [(n, 180.0, 89.9), (n + 1, -180.0, -90.0), (n + 2, None, 1.0)], "id int, lon double, lat double")
    left, right = make(60), make(80)
    kept = lambda df: sorted((r.left_id, r.right_id, round(r.dist_km, 6)) for r in df.collect())
    for options in ({"max_distance_m": 300_000}, {"k": 2, "max_distance_m": 1_500_000}):
        want = kept(spatial_join.spatial_join(left, right, left_id="id", right_id="id", strategy="nested_loop", **options))
        for strategy in ("grid", "bbox"):
            assert kept(spatial_join.spatial_join(left, right, left_id="id", right_id="id", strategy=strategy, **options)) == want
    want = kept(spatial_join.spatial_join(left, right, k=3, left_id="id", right_id="id", strategy="nested_loop"))
    assert kept(spatial_join.spatial_join(left, right, k=3, left_id="id", right_id="id")) == want
    with pytest.raises(ValueError):
        spatial_join.spatial_join(left, right)


@pytest.mark.parametrize("metres", [1e-3, 1.0, 300.0, 20_000.0, 5_000_000.0, 20_015_114.0, 30_000_000.0])
def test_all_pairs_within(spark, metres):
    """No pair is lost to the quick test, one at exactly the distance neither."""
    rng = random.Random(metres)
    at = [(0.0, 90.0), (7.0, -90.0), (180.0, 0.0), (-180.0, 1e-9), (0.0, 0.0), (1e-8, 0.0), (1e-5, -1e-5), (13.0, 52.0), (-167.0, -52.0)] + [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(30)] + [(8 + rng.gauss(0, 0.1), 48 + rng.gauss(0, 0.1)) for _ in range(30)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(at)], "id int, lon double, lat double")
    pair = lambda r: (r.left_id, r.right_id, r.d)
    every = df.toDF("left_id", "left_lon", "left_lat").crossJoin(df.toDF("right_id", "right_lon", "right_lat")).withColumn("d", spatial_join.distance("d"))
    found = sorted(map(pair, every.collect()))
    exact = next(d * 1000 for d in sorted((p[2] for p in found), key=lambda d: abs(d * 1000 - metres)) if d > 0 and d * 1000 / 1000 == d)
    for limit in (metres, exact):
        got = spatial_join.spatial_join(df, df, max_distance_m=limit, left_id="id", right_id="id", dist_col="d", strategy="nested_loop")
        assert got.columns == ["left_id", "left_lon", "left_lat", "right_id", "right_lon", "right_lat", "d"]
        assert sorted(map(pair, got.collect())) == [p for p in found if p[2] <= limit / 1000]


def test_all_pairs_are_dealt_out(spark):
    """A side of one file or row group is not one task's work."""
    df = spark.range(2000).select("id", (F.col("id") / 1000).alias("lon"), F.lit(50.0).alias("lat")).coalesce(1)
    for options in ({"max_distance_m": 1000}, {"k": 1}):
        got = spatial_join.spatial_join(df, df, left_id="id", right_id="id", strategy="nested_loop", **options)
        assert got.select("left_id").distinct().count() == 2000
    assert spatial_join.spatial_join(df, df, max_distance_m=1000, left_id="id", right_id="id", strategy="nested_loop").select(F.spark_partition_id()).distinct().count() > 1


def test_more_neighbours_than_rows(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 1.0)], "id int, lon double, lat double")
    assert spatial_join.spatial_join(df, df, k=5, left_id="id", right_id="id").count() == 4
    assert spatial_join.spatial_join(df, df.limit(0), k=1, left_id="id", right_id="id").count() == 0


def test_triples_and_relational(spark):
    t = spark.createDataFrame([("a", "p", "b"), ("b", "q", '"05"^^xsd:integer'), ("b", "q", '"x"')], "s string, p string, o string")
    assert triples.bgp(t, [("?x", "p", "?y"), ("?y", "q", "?z")]).count() == 2
    assert [r.num for r in triples.typed(t).filter("num is not null").collect()] == [5.0]
    l, r = spark.createDataFrame([(1, None), (2, 3)], "a int, k int"), spark.createDataFrame([(3, "v")], "k int, b string")
    assert sorted(map(tuple, relational.optional(l, r, True).collect())) == [(1, 3, "v"), (2, 3, "v")]
    assert relational.minus(l, r).count() == 1


def test_stats(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "v double")
    row = stats.time_summary(df, "v").first()
    assert (row.q1, row.median, row.q3, row.n) == (1.25, 2.5, 3.75, 4)


def test_quantiles_of_large_groups(spark, monkeypatch):
    """Only values near the points are ranked; the result is the same."""
    rng = random.Random(9)
    df = spark.createDataFrame([(i % 2, round(rng.gauss(0, 50)) / 4 if i % 3 else 1.0) for i in range(9000)], "k int, v double")
    points = {"a": 0.0001, "b": 0.25, "c": 0.5, "d": 0.9, "e": 0.9999}
    want = sorted(map(tuple, stats.exclusive_quantile(df, "v", ["k"], points).collect()))
    monkeypatch.setattr(stats, "WHOLE", 10)
    monkeypatch.setattr(stats, "MARGIN", 0.01)
    assert sorted(map(tuple, stats.exclusive_quantile(df, "v", ["k"], points).collect())) == want


def test_evaluation(spark):
    assert [(t.left, t.right, t.form) for t in evaluation.tasks({"a": 10, "b": 20}, most_pairs=100)] == [(l, r, f) for l, r in (("a", "b"), ("b", "a")) for f in ("grid", "bbox")]
    assert len(evaluation.tasks({"a": 10}, same=True)) == 3
    assert len(evaluation.timed(spark, lambda: spark.range(10), iterations=3, pause_s=0)) == 3
    assert len(evaluation.timed(spark, lambda: spark.range(10), iterations=3, no_repeat_after_s=0, pause_s=0)) == 1
    assert evaluation.summary([3.0, 1.0, 2.0])["median"] == 2.0 and "Range" in evaluation.plan_text(spark.range(3))
    given = ProvidedValues("x", ('"a"', '"b"'))
    assert given.text("q", "{ ?x ex:p ?y }") == 'VALUES ?q_x_ { "a" "b" }\n{ ?q_x_ ex:p ?y }' and given.text("q", "{ ?z a ?y }") == "{ ?z a ?y }"


def test_compose():
    assert str(SearchLimits("s2", 100, 5)) == "numNearestNeighbors5_maxDist100" and chunks([1, 2, 3], 2) == [[1, 2], [3]]
    for bad in (lambda: SearchLimits("s2"), lambda: ReplaceRule("a"), lambda: QueryConfig(())):
        with pytest.raises(ValueError):
            bad()
    assert Template("%A% y", (ReplaceRule("y", "z"),)).render(a="y") == "z z"
    with pytest.raises(RecursionError):
        Template("a", (ReplaceRule("a$", "aa"),)).render()
    assert indented("{\na\n}") == "{\n  a\n}"


def test_wkt(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    df = spark.createDataFrame([(2.0, 2.0, [ring]), (5.0, 2.0, [ring]), (4.0, 1.0, [ring])], "lon double, lat double, rings array<array<struct<lon: double, lat: double>>>")
    got = df.select(geo.point_in_polygon(F.col("lon"), F.col("lat"), F.col("rings")), geo.on_boundary(F.col("lon"), F.col("lat"), F.col("rings")), geo.ring_centroid(F.col("rings")[0])).collect()
    assert [bool(r[1]) for r in got] == [False, False, True] and got[0][0] and not got[1][0] and tuple(got[0][2]) == (2.0, 2.0)
