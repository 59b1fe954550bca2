import datetime
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracksmith.functions import geometry as g
from tracksmith.sources import dbase, geojson, gps, osm, raster, shapefile


@pytest.fixture(scope="module")
def formats(spark):
    raster.register(spark)
    return spark


def test_dbase_round_trip(formats, tmp_path):
    fields = [dbase.Field("id", "N", 9, 0), dbase.Field("name", "C", 12, 0), dbase.Field("size", "N", 12, 3), dbase.Field("day", "D", 8, 0), dbase.Field("ok", "L", 1, 0)]
    rows = [(1, "Été", 2.5, datetime.date(2013, 6, 12), True), (2, "", None, None, False), (3, "x" * 12, -1.125, datetime.date(1999, 1, 1), None)]
    dbase.write(path := f"{tmp_path}/a.dbf", fields, rows)
    df = formats.read.format("dbase").option("rows_per_task", 2).load(path)
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("size", "double"), ("day", "date"), ("ok", "boolean"), ("_deleted", "boolean")]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(*r, False) for r in rows]
    dbase.write(path, fields, [])
    assert formats.read.format("dbase").load(path).count() == 0
    data = (tmp_path / "a.dbf").read_bytes()
    (tmp_path / "cut.dbf").write_bytes(data[:20])
    with pytest.raises(ValueError):
        dbase.layout_of(f"{tmp_path}/cut.dbf")


def test_shapefile_round_trip(formats, tmp_path):
    df = formats.createDataFrame([(k, [[(0.0, float(k)), (1.0, 2.0)], [(3.0, 4.0), (5.0, 6.0), (7.0, 8.0)]]) for k in range(5)], "id long, parts array<array<struct<x:double,y:double>>>")
    df.coalesce(1).write.format("shapefile").mode("append").option("path", f"{tmp_path}/out").save()
    (path,) = [str(p) for p in (tmp_path / "out").glob("*.shp")]
    assert shapefile.shape_type(path) == 3 and shapefile.count(path) == 5
    back = formats.read.format("shapefile").option("rows_per_task", 2).load(path)
    assert back.columns == ["shape_no", "shape_type", "parts", "id", "_deleted"]
    assert sorted((r.id, [[tuple(p) for p in q] for q in r.parts]) for r in back.collect()) == sorted((r.id, [[tuple(p) for p in q] for q in r.parts]) for r in df.collect())
    shapefile.write(points := f"{tmp_path}/p.shp", shapefile.POINT, [([[(1.0, 2.0)]], (7,)), ([], (8,))], [dbase.Field("n", "N", 4, 0)])
    assert [(r.shape_no, r.shape_type, r.n, [tuple(q) for p in r.parts for q in p]) for r in formats.read.format("shapefile").load(points).orderBy("shape_no").collect()] == [(0, 1, 7, [(1.0, 2.0)]), (1, 0, 8, [])]
    (tmp_path / "bad.shp").write_bytes(bytes(100))
    with pytest.raises(ValueError):
        shapefile.shape_type(f"{tmp_path}/bad.shp")


@pytest.mark.parametrize("packed", [False, True])
def test_raster(formats, tmp_path, packed):
    grid = np.arange(16, dtype="<i2").reshape(4, 4)
    strips = [grid[:3].tobytes(), grid[3:].tobytes()]
    strips = [zlib.compress(s) for s in strips] if packed else strips
    entries, extra, base = [], b"", 8 + 2 + 12 * 11 + 4
    lists = {273: ("I", None), 279: ("I", [len(s) for s in strips]), 33550: ("d", [0.5, 0.5, 0.0]), 33922: ("d", [0, 0, 0, -74.0, 46.0, 0])}
    at = base + 8 + 8 + 24 + 48
    lists[273] = ("I", [at, at + len(strips[0])])
    for tag, value in [(256, 4), (257, 4), (258, 16), (259, 8 if packed else 1), (273, None), (277, 1), (278, 3), (279, None), (339, 2), (33550, None), (33922, None)]:
        if value is None:
            kind, values = lists[tag]
            entries.append(struct.pack("<HHII", tag, 4 if kind == "I" else 12, len(values), base + len(extra)))
            extra += struct.pack(f"<{len(values)}{kind}", *values)
        else:
            entries.append(struct.pack("<HHIHH", tag, 3, 1, value, 0))
    (tmp_path / "e.tif").write_bytes(b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 11) + b"".join(entries) + bytes(4) + extra + b"".join(strips))
    r = raster.describe(f"{tmp_path}/e.tif")
    assert r.transform == (-74.0, 0.5, 0.0, 46.0, 0.0, -0.5)
    cells = formats.read.format("geotiff").option("blocks_per_task", 1).load(f"{tmp_path}/e.tif")
    assert {(c.line, c.pixel): c.value for c in cells.collect()} == {(i, j): float(grid[i, j]) for i in range(4) for j in range(4)}
    points = formats.createDataFrame([(-73.9, 45.9), (-72.1, 44.1), (-60.0, 45.0)], "lon double, lat double")
    assert [q.elevation for q in raster.sample(points, cells, r.transform, F.col("lon"), F.col("lat")).orderBy("lon").collect()] == [0.0, 15.0, None]


def test_gps_log(spark, tmp_path):
    head = "n,recorded_at,latitude,longitude,altitude,speed,hort_accuracy,vert_accuracy,src,dst\n"
    rows = ["a,2013-06-12 21:37:14,45.5,-73.5,1,2,1.96,3.92,1,2", "a,2013-06-12 21:37:17,45.5,-73.5,1,-1,1,1,,", "a,2013-06-12 21:37:17,45.5,-73.5,1,2,1,1,,", "b,2013-06-12 21:00:00,95,-73.5,,,,,,", "b,never,45,-73,,,,,,", "b,2013-06-12 21:00:01,45.6,-73.4,x,,,,,", "a,2013-06-12 22:00:00,45.5,-73.5,,,,,,"]
    (tmp_path / "g.csv").write_text(head + "\n".join(rows) + "\n")
    got = gps.load_trips(spark, f"{tmp_path}/g.csv").orderBy("trip_id", "idx").collect()
    assert [(r.trip_id, r.idx, r.x is None) for r in got] == [("a#g.csv#1", 0, False), ("a#g.csv#1", 1, True), ("a#g.csv#1", 2, True), ("a#g.csv#1", 3, False), ("a#g.csv#1", 4, False), ("a#g.csv#3", 0, False), ("b", 0, False)]
    assert abs(got[0].x - 304800) < 1e-6 and abs(got[0].acc_h - 1) < 1e-9 and abs(got[0].acc_v - 2) < 1e-9 and tuple(got[0].link) == (1, 2) and got[6].altitude is None
    assert {r.trip_id for r in gps.load_trips(spark, f"{tmp_path}/g.csv", skip_last=True).collect()} == {"a", "b"}
    assert {r.trip_id for r in gps.load_trips(spark, f"{tmp_path}/g.csv", runs=False, max_trips=1).collect()} == {"a"}


def test_runs_are_carried_over_blocks(spark):
    ids = "aabbbbaac"
    df = spark.createDataFrame([("f", k // 2, k, t) for k, t in enumerate(ids)], "file string, block long, pos long, trip_id string")
    assert [r.session for r in gps.runs_of_ids(df).orderBy("pos").collect()] == [1, 1, 2, 2, 2, 2, 3, 3, 4]


def test_geojson(spark, tmp_path):
    line = {"type": "LineString", "coordinates": [[-73.5, 45.5], [-73.6, 45.6]]}
    streets = {"type": "FeatureCollection", "features": [{"geometry": line, "properties": {"ID_TRC": 9, "CLASSE": 6, "SENS_CIR": -1}}]}
    (tmp_path / "s.json").write_text(json.dumps(streets, indent=1))
    r = geojson.read_streets(spark, f"{tmp_path}/s.json").first()
    assert (r.way_id, r.type, r.sens, len(r.coords)) == (9, 6, -1, 2) and abs(r.coords[0].x - 304800) < 1e-6
    many = {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 0]], [[5, 5], [6, 6], [7, 7]]]}
    cycling = [{"geometry": many, "properties": {"ID": 1, "ID_TRC_GEOBASE": 9, "TYPE_VOIE": 3}}, {"geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"ID": 2, "ID_TRC_GEOBASE": 9, "TYPE_VOIE": 3}}]
    (tmp_path / "c.json").write_text("\n".join(map(json.dumps, cycling)))
    c = geojson.read_cycling(spark, f"{tmp_path}/c.json", lines=True)
    rows = c.orderBy("seq", "part").collect()
    assert [(q.way_id, q.part, q.type, q.sens, len(q.coords)) for q in rows] == [(1, 0, 13, 0, 2), (1, 1, 13, 0, 3)]
    edges = c.select(F.col("way_id").alias("u"), F.col("part").alias("v"), "coords")
    geojson.write_features(edges, geojson.edge_features(), f"{tmp_path}/out", one_file=True)
    (part,) = (tmp_path / "out").glob("part-*")
    out = json.loads(part.read_text())
    assert [f["properties"] for f in out["features"]] == [{"first": 1, "last": 0}, {"first": 1, "last": 1}] and out["features"][0]["geometry"]["coordinates"] == [[0.0, 0.0], [1.0, 0.0]]
    geojson.write_features(edges, geojson.edge_features(), f"{tmp_path}/seq")
    assert geojson.read_features(spark, f"{tmp_path}/seq", "first: INT", lines=True).count() == 2
    assert spark.range(1).select(geojson.wkt(F.lit(1.5), F.lit(2.0))).first()[0] == "POINT(1.5 2.0)"


def test_osm(spark, tmp_path):
    (tmp_path / "m.osm").write_text(
        '<?xml version="1.0"?>\n<osm>\n<node id="1" lat="45.5" lon="-73.5"/>\n<node id="2" lat="45.6" lon="-73.5"><tag k="a" v="b"/></node>\n<node id="3" lat="45" lon="-73"/>\n'
        '<way id="10"><nd ref="1"/><nd ref="2"/><tag k="highway" v="path"/><tag k="colour" v="red"/><tag k="name" v="x"/><tag k="name" v="y"/></way>\n'
        '<way id="11"><nd ref="3"/><tag k="building" v="yes"/></way>\n<way id="12"><nd ref="2"/><tag k="highway" v="steps"/></way>\n</osm>\n'
    )
    ways = osm.read_ways(spark, f"{tmp_path}/m.osm")
    assert {r.way_id: (r.nodes, r.tags) for r in ways.collect()} == {10: ([1, 2], {"highway": "path", "name": "y"}), 12: ([2], {"highway": "steps"})}
    nodes = osm.read_nodes(spark, f"{tmp_path}/m.osm", ways)
    assert sorted(r.node_id for r in nodes.collect()) == [1, 2] and osm.read_nodes(spark, f"{tmp_path}/m.osm").count() == 3
    assert {r.way_id: len(r.coords) for r in osm.way_lines(ways, nodes).collect()} == {10: 2, 12: 1}
    assert nodes.where("node_id = 1").select(F.abs(F.col("x") - g.FALSE_EASTING)).first()[0] < 1e-6
