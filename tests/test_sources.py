"""Readers on files built here, their errors, and export."""

import json
import math
import struct

import pytest

from terrane import errors
from terrane.functions import geometry as g
from terrane.operators import records as r
from terrane.sources import geojson, gml, mvt, shapefile
from pyspark.sql import functions as F


def shp(records, kind=3):
    body = b"".join(struct.pack(">2i", k, len(x) // 2) + x for k, x in enumerate(records, 1))
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, kind, -2, -6, 12, 44, *[0] * 4) + body


def parts(kind, *lists):
    xy = [v for p in lists for point in p for v in point]
    first = [sum(map(len, lists[:k])) for k in range(len(lists))]
    return struct.pack(f"<i4d2i{len(first)}i{len(xy)}d", kind, 0, 0, 0, 0, len(first), len(xy) // 2, *first, *xy)


def dbf(columns, rows):
    """columns: (name, kind, length); rows: lists of bytes, a leading True for a deleted one."""
    head = b"".join(n.encode().ljust(11, b"\0") + k.encode() + bytes(4) + bytes([size, 0]) + bytes(14) for n, k, size in columns)
    size = 1 + sum(c[2] for c in columns)
    out = struct.pack("<4BIHH20x", 3, 124, 1, 1, len(rows), 33 + len(head), size) + head + b"\r"
    for deleted, *cells in rows:
        out += (b"*" if deleted else b" ") + b"".join(x.ljust(c[2]) for x, c in zip(cells, columns, strict=True))
    return out


COLUMNS = [("CREEK", "C", 12), ("DEPTH", "N", 9), ("OPEN", "L", 1), ("SEEN", "D", 8)]
#: Two lines that touch the box (-3, -3, 4, 4) and one that doesn't.
LINES = [parts(3, [(-2, 7), (3, 3)]), parts(3, [(4, 4), (11, -6), (12, -6)]), parts(3, [(5, 30), (6, 44)])]
ROWS = [[False, "小川".encode("cp932"), b"2.5", b"T", b"19991231"], [False, b"Mill race", b"-4", b"n", b""], [False, b"Ditch", b"0.125", b"?", b""]]


def put(folder, name, shapes=None, table=None, **more):
    for ext, data in {"shp": shapes or shp(LINES), "dbf": table or dbf(COLUMNS, ROWS), **more}.items():
        (folder / f"{name}.{ext}").write_bytes(data)
    return str(folder / f"{name}.shp")


def fails(error, action):
    with pytest.raises(Exception) as raised:
        action()
    assert raised.type is error or error.__name__ in str(raised.value)


def test_shapefile(spark, tmp_path):
    wkt = b'GEOGCS["Round earth",DATUM["x"]]'
    path = put(tmp_path, "a.b", prj=wkt)
    got = shapefile.read_shapefile(spark, path)
    first = got.where("record_number = 1").first()
    assert first.attributes["CREEK"].text == "小川" and first.attributes["SEEN"].kind == "date" and first.attributes["OPEN"].bool is True
    assert got.where(g.intersects(g.bbox(F.col("geometry")), -3, -3, 4, 4)).count() == 2
    assert tuple(r.describe_field(got, "DEPTH", {"DEPTH": True}).first()) == (3, -4, 2.5, -1.375 / 3, 0.125)
    assert got.where(r.equals(F.col("attributes"), "OPEN", r.value("null"))).count() == 1
    m = shapefile.metadata(spark, path).first()
    assert (m.shape_type, m.n_records, m.x_max, m.crs_name, m.is_geographic, len(m.fields)) == ("Polyline", 3, 12, "Round earth", True, 4)
    fields = shapefile.declared(spark, path)
    assert fields == {"CREEK": False, "DEPTH": True, "OPEN": False, "SEEN": False}
    a = F.col("attributes")
    for action in (lambda: r.describe_field(got, "GONE", fields), lambda: r.equals(a, "GONE", r.value("null"), fields), lambda: r.is_in(a, "GONE", [], fields), lambda: r.starts_with(a, "GONE", "x", fields)):
        with pytest.raises(errors.FieldNotFound):
            action()
    with pytest.raises(errors.DescribeOnNonNumericField):
        r.describe_field(got, "CREEK", fields)
    assert [x.attributes["CREEK"].text for x in r.get(got, 1).collect()] == ["Mill race"] and r.get(got, 3).isEmpty() and r.first(got, 2).count() == 2
    other = shapefile.read_shapefile(spark, path, encoding="latin-1")
    assert other.where("record_number = 1").first().attributes["CREEK"].text == "小川".encode("cp932").decode("latin-1")


def test_accessors(spark):
    v, nothing = F.col("v"), r.value("null")
    made = [r.value("text", "x"), r.value("numeric", None, 2), r.value("logical", None, None, False), r.value("date", "20200229"), nothing]
    df = spark.range(1).select(F.explode(F.array(*made)).alias("v"))
    got = df.select(r.as_text(v), r.as_number(v), r.as_flag(v), r.is_numeric(v)).collect()
    assert [tuple(x) for x in got] == [("x", None, None, False), (None, 2, None, True), (None, None, False, False), (None, None, None, False), (None, None, None, False)]


def test_boxes_with_nan_and_without_vertices(spark):
    rows = [("Polyline", [[(float("nan"), 5.0), (2.0, 3.0)]]), ("Polyline", []), ("Point", [[(float("nan"), 1.0)]]), ("Null", None)]
    df = spark.createDataFrame([((kind, parts),) for kind, parts in rows], "g struct<type:string,parts:array<array<struct<x:double,y:double>>>>")
    got = df.select(g.bbox(F.col("g")).alias("b"), g.intersects(g.bbox(F.col("g")), 0, 0, 9, 9).alias("hit")).collect()
    inf = math.inf
    assert tuple(got[0].b) == (2, 3, 2, 5) and tuple(got[1].b) == (inf, inf, -inf, -inf) and got[3].b is None
    assert math.isnan(got[2].b.x_min) and [r.hit for r in got] == [True, False, True, False]


def test_shapefile_in_ranges(spark, tmp_path):
    """With an index a set is read in ranges, with the same numbers as whole; deleted rows count nowhere."""
    shapes = [struct.pack("<i2d", 1, k, -k) for k in range(25)]
    gone = (0, 7, 8, 24)
    table = dbf([("ID", "N", 4)], [[k in gone, str(k).encode()] for k in range(25)])
    data = shp(shapes, 1)
    index = data[:100] + b"".join(struct.pack(">2i", (100 + 28 * k) // 2, 10) for k in range(25))
    path = put(tmp_path, "many", data, table, shx=index)
    value = F.col("attributes")["ID"]["num"].cast("int")
    read = lambda **k: [tuple(r) for r in shapefile.read_shapefile(spark, path, **k).select("record_number", value).orderBy("record_number").collect()]
    want = list(enumerate([k for k in range(25) if k not in gone], 1))
    assert read() == want
    assert read(range_bytes=100) == want
    assert read(range_bytes=100, numbers=(9, 9)) == want[8:9] and read(range_bytes=100, numbers=(20, 40)) == want[19:] and read(numbers=(30, 31)) == []
    wrong = put(tmp_path, "wrong", data, table, shx=index[:-8])
    assert shapefile.read_shapefile(spark, wrong, range_bytes=100).count() == len(want)
    assert shapefile.entries_of(index[:-8], len(data)) is None
    chased = shapefile.chased(path, len(data), 60)
    assert (chased == shapefile.entries_of(index, len(data))).all() and len(shapefile.cuts_of(chased, 5, 100)) > 5
    (tmp_path / "wrong.shx").unlink()
    assert [tuple(x) for x in shapefile.read_shapefile(spark, wrong, range_bytes=100).select("record_number", value).orderBy("record_number").collect()] == want


def test_shapefile_as_a_source(spark, tmp_path):
    """Pushed record numbers choose the ranges that are read; the rows are those of read_shapefile()."""
    shapefile.register(spark)
    shapes = [parts(3, [(k, j) for j in range(k % 5 + 2)]) for k in range(60)]
    for name, gone in (("one", ()), ("two", (3, 4, 59))):
        put(tmp_path, name, shp(shapes), dbf([("ID", "N", 4)], [[k in gone, str(k).encode()] for k in range(60)]))
    got = spark.read.format("shapefile").option("rangeBytes", 500).load(str(tmp_path))
    want = shapefile.read_shapefile(spark, str(tmp_path))
    rows = lambda df: sorted(df.select(F.regexp_extract("path", "[^/]*$", 0).alias("f"), "record_number", "geometry", F.col("attributes")["ID"]["num"].alias("id")).collect(), key=lambda x: x[:2])
    assert rows(got) == rows(want) and got.count() == 117
    n = F.col("record_number")
    everything = got.rdd.getNumPartitions()
    for condition, most in ((n == 31, 2), (n.isin(3, 5), 4), ((n > 20) & (n <= 22), 4), (n < 2, 2), (n >= 58, 4), (n == 0, 1), (n > 1000, 2)):
        chosen = got.where(condition)
        assert rows(chosen) == rows(want.where(condition))
        assert chosen.rdd.getNumPartitions() <= most < everything
    one = spark.read.format("shapefile").load(str(tmp_path / "one.shp"))
    assert one.count() == 60 and spark.read.format("shapefile").load(str(tmp_path / "o*")).count() == 60
    fails(errors.MissingFile, lambda: spark.read.format("shapefile").load(str(tmp_path / "none.shp")).collect())
    broken = put(tmp_path, "broken", shp(shapes)[:-9], dbf([("ID", "N", 4)], [[False, b"1"]] * 60))
    fails(errors.CorruptedFile, lambda: spark.read.format("shapefile").option("rangeBytes", 500).load(broken).collect())


def test_shapefile_kinds_and_deleted_rows(spark, tmp_path):
    shapes = [struct.pack("<i", 0), struct.pack("<i2d", 1, 5, 6), struct.pack("<i4di4d", 8, 0, 0, 0, 0, 2, 1, 2, 3, 4), parts(5, [(0, 0), (0, 9), (9, 9), (0, 0)], [(1, 2), (2, 2), (1, 2)]), parts(3)]
    table = dbf([("N", "N", 3)], [[k == 1, str(k).encode()] for k in range(5)])
    got = shapefile.read_shapefile(spark, put(tmp_path, "k", shp(shapes), table)).orderBy("record_number").collect()
    assert [(x.geometry.type, x.attributes["N"].num) for x in got] == [("Null", 0), ("MultiPoint", 2), ("Polygon", 3), ("Polyline", 4)]
    assert [len(p) for p in got[2].geometry.parts] == [4, 3] and got[0].geometry.parts is None and got[3].geometry.parts == []


def test_shapefile_folder_and_errors(spark, tmp_path):
    good = tmp_path / "good"
    good.mkdir()
    put(good, "x")
    put(good, "y")
    assert shapefile.read_shapefile(spark, str(good)).groupBy("path").count().count() == 2
    read = lambda name, **k: shapefile.read_shapefile(spark, put(tmp_path, name, **k)).collect()
    fails(errors.CorruptedFile, lambda: read("code", shapes=b"\0" * 120))
    fails(errors.CorruptedFile, lambda: read("short", shapes=shp(LINES)[:-9]))
    fails(errors.UnsupportedShapeType, lambda: read("z", shapes=shp([struct.pack("<i3d", 11, 1, 2, 3)])))
    fails(errors.CorruptedFile, lambda: read("num", table=dbf([("N", "N", 3)], [[False, b"1_0"]] * 3)))
    fails(errors.EncodingError, lambda: read("enc", table=dbf([("N", "C", 3)], [[False, b"\xff\xff"]] * 3), cpg=b"UTF-8"))
    (tmp_path / "alone.shp").write_bytes(shp(LINES))
    fails(errors.MissingFile, lambda: shapefile.read_shapefile(spark, str(tmp_path / "alone.shp")).collect())


def collection(*features):
    return json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": x, "properties": p} for x, p in features]})


def test_geojson(spark, tmp_path):
    square = [[0, 0], [0, 2], [2, 2], [0, 0]]
    doc = collection(
        ({"type": "Point", "coordinates": [1, 2, 999]}, {"name": "A", "pop": 100, "n": {"b": 1.0, "a": [True]}, "z": None}),
        ({"type": "MultiPolygon", "coordinates": [[square], [square]]}, {"name": "AB", "pop": 300}),
        (None, None),
        ({"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[2, 2], [3, 3]]]}, {"pop": True}),
    )
    (tmp_path / "a.geojson").write_text(doc)
    got = geojson.read_geojson(spark, str(tmp_path / "a.geojson"))
    rows = got.orderBy("record_number").collect()
    assert [x.geometry.type for x in rows] == ["Point", "Polygon", "Polygon", "Null", "Polyline"]
    assert rows[0].attributes["n"].text == '{"a":[true],"b":1.0}' and rows[0].attributes["z"].kind == "null"
    assert got.where(r.starts_with(F.col("attributes"), "name", "A")).count() == 3
    assert tuple(r.describe_field(got, "pop").first()) == (3, 100, 300, 700 / 3, 300)
    for n in ("count", "median"):
        fails(errors.FieldNotFound, lambda: r.describe_field(got, "gone").select(n).collect())
        fails(errors.DescribeOnNonNumericField, lambda: r.describe_field(got, "name").select(n).collect())
    out = json.loads(geojson.to_geojson(got))
    assert out["features"][0]["geometry"] == {"type": "Point", "coordinates": [1, 2]} and out["features"][4]["properties"] == {"pop": True}
    (tmp_path / "b.geojson").write_text(json.dumps(out))
    again = geojson.read_geojson(spark, str(tmp_path / "b.geojson"))
    assert again.orderBy("record_number").drop("path").collect() == got.orderBy("record_number").drop("path").collect()
    assert len(json.loads(geojson.to_geojson(got, 2))["features"]) == 2
    pretty = geojson.to_geojson(got, pretty=True)
    assert json.loads(pretty) == out and pretty.startswith('{\n  "type": "FeatureCollection",\n  "features": [\n    {')
    (tmp_path / "c.geojson").write_text('{"type":"FeatureCollection","bbox":[-9,-8,7,6,5,4],"features":[]}')
    assert sorted(tuple(b)[1:] for b in geojson.bounds(spark, str(tmp_path / "[ac].geojson")).collect()) == [(-9, -8, 7, 6), (0, 0, 3, 3)]


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(k, value):
    return varint(k << 3) + varint(value) if isinstance(value, int) else varint(k << 3 | 2) + varint(len(value)) + value


def tile_feature(kind, numbers, tags=()):
    return field(2, b"".join(map(varint, tags))) + field(3, kind) + field(4, b"".join(map(varint, numbers)))


def layer(name, features, keys=(), values=()):
    return field(3, field(15, 2) + field(1, name.encode()) + b"".join(field(2, f) for f in features) + b"".join(field(3, k.encode()) for k in keys) + b"".join(field(4, v) for v in values))


Z = lambda *ns: [n << 1 ^ n >> 31 for n in ns]


def test_mvt(spark, tmp_path):
    ring = lambda x, y, s: [9, *Z(x, y), 26, *Z(s, 0, 0, s, -s, 0), 15]
    roads = layer("roads", [tile_feature(1, [9, *Z(100, 200)], (0, 0, 1, 1)), tile_feature(2, [9, *Z(0, 0), 18, *Z(5, 5, 5, 5)], (1, 2)), tile_feature(3, ring(0, 0, 10) + ring(20, 10, 5)), tile_feature(0, [])], ["name", "ftCode"], [field(1, b"x"), field(4, 2701), field(4, 9999)])
    at = tmp_path / "12" / "905"
    at.mkdir(parents=True)
    (at / "2210.mvt").write_bytes(roads + layer("empty", []))
    got = mvt.read_mvt(spark, str(tmp_path))
    rows = got.orderBy("record_number").collect()
    assert [x.geometry.type for x in rows] == ["Point", "Polyline", "Polygon", "Null"] and [len(p) for p in rows[2].geometry.parts] == [5, 5]
    x, y = rows[0].geometry.parts[0][0]
    assert math.isclose(x, (905 + 100 / 4096) / 2**12 * 360 - 180) and math.isclose(y, math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * (2210 + 200 / 4096) / 2**12)))))
    for b in (mvt.bounds(spark, str(tmp_path)).first(), mvt.bounds(spark, str(tmp_path), (12, 905, 2210)).first()):
        assert (b.z, b.x, b.y) == (12, 905, 2210) and math.isclose(b.x_min, 905 / 2**12 * 360 - 180) and b.x_min < x < b.x_max and b.y_min < y < b.y_max
    assert rows[0].attributes["name"].text == "x" and rows[0].attributes["_layer"].text == "roads"
    assert mvt.road_centerline(got).count() == 1 and mvt.in_layers(got, ["roads"]).count() == 4 and mvt.in_layers(got).count() == 4
    assert mvt.layer_names(spark, str(tmp_path)).first().layers == ["roads", "empty"]
    for bad in (b"\xff\xfe\xfd", layer("a", [tile_feature(2, [18, 1])]), layer("a", [tile_feature(1, [15])])):
        with pytest.raises(errors.InvalidMvt):
            list(mvt.records(bad, 0, 0, 0))


def document(*members, more=""):
    return f'<?xml version="1.0"?><k:D xmlns:gml="g" xmlns:k="k">{more}{"".join(f"<gml:featureMember>{m}</gml:featureMember>" for m in members)}</k:D>'


def test_gml(spark, tmp_path):
    square = lambda a, b: f"<gml:LinearRing><gml:posList>{a} {a} {a} {b} {b} {b} {a} {a}</gml:posList></gml:LinearRing>"
    surface = f"<gml:Polygon><gml:exterior>{square(0, 9)}</gml:exterior><gml:interior>{square(1, 2)}</gml:interior></gml:Polygon>"
    line = lambda c: f"<gml:LineString><gml:posList>{c}</gml:posList></gml:LineString>"
    doc = document(
        f'<k:Road><k:cat>1</k:cat><k:none/><k:empty></k:empty><k:loc><gml:LineString srsName="EPSG:4258"><gml:posList>51 -4 52 -3</gml:posList></gml:LineString></k:loc><k:name>Hill lane</k:name></k:Road>',
        "<k:S><k:p><gml:Point><gml:pos>51.25 -3.75</gml:pos></gml:Point></k:p></k:S>",
        f"<k:A><k:p>{surface}</k:p></k:A>",
        f"<k:M><k:p><gml:MultiCurve><gml:curveMember>{line('0 0 1 1')}</gml:curveMember><gml:curveMember>{line('2 2 3 3')}</gml:curveMember></gml:MultiCurve></k:p></k:M>",
        f"<k:M><k:p><gml:MultiSurface><gml:surfaceMember>{surface}</gml:surfaceMember><gml:surfaceMember>{surface}</gml:surfaceMember></gml:MultiSurface></k:p></k:M>",
        "<k:N><k:v>1_0</k:v></k:N>",
        f"<k:Bad><k:p>{line('1 x')}</k:p></k:Bad>",
        more="<gml:boundedBy><gml:Envelope><gml:lowerCorner>1 2</gml:lowerCorner><gml:upperCorner>3 4</gml:upperCorner></gml:Envelope></gml:boundedBy>",
    )
    (tmp_path / "a.gml").write_text(doc)
    rows = gml.read_gml(spark, str(tmp_path / "a.gml")).orderBy("record_number").collect()
    assert [x.geometry.type for x in rows] == ["Polyline", "Point", "Polygon", "Polyline", "Polygon", "Polygon", "Null"]
    assert tuple(rows[0].geometry.parts[0][0]) == (-4, 51) and tuple(rows[1].geometry.parts[0][0]) == (-3.75, 51.25)
    a = rows[0].attributes
    assert (a["cat"].num, a["none"].kind, "empty" in a, a["name"].text) == (1, "null", False, "Hill lane")
    assert len(rows[2].geometry.parts) == 2 and len(rows[3].geometry.parts) == 2 and rows[6].attributes["v"].text == "1_0"
    m = gml.metadata(spark, str(tmp_path / "a.gml")).first()
    assert (m.srs_name, m.x_min, m.y_min, m.x_max, m.y_max) == ("EPSG:4258", 2, 1, 4, 3)
    (tmp_path / "b.gml").write_text(document(f"<k:A><k:p>{surface}</k:p></k:A>"))
    (tmp_path / "c.gml").write_text(document())
    inf = math.inf
    assert sorted(tuple(b)[1:] for b in gml.bounds(spark, str(tmp_path / "*.gml")).collect()) == [(0, 0, 9, 9), (2, 1, 4, 3), (inf, inf, -inf, -inf)]


def test_gml_members_and_errors():
    both = '<D xmlns:gml="g"><gml:featureMembers><A><v>1</v></A><B><v>2</v></B></gml:featureMembers></D>'
    assert [a["v"]["num"] for _, a, _ in gml.records(both.encode())] == [1, 2]
    for bad in ("<a>", document("<k:A><gml:GeometryCollection/></k:A>")):
        with pytest.raises(errors.InvalidGml):
            list(gml.records(bad.encode()))
