"""GeoJSON by Spark's expressions and in ranges, against Python's own JSON reader."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane import errors
from terrane.sources import collection, geojson
from tests.geojson_by_hand import of_row, records
from tests.test_sources import fails

ODD = ['{"type":"X"}', "[", '{"type":"GeometryCollection","geometries":[]}', '{"type":"Point"}', '{"type":"Point","coordinates":[1]}', '{"type":"Point","coordinates":[1,"2"]}', '{"type":"Point","coordinates":[true,2]}',
       '{"type":"LineString","coordinates":[[1,2],null]}', '{"type":"LineString","coordinates":[1,2]}', '{"type":"FeatureCollection"}', '{"type":"FeatureCollection","features":5}', "{}", "5", "", "{'type':'Point','coordinates':[1,2]}",
       '{"type":"FeatureCollection","features":[{"geometry":{"type":"Point","coordinates":[1,2]}},{"geometry":{"type":"Point","coordinates":[1,null]}}]}', '{"type":"Feature","geometry":5}']


def _random(rng, n):
    """A collection with all kinds of geometries and of properties, and strings full of quotes, brackets and backslashes."""
    word = lambda: "".join(rng.choice(list('ab"\\[]{},:\n é中\U0001f600\u0001') + ["features", '"features":['], int(rng.integers(0, 9))))
    number = lambda: [int(rng.integers(-99, 99)), float(rng.normal()), 1e-7, 2.0][int(rng.integers(4))]
    point = lambda: [number(), number(), *[None, 5, "x", [1]][: int(rng.integers(0, 2))]]
    lists = lambda d: point() if d == 0 else [lists(d - 1) for _ in range(int(rng.integers(0, 4)))]
    value = lambda d=0: [None, True, number(), word(), {word(): word(), "b": 1.5, "a": [2.0, {"z": 1, "y": word()}]}, [1, word(), [2.25]]][int(rng.integers(6))]
    made = []
    for _ in range(n):
        kind = rng.choice(["Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon", ""])
        depth = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}.get(kind, 0)
        geometry = {"type": str(kind), "coordinates": lists(depth)} if kind else None
        made.append({"type": "Feature", "id": word(), "geometry": geometry, "properties": {word(): value() for _ in range(int(rng.integers(0, 5)))}})
    return made


def _collections():
    rng = np.random.default_rng(8)
    features = _random(rng, 60)
    yield json.dumps({"type": "FeatureCollection", "features": features})
    yield json.dumps({"features": features, "type": "FeatureCollection"}, ensure_ascii=False, indent=3)
    yield json.dumps({"crs": {"features": [{"geometry": 1}], "x": "}]"}, "also": [{"a": 1}, 2], "type": "FeatureCollection", "bbox": [1, 2, 3, 4], "features" : [*features[:9], None, 5, [1, 2], "x"], "after": [{"b": [1]}, "\\\\"]}, separators=(" , ", " : "))
    yield '{"type":"FeatureCollection","features":[ \n ]}'
    yield '{"type":"FeatureCollection","features":[{"properties":{"a":1,"b":{"q":1},"a":"last"}}], "t":"' + "\\\\" * 50 + '\\""}'
    yield json.dumps({"type": "Feature", "properties": {"features": [1, 2]}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 2.5], [3, 4]]]] * 7}})
    yield json.dumps({"type": "MultiPoint", "coordinates": [[k, -k] for k in range(50)]})


@pytest.mark.parametrize("size", [geojson.RANGE, 1, 7, 64, 1000])
def test_any_ranges(spark, tmp_path, size):
    want = {}
    for k, doc in enumerate(_collections()):
        if size > 1 or len(doc) < 400:  # a range a byte is slow
            (tmp_path / f"{k}.geojson").write_text(doc, encoding="utf-8")
            want[f"{k}.geojson"] = records(doc)
    got = {name: [] for name in want}
    for r in geojson.read_geojson(spark, str(tmp_path), range_bytes=size).orderBy("record_number").collect():
        got[r.path.rpartition("/")[2]].append(of_row(r))
    assert got == want


def test_strings(spark):
    docs = list(_collections())
    df = spark.createDataFrame(list(enumerate(docs)), "k long, doc string")
    got = {str(k): [] for k in range(len(docs))}
    for r in geojson.read_geojson_strings(df, "doc", "k").orderBy("record_number").collect():
        got[r.path].append(of_row(r))
    assert got == {str(k): records(d) for k, d in enumerate(docs)}


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([("{}",)], "doc string")
    plan = geojson.read_geojson_strings(df, "doc")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("doc", ODD)
def test_errors(spark, doc):
    fails(errors.InvalidGeoJson, lambda: geojson.read_geojson_strings(spark.createDataFrame([(doc,)], "doc string"), "doc").collect())


@pytest.mark.parametrize("doc", ['{"type":"FeatureCollection","features":[{"geometry":null},', '{"type":"FeatureCollection","features":[{"a":"]}', '{"type":"FeatureCollection","features":[]', *(d for d in ODD if len(d) > 20)])
def test_errors_in_ranges(spark, tmp_path, doc):
    (tmp_path / "x.geojson").write_text(doc)
    fails(errors.InvalidGeoJson, lambda: geojson.read_geojson(spark, str(tmp_path), range_bytes=16).collect())


def test_many_tasks_read_one_file(spark, tmp_path):
    features = ",".join(json.dumps({"type": "Feature", "geometry": {"type": "Point", "coordinates": [k, -k]}, "properties": {"k": k}}) for k in range(20_000))
    (tmp_path / "x.geojson").write_text('{"type":"FeatureCollection","features":[' + features + "]}")
    got = geojson.read_geojson(spark, str(tmp_path), range_bytes=64 << 10)
    assert [(r.record_number, r.geometry.parts[0][0].x) for r in got.orderBy("record_number").collect()] == [(k + 1, float(k)) for k in range(20_000)]
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_one_file_by_many_tasks(spark, tmp_path):
    """What is written reads back equal, in order, however many tasks write it; a failed write leaves nothing."""
    doc = next(_collections())
    records_ = geojson.read_geojson_strings(spark.createDataFrame([(doc,)], "doc string"), "doc").repartition(7)
    at = str(tmp_path / "out.geojson")
    collection.write_collection(records_, at)
    again = geojson.read_geojson(spark, at)
    rows = lambda df: [of_row(r) for r in df.orderBy("record_number").collect()]
    assert rows(again) == rows(records_)
    with open(at, encoding="utf-8") as f:
        names = [list(x["properties"]) for x in json.load(f)["features"]]
    assert names == [sorted(r.attributes, key=lambda k: k.encode()) for r in records_.orderBy("record_number").collect()]
    assert [p.name for p in tmp_path.iterdir()] == ["out.geojson"]
    with pytest.raises(Exception):
        collection.write_collection(records_, at)
    collection.write_collection(records_.where("false"), at, overwrite=True)
    assert json.loads((tmp_path / "out.geojson").read_text()) == {"type": "FeatureCollection", "features": []}
    broken = records_.withColumn("record_number", F.when(F.col("record_number") == 9, F.raise_error(F.lit("stop"))).otherwise(F.col("record_number")).cast("long"))
    with pytest.raises(Exception):
        collection.write_collection(broken, str(tmp_path / "other.geojson"))
    assert [p.name for p in tmp_path.iterdir()] == ["out.geojson"]
