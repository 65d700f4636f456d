"""The registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from terrane.functions import geometry as g
from terrane.operators import records as r
from terrane.plans import encoded, formats
from terrane.sources import geojson, gml


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id and a polyline of the embedding's consecutive pairs."""
    e = F.col("embedding").cast("array<double>")
    pairs = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: g.point(F.get(e, i * 2), F.get(e, i * 2 + 1)))
    return _table(spark, sf_dir, "embeddings").select("vec_id", g.geometry("Polyline", F.array(pairs)).alias("geometry"))


def _points(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    x, y = F.col("event_id") % 360 - 180, F.col("user_id") % 180 - 90
    return _table(spark, sf_dir, "events").select("event_id", *more, g.geometry("Point", F.array(F.array(g.point(x, y)))).alias("geometry"))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.create_map(F.lit("segment"), r.value("text", F.col("c_mktsegment")), F.lit("balance"), r.value("numeric", None, F.col("c_acctbal")), F.lit("name"), r.value("text", F.col("c_name")), F.lit("nation"), r.value("numeric", None, F.col("c_nationkey")))
    return _table(spark, sf_dir, "customer").select("c_custkey", fields.alias("attributes"))


def bbox_filter_points(spark, sf_dir):
    return _points(spark, sf_dir).where(g.intersects(g.bbox(F.col("geometry")), -10, -10, 40, 30)).select("event_id")


def bbox_filter_polylines(spark, sf_dir):
    lines = _lines(spark, sf_dir).where(g.intersects(g.bbox(F.col("geometry")), -0.05, -0.05, 0.05, 0.05))
    return lines.select("vec_id", F.round(g.length(F.col("geometry")), 6).alias("length"), g.num_points(F.col("geometry")).cast("long").alias("n_points"))


def ring_area(spark, sf_dir):
    return _lines(spark, sf_dir).select("vec_id", F.round(g.signed_area(F.col("geometry.parts")[0]), 6).alias("area"))


def geometry_bbox(spark, sf_dir):
    return _lines(spark, sf_dir).select("vec_id", g.bbox(F.col("geometry")).alias("b")).select("vec_id", "b.*")


def tile_bbox(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem")
    z = F.col("l_linenumber") % 5 + 10
    n = F.pow(F.lit(2.0), z).cast("long")
    b = g.tile_bounds(z, F.col("l_orderkey") % n, F.col("l_partkey") % n)
    return li.select("l_orderkey", "l_linenumber", *(F.round(b[k], 6).alias(k) for k in ("x_min", "y_min", "x_max", "y_max")))


def zigzag_decode(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", g.zigzag(F.col("o_custkey")).alias("decoded"))


def attr_eq_text(spark, sf_dir):
    return _customers(spark, sf_dir).where(r.equals(F.col("attributes"), "segment", r.value("text", "BUILDING"))).select("c_custkey")


def attr_in(spark, sf_dir):
    return _customers(spark, sf_dir).where(r.is_in(F.col("attributes"), "nation", [r.value("numeric", None, k) for k in (1, 2, 3)])).select("c_custkey")


def attr_prefix(spark, sf_dir):
    return _customers(spark, sf_dir).where(r.starts_with(F.col("attributes"), "segment", "A")).select("c_custkey")


def describe_balance(spark, sf_dir):
    d = r.describe(_customers(spark, sf_dir), F.col("attributes")["balance"]["num"])
    return d.select("count", "min", "max", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"))


def _written_each(docs: DataFrame) -> str:
    """A folder of a file for each k, all that executors share."""
    at = formats._folder(docs.sparkSession, "scan")
    made = docs.select(F.concat("k", F.lit(".txt")).alias("path"), F.col("value").cast("binary").alias("content"))
    encoded.written(made, at, {"content": ""}).count()
    return at


def _point_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event points with attributes id (numeric) and kind (text), as feature text."""
    fields = F.create_map(F.lit("id"), r.value("numeric", None, F.col("event_id")), F.lit("kind"), r.value("text", F.col("event_type")))
    return _points(spark, sf_dir, "event_type").select("event_id", geojson.feature(F.col("geometry"), fields).alias("feature"))


def geojson_scan(spark, sf_dir):
    """Features as single documents in a text column."""
    found = geojson.read_geojson_strings(_point_features(spark, sf_dir), "feature")
    a, first = F.col("attributes"), g.exterior(F.col("geometry"))[0]
    return found.where(r.starts_with(a, "kind", "c")).select(a["id"]["num"].cast("long").alias("event_id"), a["kind"]["text"].alias("event_type"), first["x"].alias("x"), first["y"].alias("y"))


def geojson_file_describe(spark, sf_dir):
    """One collection of each thousand events, read back from files."""
    each = _point_features(spark, sf_dir).groupBy(F.floor(F.col("event_id") / 1000).alias("k")).agg(F.array_join(F.collect_list("feature"), ",").alias("all"))
    docs = each.select("k", F.concat(F.lit('{"type":"FeatureCollection","features":['), "all", F.lit("]}")).alias("value"))
    found = geojson.read_geojson(spark, _written_each(docs))
    return r.describe(found, F.col("attributes")["id"]["num"])


def gml_scan(spark, sf_dir):
    """One document a file partition, members of all its customers, read back from files."""
    c = _table(spark, sf_dir, "customer")
    member = F.format_string('<gml:featureMember><k:C><k:p><gml:Point><gml:pos>%d %d</gml:pos></gml:Point></k:p><k:key>%d</k:key><k:seg>%s</k:seg></k:C></gml:featureMember>', F.col("c_nationkey"), F.col("c_custkey") % 180, "c_custkey", "c_mktsegment")
    docs = c.groupBy(F.floor(F.col("c_custkey") / 100).alias("k")).agg(F.array_join(F.collect_list(member), "").alias("all")).select("k", F.concat(F.lit('<k:D xmlns:gml="g" xmlns:k="k">'), "all", F.lit("</k:D>")).alias("value"))
    at = _written_each(docs)
    found, a = gml.read_gml(spark, at), F.col("attributes")
    first = g.exterior(F.col("geometry"))[0]
    return found.where(r.equals(a, "seg", r.value("text", "BUILDING"))).select(a["key"]["num"].cast("long").alias("c_custkey"), first["x"].alias("x"), first["y"].alias("y"))


def polygon_measures(spark, sf_dir):
    """The embedding's first eight pairs as a ring and the next four as its hole."""
    e = F.col("embedding").cast("array<double>")
    ring = lambda a, b: F.transform(F.sequence(F.lit(a), F.lit(b)), lambda i: g.point(F.get(e, i * 2), F.get(e, i * 2 + 1)))
    p = F.col("p")
    made = _table(spark, sf_dir, "embeddings").select("vec_id", g.geometry("Polygon", F.array(ring(0, 7), ring(8, 11))).alias("p"))
    return made.select("vec_id", F.round(g.polygon_area(p), 6).alias("area"), F.round(g.perimeter(p), 6).alias("perimeter"), g.is_clockwise(g.exterior(p)).alias("clockwise"), F.size(g.holes(p)).cast("long").alias("n_holes"))


def pixel_places(spark, sf_dir):
    z, n = F.lit(14), 1 << 14
    at = g.pixel_to_geo(z, F.col("l_orderkey") % n, F.col("l_partkey") % n, F.col("l_linenumber") * 100, F.col("l_quantity"), F.lit(4096))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(at["x"], 6).alias("x"), F.round(at["y"], 6).alias("y"))


def dataset_bounds(spark, sf_dir):
    return r.bounds(_points(spark, sf_dir), g.bbox(F.col("geometry")))


QUERIES = {f.__name__: f for f in (bbox_filter_points, bbox_filter_polylines, ring_area, geometry_bbox, tile_bbox, zigzag_decode, attr_eq_text, attr_in, attr_prefix, describe_balance, geojson_scan, geojson_file_describe, gml_scan, polygon_measures, pixel_places, dataset_bounds)} | formats.QUERIES

_XY = "(SELECT vec_id, list_transform(range(32), lambda i: embedding[2*i+1]::DOUBLE) xs, list_transform(range(32), lambda i: embedding[2*i+2]::DOUBLE) ys FROM embeddings)"
_BOX = f"SELECT vec_id, list_min(xs) x_min, list_min(ys) y_min, list_max(xs) x_max, list_max(ys) y_max, xs, ys FROM {_XY}"
_TILE = "(SELECT l_orderkey, l_linenumber, pow(2, l_linenumber % 5 + 10) n, l_orderkey % pow(2, l_linenumber % 5 + 10)::BIGINT x, l_partkey % pow(2, l_linenumber % 5 + 10)::BIGINT y FROM lineitem)"
_SHOELACE = "(list_sum(list_transform(range({a}, {b}+1), lambda i: xs[i]*ys[CASE WHEN i={b} THEN {a} ELSE i+1 END] - xs[CASE WHEN i={b} THEN {a} ELSE i+1 END]*ys[i])) / 2)"
_ALONG = "list_sum(list_transform(range({a}, {b}+1), lambda i: sqrt((xs[i+1]-xs[i])*(xs[i+1]-xs[i]) + (ys[i+1]-ys[i])*(ys[i+1]-ys[i]))))"

ORACLES: dict[str, str] = {
    "bbox_filter_points": "SELECT event_id FROM events WHERE event_id % 360 - 180 BETWEEN -10 AND 40 AND user_id % 180 - 90 BETWEEN -10 AND 30",
    "bbox_filter_polylines": f"SELECT vec_id, round(list_sum(list_transform(range(1, 32), lambda i: sqrt((xs[i+1]-xs[i])*(xs[i+1]-xs[i]) + (ys[i+1]-ys[i])*(ys[i+1]-ys[i])))), 6) AS length, 32::BIGINT AS n_points FROM ({_BOX}) WHERE x_min <= 0.05 AND x_max >= -0.05 AND y_min <= 0.05 AND y_max >= -0.05",
    "ring_area": f"SELECT vec_id, round(list_sum(list_transform(range(1, 33), lambda i: xs[i]*ys[i%32+1] - xs[i%32+1]*ys[i])) / 2, 6) AS area FROM {_XY}",
    "geometry_bbox": f"SELECT vec_id, x_min, y_min, x_max, y_max FROM ({_BOX})",
    "tile_bbox": f"SELECT l_orderkey, l_linenumber, round(x/n*360-180, 6) AS x_min, round(degrees(atan(sinh(pi()*(1-2*(y+1)/n)))), 6) AS y_min, round((x+1)/n*360-180, 6) AS x_max, round(degrees(atan(sinh(pi()*(1-2*y/n)))), 6) AS y_max FROM {_TILE}",
    "zigzag_decode": "SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN o_custkey // 2 ELSE -(o_custkey // 2) - 1 END AS decoded FROM orders",
    "attr_eq_text": "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'",
    "attr_in": "SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 2, 3)",
    "attr_prefix": "SELECT c_custkey FROM customer WHERE starts_with(c_mktsegment, 'A')",
    "describe_balance": 'SELECT count(c_acctbal) AS count, min(c_acctbal) AS min, max(c_acctbal) AS max, round(avg(c_acctbal), 6) AS mean, round(median(c_acctbal), 6) AS median FROM customer',
    "geojson_scan": "SELECT event_id, event_type, (event_id % 360 - 180)::DOUBLE AS x, (user_id % 180 - 90)::DOUBLE AS y FROM events WHERE starts_with(event_type, 'c')",
    "geojson_file_describe": "SELECT count(event_id) AS count, min(event_id)::DOUBLE AS min, max(event_id)::DOUBLE AS max, avg(event_id) AS mean, median(event_id) AS median FROM events",
    "gml_scan": "SELECT c_custkey, (c_custkey % 180)::DOUBLE AS x, c_nationkey::DOUBLE AS y FROM customer WHERE c_mktsegment = 'BUILDING'",
    "polygon_measures": f"SELECT vec_id, round(abs({_SHOELACE.format(a=1, b=8)}) - abs({_SHOELACE.format(a=9, b=12)}), 6) AS area, round({_ALONG.format(a=1, b=7)} + {_ALONG.format(a=9, b=11)}, 6) AS perimeter, {_SHOELACE.format(a=1, b=8)} < 0 AS clockwise, 1::BIGINT AS n_holes FROM {_XY}",
    "pixel_places": "SELECT l_orderkey, l_linenumber, round((l_orderkey % 16384 + l_linenumber * 100 / 4096) / 16384 * 360 - 180, 6) AS x, round(degrees(atan(sinh(pi() * (1 - 2 * (l_partkey % 16384 + l_quantity / 4096) / 16384)))), 6) AS y FROM lineitem",
    "dataset_bounds": "SELECT min(event_id % 360 - 180)::DOUBLE AS x_min, min(user_id % 180 - 90)::DOUBLE AS y_min, max(event_id % 360 - 180)::DOUBLE AS x_max, max(user_id % 180 - 90)::DOUBLE AS y_max FROM events",
} | formats.ORACLES
