"""GeoJSON decoded by Python's own JSON reader, one document at a time: what the readers have to equal."""

import json


def _point(c):
    if not isinstance(c, list) or len(c) < 2 or any(isinstance(v, bool) or not isinstance(v, (int, float)) for v in c[:2]):
        raise ValueError("position")
    return float(c[0]), float(c[1])


def _nested(c, depth):
    if not depth:
        return _point(c)
    if not isinstance(c, list):
        raise ValueError("list")
    return [_nested(x, depth - 1) for x in c]


DEPTHS = {"Point": (0, "Point"), "MultiPoint": (1, "MultiPoint"), "LineString": (1, "Polyline"), "MultiLineString": (2, "Polyline"), "Polygon": (2, "Polygon"), "MultiPolygon": (3, "Polygon")}


def _geometries(value):
    if value is None:
        return [("Null", None)]
    depth, kind = DEPTHS[value["type"]]
    found = _nested(value["coordinates"], depth)
    if value["type"] == "MultiPolygon":
        return [(kind, rings) for rings in found]
    return [(kind, [[found]] if depth == 0 else [found] if depth == 1 else found)]


def _property(v):
    if v is None:
        return "null", None
    if isinstance(v, bool):
        return "logical", v
    if isinstance(v, (int, float)):
        return "numeric", float(v)
    return "text", v if isinstance(v, str) else json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def records(document):
    """(number, kind, parts, {key: (kind, value)}) of each record."""
    root = json.loads(document)
    features = root["features"] if root["type"] == "FeatureCollection" else [root] if root["type"] == "Feature" else [{"geometry": root}]
    out = []
    for f in features:
        f = f if isinstance(f, dict) else {}
        properties = f.get("properties")
        attributes = {k: _property(v) for k, v in properties.items()} if isinstance(properties, dict) else {}
        out += [(kind, parts, attributes) for kind, parts in _geometries(f.get("geometry"))]
    return [(k, *r) for k, r in enumerate(out, 1)]


def of_row(r):
    """A record's row in the same form."""
    value = lambda v: (v.kind, {"text": v.text, "date": v.text, "numeric": v.num, "logical": v.bool}.get(v.kind))
    parts = r.geometry.parts and [[(p.x, p.y) for p in part] for part in r.geometry.parts]
    return r.record_number, r.geometry.type, parts if r.geometry.parts is not None else None, {k: value(v) for k, v in r.attributes.items()}
