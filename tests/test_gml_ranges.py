"""GML files in ranges of any size give the records of the whole file."""

import pytest

from terrane import errors
from terrane.sources import gml, splitxml
from tests.test_sources import fails
from pyspark.sql import functions as F

LINE = "<gml:LineString><gml:posList>{0} {0} {1} {1}</gml:posList></gml:LineString>"
SURFACE = "<gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>0 0 0 {0} {0} {0} 0 0</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon>"
TWO = f"<gml:MultiSurface><gml:surfaceMember>{SURFACE}</gml:surfaceMember><gml:surfaceMember>{SURFACE}</gml:surfaceMember></gml:MultiSurface>"


def _members():
    for k in range(40):
        shape = [LINE.format(k, k + 1), TWO.format(k + 1), "", LINE.format("x", 1), f"<gml:Point><gml:pos>{k} 3</gml:pos></gml:Point>"][k % 5]
        odd = ["", "<!-- </gml:featureMember> <gml:featureMember> -->", "<k:t><![CDATA[</gml:featureMember>]]>x</k:t>", "<?pi </gml:featureMember><gml:featureMember> ?>", "<k:t>é --> ]]&gt; ?></k:t>", "<k:none/>"][k % 6]
        yield f'<gml:featureMember{" a=\'>\'" if k % 7 == 0 else ""}{chr(10) if k % 4 == 0 else ""}>{odd}<k:R gml:id="r{k}"><k:id>{k}</k:id>{odd}<k:p>{shape}</k:p></k:R></gml:featureMember>'


def _documents():
    root = '<k:D xmlns:gml="g" xmlns:k="k">'
    body = list(_members())
    box = "<gml:boundedBy><gml:Envelope><gml:lowerCorner>1 2</gml:lowerCorner><gml:upperCorner>3 4</gml:upperCorner></gml:Envelope></gml:boundedBy>"
    yield "plain", f'<?xml version="1.0" encoding="UTF-8"?>\n{root}{box}{"".join(body)}</k:D>'.encode()
    yield "layers", f'{root}<k:layer>{" ".join(body[:9])}</k:layer><!-- <gml:featureMember> --><k:layer>{body[9]}</k:layer><gml:featureMember/>{body[10]}</k:D>'.encode()
    yield "latin", f'<?xml version="1.0" encoding="ISO-8859-1"?>{root}{"".join(body)}</k:D>'.encode("latin-1")
    yield "nested", f"{root}<gml:featureMember><k:A><k:v>1</k:v><gml:featureMember><k:B/></gml:featureMember></k:A></gml:featureMember>{body[3]}{body[4]}</k:D>".encode()
    yield "plural", f"{root}<gml:featureMembers><k:A><k:v>1</k:v></k:A><k:B><k:v>2</k:v></k:B></gml:featureMembers></k:D>".encode()
    yield "typed", f'<!DOCTYPE D [<!ENTITY e "12">]>{root}<gml:featureMember><k:A><k:v>&e;</k:v></k:A></gml:featureMember></k:D>'.encode()
    yield "wide", f'<?xml version="1.0" encoding="UTF-16"?>{root}{body[0]}</k:D>'.encode("utf-16")
    yield "none", f"{root}</k:D>".encode()


def _flat(r):
    value = {k: (v.kind, v.text, v.num) for k, v in r.attributes.items()}
    return r.record_number, r.geometry.type, r.geometry.parts and [[tuple(p) for p in part] for part in r.geometry.parts], value


@pytest.mark.parametrize("size", [13, 60, 1000, 100_000])
def test_any_ranges(spark, tmp_path, size, monkeypatch):
    monkeypatch.setattr(splitxml, "TOGETHER", 700)
    for name, doc in _documents():
        (tmp_path / f"{name}.gml").write_bytes(doc)
    whole = gml.read_gml(spark, str(tmp_path))
    rows = lambda df: sorted((r.path, *_flat(r)) for r in df.select("*").collect())
    want = rows(whole)
    assert len({w[0] for w in want}) == 7 and len(want) > 100
    assert rows(gml.read_gml(spark, str(tmp_path), range_bytes=size)) == want


def test_many_tasks_read_one_file(spark, tmp_path):
    body = "".join(f"<gml:featureMember><k:A><k:v>{k}</k:v></k:A></gml:featureMember>" for k in range(4000))
    (tmp_path / "x.gml").write_text(f'<k:D xmlns:gml="g" xmlns:k="k">{body}</k:D>')
    got = gml.read_gml(spark, str(tmp_path), range_bytes=1 << 14)
    v = F.col("attributes")["v"]["num"]
    assert got.where(v + 1 == F.col("record_number")).count() == 4000
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 4


@pytest.mark.parametrize("doc", ["<D><gml:featureMember><k:A>", "<D><gml:featureMember><k:A></k:B></gml:featureMember></D>", "<D><!-- <gml:featureMember></gml:featureMember></D>"])
def test_errors_in_ranges(spark, tmp_path, doc):
    (tmp_path / "x.gml").write_text(doc)
    fails(errors.InvalidGml, lambda: gml.read_gml(spark, str(tmp_path), range_bytes=16).collect())
