"""Each registered query against its SQL."""

import duckdb
import pytest

from terrane.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "embeddings", "lineitem", "orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert _close(got[cols], want[cols])


def _close(a, b):
    a, b = (x.apply(lambda c: c.astype(float) if c.dtype.kind in "iufb" else c).sort_values(list(x.columns)).reset_index(drop=True) for x in (a, b))
    if a.shape != b.shape:
        return False
    missing = [a[c].isna() & b[c].isna() for c in a.columns]
    same = [none | ((a[c] - b[c]).abs().lt(1e-5) if a[c].dtype.kind == "f" else a[c] == b[c]) for c, none in zip(a.columns, missing, strict=True)]
    return all(x.all() for x in same)
