"""The statistics of fields against sorted numbers."""

import math
import struct

import numpy as np
import pytest

from terrane.operators import records as r
from terrane.operators.statistics import digits
from pyspark.sql import functions as F

INF, NAN = math.inf, math.nan
ENDS = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308, INF, -INF, 1.0, -1.0, 1.0000000000000002, 0.9999999999999999, 2.0**52, 2.0**53 - 1, 4.0, 3.9999999999999996, 8.0, 7.999999999999999]


def _order(v):
    return math.isnan(v), v


def _want(values):
    numbers = sorted((v for v in values if v is not None), key=_order)
    n = len(numbers)
    if not n:
        return 0, None, None, None
    low, high = numbers[(n - 1) // 2], numbers[n // 2]
    return n, numbers[0], numbers[-1], low if low == high else low * 0.5 + high * 0.5


def _same(a, b):
    return a == b or a is not None and b is not None and math.isnan(a) and math.isnan(b)


def _cases():
    rng = np.random.default_rng(2)
    bits = [struct.unpack("<d", rng.bytes(8))[0] for _ in range(501)]
    yield from ([], [None], [None, 3.0], [1.0, None, 2.0], [NAN], [1.0, NAN], [1.0, 2.0, NAN], [INF, -INF], [0.0, -0.0, -1.0], ENDS, ENDS[:-1], bits, bits[:-1], [7.5] * 40 + [8.0] * 40, [7.5] * 41 + [8.0] * 40)
    yield [float(x) for x in rng.normal(size=400).round(2)] + [None] * 30


@pytest.mark.parametrize("values", list(_cases()))
def test_describe(spark, values):
    got = r.describe(spark.createDataFrame([(v,) for v in values], "v double").repartition(3), F.col("v")).collect()
    assert len(got) == 1 and all(_same(a, b) for a, b in zip((got[0]["count"], got[0]["min"], got[0]["max"], got[0]["median"]), _want(values), strict=True))
    numbers = [v for v in values if v is not None]
    if numbers and all(abs(v) < 1e100 for v in numbers):
        assert math.isclose(got[0]["mean"], math.fsum(numbers) / len(numbers), rel_tol=1e-12, abs_tol=1e-12)


def test_digits_are_ordered(spark):
    rng = np.random.default_rng(6)
    values = sorted({*ENDS, *(struct.unpack("<d", rng.bytes(8))[0] for _ in range(3000))} - {NAN}, key=_order)
    values = [v for v in values if not math.isnan(v)] + [NAN]
    first, fraction = digits(F.col("v"))
    got = [tuple(x) for x in spark.createDataFrame(list(enumerate(values)), "k long, v double").repartition(3).select("k", first, fraction).orderBy("k").collect()]
    assert all(a[1:] < b[1:] for a, b in zip(got, got[1:], strict=False))


def test_describe_field_runs_no_job(spark):
    df = spark.createDataFrame([(1,)], "k int").select(F.create_map(F.lit("a"), r.value("numeric", None, F.raise_error(F.lit("a job ran")).cast("double"))).alias("attributes"))
    r.describe_field(df, "a")


def test_values_are_read_once(spark):
    """All rounds share one shuffle of the counted values."""
    plan = r.describe(spark.range(1000).select(F.col("id").cast("double").alias("v")), F.col("v"))
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    final = text[: text.index("Initial Plan")] if "Initial Plan" in text else text
    assert final.count("Range (0, 1000") == 1
