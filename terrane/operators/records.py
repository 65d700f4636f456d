"""Attribute filters and descriptive statistics.

Attributes are map<string, struct<kind, text, num, bool>>; a missing key differs from a value of kind null.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, functions as F

from terrane.errors import DescribeOnNonNumericField, FieldNotFound
from terrane.operators.statistics import summary

VALUE = "struct<kind:string,text:string,num:double,bool:boolean>"


def value(kind: str, text=None, num=None, flag=None) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(F.lit(kind).alias("kind"), as_col(text).cast("string").alias("text"), as_col(num).cast("double").alias("num"), as_col(flag).cast("boolean").alias("bool")).cast(VALUE)


def as_text(v: Column) -> Column:
    """A value's text, null for any other kind; so do the two below."""
    return F.when(v["kind"] == "text", v["text"])


def as_number(v: Column) -> Column:
    return F.when(v["kind"] == "numeric", v["num"])


def as_flag(v: Column) -> Column:
    return F.when(v["kind"] == "logical", v["bool"])


def is_numeric(v: Column) -> Column:
    return v["kind"] == "numeric"


def first(df: DataFrame, n: int) -> DataFrame:
    """Each file's first n records."""
    return df.where(F.col("record_number") <= n)


def get(df: DataFrame, index: int) -> DataFrame:
    """Each file's record at index, from 0; no row where there is none."""
    return df.where(F.col("record_number") == index + 1)


def is_empty(df: DataFrame) -> DataFrame:
    """One row: is_empty."""
    return df.limit(1).agg((F.count(F.lit(1)) == 0).alias("is_empty"))


def _known(field: str, declared: Collection[str] | None) -> None:
    if declared is not None and field not in declared:
        raise FieldNotFound(field)


def _no_nan(v: Column) -> Column:
    return ~F.coalesce(F.isnan(v["num"]), F.lit(False))


def equals(attributes: Column, field: str, wanted: Column, declared: Collection[str] | None = None) -> Column:
    """Key present, and kind and payload equal; NaN equals nothing.

    declared: the fields of a table's header; another field raises FieldNotFound, here and below.
    """
    _known(field, declared)
    v = attributes[field]
    return F.coalesce((v == wanted) & _no_nan(v), F.lit(False))


def is_in(attributes: Column, field: str, wanted: list[Column], declared: Collection[str] | None = None) -> Column:
    _known(field, declared)
    v = attributes[field]
    return F.coalesce(F.array_contains(F.array(*wanted), v) & _no_nan(v), F.lit(False)) if wanted else F.lit(False)


def starts_with(attributes: Column, field: str, prefix: str, declared: Collection[str] | None = None) -> Column:
    """Only values of kind text."""
    _known(field, declared)
    v = attributes[field]
    return F.coalesce((v["kind"] == "text") & F.startswith(v["text"], F.lit(prefix)), F.lit(False))


def describe(df: DataFrame, number: Column) -> DataFrame:
    """count, min, max, mean and exact median of the numbers that are there."""
    return summary(df, number, F.lit(True)).drop("found")


def describe_field(df: DataFrame, field: str, declared: dict[str, bool] | None = None) -> DataFrame:
    """describe() of an attribute in one pass, with its checks; no job runs before the result is asked for.

    declared: fields of a table's header and whether they are numeric; without it a field exists if some record has it, and is
    numeric if some value is, and errors come with the result.  A declared field without numbers has count 0 and NaN for the rest.
    """
    _known(field, declared)
    if declared is not None and not declared[field]:
        raise DescribeOnNonNumericField(field)
    s = summary(df, as_number(F.col("attributes")[field]), F.map_contains_key("attributes", F.lit(field)))
    fails = lambda e: F.raise_error(F.lit(f"{e.__name__}: {field}"))
    checked = lambda v: v if declared is not None else F.when(~F.col("found"), fails(FieldNotFound)).when(F.col("count") == 0, fails(DescribeOnNonNumericField)).otherwise(v)
    return s.select(checked(F.col("count")).alias("count"), *(checked(F.coalesce(n, F.lit(float("nan")))).alias(n) for n in ("min", "max", "mean", "median")))


def bounds(df: DataFrame, box: Column) -> DataFrame:
    """The box around all records' boxes; from plus to minus infinity without any."""
    inf = float("inf")
    ends = (("x_min", F.min, inf), ("y_min", F.min, inf), ("x_max", F.max, -inf), ("y_max", F.max, -inf))
    return df.agg(*(F.coalesce(f(box[n]), F.lit(none)).alias(n) for n, f, none in ends))
