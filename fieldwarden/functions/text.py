"""Text expressions whose results equal the usual Python string operations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPACE = r"[\s\x1c-\x1f]"


def strip(value: Column) -> Column:
    """Unicode strip; the regular expression only runs on padded values."""
    ends = F.concat(F.substring(value, 1, 1), F.substring(value, -1, 1))
    trimmed = F.regexp_replace(value, rf"(?U)\A{_SPACE}+|{_SPACE}+\z", "")
    return F.when(ends.rlike(rf"(?U){_SPACE}"), trimmed).otherwise(value)


def has_more_than_three_words(stripped: Column) -> Column:
    """More than three whitespace-separated words in a stripped text."""
    return stripped.rlike(r"(?U)\S\s+\S+\s+\S+\s+\S")


def lines(text: Column) -> Column:
    """Array of lines, any line-break convention."""
    return F.split(text, r"\R", -1)


def lit_strings(items) -> Column:
    return F.array(*[F.lit(i) for i in items])


def _float_text(value: Column) -> Column:
    """Shortest decimal text, positional between 1e-4 and 1e16, then ``1e+16`` / ``1e-05``."""
    plain = value.cast("string")
    size = F.abs(value)
    unpad = lambda c: F.regexp_replace(c, r"(\.\d+?)0+\z", "$1")
    large = unpad(value.cast("decimal(38,9)").cast("string"))
    small = unpad(value.cast("decimal(38,21)").cast("string"))
    science = F.regexp_replace(plain, r"\.0E", "E")
    science = F.regexp_replace(science, r"E(\d)", "e+$1")
    science = F.regexp_replace(science, r"E-(\d)\z", "e-0$1")
    science = F.regexp_replace(science, r"E-", "e-")
    return (
        F.when(F.isnan(value), None)
        .when((size == 0) | ((size >= 1e-3) & (size < 1e7)), plain)
        .when((size >= 1e7) & (size < 1e16), large)
        .when((size >= 1e-4) & (size < 1e-3), small)
        .when(size == float("inf"), F.when(value > 0, "inf").otherwise("-inf"))
        .otherwise(science)
    )


def as_text(value: Column, dtype: T.DataType) -> Column:
    """Text of a typed cell; NaN counts as missing, booleans read ``True``/``False``."""
    if isinstance(dtype, T.StringType):
        return value
    if isinstance(dtype, T.BooleanType):
        return F.when(value, "True").when(~value, "False")
    if isinstance(dtype, T.DoubleType):
        return _float_text(value)
    if isinstance(dtype, T.FloatType):
        return F.when(F.isnan(value), None).otherwise(value.cast("string"))
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.to_json(value)
    return value.cast("string")


def is_missing(value: Column, dtype: T.DataType) -> Column:
    """Null, or NaN for floating-point columns."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return value.isNull() | F.isnan(value)
    return value.isNull()
