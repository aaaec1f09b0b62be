"""Profiles as stored state that merges over partitions, days and runs (PRF-1, PRF-2, PRF-3, PRF-5).

A state has a row for each column (and for each value of the caller's keys): counts, ends and sums that are exact, beside a
HyperLogLog sketch of the distinct texts and KLL sketches of numbers and text lengths. States of parts are merged by one
small aggregation, so a table that grows by a day is profiled by reading that day.

Exact after any merge: rows, filled cells and their share, numeric and length ends, mean, numeric-looking and trimmed share.
Estimated: distinct values (standard error 1.04 / sqrt(2^lg_k), 0.8 % for the default, merged or not; a merged sketch is read
by another formula than one that saw every value, so the two can differ within that error) and quantiles (rank error below
0.5 % with 99 % confidence for the default k of 600; a merged sketch keeps that bound).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldwarden.functions.text import as_text, is_missing, strip
from fieldwarden.operators.profile import NUMERIC_TEXT
from fieldwarden.operators.values import q

LG_K, KLL_K = 14, 600
#: Counts that add up, ends that are compared, and sketches, with the function that merges each.
_MERGES = {
    "rows": F.sum, "non_null": F.sum, "total": F.sum, "numeric_like": F.sum, "trimmed": F.sum,
    "low": F.min, "high": F.max, "len_min": F.min, "len_max": F.max,
    "values": F.hll_union_agg, "numbers": F.kll_merge_agg_double, "lengths": F.kll_merge_agg_bigint,
}


def _column_state(name: str, dtype: T.DataType) -> dict[str, Column]:
    """The aggregates of one column; those that do not apply are null."""
    cell = q(name)
    filled = ~is_missing(cell, dtype)
    text = F.when(filled, as_text(cell, dtype))
    none = F.lit(None)
    out = {
        "rows": F.count(F.lit(1)),
        "non_null": F.count_if(filled),
        "values": F.hll_sketch_agg(text, LG_K),
        "total": none.cast("double"), "low": none.cast("double"), "high": none.cast("double"), "numbers": none.cast("binary"),
        "len_min": none.cast("int"), "len_max": none.cast("int"), "lengths": none.cast("binary"),
        "numeric_like": none.cast("long"), "trimmed": none.cast("long"),
    }
    if isinstance(dtype, T.NumericType):
        number = F.when(filled, cell.cast("double"))
        out |= {"total": F.sum(number), "low": F.min(number), "high": F.max(number), "numbers": F.kll_sketch_agg_double(number, KLL_K)}
    if isinstance(dtype, T.StringType):
        length = F.length(cell)
        numeric = F.regexp_extract(cell, r"(?U)\A(?:" + NUMERIC_TEXT + r"\z|)", 0) != ""
        out |= {
            "len_min": F.min(length), "len_max": F.max(length), "lengths": F.kll_sketch_agg_bigint(length.cast("long"), KLL_K),
            "numeric_like": F.count_if(numeric), "trimmed": F.count_if(cell == strip(cell)),
        }
    return out


def profile_state(df: DataFrame, columns: Sequence[str] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """``*keys, column, dtype, position`` and the state of each column; one pass, a task sends one row for each key."""
    names = [c for c in (columns if columns is not None else df.columns) if c not in keys]
    types = {f.name: f.dataType for f in df.schema.fields}
    states = {c: _column_state(c, types[c]) for c in names}
    aggregates = [a.alias(f"{k}__{i}") for i, c in enumerate(names) for k, a in states[c].items()]
    wide = df.groupBy(*[q(k) for k in keys]).agg(*aggregates)
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"), F.lit(types[c].simpleString()).alias("dtype"), F.lit(i).alias("position"),
                *[F.col(f"{k}__{i}").alias(k) for k in states[c]],
            )
            for i, c in enumerate(names)
        ]
    )
    return wide.select(*[q(k) for k in keys], F.explode(rows).alias("r")).select(*[q(k) for k in keys], "r.*")


def merged_state(states: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One state for each column (and each value of ``keys``) from any number of states of parts.

    A column that has changed its type is a column of its own for each type.
    """
    own = ["column", "dtype"]
    merged = states.groupBy(*[q(k) for k in keys], *own).agg(
        F.min("position").alias("position"), *[merge(F.col(name)).alias(name) for name, merge in _MERGES.items()]
    )
    order = [*keys, *own, "position", *[f for f in states.columns if f in _MERGES]]
    return merged.select(*[q(c) for c in order])


def _quantile(sketch: str, probability: float, kind: str) -> Column:
    get = F.kll_sketch_get_quantile_double if kind == "double" else F.kll_sketch_get_quantile_bigint
    n = F.kll_sketch_get_n_double if kind == "double" else F.kll_sketch_get_n_bigint
    return F.when(n(sketch) > 0, get(sketch, F.lit(probability)))


def profile_of(states: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """PRF-1 to PRF-3 read off the states: exact columns as in :func:`profile`, estimates named ``approx_*``."""
    share = lambda part, whole: F.when(F.col(whole) > 0, F.bround(part / F.col(whole) * 100, 2))
    return states.select(
        *[q(k) for k in keys], "column", "dtype", "position", "rows", "non_null",
        F.coalesce(share(F.col("rows") - F.col("non_null"), "rows"), F.lit(0.0)).alias("null_pct"),
        F.coalesce(F.hll_sketch_estimate("values"), F.lit(0)).alias("approx_distinct"),
        F.col("low").alias("numeric_min"), F.col("high").alias("numeric_max"),
        F.when(F.col("non_null") > 0, F.col("total") / F.col("non_null")).alias("numeric_mean"),
        _quantile("numbers", 0.01, "double").alias("approx_p01"), _quantile("numbers", 0.99, "double").alias("approx_p99"),
        "len_min", "len_max", _quantile("lengths", 0.95, "bigint").alias("approx_len_p95"),
        share(F.col("numeric_like"), "non_null").alias("numeric_parse_pct"), share(F.col("trimmed"), "non_null").alias("trimmed_pct"),
    )


__all__ = ["profile_state", "merged_state", "profile_of", "LG_K", "KLL_K"]
