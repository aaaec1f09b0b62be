"""Column profiles (PRF-1..5)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldwarden.functions.text import as_text, is_missing, strip
from fieldwarden.operators.values import (
    first_cells,
    literal_rows,
    long_form,
    q,
    representative_sample,
    top_n,
    value_index,
)

NUMERIC_TEXT = r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)"
# Exact quantiles rank a bracket of at most this many rows in the final step.
EXACT_ROWS = 100_000
# Steps in each power of two of the first grid, and the place of the number 1 in it.
OCTAVE_STEPS, OCTAVE_ZERO = 64, 70_000


def _numeric_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    types = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in columns if isinstance(types[c], T.NumericType)]


def _text_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    types = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in columns if isinstance(types[c], T.StringType)]


def _number(df: DataFrame, column: str) -> Column:
    """Numeric cell as double with NaN as missing."""
    dtype = df.schema[column].dataType
    value = q(column).cast("double")
    return F.when(~is_missing(q(column), dtype), value)


@dataclass
class _Bracket:
    """Closed interval that holds a wanted rank, with exact row counts below and inside."""

    column: int
    low: float
    high: float
    below: int
    inside: int


def _numeric_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``c, x``: every number of every column, the column by its place."""
    cells = F.array(*[F.struct(F.lit(i).alias("c"), _number(df, c).alias("x")) for i, c in enumerate(columns)])
    return df.select(F.explode(cells).alias("r")).select("r.c", "r.x").where("x is not null")


def _octave_bucket(x: Column) -> Column:
    """A number that never falls while ``x`` grows, at most 270,000 in all: sign and 64 steps in each power of two."""
    size = F.lit(OCTAVE_ZERO) + F.floor(F.log2(F.abs(x)) * OCTAVE_STEPS)
    ends = F.when(x == float("inf"), 2 * OCTAVE_ZERO).when(x == float("-inf"), -2 * OCTAVE_ZERO)
    return ends.when(x == 0, 0).when(x > 0, size).otherwise(-size).cast("long")


def _hit_buckets(buckets: DataFrame, ranks: Column) -> DataFrame:
    """Buckets ``g, b, n, low, high`` in which some rank falls, with ``below``; the running sum is over buckets, not rows.

    ``ranks`` may use ``g`` and ``total``, the rows of ``g``.
    """
    order = Window.partitionBy("g").orderBy("b")
    counted = buckets.withColumn("below", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    counted = counted.withColumn("total", F.sum("n").over(Window.partitionBy("g")))
    inside = lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("n"))
    return counted.where(F.exists(ranks, inside))


def _steps_in(x: Column, low: float, high: float) -> Column:
    """Which of 65,537 even steps from ``low`` to ``high``; never falls while ``x`` grows."""
    return F.floor((x - F.lit(low)) / F.lit(high - low) * 65_536).cast("long")


def number_ranges(df: DataFrame, columns: Sequence[str], probs: Sequence[float], max_rows: int = EXACT_ROWS) -> list[dict]:
    """``n, low, high, quantiles`` of each numeric column: exact, linearly interpolated, without sorting the table.

    1. One pass counts the numbers of all columns in buckets of a fixed grid (:func:`_octave_bucket`), each with its least
       and greatest number. Running sums over the buckets show which of them hold the wanted ranks.
    2. Buckets with several numbers and more than ``max_rows`` rows are counted again, in even steps between their ends,
       until the step that holds a rank has one number or few rows: once, unless most of the numbers lie in 1 / 65,536 of
       a bucket.
    3. The numbers of the remaining steps are counted by value, and the ranks read off.

    The plan of a pass does not grow with the ranks, no task sorts more than the buckets or ``max_rows`` numbers, and only
    the buckets that were hit reach the driver.
    """
    if not columns:
        return []
    cells = _numeric_cells(df, columns)
    first = cells.groupBy(F.col("c").alias("g"), _octave_bucket(F.col("x")).alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")
    )
    place = lambda p: F.lit(p) * (F.col("total") - 1)
    wanted = [F.least(F.floor(place(p)) + extra, F.col("total") - 1) for p in probs for extra in (0, 1)]
    # the first and last bucket give the ends
    hits = _hit_buckets(first, F.array(*wanted, F.lit(0).cast("long"), F.col("total") - 1)).collect()
    out = [{"n": 0, "low": None, "high": None, "quantiles": [None] * len(probs)} for _ in columns]
    found: dict[tuple[int, int], float] = {}
    open_: dict[tuple[int, int], _Bracket] = {}
    for r in hits:
        own = out[r["g"]]
        own["n"] = r["total"]
        own["low"] = r["low"] if own["low"] is None else min(own["low"], r["low"])
        own["high"] = r["high"] if own["high"] is None else max(own["high"], r["high"])
    ranks = {
        (i, min(int(p * (own["n"] - 1)) + extra, own["n"] - 1)) for i, own in enumerate(out) if own["n"] for p in probs for extra in (0, 1)
    }

    def settle(tag: tuple[int, int], bracket: _Bracket) -> None:
        if bracket.low == bracket.high:
            found[tag] = bracket.low
            open_.pop(tag, None)
        else:
            open_[tag] = bracket

    for r in hits:
        for tag in ranks:
            if tag[0] == r["g"] and r["below"] <= tag[1] < r["below"] + r["n"]:
                settle(tag, _Bracket(r["g"], r["low"], r["high"], r["below"], r["n"]))

    def narrowed(chosen: list[tuple[int, int]], by_value: bool) -> None:
        """One more pass over the numbers of the chosen ranks' brackets."""
        brackets = list({(b.column, b.low, b.high, b.below): None for b in map(open_.get, chosen)})
        of = {key: [t for t in chosen if (open_[t].column, open_[t].low, open_[t].high, open_[t].below) == key] for key in brackets}
        parts = []
        for g, (c, low, high, _) in enumerate(brackets):
            x = _number(df, columns[c])
            step = F.lit(0).cast("long") if by_value else _steps_in(x, low, high)
            own = F.struct(F.lit(g).alias("g"), step.alias("step"), x.alias("x"))
            parts.append(F.when((x >= F.lit(low)) & (x <= F.lit(high)), own))
        inside = df.select(F.explode(F.array_compact(F.array(*parts))).alias("r")).select("r.*")
        keys = [F.col("g"), F.col("x" if by_value else "step").alias("b")]
        counted = inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        asked = F.array(*[F.array(*[F.lit(t[1] - key[3]).cast("long") for t in of[key]]) for key in brackets])
        for r in _hit_buckets(counted, F.get(asked, F.col("g"))).collect():
            key = brackets[r["g"]]
            for t in of[key]:
                if r["below"] <= t[1] - key[3] < r["below"] + r["n"]:
                    settle(t, _Bracket(key[0], r["low"], r["high"], key[3] + r["below"], r["n"]))

    while wide := [t for t, b in open_.items() if b.inside > max_rows]:
        narrowed(wide, by_value=False)
    if open_:
        narrowed(list(open_), by_value=True)
    for i, own in enumerate(out):
        if not own["n"]:
            continue
        own["quantiles"] = []
        for p in probs:
            place_ = p * (own["n"] - 1)
            low = int(place_)
            a, b = found[(i, low)], found[(i, min(low + 1, own["n"] - 1))]
            own["quantiles"].append(a if a == b else a + (b - a) * (place_ - low))
    return out


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], max_rows: int = EXACT_ROWS
) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles of numeric columns, see :func:`number_ranges`."""
    return {c: own["quantiles"] for c, own in zip(columns, number_ranges(df, columns, probs, max_rows), strict=True)}


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """PRF-2: count, min, max and the 1st / 99th percentile per numeric column."""
    names = _numeric_columns(df, columns if columns is not None else df.columns)
    schema = "column string, non_null long, numeric_min double, numeric_max double, p01 double, p99 double"
    if not approximate:
        found = zip(names, number_ranges(df, names, [0.01, 0.99]), strict=True)
        return literal_rows(df.sparkSession, [(c, own["n"], own["low"], own["high"], *own["quantiles"]) for c, own in found if own["n"]], schema)
    fields, aggregates = [], []
    for i, c in enumerate(names):
        x = _number(df, c)
        aggregates += [
            F.count(x).alias(f"n{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"),
            F.percentile_approx(x, F.lit([0.01, 0.99]), F.lit(10_000)).alias(f"p{i}"),
        ]
        fields.append(
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"n{i}").alias("non_null"),
                F.col(f"lo{i}").alias("numeric_min"),
                F.col(f"hi{i}").alias("numeric_max"),
                F.col(f"p{i}")[0].alias("p01"),
                F.col(f"p{i}")[1].alias("p99"),
            )
        )
    return df.agg(*aggregates).select(F.explode(F.array(*fields)).alias("r")).select("r.*").where("non_null > 0")


def text_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """PRF-3: lengths, numeric-looking share and trimmed share per text column.

    The length percentile keeps one counter per distinct length, which the
    longest text bounds; everything is one partial aggregation.
    """
    names = _text_columns(df, columns if columns is not None else df.columns)
    aggregates, fields = [], []
    for i, c in enumerate(names):
        text = q(c)
        length = F.length(text)
        numeric = F.regexp_extract(text, r"(?U)\A(?:" + NUMERIC_TEXT + r"\z|)", 0) != ""
        trimmed = text == strip(text)
        aggregates += [
            F.count(text).alias(f"n{i}"),
            F.min(length).alias(f"lo{i}"),
            F.max(length).alias(f"hi{i}"),
            F.percentile(length, F.lit(0.95)).alias(f"p{i}"),
            F.count_if(numeric).alias(f"num{i}"),
            F.count_if(trimmed).alias(f"trim{i}"),
        ]
        fields.append(
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"n{i}").alias("non_null"),
                F.col(f"lo{i}").alias("len_min"),
                F.col(f"hi{i}").alias("len_max"),
                F.col(f"p{i}").alias("len_p95"),
                F.bround(F.col(f"num{i}") / F.col(f"n{i}") * 100, 2).alias("numeric_parse_pct"),
                F.bround(F.col(f"trim{i}") / F.col(f"n{i}") * 100, 2).alias("trimmed_pct"),
            )
        )
    return df.agg(*aggregates).select(F.explode(F.array(*fields)).alias("r")).select("r.*").where("non_null > 0")


def common_profile(
    df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False
) -> DataFrame:
    """PRF-1 without examples: type, rows, filled, null share, distinct values and share."""
    names = list(columns) if columns is not None else list(df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(names):
        aggregates.append(F.count_if(~is_missing(q(c), types[c])).alias(f"n{i}"))
        if approximate:
            aggregates.append(F.approx_count_distinct(as_text(q(c), types[c]), 0.01).alias(f"d{i}"))
    fields = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(types[c].simpleString()).alias("dtype"),
            F.col("rows").alias("rows"),
            F.col(f"n{i}").alias("non_null"),
            (F.col(f"d{i}") if approximate else F.lit(None).cast("long")).alias("distinct"),
        )
        for i, c in enumerate(names)
    ]
    base = df.agg(*aggregates).select(F.explode(F.array(*fields)).alias("r")).select("r.*")
    if not approximate:
        exact = distinct_counts(df, names)
        base = base.drop("distinct").join(F.broadcast(exact), "column", "left")
    return base.select(
        "column", "dtype", "rows", "non_null",
        F.when(F.col("rows") > 0, F.bround((F.col("rows") - F.col("non_null")) / F.col("rows") * 100, 2))
        .otherwise(0.0).alias("null_pct"),
        F.coalesce("distinct", F.lit(0)).alias("distinct"),
        F.when(F.col("non_null") > 0, F.bround(F.coalesce("distinct", F.lit(0)) / F.col("non_null") * 100, 2))
        .otherwise(0.0).alias("distinct_pct"),
    )


def _short_cells(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Cells with long texts replaced by their SHA-256, so counting does not shuffle whole texts."""
    value = F.col("value")
    return long_form(df, names).select(
        "source", "column",
        F.when(F.length(value) > 64, F.concat(F.lit("\u0000"), F.sha2(value, 256))).otherwise(value).alias("value"),
        "rid",
    )


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact distinct values per column from one shared grouping."""
    return (
        _short_cells(df, columns)
        .groupBy("column", "value").agg(F.lit(1).alias("one"))
        .groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))
    )


def few_valued(df: DataFrame, columns: Sequence[str], most: int) -> list[str]:
    """Columns that may have at most ``most`` distinct texts; those that surely have more than twice as many are left out.

    While few of its 512 registers are hit, the estimate is a count of those that are not: d values hit at most d of them,
    so up to 200 values it comes out at most at 512 * ln(512 / (512 - d)), less than twice their number.
    """
    if not columns or most > 200:
        return list(columns)
    seen = df.agg(*[F.approx_count_distinct(q(c), 0.05).alias(f"d{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if seen[f"d{i}"] <= 2 * most]


def top_values(df: DataFrame, columns: Sequence[str] | None = None, n: int = 8, max_distinct: int = 50) -> DataFrame:
    """PRF-4: most frequent values of columns with few distinct ones: ``column, value, cnt, rank``.

    Columns with many values drop out after one pass of sketches; of the others a task sends a few values each.
    """
    names = few_valued(df, _text_columns(df, columns if columns is not None else df.columns), max_distinct)
    if not names:
        return literal_rows(df.sparkSession, [], "column string, value string, cnt long, rank int")
    index = value_index(long_form(df, names)).select("column", "value", "cnt")
    # One bounded ranking decides both questions: who leads, and is there a 51st value.
    ranked = top_n(index, ["column"], [F.desc("cnt"), F.col("value")], max_distinct + 1, ["value"], "rank")
    wide = ranked.groupBy("column").agg(F.max("rank").alias("shown")).where(F.col("shown") > max_distinct)
    return ranked.where(F.col("rank") <= n).join(F.broadcast(wide), "column", "left_anti")


def profile(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    order_by: str | Sequence[str] | None = None,
    samples: int = 5,
    top: int = 8,
    approximate: bool = False,
) -> DataFrame:
    """PRF-1..4 joined: one row per column."""
    names = list(columns) if columns is not None else list(df.columns)
    out = common_profile(df, names, approximate)
    firsts = first_cells(long_form(df, names, order_by), samples).select(
        "column", F.col("values").alias("sample_values")
    )
    out = out.join(firsts, "column", "left")
    numeric, text = _numeric_columns(df, names), _text_columns(df, names)
    if numeric:
        out = out.join(F.broadcast(numeric_profile(df, numeric, approximate).drop("non_null")), "column", "left")
    if text:
        out = out.join(F.broadcast(text_profile(df, text).drop("non_null")), "column", "left")
        leaders = (
            top_values(df, text, top)
            .groupBy("column")
            .agg(F.sort_array(F.collect_list(F.struct("rank", "value", "cnt"))).alias("t"))
            .select("column", F.transform("t", lambda r: F.struct(r["value"].alias("value"), r["cnt"].alias("count"))).alias("top_values"))
        )
        out = out.join(leaders, "column", "left")
    return out


def dataset_profile(
    df: DataFrame,
    order_by: str | None = None,
    max_columns: int | None = None,
    representative: bool = False,
    batch_size: int | None = None,
    samples: int = 5,
    top: int = 8,
) -> DataFrame:
    """PRF-5: table header fields repeated on the column rows.

    Every column, or the first ``max_columns``; with ``batch_size`` every
    column, numbered by batch.  ``representative`` profiles the head, middle and
    tail rows only (needs a unique ``order_by``).
    """
    rows = df.count()
    frame = representative_sample(df, order_by) if representative else df
    sampled = min(rows, 1000) if representative else rows
    names = list(df.columns) if batch_size else list(df.columns)[:max_columns]
    batches = literal_rows(
        df.sparkSession,
        [(c, i // batch_size if batch_size else 0, i) for i, c in enumerate(names)],
        "column string, batch int, position int",
    )
    return (
        profile(frame, names, order_by, samples, top)
        .join(F.broadcast(batches), "column")
        .withColumn("row_count", F.lit(rows).cast("long"))
        .withColumn("profile_sample_rows", F.lit(sampled).cast("long"))
        .withColumn("column_count", F.lit(len(df.columns)))
    )
