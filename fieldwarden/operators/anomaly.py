"""Anomalous values per column with an isolation forest (ANO-1..5).

With one feature a tree of an isolation forest (Liu, Ting and Zhou, 2008) is a
step function of the value.  A column's forest therefore collapses to one
sorted list of break points with a score per interval: it is fitted on a
bounded uniform sample, the whole table is then only counted into those
intervals, and the contamination threshold follows exactly from the counts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldwarden.functions.text import as_text, is_missing
from fieldwarden.operators.values import literal_rows, long_form, q, row_key, top_n, value_index

# Forest size, sample per tree, smallest column.
TREES = 100
TREE_ROWS = 256
MIN_ROWS = 10
CONTAMINATION = 0.05
SEED = 42
POOL_ROWS = TREES * TREE_ROWS
COLUMNS_PER_MODEL_BATCH = 32

RESULT_SCHEMA = (
    "column string, anomalous_row_count long, total_rows long, anomaly_pct double, explanation string, "
    "sample_anomalous_values array<string>"
)
_FIT_SCHEMA = "column string, breaks array<double>, scores array<double>, center double"
_BIN_SCHEMA = "column string, bin int, cnt long, dev double, dev2 double"
_FLAG_SCHEMA = (
    "column string, flagged long, explanation string, lows array<double>, highs array<double>"
)


def average_path(n: float) -> float:
    """Mean path length of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _tree(sorted_values: np.ndarray, rng: np.random.Generator, limit: int) -> tuple[list[float], list[float]]:
    """Break points and leaf path lengths, left to right."""
    breaks: list[float] = []
    paths: list[float] = []

    def grow(lo: int, hi: int, depth: int) -> None:
        low, high = sorted_values[lo], sorted_values[hi - 1]
        if depth >= limit or hi - lo <= 1 or low == high:
            paths.append(depth + average_path(hi - lo))
            return
        cut = rng.uniform(low, high)
        middle = lo + int(np.searchsorted(sorted_values[lo:hi], cut, side="right"))
        middle = min(max(middle, lo + 1), hi - 1)
        grow(lo, middle, depth + 1)
        breaks.append(cut)
        grow(middle, hi, depth + 1)

    grow(0, len(sorted_values), 0)
    return breaks, paths


def fit_forest(draw, size: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Step function of a forest: interval ends and the anomaly score of each interval.

    ``draw(rng, k)`` returns ``k`` sampled values.  Interval ``i`` covers values
    above ``breaks[i - 1]`` up to and including ``breaks[i]``.
    """
    rng = np.random.default_rng(seed)
    rows = min(TREE_ROWS, size)
    limit = int(math.ceil(math.log2(max(rows, 2))))
    trees = [_tree(np.sort(draw(rng, rows)), rng, limit) for _ in range(TREES)]
    breaks = np.unique(np.concatenate([np.asarray(b, dtype=float) for b, _ in trees] or [np.empty(0)]))
    ends = np.append(breaks, np.inf)
    path = np.zeros(len(ends))
    for b, p in trees:
        path += np.asarray(p)[np.searchsorted(np.asarray(b, dtype=float), ends, side="left")]
    norm = average_path(rows) or 1.0
    return breaks, np.power(2.0, -(path / TREES) / norm)


def weighted_quantile(values: np.ndarray, weights: np.ndarray, p: float) -> float:
    """Linear-interpolated quantile of values repeated by integer weights."""
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(weights[order])
    rank = p * (upto[-1] - 1)
    low = math.floor(rank)
    a = values[order][np.searchsorted(upto, low, side="right")]
    b = values[order][np.searchsorted(upto, min(low + 1, upto[-1] - 1), side="right")]
    return float(a + (b - a) * (rank - low))


def _flag_row(column: str, flagged: int, text: str, odd: np.ndarray, low: np.ndarray, high: np.ndarray) -> pd.DataFrame:
    """One result row; neighbouring flagged intervals are merged."""
    at = np.flatnonzero(odd)
    runs = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1)
    lows = [float(low[r[0]]) for r in runs]
    highs = [float(high[r[-1]]) for r in runs]
    return pd.DataFrame(
        {"column": [column], "flagged": [flagged], "explanation": [text], "lows": [lows], "highs": [highs]}
    )


def _no_flags() -> pd.DataFrame:
    names = ("column", "flagged", "explanation", "lows", "highs")
    return pd.DataFrame({n: pd.Series(dtype=object) for n in names})


def _held(flags: DataFrame) -> DataFrame:
    """Model verdicts as a local table, so later passes do not refit; one row per column."""
    return flags.sparkSession.createDataFrame(flags.collect(), _FLAG_SCHEMA)


def _is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def _as_double(value: Column, dtype: T.DataType) -> Column:
    number = value.cast("int").cast("double") if isinstance(dtype, T.BooleanType) else value.cast("double")
    return F.when(~is_missing(value, dtype), number)


def _numeric_pool(df: DataFrame, sizes: dict[str, int], order_by) -> DataFrame:
    """About ``POOL_ROWS`` uniformly chosen values per column (all when fewer)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    names = list(sizes)
    share = {c: min(1.0, POOL_ROWS / n) for c, n in sizes.items()}
    numbers = [_as_double(q(c), types[c]).alias(f"x{i}") for i, c in enumerate(names)]
    rows = df.select(F.struct(row_key(order_by, types)).alias("rid"), *numbers)
    chance = F.pmod(F.xxhash64("*", F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.select("*", chance.alias("chance")).where(F.col("chance") < max(share.values()))
    parts = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"x{i}").alias("x"), F.lit(share[c]).alias("share"))
            for i, c in enumerate(names)
        ]
    )
    return (
        rows.select("chance", F.explode(parts).alias("p"))
        .where(F.col("p.x").isNotNull() & (F.col("chance") < F.col("p.share")))
        .select("p.column", "p.x")
    )


def _fit_pool(key, pdf):
    pool = np.sort(pdf["x"].to_numpy())  # sorted first, so task order does not change the draw
    breaks, scores = fit_forest(lambda rng, k: rng.choice(pool, k, replace=False), len(pool))
    return pd.DataFrame(
        {"column": [key[0]], "breaks": [breaks.tolist()], "scores": [scores.tolist()], "center": [float(pool.mean())]}
    )


def _count_into_bins(df: DataFrame, models: dict[str, tuple[np.ndarray, float]]) -> DataFrame:
    """Rows per interval and column; each task returns one small histogram."""
    types = {f.name: f.dataType for f in df.schema.fields}
    names = list(models)
    narrow = df.select(*[_as_double(q(c), types[c]).alias(f"c{i}") for i, c in enumerate(names)])

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = [len(models[c][0]) + 1 for c in names]
        counts = [np.zeros(s, dtype=np.int64) for s in sizes]
        first = [np.zeros(s) for s in sizes]
        second = [np.zeros(s) for s in sizes]
        for batch in batches:
            for i, c in enumerate(names):
                breaks, center = models[c]
                x = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
                where = np.searchsorted(breaks, x, side="left")
                off = x - center
                counts[i] += np.bincount(where, minlength=sizes[i])
                first[i] += np.bincount(where, weights=off, minlength=sizes[i])
                second[i] += np.bincount(where, weights=off * off, minlength=sizes[i])
        for i, c in enumerate(names):
            used = np.flatnonzero(counts[i])
            yield pa.RecordBatch.from_pydict(
                {
                    "column": pa.array([c] * len(used), pa.string()),
                    "bin": pa.array(used.astype(np.int32)),
                    "cnt": pa.array(counts[i][used]),
                    "dev": pa.array(first[i][used]),
                    "dev2": pa.array(second[i][used]),
                }
            )

    return (
        narrow.mapInArrow(histogram, _BIN_SCHEMA)
        .groupBy("column", "bin")
        .agg(F.sum("cnt").alias("cnt"), F.sum("dev").alias("dev"), F.sum("dev2").alias("dev2"))
    )


def explain_numeric(mean: float, std: float, flagged_mean: float) -> str:
    """ANO-3: how far the flagged values lie from the rest, in deviations of the rest."""
    if not std:
        return "All other rows hold one and the same value."
    distance = (flagged_mean - mean) / std
    return (
        f"{abs(distance):.1f} standard deviations {'above' if distance > 0 else 'below'} the others: "
        f"mean {flagged_mean:.2f} against {mean:.2f} (deviation {std:.2f})."
    )


def _numeric_flags(df: DataFrame, sizes: dict[str, int], contamination: float, order_by) -> DataFrame:
    fitted = _numeric_pool(df, sizes, order_by).groupBy("column").applyInPandas(_fit_pool, _FIT_SCHEMA).collect()
    models = {r["column"]: (np.asarray(r["breaks"]), np.asarray(r["scores"]), r["center"]) for r in fitted}
    bins = _count_into_bins(df, {c: (b, m) for c, (b, _, m) in models.items()})

    def flag(key, pdf):
        breaks, scores, center = models[key[0]]
        score = -scores[pdf["bin"].to_numpy()]
        cnt = pdf["cnt"].to_numpy()
        odd = score < weighted_quantile(score, cnt, contamination)
        flagged = int(cnt[odd].sum())
        if not flagged:
            return _no_flags()
        n, s1, s2 = cnt[~odd].sum(), pdf["dev"][~odd].sum(), pdf["dev2"][~odd].sum()
        std = math.sqrt(max(0.0, (s2 - s1 * s1 / n) / (n - 1))) if n > 1 else float("nan")
        text = explain_numeric(center + s1 / n, std, center + pdf["dev"][odd].sum() / flagged)
        flags = np.zeros(len(breaks) + 1, dtype=bool)
        flags[pdf["bin"].to_numpy()[odd]] = True
        low = np.append(-np.inf, breaks)
        high = np.append(breaks, np.inf)
        return _flag_row(key[0], flagged, text, flags, low, high)

    # At most one row per interval of a fitted model, whatever the table size.
    return _held(bins.groupBy("column").applyInPandas(flag, _FLAG_SCHEMA))


def rarity_encoding(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """ANO-2: per distinct value its row count and code ``1 / (count + 1)``."""
    return value_index(long_form(df, columns)).select(
        "column", "value", "cnt", (F.lit(1.0) / (F.col("cnt") + 1)).alias("code")
    )


def _rarity_flags(index: DataFrame, contamination: float) -> DataFrame:
    """Flagged frequencies per text column; a group holds one row per distinct frequency."""

    def flag(key, pdf):
        pdf = pdf.sort_values("cnt")
        freq = pdf["cnt"].to_numpy()
        rows = freq * pdf["values"].to_numpy()
        code = 1.0 / (freq + 1.0)
        total = int(rows.sum())

        def draw(rng, k):
            return np.repeat(code, rng.multinomial(k, rows / total))

        breaks, scores = fit_forest(draw, total)
        score = -scores[np.searchsorted(breaks, code, side="left")]
        odd = score < weighted_quantile(score, rows, contamination)
        if not odd.any():
            return _no_flags()
        return _flag_row(key[0], int(rows[odd].sum()), "", odd, freq, freq)

    spread = index.groupBy("column", "cnt").agg(F.count(F.lit(1)).alias("values"))
    return _held(spread.groupBy("column").applyInPandas(flag, _FLAG_SCHEMA))


# What counts as much longer, much shorter, a common value, and mostly unique.
LONGER, SHORTER, COMMON_SHARE, UNIQUE_SHARE = 2.5, 0.4, 0.05, 0.9
# What stands out, in the order in which it is looked for: condition and text.
TEXT_RULES = (
    (f"usual > 0 AND unusual / usual > {LONGER}", "'Much longer than the rest: about ', bround(unusual, 0), ' characters against ', bround(usual, 0), '.'"),
    (f"usual > 0 AND unusual / usual < {SHORTER}", "'Much shorter than the rest: about ', bround(unusual, 0), ' characters against ', bround(usual, 0), '.'"),
    (f"top / n > {COMMON_SHARE}", "'Seldom seen in a column where some values are common.'"),
    (f"kinds / n > {UNIQUE_SHARE}", "'Of another make than the mostly distinct values around.'"),
    ("true", "'Rare for this column, without one clear reason.'"),
)


def explain_text(flagged_index: DataFrame) -> DataFrame:
    """ANO-4 from the value index with an ``odd`` flag: one explanation per column.

    A value is flagged with all its rows, so flagged values never occur among the others.
    """
    summary = flagged_index.groupBy("column").agg(
        F.expr("sum(if(odd, 0, cnt))").alias("n"),
        F.expr("max(if(odd, null, cnt))").alias("top"),
        F.expr("count_if(NOT odd)").alias("kinds"),
        F.expr("try_divide(sum(if(odd, 0, cnt * length(value))), sum(if(odd, 0, cnt)))").alias("usual"),
        F.expr("try_divide(sum(if(odd, cnt * length(value), 0)), sum(if(odd, cnt, 0)))").alias("unusual"),
    )
    whole = lambda text: re.sub(r"bround\((\w+), 0\)", r"cast(bround(\1, 0) AS BIGINT)", text)
    cases = " ".join(f"WHEN {condition} THEN concat({whole(text)})" for condition, text in TEXT_RULES)
    return summary.select("column", F.expr(f"CASE {cases} END").alias("explanation"))


def _in_any(value: Column, ranges: Sequence[tuple[float, float]]) -> Column:
    """Value lies above the low and up to the high end of some range."""
    pairs = F.array(*[F.struct(F.lit(a).alias("low"), F.lit(b).alias("high")) for a, b in ranges])
    return F.exists(pairs, lambda r: (value > r["low"]) & (value <= r["high"]))


def _in_ranges(value: Column) -> Column:
    return F.exists(F.arrays_zip("lows", "highs"), lambda r: (value >= r["lows"]) & (value <= r["highs"]))


def _first_examples(flagged: DataFrame, n: int) -> DataFrame:
    """First ``n`` distinct flagged values per column: ``column, value, first_rid`` in, arrays out."""
    return (
        top_n(flagged, ["column"], [F.col("first_rid"), F.col("value")], n, ["value"], "k")
        .groupBy("column")
        .agg(F.sort_array(F.collect_list(F.struct("k", "value"))).alias("e"))
        .select("column", F.col("e.value").alias("sample_anomalous_values"))
    )


def detect_anomalies(
    df: DataFrame,
    contamination: float = CONTAMINATION,
    max_sample_values: int = 5,
    columns: Sequence[str] | None = None,
    order_by: str | Sequence[str] | None = None,
) -> DataFrame:
    """ANO-5: one row per column that has flagged values."""
    types = {f.name: f.dataType for f in df.schema.fields}
    names = list(columns) if columns is not None else list(df.columns)
    counted = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(~is_missing(q(c), types[c])).alias(f"n{i}") for i, c in enumerate(names)],
    ).first()
    filled = {c: counted[f"n{i}"] for i, c in enumerate(names) if counted[f"n{i}"] >= MIN_ROWS}
    numeric = {c: n for c, n in filled.items() if _is_numeric(types[c])}
    text = [c for c in filled if not _is_numeric(types[c])]
    out = literal_rows(df.sparkSession, [], RESULT_SCHEMA)

    def finish(flags: DataFrame, examples: DataFrame) -> DataFrame:
        return flags.join(examples, "column", "left").select(
            "column",
            F.col("flagged").alias("anomalous_row_count"),
            F.lit(counted["total"]).cast("long").alias("total_rows"),
            F.bround(F.col("flagged") * 100 / counted["total"], 1).alias("anomaly_pct"),
            "explanation",
            F.coalesce("sample_anomalous_values", F.array().cast("array<string>")).alias("sample_anomalous_values"),
        )

    listed = list(numeric.items())
    for start in range(0, len(listed), COLUMNS_PER_MODEL_BATCH):
        sizes = dict(listed[start : start + COLUMNS_PER_MODEL_BATCH])
        flags = _numeric_flags(df, sizes, contamination, order_by)
        # Ranges are model metadata, at most one per fitted interval; only flagged cells become text.
        ranges = {r["column"]: list(zip(r["lows"], r["highs"])) for r in flags.collect()}
        cells = F.array_compact(
            F.array(
                *[
                    F.when(
                        _in_any(_as_double(q(c), types[c]), found),
                        F.struct(F.lit(c).alias("column"), as_text(q(c), types[c]).alias("value")),
                    )
                    for c, found in ranges.items()
                ]
            )
        ) if ranges else None
        if cells is None:
            continue
        odd = (
            df.select(row_key(order_by, types).alias("rid"), F.explode(cells).alias("c"))
            .groupBy("c.column", "c.value")
            .agg(F.min("rid").alias("first_rid"))
        )
        out = out.unionByName(finish(flags, _first_examples(odd, max_sample_values)))
    if text:
        index = value_index(long_form(df, text, order_by)).select("column", "value", "cnt", "first_rid")
        flags = _rarity_flags(index, contamination)
        marked = index.join(F.broadcast(flags.select("column", "lows", "highs")), "column").withColumn(
            "odd", _in_ranges(F.col("cnt"))
        )
        explained = flags.drop("explanation").join(explain_text(marked.drop("lows", "highs")), "column")
        out = out.unionByName(finish(explained, _first_examples(marked.where("odd"), max_sample_values)))
    return out
