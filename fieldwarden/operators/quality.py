"""Value plausibility, cross-column consistency and completeness (QLT-1..3).

As in the privacy checks, every question is answered by a stated rule over the
whole table.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldwarden.functions.text import as_text, is_missing, strip
from fieldwarden.operators.privacy import name_words
from fieldwarden.operators.values import literal_rows, q

ISSUE_SCHEMA = "column string, issue string, example string, severity string"


def _number(cell: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.NumericType):
        return F.when(~is_missing(cell, dtype), cell.cast("double"))
    return as_text(cell, dtype).try_cast("double")


def _date(cell: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return cell.cast("date")
    return as_text(cell, dtype).try_cast("date")


@dataclass(frozen=True)
class ValueRule:
    """Cells of columns whose name matches ``name`` must not satisfy ``violates(cell, dtype)``."""

    name: str
    issue: str
    severity: str
    violates: Callable[[Column, T.DataType], Column]
    label: str = ""


def between_rule(name: str, low: float | None, high: float | None, issue: str, severity: str) -> ValueRule:
    def violates(cell: Column, dtype: T.DataType) -> Column:
        value, bad = _number(cell, dtype), F.lit(False)
        if low is not None:
            bad = bad | (value < low)
        if high is not None:
            bad = bad | (value > high)
        return bad

    return ValueRule(name, issue, severity, violates)


# Our rules: matched against the words of a column name joined by spaces.
VALUE_RULES = (
    between_rule(r"\bage\b", 0, 120, "Ages outside 0 to 120.", "HIGH"),
    between_rule(r"\b(pct|percent|percentage)\b", 0, 100, "Percentages outside 0 to 100.", "HIGH"),
    between_rule(r"\b(discount|tax|rate)\b", 0, 1, "Fractions outside 0 to 1.", "MEDIUM"),
    between_rule(
        r"\b(salary|wage|price|totalprice|extendedprice|retailprice|amount|quantity|qty)\b", 0, None,
        "Negative amounts.", "HIGH",
    ),
    between_rule(r"\b(balance|acctbal)\b", 0, None, "Negative balances.", "MEDIUM"),
    ValueRule(
        r"\b(date|orderdate|shipdate|dob|birthdate)\b", "Dates before 1900 or more than 50 years ahead.", "HIGH",
        lambda c, t: (_date(c, t) < F.lit("1900-01-01").cast("date"))
        | (_date(c, t) > F.add_months(F.current_date(), 600)),
    ),
    ValueRule(
        r"\b(zip|zipcode|postal)\b", "Postal codes holding letters.", "MEDIUM",
        lambda c, t: as_text(c, t).rlike(r"[A-Za-z]"),
    ),
)

# Our rule: spellings of yes/no values; a column mixing families is implausible.
BOOLEAN_FAMILIES = {
    "Y/N": ("y", "n"),
    "Yes/No": ("yes", "no"),
    "True/False": ("true", "false"),
    "T/F": ("t", "f"),
    "1/0": ("1", "0"),
}


def plausibility_counts(df: DataFrame, rules: Sequence[ValueRule] = VALUE_RULES) -> DataFrame:
    """Violations per column and rule in one pass: filled cells, bad cells, smallest bad value by text."""
    types = {f.name: f.dataType for f in df.schema.fields}
    aggregates, rows = [], []
    for i, (c, dtype) in enumerate(types.items()):
        spoken = " ".join(name_words(c))
        for j, rule in enumerate(rules):
            if not re.search(rule.name, spoken):
                continue
            bad = F.coalesce(rule.violates(q(c), dtype), F.lit(False))
            text = as_text(q(c), dtype)
            aggregates += [
                F.count(text).alias(f"n{i}_{j}"),
                F.count_if(bad).alias(f"m{i}_{j}"),
                F.min(F.when(bad, text)).alias(f"e{i}_{j}"),
            ]
            rows.append(
                F.struct(
                    F.lit(c).alias("column"),
                    F.lit(rule.issue).alias("issue"),
                    F.lit(rule.severity).alias("severity"),
                    F.col(f"n{i}_{j}").alias("values"),
                    F.col(f"m{i}_{j}").alias("violations"),
                    F.col(f"e{i}_{j}").alias("example"),
                )
            )
    if not rows:
        return literal_rows(
            df.sparkSession, [],
            "column string, issue string, severity string, values long, violations long, example string",
        )
    return df.agg(*aggregates).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def mixed_booleans(df: DataFrame) -> DataFrame:
    """Text columns holding only yes/no words from more than one spelling family."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    aggregates, rows = [], []
    words = [w for family in BOOLEAN_FAMILIES.values() for w in family]
    for i, c in enumerate(names):
        value = F.lower(F.trim(q(c)))
        filled = F.when(value != "", value)
        aggregates.append(F.count_if(~filled.isin(*words)).alias(f"other{i}"))
        shown = []
        for j, (family, members) in enumerate(BOOLEAN_FAMILIES.items()):
            aggregates.append(F.count_if(filled.isin(*members)).alias(f"f{i}_{j}"))
            shown.append(F.when(F.col(f"f{i}_{j}") > 0, F.lit(family)))
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"other{i}").alias("other"),
                F.array_compact(F.array(*shown)).alias("families"),
            )
        )
    if not rows:
        return literal_rows(df.sparkSession, [], ISSUE_SCHEMA)
    return (
        df.agg(*aggregates)
        .select(F.explode(F.array(*rows)).alias("r"))
        .select("r.*")
        .where((F.col("other") == 0) & (F.size("families") > 1))
        .select(
            "column",
            F.lit("Yes/no values are spelled in several ways.").alias("issue"),
            F.array_join("families", ", ").alias("example"),
            F.lit("MEDIUM").alias("severity"),
        )
    )


def plausibility(df: DataFrame, rules: Sequence[ValueRule] = VALUE_RULES) -> DataFrame:
    """QLT-1."""
    counted = plausibility_counts(df, rules).where(F.col("violations") > 0)
    return counted.select("column", "issue", "example", "severity").unionByName(mixed_booleans(df))


@dataclass(frozen=True)
class DateOrder:
    start: str
    end: str


@dataclass(frozen=True)
class SumOf:
    total: str
    parts: tuple[str, ...]
    tolerance: float = 0.01


@dataclass(frozen=True)
class Determines:
    """``left`` columns fix the value of ``right``."""

    left: tuple[str, ...]
    right: str


@dataclass(frozen=True)
class ListedIn:
    """Combinations of ``columns`` must occur in ``table`` (same column names)."""

    columns: tuple[str, ...]
    table: DataFrame


Rule = DateOrder | SumOf | Determines | ListedIn

START_WORDS = ("start", "begin", "from", "opened", "hired", "created", "admitted")
END_WORDS = ("end", "finish", "to", "closed", "terminated", "resolved", "discharged")


def implied_rules(columns: Sequence[str]) -> list[Rule]:
    """Rules the column names suggest: matching start and end dates, zip fixing the state."""
    out: list[Rule] = []
    by_rest: dict[tuple, dict[str, str]] = {}
    for c in columns:
        words = name_words(c)
        for i, w in enumerate(words):
            side = "start" if w in START_WORDS else "end" if w in END_WORDS else None
            if side:
                by_rest.setdefault(tuple(words[:i] + words[i + 1 :]), {})[side] = c
    out += [DateOrder(p["start"], p["end"]) for p in by_rest.values() if len(p) == 2]
    zips = [c for c in columns if {"zip", "zipcode", "postal"} & set(name_words(c))]
    states = [c for c in columns if "state" in name_words(c)]
    out += [Determines((z,), s) for z in zips for s in states]
    return out


def date_order_counts(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows with both dates and rows that end before they start."""
    both = q(start).isNotNull() & q(end).isNotNull()
    return df.agg(F.count_if(both).alias("rows"), F.count_if(q(end) < q(start)).alias("violations"))


def dependency_counts(df: DataFrame, left: Sequence[str], right: str) -> DataFrame:
    """Groups and rows of ``left`` holding more than one ``right`` value.

    Smallest and largest value differ exactly when there are two values, so a
    group needs constant memory however many rows it holds.
    """
    groups = df.where(q(right).isNotNull()).groupBy(*[q(c) for c in left]).agg(
        F.count(F.lit(1)).alias("n"), F.min(q(right)).alias("low"), F.max(q(right)).alias("high")
    )
    broken = F.col("low") != F.col("high")
    return groups.agg(
        F.count(F.lit(1)).alias("groups"),
        F.count_if(broken).alias("violating_groups"),
        F.coalesce(F.sum(F.when(broken, F.col("n"))), F.lit(0)).alias("rows_involved"),
    )


def _severity(share: Column) -> Column:
    return F.when(share >= 0.1, "HIGH").when(share >= 0.01, "MEDIUM").otherwise("LOW")


def consistency(df: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """QLT-2: one row per broken rule."""
    types = {f.name: f.dataType for f in df.schema.fields}
    rules = implied_rules(df.columns) if rules is None else rules
    out = literal_rows(df.sparkSession, [], "columns string, issue string, severity string")

    def add(columns: Sequence[str], counts: DataFrame, bad: str, whole: str, text: str) -> DataFrame:
        return out.unionByName(
            counts.where(F.col(bad) > 0).select(
                F.lit(", ".join(columns)).alias("columns"),
                F.format_string(text, bad, whole).alias("issue"),
                _severity(F.col(bad) / F.col(whole)).alias("severity"),
            )
        )

    # Row-level rules share one pass over the table.
    row_rules = [r for r in rules if isinstance(r, (DateOrder, SumOf))]
    if row_rules:
        aggregates = []
        for i, r in enumerate(row_rules):
            if isinstance(r, DateOrder):
                start, end = _date(q(r.start), types[r.start]), _date(q(r.end), types[r.end])
                known, bad = start.isNotNull() & end.isNotNull(), end < start
            else:
                total = _number(q(r.total), types[r.total])
                parts = [_number(q(p), types[p]) for p in r.parts]
                added = parts[0]
                for p in parts[1:]:
                    added = added + p
                known, bad = (total + added).isNotNull(), F.abs(total - added) > r.tolerance
            aggregates += [F.count_if(known).alias(f"n{i}"), F.count_if(bad).alias(f"m{i}")]
        totals = df.agg(*aggregates)
        for i, r in enumerate(row_rules):
            if isinstance(r, DateOrder):
                out = add((r.start, r.end), totals, f"m{i}", f"n{i}", "%d of %d rows end before they start.")
            else:
                out = add((r.total, *r.parts), totals, f"m{i}", f"n{i}", "%d of %d totals differ from the sum of their parts.")
    for r in rules:
        if isinstance(r, Determines):
            counts = dependency_counts(df, r.left, r.right)
            out = add((*r.left, r.right), counts, "violating_groups", "groups", "%d of %d key values have several values in the other column.")
        elif isinstance(r, ListedIn):
            names = list(r.columns)
            seen = df.select(*[q(c) for c in names]).dropna().groupBy(*names).agg(F.count(F.lit(1)).alias("__n"))
            listed = r.table.select(*[q(c) for c in names]).distinct().withColumn("__known", F.lit(True))
            counts = seen.join(listed, names, "left").agg(
                F.sum("__n").alias("rows"), F.sum(F.when(F.col("__known").isNull(), F.col("__n")).otherwise(0)).alias("bad")
            )
            out = add(names, counts, "bad", "rows", "%d of %d rows hold a combination that is not listed.")
    return out


# Our rule: texts that stand for a missing value.
PLACEHOLDERS = (
    "nan", "n/a", "na", "none", "null", "nil", "tbd", "tba", "todo", "unknown", "-", "--", "?", "xxx", "test",
    "placeholder",
)
# Our rule: a word in some column name asks for one of these words in another.
COMPANIONS = (
    ("address", ("zip", "zipcode", "postal")),
    ("street", ("city",)),
    ("city", ("state", "country")),
    ("name", ("id", "key", "rid")),
    ("amount", ("currency",)),
)


def completeness_rates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null, blank and placeholder cells per column: one pass."""
    types = {f.name: f.dataType for f in df.schema.fields}
    names = list(columns) if columns is not None else list(df.columns)
    aggregates, rows = [F.count(F.lit(1)).alias("rows")], []
    for i, c in enumerate(names):
        aggregates.append(F.count_if(is_missing(q(c), types[c])).alias(f"n{i}"))
        if isinstance(types[c], T.StringType):
            text = strip(q(c))
            aggregates.append(F.count_if(text == "").alias(f"b{i}"))
            aggregates.append(F.count_if(F.lower(text).isin(*PLACEHOLDERS)).alias(f"p{i}"))
        else:
            aggregates += [F.count_if(F.lit(False)).alias(f"b{i}"), F.count_if(F.lit(False)).alias(f"p{i}")]
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                F.col("rows").alias("rows"),
                F.col(f"n{i}").alias("nulls"),
                F.col(f"b{i}").alias("blanks"),
                F.col(f"p{i}").alias("placeholders"),
            )
        )
    return df.agg(*aggregates).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def missing_companions(columns: Sequence[str], companions=COMPANIONS) -> list[tuple[str, str, str]]:
    """Dataset-level rows for companion columns that are absent (names only, no data read)."""
    spoken = [set(name_words(c)) for c in columns]
    out = []
    for word, partners in companions:
        if any(word in s for s in spoken) and not any(s & set(partners) for s in spoken):
            out.append(
                ("dataset-level", f"A column about '{word}' has no companion about '{' or '.join(partners)}'.", "LOW")
            )
    return out


def completeness(
    df: DataFrame, companions=COMPANIONS, threshold: float = 0.05, rates: DataFrame | None = None
) -> DataFrame:
    """QLT-3: columns with more than ``threshold`` unusable cells, and absent companions."""
    gaps = F.col("nulls") + F.col("blanks") + F.col("placeholders")
    share = gaps / F.col("rows")
    cells = (
        (completeness_rates(df) if rates is None else rates)
        .where((F.col("rows") > 0) & (share > threshold))
        .select(
            "column",
            F.format_string(
                "%d of %d values are missing: %d null, %d blank, %d placeholder.",
                gaps, F.col("rows"), F.col("nulls"), F.col("blanks"), F.col("placeholders"),
            ).alias("issue"),
            F.when(share >= 0.5, "HIGH").when(share >= 0.2, "MEDIUM").otherwise("LOW").alias("severity"),
        )
    )
    absent = missing_companions(df.columns, companions)
    return cells.unionByName(literal_rows(df.sparkSession, absent, "column string, issue string, severity string"))
