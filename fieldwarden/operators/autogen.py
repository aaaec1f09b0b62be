"""Generated expectations: profile fallbacks, execution, outcomes (AUT-3, AUT-4)."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwarden.functions.text import as_text
from fieldwarden.operators.expectations import (
    Prepared,
    NOT_NULL,
    REGEX,
    UNIQUE,
    Expectation,
    ValidationResult,
    build_report,
    explain_failure,
    run_expectations,
)
from fieldwarden.operators.profile import NUMERIC_TEXT
from fieldwarden.operators.responses import (
    deduplicated_specs,
    proposal_diagnostics,
    proposal_items,
    sanitised_specs,
)
from fieldwarden.operators.values import literal_rows, q

# Name rules and value patterns of the profile fallbacks.
IDENTIFIER_NAME = re.compile(r"\b(id|uuid|key|identifier|reference)\b", re.IGNORECASE)
DATE_NAME = re.compile(r"\b(date|dated|restocked|timestamp|time)\b", re.IGNORECASE)
NUMERIC_VALUE = r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)$"
DATE_VALUE = r"^(?:\d{4}-\d{2}-\d{2}|\d{2}[/-]\d{2}[/-]\d{4})$"
TRIMMED_TEXT = r"^\S(?:.*\S)?$"
FALLBACK = "PROFILE_FALLBACK"
PROPOSED = "LLM"

SPEC_SCHEMA = (
    "index int, expectation_type string, column string, params string, rationale string, "
    "confidence string, generation_source string"
)


@dataclass(frozen=True)
class AutoRun:
    specs: DataFrame
    outcomes: DataFrame
    report: DataFrame
    failures: DataFrame
    diagnostics: DataFrame | None = None


def numeric_ratios(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of filled cells that look numeric: one row per column, one pass over the table."""
    types = {f.name: f.dataType for f in df.schema.fields}
    aggregates, rows = [], []
    for i, c in enumerate(columns):
        text = as_text(q(c), types[c])
        numeric = F.regexp_extract(text, r"(?U)\A(?:" + NUMERIC_TEXT + r"\z|)", 0) != ""
        aggregates += [F.count(text).alias(f"n{i}"), F.count_if(numeric).alias(f"m{i}")]
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                F.when(F.col(f"n{i}") > 0, F.col(f"m{i}") / F.col(f"n{i}")).otherwise(0.0).alias("numeric_ratio"),
            )
        )
    return df.agg(*aggregates).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@dataclass(frozen=True)
class FallbackRule:
    """A check proposed for every column to which ``applies`` (name, share of numeric values) says yes."""

    applies: Callable[[str, float], bool]
    check: str
    parameters: dict
    rationale: str
    confidence: str


def _named(rule: re.Pattern) -> Callable[[str, float], bool]:
    return lambda name, share: bool(rule.search(name))


def _other(numeric: bool) -> Callable[[str, float], bool]:
    return lambda name, share: not (IDENTIFIER_NAME.search(name) or DATE_NAME.search(name)) and (share >= 0.5) is numeric


FALLBACK_RULES = (
    FallbackRule(lambda name, share: True, NOT_NULL, {"mostly": 0.95}, "At most one cell in twenty may be empty.", "MEDIUM"),
    FallbackRule(_named(IDENTIFIER_NAME), UNIQUE, {}, "The name says that a value stands for one record.", "HIGH"),
    FallbackRule(
        lambda name, share: bool(DATE_NAME.search(name)) and not IDENTIFIER_NAME.search(name),
        REGEX, {"regex": DATE_VALUE}, "The name says date, so one date form is expected throughout.", "HIGH",
    ),
    FallbackRule(_other(True), REGEX, {"regex": NUMERIC_VALUE}, "Most cells are numbers; the others may be slips.", "MEDIUM"),
    FallbackRule(_other(False), REGEX, {"regex": TRIMMED_TEXT}, "Blanks at either end split equal texts into two values.", "MEDIUM"),
)


def fallback_specs(
    df: DataFrame, existing: Sequence[Expectation] = (), shares: dict[str, float] | None = None
) -> list[Expectation]:
    """AUT-3: the rules above for every column, but for checks that are already proposed."""
    if shares is None:
        shares = {r["column"]: r["numeric_ratio"] for r in numeric_ratios(df, df.columns).collect()}
    taken = {(s.column, s.type) for s in existing}
    return [
        Expectation(rule.check, c, dict(rule.parameters), rule.rationale, rule.confidence, FALLBACK)
        for c in df.columns
        for rule in FALLBACK_RULES
        if (c, rule.check) not in taken and rule.applies(c, shares[c])
    ]


def specs_table(df: DataFrame, specs: Sequence[Expectation]) -> DataFrame:
    rows = [
        (i + 1, s.type, s.column, s.params, s.rationale, s.confidence, s.generation_source)
        for i, s in enumerate(specs)
    ]
    return literal_rows(df.sparkSession, rows, SPEC_SCHEMA)


def _accepted(specs: DataFrame, order: Sequence[str]) -> list[Expectation]:
    """Accepted proposals as suite entries; one table's suite is driver-sized metadata."""
    out = []
    for r in specs.orderBy(*order, "pos").collect():
        kw = {}
        if r["mostly"] is not None:
            kw["mostly"] = r["mostly"]
        if r["value_set"] is not None:
            kw["value_set"] = list(r["value_set"])
        if r["regex"] is not None:
            kw["regex"] = r["regex"]
        for bound in ("min_value", "max_value"):
            if r[bound] is not None:
                kw[bound] = json.loads(r[bound])
        out.append(Expectation(r["expectation_type"], r["column"], kw, r["rationale"], r["confidence"], PROPOSED))
    return out


def outcome_rows(result: ValidationResult) -> DataFrame:
    """AUT-4: outcome table with status and explanation."""
    details = F.when(
        ~F.col("passed"), F.map_filter(explain_failure(), lambda _, v: v.isNotNull() & (v != ""))
    ).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    return result.outcomes.select(
        "index", "expectation", "expectation_label", "column", "params", "confidence", "rationale",
        "generation_source", "passed",
        F.when(F.col("passed"), "PASS").otherwise("FAIL").alias("status"),
        F.when(F.col("passed"), "✅").otherwise("❌").alias("status_icon"),
        details.alias("failure_details"),
    )


def auto_expectations(
    df: DataFrame,
    proposed: DataFrame | None = None,
    text: str = "response",
    order: Sequence[str] = (),
    order_by: str | Sequence[str] | None = None,
    file_name: str = "",
    shares: dict[str, float] | None = None,
    prepare: Callable[[list[Expectation]], Prepared] | None = None,
) -> AutoRun:
    """Proposals (optional JSON answers) plus fallbacks, executed over the whole table.

    ``shares`` of numeric texts and ``prepare``, the counts of a suite, stand for passes over the table where given.
    """
    suite: list[Expectation] = []
    diagnostics = None
    if proposed is not None:
        items = proposal_items(proposed, text)
        accepted = deduplicated_specs(sanitised_specs(items, df.columns), order)
        suite = _accepted(accepted, order)
    extra = fallback_specs(df, suite, shares)
    if proposed is not None:
        diagnostics = proposal_diagnostics(proposed, text, items, accepted, df.columns, len(extra))
    suite += extra
    outcomes = run_expectations(df, suite, order_by, prepared=prepare(suite) if prepare else None)
    result = build_report(outcomes, file_name)
    return AutoRun(specs_table(df, suite), outcome_rows(result), result.report, result.failures, diagnostics)
