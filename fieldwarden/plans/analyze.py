"""Several checks over one table (QLT-7)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from fieldwarden.operators.anomaly import detect_anomalies
from fieldwarden.operators.autogen import auto_expectations, fallback_specs
from fieldwarden.operators.cell_index import CellIndex, described
from fieldwarden.operators.expectations import Expectation, Prepared, build_input_suite, validate
from fieldwarden.operators.privacy import format_anomalies, quasi_identifiers, regulatory_flags, semantic_pii
from fieldwarden.operators.quality import completeness, consistency, plausibility
from fieldwarden.operators.responses import failure_payload
from fieldwarden.operators.scan import scan

#: Checks that are sums over one stored index of the table's distinct cells.
SHARED = ("narrative", "regulatory", "completeness", "auto_expectations")
CHECKS = (
    "narrative", "anomaly", "semantic_pii", "regulatory", "quasi_id", "format_check", "plausibility",
    "consistency", "completeness", "auto_expectations",
)


@dataclass
class Analysis:
    results: dict[str, DataFrame] = field(default_factory=dict)
    checks_run: list[str] = field(default_factory=list)
    errors: dict[str, str] = field(default_factory=dict)


def analyze(
    df: DataFrame,
    checks: Sequence[str] = CHECKS,
    source: str = "table",
    known_columns: Sequence[str] = (),
    order_by: str | Sequence[str] | None = None,
    proposed: DataFrame | None = None,
    entities: bool = True,
    shared: bool = True,
) -> Analysis:
    """Run the chosen checks; one that fails is reported and does not stop the others.

    ``narrative`` yields the failure payload a writer would be given. Where two or more checks of ``SHARED`` are chosen, the
    table is read once for all of them (see :mod:`fieldwarden.operators.cell_index`) and once more for the first offending
    rows of failed checks; without ``shared`` each check reads for itself. ``entities`` of the regulatory check are one
    more pass over the texts.
    """
    unknown = [c for c in checks if c not in CHECKS]
    if unknown:
        raise ValueError(f"unknown checks: {', '.join(unknown)}")

    out = Analysis()
    index: CellIndex | None = None
    suites: dict[str, list[Expectation]] = {}
    ready: dict[str, Prepared] = {}
    if shared and len(set(checks) & set(SHARED)) > 1:
        try:
            index = CellIndex(df, order_by)
            if "narrative" in checks:
                suites["narrative"] = build_input_suite(df, index.suite_facts())
            if "auto_expectations" in checks and proposed is None:
                suites["auto"] = fallback_specs(df, (), index.numeric_shares())
            ready = index.prepared(suites)
        except Exception as error:  # each check still runs for itself
            out.errors["shared"], index, ready = _said(error), None, {}

    def narrative() -> DataFrame:
        if "narrative" in ready:
            result = validate(df, suites["narrative"], order_by, source, ready["narrative"])
        else:
            result = validate(df, order_by=order_by, file_name=source)
        return failure_payload(result.report, result.failures)

    def auto() -> DataFrame:
        if index is None:
            return auto_expectations(df, proposed, order_by=order_by, file_name=source).outcomes

        def prepare(suite: list[Expectation]) -> Prepared:
            if "auto" in ready and described(suite) == described(suites["auto"]):
                return ready["auto"]
            return index.prepared({"auto": suite})["auto"]

        return auto_expectations(df, proposed, order_by=order_by, file_name=source, shares=index.numeric_shares(), prepare=prepare).outcomes

    def scanned():
        return index.scan(source, entities) if index is not None else scan(df, source, order_by=order_by, entities=entities)

    runners = {
        "narrative": narrative,
        "anomaly": lambda: detect_anomalies(df, order_by=order_by),
        "semantic_pii": lambda: semantic_pii(df, known_columns),
        "regulatory": lambda: regulatory_flags(scanned().findings),
        "quasi_id": lambda: quasi_identifiers(df),
        "format_check": lambda: format_anomalies(df),
        "plausibility": lambda: plausibility(df),
        "consistency": lambda: consistency(df),
        "completeness": lambda: completeness(df, rates=index.completeness_rates() if index is not None else None),
        "auto_expectations": auto,
    }
    for check in [c for c in CHECKS if c in checks]:
        try:
            out.results[check] = runners[check]()
            out.checks_run.append(check)
        except Exception as error:
            out.errors[check] = _said(error)
    return out


def _said(error: Exception) -> str:
    return str(error).splitlines()[0] if str(error) else type(error).__name__
