"""Remediation of a table from its findings (REM-5..10, REM-13..16).

Findings are metadata (columns x rules) and are read on the driver; the table
itself is rewritten by one narrow chain of projections with no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from fieldwarden.functions.patterns import (
    DEFAULT_REGISTRY,
    ENTITY_SOURCES,
    REGEX_SOURCE,
    PatternRegistry,
)
from fieldwarden.functions.steps import Flag, Step, common_steps, entity_steps, sample_step, whole_cell_step
from fieldwarden.functions.text import as_text
from fieldwarden.functions.tokens import strategy_label
from fieldwarden.operators.scan import ScanResult
from fieldwarden.operators.values import literal_rows, q

DEFAULT_SALT = "api-remediation-salt"
AUDIT_SCHEMA = (
    "file_name string, column string, pattern string, detection_source string, strategy string, cells_changed long"
)
# Order in which findings are applied; unlisted patterns come last by name.
PATTERN_PRIORITY = {
    "LOCATION": 10,
    "PERSON": 20,
    "EMAIL_ADDRESS": 30,
    "PHONE_NUMBER": 40,
    "email": 50,
    "phone": 60,
    "ssn": 70,
    "zip": 80,
    "DATE_TIME": 90,
    "URL": 100,
}
SAMPLE_COLUMNS = [f"sample_match_{i}" for i in range(1, 6)]


def finding_order(pattern: str, detection_source: str) -> tuple[int, int, str]:
    """REM-10."""
    return (0 if detection_source in ENTITY_SOURCES else 1, PATTERN_PRIORITY.get(pattern, 999), pattern)


@dataclass(frozen=True)
class RemediationResult:
    """Rewritten table, audit of changed cells, and the flagged frame both come from."""

    data: DataFrame
    audit: DataFrame
    flagged: DataFrame
    _counters: list[tuple[str, Flag, Column]]
    _file_name: str
    _strategy: str

    def observed(self, name: str = "remediation") -> tuple[DataFrame, Observation]:
        """Rewritten table that counts changed cells while it is written (one pass)."""
        watch = Observation(name)
        if not self._counters:
            return self.data, watch
        sums = [F.count_if(c).alias(f"c{i}") for i, (_, _, c) in enumerate(self._counters)]
        return self.flagged.observe(watch, *sums).select(*[q(c) for c in self.data.columns]), watch

    def audit_of(self, watch: Observation) -> DataFrame:
        """Audit rows from a finished :meth:`observed` run."""
        counts = watch.get if self._counters else {}
        rows = [
            (self._file_name, column, flag[0], flag[1], self._strategy, counts[f"c{i}"])
            for i, (column, flag, _) in enumerate(self._counters)
            if counts[f"c{i}"] > 0
        ]
        return literal_rows(self.data.sparkSession, rows, AUDIT_SCHEMA)


def _collect_findings(
    findings: DataFrame | ScanResult, source: str | None, registry: PatternRegistry, recognisers: bool = True
) -> list[dict]:
    """Findings of one source as plain rows; a table of several needs ``source``.

    The kinds of findings are asked for first; examples only where some finding is not applied by a rule, nor by a
    recogniser where ``recognisers`` apply.
    """
    kinds = findings.kinds if isinstance(findings, ScanResult) else findings
    table = findings.findings if isinstance(findings, ScanResult) else findings

    def read(df: DataFrame, names: Iterable[str]) -> list[dict]:
        own = df.where(F.col("source") == source) if source is not None and "source" in df.columns else df
        return [r.asDict() for r in own.select(*[c for c in names if c in df.columns]).collect()]

    names = ["column", "pattern", "risk", "detection_source"]
    if source is None and "source" in kinds.columns:
        names.append("source")
    rows = read(kinds, names)
    if len({r.get("source") for r in rows}) > 1:
        raise ValueError("findings of several sources: name the one to apply, or use remediate_files")

    def applied(r: dict) -> bool:
        if r.get("detection_source") in ENTITY_SOURCES:
            return recognisers
        return r.get("detection_source") == REGEX_SOURCE and r["pattern"] in registry

    return rows if all(applied(r) for r in rows) else read(table, [*names, *SAMPLE_COLUMNS])


def plan_steps(
    columns: Iterable[str],
    findings: list[dict],
    mode: str,
    salt: str,
    include_review: bool,
    person: bool,
    location: bool,
    common: bool,
    dates: bool,
    patterns: set[str] | None,
    registry: PatternRegistry,
    protect_tokens: bool = False,
) -> dict[str, list[Step]]:
    """Ordered steps per column; a column counts as touched before the review check."""
    known = set(columns)
    steps: dict[str, list[Step]] = {}
    pending: dict[str, list] = {}

    def flush(column: str) -> None:
        rules = pending.pop(column, None)
        if rules:
            steps[column].append(whole_cell_step(rules, mode, salt))

    ordered = sorted(
        findings, key=lambda f: finding_order(str(f.get("pattern") or ""), str(f.get("detection_source") or ""))
    )
    for finding in ordered:
        column, pattern = finding.get("column"), finding.get("pattern")
        source = str(finding.get("detection_source") or "")
        if not column or not pattern or column not in known:
            continue
        if patterns and pattern not in patterns:
            continue
        steps.setdefault(column, [])
        if not include_review and finding.get("risk") == "REVIEW":
            continue
        if source == REGEX_SOURCE and pattern in registry:
            pending.setdefault(column, []).append(registry[pattern])
            continue
        flush(column)
        if source in ENTITY_SOURCES:
            steps[column] += entity_steps(column, pattern, source, mode, salt, person, location)
        else:
            samples = [finding[s] for s in SAMPLE_COLUMNS if finding.get(s)]
            if samples:
                steps[column].append(sample_step(samples, pattern, source, mode, salt))
    for column in list(pending):
        flush(column)
    if common:
        for column in steps:
            steps[column] += common_steps(mode, salt, dates, patterns, protect_tokens)
    return steps


def apply_steps(df: DataFrame, steps: dict[str, list[Step]]) -> tuple[DataFrame, dict[str, list[tuple[Flag, str]]]]:
    """Run the k-th step of every column in the k-th pair of projections.

    Returns the frame with rewritten columns plus boolean flag columns, and per
    column the flags with the names of their columns.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    names = list(df.columns)
    active = {c: s for c, s in steps.items() if s}
    current = df.select(*[as_text(q(c), types[c]).alias(c) if c in active else q(c) for c in names])
    flags: dict[str, list[tuple[Flag, str]]] = {c: [] for c in active}
    flag_columns: list[str] = []
    for k in range(max((len(s) for s in active.values()), default=0)):
        turn = {c: s[k] for c, s in active.items() if k < len(s)}
        found = {c: f"__found_{i}" for i, c in enumerate(turn)}
        current = current.select("*", *[step.find(q(c)).alias(found[c]) for c, step in turn.items()])
        new_flags = []
        for c, step in turn.items():
            for flag, changed in step.flags.items():
                name = f"__flag_{len(flag_columns) + len(new_flags)}"
                new_flags.append(F.coalesce(changed(F.col(found[c])), F.lit(False)).alias(name))
                flags[c].append((flag, name))
        current = current.select(
            *[turn[c].rewrite(q(c), F.col(found[c])).alias(c) if c in turn else q(c) for c in names],
            *flag_columns,
            *new_flags,
        )
        flag_columns += [f"__flag_{len(flag_columns) + i}" for i in range(len(new_flags))]
    if not active:
        return current, flags
    # A one-row generator closes the chain: predicates a caller puts on a rewritten
    # column stay above it instead of being substituted into every step.
    done = F.array(F.struct(*[q(c).alias(c) for c in active], *[F.col(f) for f in flag_columns]))
    return current.select(*[q(c) for c in names if c not in active], F.inline(done)), flags


def _result(df: DataFrame, steps: dict[str, list[Step]], mode: str, file_name: str) -> RemediationResult:
    strategy = strategy_label(mode)
    flagged, flags = apply_steps(df, steps)
    counters: list[tuple[str, Flag, Column]] = []
    for column in sorted(flags):
        merged: dict[Flag, Column] = {}
        for flag, name in flags[column]:
            merged[flag] = merged[flag] | F.col(name) if flag in merged else F.col(name)
        counters += [(column, flag, changed) for flag, changed in merged.items()]
    data = flagged.select(*[q(c) for c in df.columns])
    if not counters:
        return RemediationResult(
            df if not any(steps.values()) else data,
            literal_rows(df.sparkSession, [], AUDIT_SCHEMA), flagged, [], file_name, strategy,
        )
    sums = flagged.agg(*[F.count_if(c).alias(f"c{i}") for i, (_, _, c) in enumerate(counters)])
    rows = F.array(
        *[
            F.struct(
                F.lit(file_name).alias("file_name"),
                F.lit(column).alias("column"),
                F.lit(flag[0]).alias("pattern"),
                F.lit(flag[1]).alias("detection_source"),
                F.lit(strategy).alias("strategy"),
                F.col(f"c{i}").alias("cells_changed"),
            )
            for i, (column, flag, _) in enumerate(counters)
        ]
    )
    audit = sums.select(F.explode(rows).alias("r")).select("r.*").where(F.col("cells_changed") > 0)
    return RemediationResult(data, audit, flagged, counters, file_name, strategy)


def remediate(
    df: DataFrame,
    findings: DataFrame | ScanResult,
    mode: str = "redact",
    salt: str = DEFAULT_SALT,
    include_review: bool = True,
    person: bool = True,
    location: bool = True,
    common: bool = True,
    dates: bool = True,
    patterns: Iterable[str] | None = None,
    file_name: str = "",
    source: str | None = None,
    registry: PatternRegistry = DEFAULT_REGISTRY,
    protect_tokens: bool = False,
) -> RemediationResult:
    """REM-15: apply findings to all rows, then the free-text fallbacks on touched columns.

    ``findings`` is a table or, without a ranking of examples, the result of a scan. If it covers several tables,
    ``source`` picks the rows of this one.
    Null cells stay null, and every column with a step is returned as text.
    ``patterns`` limits the rules (empty or ``None`` means all).
    """
    selected = set(patterns) if patterns else None
    rows = _collect_findings(findings, source, registry)
    steps = plan_steps(
        df.columns, rows, mode, salt, include_review, person, location, common, dates, selected, registry,
        protect_tokens,
    )
    return _result(df, steps, mode, file_name)


def redact_text(
    df: DataFrame,
    columns: Iterable[str],
    mode: str = "redact",
    salt: str = DEFAULT_SALT,
    dates: bool = True,
    patterns: Iterable[str] | None = None,
    file_name: str = "",
    protect_tokens: bool = False,
) -> RemediationResult:
    """REM-13/14 alone: the free-text fallbacks on the given columns."""
    selected = set(patterns) if patterns else None
    steps = {c: common_steps(mode, salt, dates, selected, protect_tokens) for c in columns}
    return _result(df, steps, mode, file_name)


def anonymise(df: DataFrame, findings: DataFrame | ScanResult, source: str | None = None,
              registry: PatternRegistry = DEFAULT_REGISTRY) -> DataFrame:
    """REM-16: plain ``<PII:pattern>`` tags; whole cells by rule, examples by literal, in the order of the listing.

    The result of a scan, which has no order of its own, is listed in the order of the registry.
    """
    steps: dict[str, list[Step]] = {}
    place = {name: i for i, name in enumerate(registry.names)}
    rows = _collect_findings(findings, source, registry, recognisers=False)
    if isinstance(findings, ScanResult):
        rows.sort(key=lambda f: (str(f.get("column")), place.get(f.get("pattern"), len(place)), str(f.get("pattern"))))
    for finding in rows:
        column, pattern = finding.get("column"), finding.get("pattern")
        if column not in df.columns or not pattern:
            continue
        if finding.get("detection_source") == REGEX_SOURCE and pattern in registry:
            steps.setdefault(column, []).append(whole_cell_step([registry[pattern]], "tag", ""))
            continue
        samples = [finding[s] for s in SAMPLE_COLUMNS if finding.get(s)]
        if samples:
            steps.setdefault(column, []).append(sample_step(samples, pattern, "", "tag", ""))
    return _result(df, steps, "tag", "").data
