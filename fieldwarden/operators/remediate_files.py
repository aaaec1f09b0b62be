"""Remediation of many files of one layout in one plan (REM-15, SNK-6).

Findings stay a table. For each file and column they become one number, whose bits say which steps apply; the numbers are
joined to the rows, and every step of the chain looks at its bit. The chain holds the steps that some file needs, in the
order in which a single table's findings are applied, so its length follows the columns and rules, not the files.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwarden.functions import patterns as P
from fieldwarden.functions.patterns import DEFAULT_REGISTRY, ENTITY_SOURCES, REGEX_SOURCE, PatternRegistry
from fieldwarden.functions.steps import Flag, Step, common_steps, entity_steps
from fieldwarden.functions.text import strip
from fieldwarden.functions.tokens import strategy_label, token
from fieldwarden.operators.remediate import DEFAULT_SALT, SAMPLE_COLUMNS, apply_steps, finding_order
from fieldwarden.operators.values import literal_rows, q

#: Bit 0 says that a column has a finding at all; kinds of findings follow.
MOST_KINDS = 62
Kind = tuple[str, str]  # (pattern, detection source)


@dataclass(frozen=True)
class FilesResult:
    """Rewritten rows of all files, and the changed cells of each file, column and rule."""

    data: DataFrame
    audit: DataFrame
    source: str
    strategy: str


def finding_kinds(findings: DataFrame, columns: Sequence[str], patterns: set[str] | None) -> dict[str, list[Kind]]:
    """Kinds of findings of each column in the order of REM-10, over all files; at most columns x rules rows."""
    known = findings.where(F.col("column").isin(list(columns)) & F.col("pattern").isNotNull())
    if patterns:
        known = known.where(F.col("pattern").isin(sorted(patterns)))
    kinds: dict[str, list[Kind]] = {}
    for r in known.select("column", "pattern", F.coalesce("detection_source", F.lit("")).alias("origin")).distinct().collect():
        kinds.setdefault(r["column"], []).append((r["pattern"], r["origin"]))
    for column, found in kinds.items():
        found.sort(key=lambda k: finding_order(*k))
        if len(found) > MOST_KINDS:
            raise ValueError(f"at most {MOST_KINDS} kinds of findings for a column: {column}")
    return kinds


def _has_samples(kind: Kind, registry: PatternRegistry) -> bool:
    """Findings of other origins are applied by their examples."""
    return kind[1] not in ENTITY_SOURCES and not (kind[1] == REGEX_SOURCE and kind[0] in registry)


def file_masks(
    findings: DataFrame, kinds: dict[str, list[Kind]], include_review: bool, registry: PatternRegistry
) -> DataFrame:
    """``__file``, a number ``__m<i>`` for the i-th column, and ``__s<i>_<bit>`` with the examples of kinds that need them."""
    rows = [
        (column, pattern, origin, i, bit)
        for i, (column, found) in enumerate(kinds.items())
        for bit, (pattern, origin) in enumerate(found, 1)
    ]
    bits = literal_rows(findings.sparkSession, rows, "column string, pattern string, origin string, place int, bit int")
    applies = F.lit(True) if include_review else F.coalesce(F.col("risk") != "REVIEW", F.lit(True))
    own = findings.withColumn("origin", F.coalesce("detection_source", F.lit(""))).join(F.broadcast(bits), ["column", "pattern", "origin"])
    mask = F.when(applies, F.expr("shiftleft(1L, bit)")).otherwise(F.lit(0).cast("long")).bitwiseOR(F.lit(1).cast("long"))
    there = [c for c in SAMPLE_COLUMNS if c in findings.columns]
    samples = F.filter(F.array(*[F.col(c) for c in there]) if there else F.array().cast("array<string>"), lambda s: s.isNotNull() & (s != ""))
    wide = []
    for i, (column, found) in enumerate(kinds.items()):
        wide.append(F.coalesce(F.bit_or(F.when(F.col("place") == i, mask)), F.lit(0).cast("long")).alias(f"__m{i}"))
        for bit, kind in enumerate(found, 1):
            if _has_samples(kind, registry):
                wide.append(F.max(F.when((F.col("place") == i) & (F.col("bit") == bit) & applies, samples)).alias(f"__s{i}_{bit}"))
    return own.groupBy(F.col("source").alias("__file")).agg(*wide)


def _guarded(step: Step, on: Column) -> Step:
    """The step where ``on`` holds; elsewhere nothing is found, changed or counted."""
    return Step(
        find=lambda v: F.when(on, step.find(v)),
        rewrite=lambda v, hit: F.when(on, step.rewrite(v, hit)).otherwise(v),
        flags={flag: (lambda hit, changed=changed: on & F.coalesce(changed(hit), F.lit(False))) for flag, changed in step.flags.items()},
    )


def _cell_step(rules: Sequence[tuple[P.Rule, Column]], mode: str, salt: str) -> Step:
    """REM-5 with a condition for each rule: the first rule of the file that matches wins."""

    def find(v: Column) -> Column:
        bare = strip(v)
        label = F.when(F.lit(False), F.lit(None).cast("string"))
        for rule, on in rules:
            label = label.when(on & rule.matches(bare), rule.name)
        return F.when(bare != "", label)

    def rewrite(v: Column, label: Column) -> Column:
        out = F.when(F.lit(False), v)
        for rule, _ in rules:
            out = out.when(label == rule.name, token(strip(v), rule.name, mode, salt))
        return out.otherwise(v)

    return Step(find, rewrite, {(rule.name, REGEX_SOURCE): (lambda label, name=rule.name: label == name) for rule, _ in rules})


def _example_step(samples: Column, kind: Kind, mode: str, salt: str) -> Step:
    """REM-6 with the examples of the row's own file."""
    pattern, origin = kind

    def rewrite(v: Column, hit: Column) -> Column:
        done = F.aggregate(samples, v, lambda text, s: F.replace(text, s, token(s, pattern, mode, salt)))
        return F.when(hit, done).otherwise(v)

    return Step(find=lambda v: F.exists(samples, lambda s: F.contains(v, s)), rewrite=rewrite, flags={kind: lambda hit: hit})


def _steps(
    column: str, place: int, found: Sequence[Kind], mode: str, salt: str, person: bool, location: bool, common: bool,
    dates: bool, patterns: set[str] | None, registry: PatternRegistry, protect_tokens: bool,
) -> list[Step]:
    on = lambda bit: F.getbit(F.col(f"__m{place}"), F.lit(bit)) == 1
    steps: list[Step] = []
    rules: list[tuple[P.Rule, Column]] = []

    def flush() -> None:
        if rules:
            steps.append(_cell_step(list(rules), mode, salt))
            rules.clear()

    for bit, (pattern, origin) in enumerate(found, 1):
        if origin == REGEX_SOURCE and pattern in registry:
            rules.append((registry[pattern], on(bit)))
            continue
        flush()
        if origin in ENTITY_SOURCES:
            steps += [_guarded(s, on(bit)) for s in entity_steps(column, pattern, origin, mode, salt, person, location)]
        else:
            steps.append(_guarded(_example_step(F.col(f"__s{place}_{bit}"), (pattern, origin), mode, salt), on(bit)))
    flush()
    if common:
        steps += [_guarded(s, on(0)) for s in common_steps(mode, salt, dates, patterns, protect_tokens)]
    return steps


def remediate_files(
    df: DataFrame,
    findings: DataFrame,
    source: str,
    mode: str = "redact",
    salt: str = DEFAULT_SALT,
    include_review: bool = True,
    person: bool = True,
    location: bool = True,
    common: bool = True,
    dates: bool = True,
    patterns: Iterable[str] | None = None,
    registry: PatternRegistry = DEFAULT_REGISTRY,
    protect_tokens: bool = False,
) -> FilesResult:
    """REM-15 for the rows of many files: ``df[source]`` names a row's file, ``findings.source`` a finding's.

    A row is rewritten by the findings of its own file, as :func:`remediate` would rewrite that file alone; rows of files
    without findings, or without a name, stay as they are. Columns with a step for some file are returned as text. The join
    of rows and numbers has one row for each file on its right; Spark broadcasts it while it is small.
    """
    selected = set(patterns) if patterns else None
    strategy = strategy_label(mode)
    columns = [c for c in df.columns if c != source]
    kinds = finding_kinds(findings, columns, selected)
    empty = literal_rows(df.sparkSession, [], AUDIT)
    if not kinds:
        return FilesResult(df, empty, source, strategy)
    masks = file_masks(findings, kinds, include_review, registry)
    joined = df.join(masks, q(source).cast("string") == F.col("__file"), "left").drop("__file")
    joined = joined.withColumns({f"__m{i}": F.coalesce(f"__m{i}", F.lit(0).cast("long")) for i in range(len(kinds))})
    steps = {
        column: _steps(column, i, found, mode, salt, person, location, common, dates, selected, registry, protect_tokens)
        for i, (column, found) in enumerate(kinds.items())
    }
    flagged, flags = apply_steps(joined, steps)
    counters: list[tuple[str, Flag, Column]] = []
    for column in sorted(flags):
        merged: dict[Flag, Column] = {}
        for flag, name in flags[column]:
            merged[flag] = merged[flag] | F.col(name) if flag in merged else F.col(name)
        counters += [(column, flag, changed) for flag, changed in merged.items()]
    data = flagged.select(*[q(c) for c in df.columns])
    if not counters:
        return FilesResult(data, empty, source, strategy)
    sums = flagged.groupBy(q(source).cast("string").alias("file_name")).agg(
        *[F.count_if(c).alias(f"c{i}") for i, (_, _, c) in enumerate(counters)]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(column).alias("column"),
                F.lit(flag[0]).alias("pattern"),
                F.lit(flag[1]).alias("detection_source"),
                F.lit(strategy).alias("strategy"),
                F.col(f"c{i}").alias("cells_changed"),
            )
            for i, (column, flag, _) in enumerate(counters)
        ]
    )
    audit = sums.select("file_name", F.explode(rows).alias("r")).select("file_name", "r.*").where("cells_changed > 0")
    return FilesResult(data, audit, source, strategy)


AUDIT = "file_name string, column string, pattern string, detection_source string, strategy string, cells_changed long"

__all__ = ["remediate_files", "FilesResult", "file_masks", "finding_kinds"]
