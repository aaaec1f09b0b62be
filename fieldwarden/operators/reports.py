"""Summaries of findings and audit rows (AGG-1..9, PRD-8..10, DQ-8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwarden.functions.patterns import ENTITY_SOURCES, FALLBACK_SOURCE, REGEX_SOURCE

# Risk levels, display names and source suffixes.
RISK_LEVELS = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "REVIEW")
DISPLAY_ALIASES = {
    "PHONE_NUMBER": "Phone",
    "EMAIL_ADDRESS": "Email",
    "US_SSN": "SSN",
    "CREDIT_CARD": "Credit Card",
    "IP_ADDRESS": "IP",
    "PERSON": "Person",
    "LOCATION": "Location",
}
SOURCE_SUFFIXES = {REGEX_SOURCE: "Regex", FALLBACK_SOURCE: "Fallback"} | {s: "NLP" for s in ENTITY_SOURCES}
SAMPLE_COLUMNS = [f"sample_match_{i}" for i in range(1, 6)]


def _lookup(key: Column, table: dict[str, str]) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for k, v in table.items():
        out = out.when(key == k, v)
    return out


def drop_entity_findings(findings: DataFrame) -> DataFrame:
    """PRD-8."""
    return findings.where(~F.col("detection_source").isin(*ENTITY_SOURCES))


def known_columns(findings: DataFrame) -> DataFrame:
    """PRD-9: distinct flagged columns."""
    return findings.select("column").where(F.coalesce(F.col("column"), F.lit("")) != "").distinct()


def hide_samples(findings: DataFrame) -> DataFrame:
    """PRD-10."""
    return findings.drop(*SAMPLE_COLUMNS)


def display_label(pattern: Column, detection_source: Column) -> Column:
    """AGG-9: readable pattern name with its detection kind."""
    bare = F.trim(F.coalesce(pattern, F.lit("")))
    name = F.coalesce(_lookup(bare, DISPLAY_ALIASES), F.initcap(F.trim(F.replace(bare, F.lit("_"), F.lit(" ")))))
    suffix = _lookup(F.trim(F.coalesce(detection_source, F.lit(""))), SOURCE_SUFFIXES)
    shown = F.when(suffix.isNotNull(), F.concat(name, F.lit("("), suffix, F.lit(")"))).otherwise(name)
    return F.when(bare == "", "").otherwise(shown)


def with_display_label(findings: DataFrame) -> DataFrame:
    return findings.withColumn("pattern", display_label(F.col("pattern"), F.col("detection_source")))


def risk_summary(findings: DataFrame) -> DataFrame:
    """AGG-1: one row, five fixed levels, zero filled."""
    return findings.agg(*[F.count_if(F.col("risk") == level).alias(level) for level in RISK_LEVELS])


def risk_counts(findings: DataFrame) -> DataFrame:
    """AGG-4: counts of the levels that occur."""
    return findings.groupBy("risk").agg(F.count(F.lit(1)).alias("findings"))


def top_findings(findings: DataFrame, n: int = 10) -> DataFrame:
    """AGG-2: matches by displayed pattern and risk, largest first."""
    return (
        with_display_label(findings)
        .groupBy("pattern", "risk")
        .agg(F.sum("matches").alias("matches"))
        .orderBy(F.desc("matches"), "pattern", "risk")
        .limit(n)
    )


def distinct_findings(findings: DataFrame) -> DataFrame:
    """AGG-5."""
    return findings.select("column", "pattern", "risk", "detection_source").distinct()


def sorted_findings(findings: DataFrame) -> DataFrame:
    """AGG-8: listing in plain string order."""
    shown = [
        "source", "column", "pattern", "risk", "confidence", "matches", "match_pct", "detection_source",
        "sample_match_1",
    ]
    return findings.select(*shown).orderBy("risk", "detection_source", "source", "column", "pattern")


def remediation_summary(audit: DataFrame) -> DataFrame:
    """AGG-3."""
    return (
        audit.groupBy("file_name", "pattern", "strategy")
        .agg(F.sum("cells_changed").alias("cells_changed"))
        .orderBy(F.desc("cells_changed"), "file_name", "pattern")
    )


def total_cells(audit: DataFrame) -> DataFrame:
    """AGG-7."""
    return audit.agg(F.coalesce(F.sum("cells_changed"), F.lit(0)).alias("total_cells_changed"))


def quality_score(report: DataFrame) -> DataFrame:
    """DQ-8: whole-percent score and its band."""
    score = F.when(F.col("evaluated") > 0, F.bround(F.col("successful") / F.col("evaluated") * 100, 0)).otherwise(0.0)
    scored = report.withColumn("score", score.cast("long"))
    band = (
        F.when(F.col("evaluated") == 0, "none run")
        .when(F.col("score") >= 90, "meets")
        .when(F.col("score") >= 70, "warn")
        .otherwise("fail")
    )
    return scored.withColumn("band", band)


def file_rollup(
    findings: DataFrame, reports: DataFrame, audit: DataFrame, status: DataFrame | None = None
) -> DataFrame:
    """AGG-6: findings, quality score, remediated cells and errors per file.

    ``findings`` is keyed by ``source``, ``reports`` by ``file_name``, ``audit``
    by ``file_name``, ``status`` by ``file`` with a ``state``.
    """
    found = findings.groupBy(F.col("source").alias("file")).agg(F.count(F.lit(1)).alias("pii_findings"))
    scores = quality_score(reports).select(F.col("file_name").alias("file"), F.col("score").alias("dq_score"))
    cells = audit.groupBy(F.col("file_name").alias("file")).agg(F.sum("cells_changed").alias("cells_remediated"))
    files = found.select("file").union(scores.select("file")).union(cells.select("file"))
    if status is not None:
        errors = status.groupBy("file").agg(F.count_if(F.col("state") == "FAILED").alias("errors"))
        files = files.union(errors.select("file"))
    out = files.distinct().join(found, "file", "left").join(scores, "file", "left").join(cells, "file", "left")
    out = out.join(errors, "file", "left") if status is not None else out.withColumn("errors", F.lit(0).cast("long"))
    return out.select(
        "file",
        F.coalesce("pii_findings", F.lit(0)).alias("pii_findings"),
        "dq_score",
        F.coalesce("cells_remediated", F.lit(0)).alias("cells_remediated"),
        F.coalesce("errors", F.lit(0)).alias("errors"),
    )
