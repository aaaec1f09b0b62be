"""Personal-data scan of a table: candidate columns, rule counts, findings (PRD-*, DET-*)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwarden.functions.entities import rule_spans
from fieldwarden.functions.patterns import (
    CANDIDATE_HINTS,
    DEFAULT_REGISTRY,
    ENTITY_PRIORITY_HINTS,
    ENTITY_SOURCE,
    REGEX_SOURCE,
    PatternRegistry,
    contains_any,
)
from fieldwarden.functions.text import has_more_than_three_words, lit_strings
from fieldwarden.operators.entities import entity_hits, entity_scan, entity_values
from fieldwarden.operators.values import (
    literal_rows,
    long_form,
    near_first,
    q,
    sample_values,
    stripped_cells,
    top_n,
)

KEYS = ["source", "column"]
EXAMPLES = 5
#: Longer texts travel as their digests.
LONG = 256
DOMINANT_SHARE = 0.8
KIND_COLUMNS = ["source", "column", "pattern", "risk", "detection_source"]
FINDING_COLUMNS = [
    "source", "column", "pattern", "confidence", "risk", "matches", "sample_size", "match_pct",
    "entity_score", "sample_match_1", "sample_match_2", "sample_match_3", "sample_match_4",
    "sample_match_5", "detection_source", "detection_timestamp",
]


@dataclass
class ScanResult:
    """Findings, and what is only planned when asked for: per-source statistics, and the kinds of findings alone.

    ``kinds`` has source, column, pattern, risk and detection source of every finding; without examples and shares it needs
    no ranking, which is all that a rewriting by rules and recognisers asks for.
    """

    findings: DataFrame
    build_stats: Callable[[DataFrame], DataFrame]
    build_kinds: Callable[[], DataFrame] | None = None

    @cached_property
    def kinds(self) -> DataFrame:
        return self.build_kinds() if self.build_kinds else self.findings.select(*KIND_COLUMNS)

    @cached_property
    def stats(self) -> DataFrame:
        return self.build_stats(self.findings)


def column_shape(sample: DataFrame) -> DataFrame:
    """PRD-4 per column: size, mean length, share of wordy values, free-text verdict."""
    value = F.col("value")
    return (
        sample.groupBy(*KEYS)
        .agg(
            F.count(F.lit(1)).alias("sample_size"),
            F.avg(F.length(value)).alias("avg_length"),
            F.avg(F.when(has_more_than_three_words(value), 1.0).otherwise(0.0)).alias("wordy_share"),
        )
        .withColumn("free_text", free_text(F.col("avg_length"), F.col("wordy_share")))
    )


def free_text(avg_length: Column, wordy_share: Column) -> Column:
    return (avg_length > 15) | (wordy_share > 0.25)


def candidate(column: Column) -> Column:
    return contains_any(F.lower(column), CANDIDATE_HINTS)


def priority(column: Column) -> Column:
    return contains_any(F.lower(column), ENTITY_PRIORITY_HINTS)


def scan_gate(source: Column, column: Column, is_free_text: Column) -> Column:
    """PRD-5: text files always, else by name, else by shape."""
    return F.lower(source).endswith(".txt") | candidate(column) | F.coalesce(is_free_text, F.lit(False))


def match_counts(sample: DataFrame, registry: PatternRegistry = DEFAULT_REGISTRY) -> DataFrame:
    """DET-1 on a bounded sample: one row per column and matching rule.

    A column contributes at most the sample limit, so its matches and examples
    are gathered in the same single aggregation that measures its shape.
    """
    return _unfold(_column_summary(sample, registry), registry)


def _column_summary(sample: DataFrame, registry: PatternRegistry) -> DataFrame:
    """One row per column: shape, matches per rule (``n``) and the matching values per rule (``e``)."""
    value = F.col("value")
    rules = range(len(registry.names))
    flagged = sample.select(
        *KEYS,
        "rn",
        "value",
        has_more_than_three_words(value).alias("wordy"),
        F.array(*[rule.matches(value) for rule in registry]).alias("hit"),
    )
    counts = ", ".join(f"count_if(hit[{i}])" for i in rules)
    examples = ", ".join(
        f"slice(sort_array(collect_list(if(hit[{i}], struct(rn, value), null))), 1, {EXAMPLES}).value" for i in rules
    )
    return flagged.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("sample_size"),
        F.expr("avg(length(value))").alias("avg_length"),
        F.expr("avg(if(wordy, 1.0D, 0.0D))").alias("wordy_share"),
        F.expr(f"array({counts})").alias("n"),
        F.expr(f"array({examples})").alias("e"),
    )


def _unfold(summary: DataFrame, registry: PatternRegistry) -> DataFrame:
    found = F.arrays_zip(lit_strings(registry.names).alias("pattern"), F.col("n").alias("matches"), F.col("e").alias("examples"))
    return (
        summary.select(*KEYS, "sample_size", "avg_length", "wordy_share", F.explode(found).alias("m"))
        .select(*KEYS, "sample_size", "avg_length", "wordy_share", "m.*")
        .where(F.col("matches") > 0)
    )


def dominant() -> Column:
    """PRD-6: some rule covers at least 80 % of the sample."""
    return F.array_max("n") / F.col("sample_size") >= DOMINANT_SHARE


def _percent(part: Column, whole: Column) -> Column:
    return F.bround(part / whole * 100, 2)


def _example_columns(examples: Column) -> list[Column]:
    return [
        F.coalesce(F.get(examples, F.lit(i)), F.lit("")).alias(f"sample_match_{i + 1}")
        for i in range(EXAMPLES)
    ]


def _now() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def scan_sample(
    sample: DataFrame,
    columns: DataFrame,
    registry: PatternRegistry = DEFAULT_REGISTRY,
    entities: bool = True,
    spans: Callable[[Column], Column] = rule_spans,
) -> ScanResult:
    """DET-5/6 from sampled values of any number of sources.

    ``columns`` lists every ``(source, column)``, so columns without any value
    still count as scanned when their name or source asks for it.
    """
    # The summary has one row per column; it carries all gates.
    summary = _column_summary(sample, registry)
    is_free = free_text(F.col("avg_length"), F.col("wordy_share"))
    gated = summary.select(
        "*",
        scan_gate(F.col("source"), F.col("column"), is_free).alias("scanned"),
        ((is_free | priority(F.col("column"))) & (priority(F.col("column")) | ~dominant())).alias("entity_gate"),
    )
    findings = _as_findings(_rated(_unfold(gated.where("scanned"), registry), registry))
    if entities:
        allowed = gated.where("scanned AND entity_gate").select(*KEYS, "sample_size")
        hits = entity_scan(sample.join(allowed, KEYS, "left_semi"), spans)
        findings = findings.unionByName(_entity_findings(hits, allowed))
    return ScanResult(findings, lambda found: _stats(columns, gated.select(*KEYS, "scanned"), found))


def _rated(rows: DataFrame, registry: PatternRegistry) -> DataFrame:
    """DET-2..4 added to rows of column, pattern, matches and sample size."""
    return (
        rows.select(
            "*",
            registry.confidence(F.col("column"), F.col("pattern")).alias("confidence"),
            _percent(F.col("matches"), F.col("sample_size")).alias("match_pct"),
            F.lit(None).cast("double").alias("entity_score"),
            F.lit(REGEX_SOURCE).alias("detection_source"),
        )
        .withColumn("risk", registry.risk(F.col("pattern"), F.col("confidence"), F.col("match_pct")))
    )


def _stats(columns: DataFrame, shape: DataFrame, findings: DataFrame) -> DataFrame:
    counted = findings.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("findings"))
    by_name = scan_gate(F.col("source"), F.col("column"), F.lit(False))
    return (
        columns.join(shape, KEYS, "left")
        .join(counted, KEYS, "left")
        .groupBy("source")
        .agg(
            F.count_if(F.coalesce("scanned", by_name)).alias("columns_scanned"),
            F.coalesce(F.sum("findings"), F.lit(0)).alias("findings"),
        )
    )


def _as_findings(rows: DataFrame) -> DataFrame:
    return rows.select(
        *KEYS, "pattern", "confidence", "risk", "matches", "sample_size", "match_pct", "entity_score",
        *_example_columns(F.col("examples")), "detection_source", _now().alias("detection_timestamp"),
    )


def column_list(df: DataFrame, source: str, columns: Sequence[str] | None = None) -> DataFrame:
    names = list(columns) if columns is not None else list(df.columns)
    return literal_rows(df.sparkSession, [(source, n) for n in names], "source string, column string")


def scan(
    df: DataFrame,
    source: str,
    *,
    columns: Sequence[str] | None = None,
    order_by: str | Sequence[str] | None = None,
    sample_limit: int | None = None,
    entities: bool = True,
    spans: Callable[[Column], Column] = rule_spans,
    registry: PatternRegistry = DEFAULT_REGISTRY,
) -> ScanResult:
    """Scan one table: every distinct value of each column, or only the first ``sample_limit`` when one is given.

    Findings from a sample say nothing about later values, so do not remediate by them.
    """
    if sample_limit is None:
        cells = stripped_cells(long_form(df, columns, order_by, source))
        return scan_cells(cells, column_list(df, source, columns), registry, entities, spans)
    sample = sample_values(df, columns, sample_limit, order_by, source)
    return scan_sample(sample, column_list(df, source, columns), registry, entities, spans)


def tallied(cells: DataFrame, registry: PatternRegistry) -> tuple[DataFrame, DataFrame]:
    """One row per column with its shape and tallies, and the first matching values per column and rule.

    Every step aggregates partially per task; examples come from a two-level
    top-n, never from a collected group.  Values beyond 256 characters travel
    as their SHA-256 after the rules have seen them, so long texts are not
    shuffled just to be counted.
    """
    return value_tallies(distinct_cells(cells, registry), registry)


def distinct_cells(cells: DataFrame, registry: PatternRegistry) -> DataFrame:
    """The distinct stripped values of ``cells``, as :func:`value_tallies` reads them."""
    value = F.col("value")
    is_long = F.length(value) > LONG
    # Only long values are tested before the shuffle; one that matches keeps its text.
    early = cells.select("*", F.when(is_long, registry.mask(value)).alias("early"))
    keyed = early.select(
        *KEYS, "rid", "early",
        F.when(is_long, F.length(value)).alias("chars"),
        F.when(is_long, has_more_than_three_words(value).cast("int")).alias("wordy"),
        F.when(is_long, F.sha2(value, 256)).alias("digest"),
        F.when(~is_long | (F.col("early") > 0), value).alias("value"),
    )
    index = keyed.groupBy(*KEYS, "value", "digest").agg(
        F.count(F.lit(1)).alias("cnt"), F.min("rid").alias("first_rid"), F.max("early").alias("early"),
        F.max("chars").alias("chars"), F.max("wordy").alias("wordy"),
    )
    # short values are measured once each
    chars, wordy = F.coalesce("chars", F.length("value")), F.coalesce("wordy", has_more_than_three_words(F.col("value")).cast("int"))
    return index.withColumns({"chars": chars, "wordy": wordy})


def masked_values(index: DataFrame, registry: PatternRegistry) -> DataFrame:
    """``index`` with the rules that match (``mask``); ``digest`` tells long texts."""
    return index.select(
        *KEYS, "value", "digest", "cnt", "first_rid", "chars", "wordy", F.coalesce("early", registry.mask(F.col("value"))).alias("mask")
    )


def value_tallies(index: DataFrame, registry: PatternRegistry) -> tuple[DataFrame, DataFrame]:
    """The tallies of distinct stripped values: ``source, column, value, digest, cnt, first_rid, early, chars, wordy``."""
    return mask_tallies(masked_values(index, registry).drop("digest"), registry)


def mask_tallies(masked: DataFrame, registry: PatternRegistry, stored: bool = False) -> tuple[DataFrame, DataFrame]:
    """The tallies of :func:`masked_values`; where these are ``stored``, few of them are ranked for examples."""
    # Entry -1 stands for the value itself and yields the totals.
    entries = F.concat(F.array(F.lit(-1)), registry.rules_of(F.col("mask")))
    exploded = masked.select(*KEYS, "value", "cnt", "first_rid", "chars", "wordy", F.explode(entries).alias("rule_order"))
    tallies = exploded.groupBy(*KEYS, "rule_order").agg(
        F.count(F.lit(1)).alias("matches"),
        # both branches read every column of the index; that keeps their plans below the exchange equal, and the exchange shared
        F.sum(F.when(F.col("first_rid").isNotNull(), F.col("cnt"))).alias("rows"),
        F.sum("chars").alias("chars"), F.sum("wordy").alias("wordy"),
    )
    # At most one entry per rule and column; the totals entry is read beside the others.
    grouped = tallies.groupBy(*KEYS).agg(F.collect_list(F.struct("rule_order", "matches", "rows", "chars", "wordy")).alias("t"))
    total = F.get(F.filter("t", lambda x: x["rule_order"] == -1), F.lit(0))
    rules = F.filter("t", lambda x: x["rule_order"] >= 0)
    per_column = grouped.select(
        *KEYS,
        total["matches"].alias("sample_size"),
        total["rows"].alias("total_rows"),
        (total["chars"] / total["matches"]).alias("avg_length"),
        (total["wordy"] / total["matches"]).alias("wordy_share"),
        F.coalesce(F.array_max(F.transform(rules, lambda x: x["matches"])), F.lit(0)).alias("most"),
        rules.alias("t"),
    )
    matching = exploded.where("rule_order >= 0 AND cnt > 0 AND chars >= 0 AND wordy >= 0")
    if stored:
        matching = near_first(matching, [*KEYS, "rule_order"], "first_rid", EXAMPLES, ["value"])
    firsts = (
        top_n(matching, [*KEYS, "rule_order"], [F.col("first_rid"), F.col("value")], EXAMPLES, ["value"], "k")
        .groupBy(*KEYS, "rule_order")
        .agg(F.sort_array(F.collect_list(F.struct("k", "value", "cnt"))).alias("e"))
        .select(*KEYS, "rule_order", F.col("e.value").alias("examples"))
    )
    return per_column, firsts


def _rule_rows(per_column: DataFrame, firsts: DataFrame | None, registry: PatternRegistry) -> DataFrame:
    own = [*KEYS, *(["name"] if "name" in per_column.columns else [])]
    counts = per_column.select(*own, "sample_size", "total_rows", F.explode("t").alias("x")).select(
        *own, "sample_size", "total_rows", "x.rule_order", "x.matches", "x.rows"
    )
    named = F.get(lit_strings(registry.names), F.col("rule_order"))
    return (counts if firsts is None else counts.join(firsts, [*KEYS, "rule_order"])).withColumn("pattern", named)


def full_counts(cells: DataFrame, registry: PatternRegistry = DEFAULT_REGISTRY) -> DataFrame:
    """DET-7 counts over all distinct values: ``matches`` (distinct) and ``rows`` (weighted)."""
    return _rule_rows(*tallied(cells, registry), registry)


def full_shape(cells: DataFrame, registry: PatternRegistry = DEFAULT_REGISTRY) -> DataFrame:
    """PRD-4 over every distinct value of a column."""
    per_column, _ = tallied(cells, registry)
    return per_column.select(
        *KEYS, "sample_size", "avg_length", "wordy_share", free_text(F.col("avg_length"), F.col("wordy_share")).alias("free_text")
    )


def scan_cells(
    cells: DataFrame,
    columns: DataFrame,
    registry: PatternRegistry = DEFAULT_REGISTRY,
    entities: bool = True,
    spans: Callable[[Column], Column] = rule_spans,
) -> ScanResult:
    """DET-5..7 over every distinct value of any number of sources (stripped ``source, column, value, rid``)."""
    per_column, firsts = tallied(cells, registry)
    return scan_tallies(per_column.withColumn("name", F.col("column")), firsts, cells, columns, registry, entities, spans)


def scan_tallies(
    per_column: DataFrame,
    firsts: DataFrame,
    cells: DataFrame,
    columns: DataFrame,
    registry: PatternRegistry = DEFAULT_REGISTRY,
    entities: bool = True,
    spans: Callable[[Column], Column] = rule_spans,
    masked: DataFrame | None = None,
) -> ScanResult:
    """Findings and statistics from tallies; ``name`` is how a column is shown, ``column`` how its cells are keyed.

    With stored :func:`masked_values`, the built-in recognisers read short texts there, and ``cells`` only for the long ones.
    """
    is_free = free_text(F.col("avg_length"), F.col("wordy_share"))
    wanted = priority(F.col("name"))
    ruled = F.col("most") / F.col("sample_size") >= DOMINANT_SHARE
    gated = per_column.select(
        "*",
        scan_gate(F.col("source"), F.col("name"), is_free).alias("scanned"),
        ((is_free | wanted) & (wanted | ~ruled)).alias("entity_gate"),
    )
    scanned = gated.where("scanned")
    rules = _rule_rows(scanned, firsts, registry).drop("column").withColumnRenamed("name", "column")
    findings = _as_findings(_rated(rules, registry))
    allowed = gated.where("scanned AND entity_gate").select(*KEYS, "name", "sample_size")

    def values() -> DataFrame:
        # one row per column
        own = F.broadcast(allowed.select(*KEYS))
        if masked is None or spans is not rule_spans:
            return entity_values(cells.join(own, KEYS, "left_semi"), spans)
        short = masked.where("digest IS NULL").join(own, KEYS, "left_semi")
        long = entity_values(cells.where(F.length("value") > LONG).join(own, KEYS, "left_semi"), spans)
        return short.select(*KEYS, F.col("first_rid").alias("rn"), spans(F.col("value")).alias("spans")).unionByName(long)

    if entities:
        findings = findings.unionByName(_entity_findings(entity_scan(values(), spans, masked is not None), allowed))

    def kinds() -> DataFrame:
        plain = _rule_rows(scanned, None, registry).drop("column").withColumnRenamed("name", "column")
        found = _rated(plain, registry).select(*KIND_COLUMNS)
        if not entities:
            return found
        named = entity_hits(values(), spans).select(*KEYS, "entity").distinct().join(allowed, KEYS)
        return found.unionByName(
            named.select("source", F.col("name").alias("column"), F.col("entity").alias("pattern"), F.lit("REVIEW").alias("risk"), F.lit(ENTITY_SOURCE).alias("detection_source"))
        )

    shape = gated.select("source", F.col("name").alias("column"), "scanned")
    return ScanResult(findings, lambda found: _stats(columns, shape, found), kinds)


def _entity_findings(hits: DataFrame, allowed: DataFrame) -> DataFrame:
    if "name" in allowed.columns:
        hits = hits.join(allowed, KEYS).drop("column").withColumnRenamed("name", "column")
    else:
        hits = hits.join(allowed, KEYS)
    found = hits.select(
        *KEYS, "matches", "sample_size", "entity_score", "examples",
        F.col("entity").alias("pattern"),
        F.lit("AI").alias("confidence"),
        F.lit("REVIEW").alias("risk"),
        _percent(F.col("matches"), F.col("sample_size")).alias("match_pct"),
        F.lit(ENTITY_SOURCE).alias("detection_source"),
    )
    return _as_findings(found)


def scan_files(
    df: DataFrame,
    source: str,
    *,
    columns: Sequence[str] | None = None,
    order_by: str | Sequence[str] | None = None,
    entities: bool = True,
    spans: Callable[[Column], Column] = rule_spans,
    registry: PatternRegistry = DEFAULT_REGISTRY,
) -> ScanResult:
    """DET-6 for rows of many files of one layout: ``df[source]`` names a row's file, rows without a name are left out."""
    names = list(columns) if columns is not None else [c for c in df.columns if c != source]
    named = df.where(q(source).isNotNull())
    cells = stripped_cells(long_form(named, names, order_by, q(source).cast("string")))
    listing = named.select(q(source).cast("string").alias("source")).distinct()
    listing = listing.select("source", F.explode(F.array(*[F.lit(n) for n in names])).alias("column"))
    return scan_cells(cells, listing, registry, entities, spans)


def full_scan(
    df: DataFrame,
    source: str,
    *,
    columns: Sequence[str] | None = None,
    order_by: str | Sequence[str] | None = None,
    registry: PatternRegistry = DEFAULT_REGISTRY,
) -> ScanResult:
    """DET-7 as findings of the rules alone."""
    return scan(df, source, columns=columns, order_by=order_by, entities=False, registry=registry)


__all__ = [
    "ScanResult", "FINDING_COLUMNS", "column_shape", "free_text", "candidate", "priority", "scan_gate",
    "match_counts", "scan_sample", "scan_cells", "scan_tallies", "tallied", "value_tallies", "distinct_cells", "masked_values", "mask_tallies", "scan", "scan_files", "full_counts", "full_shape", "full_scan", "column_list", "sample_values",
]
