"""Tables sent to and read back from an external reviewer (QLT-4..6, AUT-1, AUT-2, AUT-5, AUT-6).

The reviewer itself (a hosted model or a person) is outside this library; its
answers arrive as a text column with one JSON answer per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwarden.operators.expectations import BETWEEN, IN_SET, LENGTHS, NOT_NULL, REGEX, UNIQUE
from fieldwarden.operators.values import first_cells, literal_rows, long_form

# Payload sizes, wrapper keys, accepted expectation types, clamps.
PRIVACY_ROWS = 5
QUALITY_ROWS = 8
WRAPPER_KEYS = ("expectations", "items", "results", "data", "checks")
ALLOWED_TYPES = (NOT_NULL, UNIQUE, BETWEEN, IN_SET, REGEX, LENGTHS)
MIN_MOSTLY = 0.95


def sample_payload(
    df: DataFrame,
    rows: int = PRIVACY_ROWS,
    skip: Sequence[str] = (),
    order_by: str | Sequence[str] | None = None,
    max_columns: int | None = None,
) -> DataFrame:
    """QLT-4: first non-null texts per column as one JSON object (PRD-11: known columns skipped).

    All other columns, or the first ``max_columns`` where a reviewer takes no more.
    """
    names = [c for c in df.columns if c not in set(skip)][:max_columns]
    listed = literal_rows(df.sparkSession, [(i, c) for i, c in enumerate(names)], "position int, column string")
    firsts = first_cells(long_form(df, names, order_by), rows)
    entries = F.sort_array(F.collect_list(F.struct("position", "column", "values")))
    return (
        listed.join(firsts, "column", "left")
        .select("position", "column", F.coalesce("values", F.array().cast("array<string>")).alias("values"))
        .agg(entries.alias("e"))
        .select(
            F.to_json(
                F.map_from_entries(F.transform("e", lambda r: F.struct(r["column"], r["values"])))
            ).alias("payload")
        )
    )


def failure_payload(report: DataFrame, failures: DataFrame) -> DataFrame:
    """QLT-6: file, counts and failures as JSON; no row when the report passed."""
    listed = failures.groupBy("file_name").agg(
        F.to_json(
            F.transform(
                F.array_sort(
                    F.collect_list(F.struct("index", "expectation", "column", "details")),
                    lambda a, b: a["index"] - b["index"],
                ),
                lambda f: F.map_concat(
                    F.create_map(
                        F.lit("issue"), f["expectation"],
                        F.lit("column"), F.coalesce(f["column"], F.lit("(table-level)")),
                    ),
                    f["details"],
                ),
            )
        ).alias("failures")
    )
    return (
        report.where(~F.col("passed"))
        .join(listed, "file_name")
        .select("file_name", "evaluated", "successful", "failed", "failures")
    )


def _unfenced_json(text: Column) -> Column:
    """Drop a ```` ```json ```` / ```` ``` ```` fence around an answer."""
    bare = F.regexp_replace(F.trim(text), r"\A\s+|\s+\z", "")
    bare = F.regexp_replace(bare, r"\A```json", "")
    bare = F.regexp_replace(bare, r"\A```", "")
    return F.regexp_replace(F.regexp_replace(bare, r"```\z", ""), r"\A\s+|\s+\z", "")


def _text_of(item: Column, key: str) -> Column:
    return F.coalesce(F.try_variant_get(item, f"$.{key}", "string"), F.lit(""))


def response_rows(
    answers: DataFrame,
    text: str,
    required: Sequence[str],
    optional: Sequence[str] = (),
    level: str = "severity",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """QLT-5: review answers as rows.

    Answers that are not a JSON list give no rows; items lacking a required key
    are dropped; the level is upper-cased and defaults to MEDIUM.  With
    ``columns`` the item's column must be one of them.
    """
    keep = [c for c in answers.columns if c != text]
    parsed = F.try_parse_json(_unfenced_json(F.col(text)))
    items = F.try_variant_get(parsed, "$", "array<variant>")
    rows = answers.select(*keep, F.posexplode(items).alias("pos", "item")).where(
        F.schema_of_variant("item").startswith("OBJECT")
    )
    rows = rows.select(
        *keep,
        "pos",
        *[F.trim(_text_of(F.col("item"), k)).alias(k) for k in [*required, *optional]],
        F.upper(F.trim(F.coalesce(F.try_variant_get("item", f"$.{level}", "string"), F.lit("MEDIUM")))).alias(level),
    )
    for key in required:
        rows = rows.where(F.col(key) != "")
    return rows.where(F.col("column").isin(*columns)) if columns is not None else rows


def proposal_items(answers: DataFrame, text: str) -> DataFrame:
    """AUT-6: proposed expectations as one variant per row, in answer order.

    Accepts a bare list or an object holding one under a known key, with any
    code fence.
    """
    keep = [c for c in answers.columns if c != text]
    bare = F.regexp_replace(F.col(text), r"(?U)\A\s+|\s+\z", "")
    bare = F.regexp_replace(bare, r"\A```[a-zA-Z]*\s*", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"\s*```\z", ""), r"(?U)\A\s+|\s+\z", "")
    parsed = F.try_parse_json(bare)
    items = F.coalesce(
        F.try_variant_get(parsed, "$", "array<variant>"),
        *[F.try_variant_get(parsed, f"$.{k}", "array<variant>") for k in WRAPPER_KEYS],
    )
    return answers.select(*keep, F.posexplode(items).alias("pos", "item")).where(
        F.schema_of_variant("item").startswith("OBJECT")
    )


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit(""))


def _member_text(value: Column) -> Column:
    """Text of one set member."""
    text = F.coalesce(F.try_variant_get(value, "$", "string"), F.lit("None"))
    return F.when(F.schema_of_variant(value) == "BOOLEAN", F.initcap(text)).otherwise(text)


def sanitised_specs(items: DataFrame, allowed_columns: Sequence[str]) -> DataFrame:
    """AUT-1: well-formed proposals with cleaned parameters."""
    item = F.col("item")
    keep = [c for c in items.columns if c not in ("item", "pos")]
    kw = F.try_variant_get(item, "$.kwargs", "variant")
    part = lambda key: F.try_variant_get(F.col("kw"), f"$.{key}", "variant")
    raw = lambda key: F.when(part(key).isNotNull() & (_kind(part(key)) != "VOID"), F.to_json(part(key)))
    kind = F.col("expectation_type")
    members = F.transform(F.try_variant_get(F.col("kw"), "$.value_set", "array<variant>"), _member_text)
    mostly = F.coalesce(F.try_variant_get(F.col("kw"), "$.mostly", "double"), F.lit(1.0))
    typed = (
        items.select(
            *keep,
            "pos",
            F.lower(F.trim(_text_of(item, "expectation_type"))).alias("expectation_type"),
            F.trim(_text_of(item, "column")).alias("column"),
            kw.alias("kw"),
            F.trim(_text_of(item, "rationale")).alias("rationale"),
            F.upper(
                F.trim(F.coalesce(F.try_variant_get(item, "$.confidence", "string"), F.lit("MEDIUM")))
            ).alias("confidence"),
        )
        .where(kind.isin(*ALLOWED_TYPES) & F.col("column").isin(*allowed_columns))
        .where(F.col("kw").isNull() | _kind(F.col("kw")).startswith("OBJECT"))
        .select(
            *keep, "pos", "expectation_type", "column", "rationale", "confidence",
            F.when(kind == NOT_NULL, F.least(F.lit(1.0), F.greatest(F.lit(MIN_MOSTLY), mostly)))
            .otherwise(F.try_variant_get(F.col("kw"), "$.mostly", "double")).alias("mostly"),
            F.when(kind == IN_SET, members).alias("value_set"),
            F.when(_kind(part("regex")) == "STRING", F.try_variant_get(F.col("kw"), "$.regex", "string")).alias("regex"),
            raw("min_value").alias("min_value"),
            raw("max_value").alias("max_value"),
        )
    )
    complete = (
        F.when(kind == IN_SET, F.coalesce(F.size("value_set"), F.lit(0)) > 0)
        .when(kind == REGEX, F.coalesce(F.trim("regex"), F.lit("")) != "")
        .when(kind.isin(BETWEEN, LENGTHS), F.col("min_value").isNotNull() | F.col("max_value").isNotNull())
        .otherwise(True)
    )
    params = F.to_json(F.struct("column", "max_value", "min_value", "mostly", "regex", "value_set"))
    return typed.where(complete).withColumn("params", params)


def deduplicated_specs(specs: DataFrame, order: Sequence[str]) -> DataFrame:
    """AUT-2: the first proposal per type, column and parameters, by minimum (partial per task)."""
    payload = [c for c in specs.columns if c not in (*order, "pos", "expectation_type", "column", "params")]
    first = F.min(F.struct(*order, "pos", F.struct(*payload).alias("rest")))
    return (
        specs.groupBy("expectation_type", "column", "params")
        .agg(first.alias("f"))
        .select(*[F.col(f"f.{c}") for c in [*order, "pos"]], "expectation_type", "column", "params", "f.rest.*")
    )


def proposal_diagnostics(
    answers: DataFrame, text: str, items: DataFrame, accepted: DataFrame, allowed_columns: Sequence[str],
    fallback_specs: int = 0,
) -> DataFrame:
    """AUT-5: what became of the proposals, one row."""
    kind = F.lower(F.trim(_text_of(F.col("item"), "expectation_type")))
    column = F.trim(_text_of(F.col("item"), "column"))
    known = kind.isin(*ALLOWED_TYPES)
    # One-row aggregates of three tables, stacked and summed into one row.
    zero = lambda name: F.lit(0).cast("long").alias(name)
    seen = items.agg(
        F.count(F.lit(1)).alias("items_parsed"),
        F.count_if(~known).alias("rejected_unknown_type"),
        F.count_if(known & ~column.isin(*allowed_columns)).alias("rejected_bad_column"),
        *[zero(n) for n in ("response_chars", "responses", "proposed_specs_accepted")],
    )
    asked = answers.agg(
        F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("response_chars"),
        F.count(F.lit(1)).alias("responses"),
        *[zero(n) for n in ("items_parsed", "rejected_unknown_type", "rejected_bad_column", "proposed_specs_accepted")],
    )
    kept = accepted.agg(
        F.count(F.lit(1)).alias("proposed_specs_accepted"),
        *[zero(n) for n in ("items_parsed", "rejected_unknown_type", "rejected_bad_column", "response_chars", "responses")],
    )
    stacked = seen.unionByName(asked).unionByName(kept)
    joined = stacked.agg(*[F.sum(n).alias(n) for n in seen.columns])
    hint = F.when(
        F.col("items_parsed") == 0,
        F.concat(
            F.lit("No parseable JSON items were returned."),
            F.when(F.col("response_chars") == 0, F.lit(" Every response was empty.")).otherwise(F.lit("")),
        ),
    ).when(
        F.col("proposed_specs_accepted") + fallback_specs == 0,
        F.format_string(
            "%d item(s) were returned but all were rejected. Bad type: %d, unrecognised column: %d.",
            "items_parsed", "rejected_unknown_type", "rejected_bad_column",
        ),
    )
    return joined.select(
        F.lit(-(-len(allowed_columns) // 8) if allowed_columns else 1).alias("batches"),
        "responses",
        "response_chars",
        "items_parsed",
        (F.col("proposed_specs_accepted") + fallback_specs).alias("specs_accepted"),
        "proposed_specs_accepted",
        F.lit(fallback_specs).cast("long").alias("profile_fallback_specs"),
        "rejected_unknown_type",
        "rejected_bad_column",
        hint.alias("hint"),
    )
