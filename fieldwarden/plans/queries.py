"""Registered queries: one or more per operator, each over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwarden.functions.patterns import REGEX_SOURCE, contains_any
from fieldwarden.functions.steps import context_digits
from fieldwarden.operators import anomaly, autogen, expectations, privacy, profile, quality, reports, responses, scan
from fieldwarden.operators.entities import entity_scan, entity_values
from fieldwarden.operators.expectations import Expectation
from fieldwarden.operators.profile_state import merged_state, profile_of, profile_state
from fieldwarden.operators.remediate import anonymise, redact_text, remediate
from fieldwarden.operators.remediate_files import remediate_files
from fieldwarden.operators.values import (
    first_cells,
    first_values,
    hash_sample,
    long_form,
    representative_sample,
    sample_values,
    spread,
    stripped_cells,
    value_index,
)
from fieldwarden.plans.analyze import SHARED, analyze
from fieldwarden.plans.tables import CONTACT_COLUMNS, CONTACT_VALUES, IDENTITY_VALUES, KEY_PARTS, contacts, derived, doc_tokens, files, identities, notes, shared_dir, table, talk
from fieldwarden.sources.catalog import file_states, list_files, scan_path, scan_tables
from fieldwarden.sources.readers import text_lines
from fieldwarden.streaming import remediate_stream, write_remediated

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

EMBEDDED = ("email", "phone", "ssn", "credit_card", "ein", "ip")


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


# --- scanning -------------------------------------------------------------


@query
def sample_values_contacts(spark, d):
    return sample_values(contacts(spark, d), CONTACT_VALUES, order_by="rid").select("column", "value", "cnt", "rn")


@query
def column_shape(spark, d):
    parts = [
        long_form(contacts(spark, d), CONTACT_VALUES, "rid", "contacts"),
        long_form(table(spark, d, "documents"), ["text", "lang", "source"], "doc_id", "documents"),
    ]
    shape = scan.full_shape(stripped_cells(parts[0].unionByName(parts[1])))
    return shape.select(
        "source", "column", "sample_size",
        F.round("avg_length", 6).alias("avg_length"),
        F.round("wordy_share", 6).alias("wordy_share"),
        "free_text",
        scan.candidate(F.col("column")).alias("candidate"),
        scan.priority(F.col("column")).alias("priority"),
        scan.scan_gate(F.col("source"), F.col("column"), F.col("free_text")).alias("scanned"),
    )


@query
def pattern_counts(spark, d):
    cells = stripped_cells(long_form(contacts(spark, d), CONTACT_VALUES, "rid"))
    return scan.full_counts(cells).select(
        "column", "pattern", "matches", "sample_size", F.array_join("examples", "|").alias("examples")
    )


def _contact_scan(spark, d) -> scan.ScanResult:
    return scan.scan(contacts(spark, d), "contacts", columns=CONTACT_VALUES, order_by="rid", entities=False)


def _contact_findings(spark, d) -> DataFrame:
    return _contact_scan(spark, d).findings


def _many(spark, d):
    stock = {"region": "r_regionkey", "supplier": "s_suppkey", "part": "p_partkey"}
    tables = {"contacts": (contacts(spark, d), "rid")}
    tables |= {name: (table(spark, d, name), key) for name, key in stock.items()}
    return scan_tables(tables, {"contacts": CONTACT_VALUES}, entities=False)


@query
def scan_findings(spark, d):
    return _many(spark, d).findings.drop("detection_timestamp", "entity_score")


@query
def scan_stats(spark, d):
    return _many(spark, d).stats


@query
def full_scan_contacts(spark, d):
    found = scan.full_scan(contacts(spark, d), "contacts", columns=CONTACT_VALUES, order_by="rid").findings
    return found.select("column", "pattern", "confidence", "risk", "matches", "sample_size", "match_pct", "sample_match_1", "sample_match_5")


@query
def full_scan_tokens(spark, d):
    cells = stripped_cells(long_form(doc_tokens(spark, d), ["token"], ["doc_id", "pos"]))
    return scan.full_counts(cells).select("pattern", "matches", "rows", "sample_size", "total_rows")


@query
def entity_scan_documents(spark, d):
    cells = stripped_cells(long_form(spread(table(spark, d, "documents").select("doc_id", "text")), ["text"], "doc_id"))
    return entity_scan(entity_values(cells)).select("column", "entity", "matches", "entity_score")


@query
def entity_scan_conversations(spark, d):
    """Turns with personal data added by place, so that every recogniser has hits."""
    cells = stripped_cells(long_form(talk(spark, d), ["text"], ["conv_id", "turn"]))
    return entity_scan(entity_values(cells)).select("column", "entity", "matches", "entity_score")


@query
def entity_findings_notes(spark, d):
    found = scan.scan(notes(spark, d), "notes", columns=["full_name", "note"], order_by="rid").findings
    return found.drop("detection_timestamp", "sample_match_4", "sample_match_5")


@query
def scan_identities(spark, d):
    """Dates of birth, passports, routing and tax numbers: the rules that no other table has hits for."""
    found = scan.scan(identities(spark, d), "identities", columns=IDENTITY_VALUES, order_by="rid", entities=False).findings
    return found.drop("detection_timestamp", "entity_score")


@query
def redact_identities(spark, d):
    found = scan.scan(identities(spark, d), "identities", columns=IDENTITY_VALUES, order_by="rid", entities=False).findings
    best = found.where("confidence = 'HIGH'")
    return remediate(identities(spark, d), best, common=False, file_name="identities").data


@query
def rule_findings_only(spark, d):
    found = scan.scan(contacts(spark, d), "contacts", columns=CONTACT_VALUES, order_by="rid").findings
    return reports.drop_entity_findings(found).select("column", "pattern", "risk")


# --- findings reports -------------------------------------------------------


@query
def risk_summary(spark, d):
    return reports.risk_summary(_contact_findings(spark, d))


@query
def risk_counts(spark, d):
    return reports.risk_counts(_contact_findings(spark, d))


@query
def top_findings(spark, d):
    return reports.top_findings(_contact_findings(spark, d))


@query
def distinct_findings(spark, d):
    return reports.distinct_findings(_contact_findings(spark, d))


@query
def findings_sorted(spark, d):
    return reports.sorted_findings(_contact_findings(spark, d))


@query
def display_labels(spark, d):
    return reports.with_display_label(_contact_findings(spark, d)).select("column", "pattern")


@query
def known_columns(spark, d):
    return reports.known_columns(_contact_findings(spark, d))


@query
def findings_without_samples(spark, d):
    return reports.hide_samples(_contact_findings(spark, d)).drop("detection_timestamp", "entity_score")


# --- remediation ------------------------------------------------------------


def _remediated(spark, d, mode):
    return remediate(
        contacts(spark, d), _contact_scan(spark, d), mode=mode, salt="s", common=False, file_name="contacts.csv"
    )


def _long(df: DataFrame, columns) -> DataFrame:
    return long_form(df, columns, "rid").select("rid", "column", "value")


@query
def redact_cells(spark, d):
    return _long(_remediated(spark, d, "redact").data, CONTACT_VALUES)


@query
def mask_cells(spark, d):
    return _long(_remediated(spark, d, "mask_last4").data, CONTACT_VALUES)


@query
def hash_cells(spark, d):
    return _long(_remediated(spark, d, "hash").data, CONTACT_VALUES)


@query
def remediation_audit(spark, d):
    return _remediated(spark, d, "redact").audit


@query
def remediation_summary(spark, d):
    return reports.remediation_summary(_remediated(spark, d, "hash").audit)


@query
def total_cells(spark, d):
    return reports.total_cells(_remediated(spark, d, "redact").audit)


@query
def anonymised_cells(spark, d):
    return _long(anonymise(contacts(spark, d), _contact_scan(spark, d)), CONTACT_VALUES)


def _files(spark, d):
    """Three files of one layout whose columns hold different things, rewritten in one plan."""
    rows = files(spark, d)
    found = scan.scan_files(rows, "file", columns=["email", "ssn"], order_by="rid", entities=False).findings
    return remediate_files(rows, found, "file")


@query
def remediate_many_files(spark, d):
    return _files(spark, d).data


@query
def remediate_many_audit(spark, d):
    return _files(spark, d).audit


@query
def sample_literals(spark, d):
    found = _contact_findings(spark, d).where("pattern = 'email'").withColumn("detection_source", F.lit("MANUAL"))
    done = remediate(contacts(spark, d), found, common=False, file_name="contacts.csv")
    return done.data.select("rid", "email")


def _documents(spark, d) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


@query
def redact_documents(spark, d):
    return redact_text(_documents(spark, d), ["text"], patterns=EMBEDDED).data


@query
def redact_documents_audit(spark, d):
    return redact_text(_documents(spark, d), ["text"], patterns=EMBEDDED, file_name="documents").audit


@query
def hash_documents(spark, d):
    return redact_text(_documents(spark, d), ["text"], mode="hash", salt="s").data


@query
def context_digits_orders(spark, d):
    text = F.concat(
        F.lit("Customer paid by account "), F.lpad(F.col("o_custkey").cast("string"), 10, "0"),
        F.lit(" and then "), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"),
        F.lit(" was booked on the ledger of the month, ABA "),
        F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit("."),
    )
    rows = table(spark, d, "orders").select("o_orderkey", text.alias("text"))
    done = rows.select("o_orderkey", "text", context_digits(F.col("text"), "redact", "s").alias("found"))
    return done.select(
        "o_orderkey", F.coalesce("found.text", "text").alias("text"), "found.routing", "found.account"
    )


@query
def person_location_fallback(spark, d):
    source = notes(spark, d)
    found = scan.scan(source, "notes", columns=["full_name", "note"], order_by="rid").findings
    return remediate(source, found, mode="hash", salt="s", common=False, file_name="notes").data.select(
        "rid", "full_name", "note"
    )


@query
def review_findings_excluded(spark, d):
    source = notes(spark, d)
    found = scan.scan(source, "notes", columns=["full_name", "note"], order_by="rid").findings
    return remediate(source, found, include_review=False, file_name="notes").data.select("rid", "full_name", "note")


@query
def stream_redacted_contacts(spark, d):
    """STR-1: the same rewriting over a file stream, appended to shared storage."""
    batch = table(spark, d, "customer")
    found = _contact_findings(spark, d)
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "customer.parquet").parquet(d)
    rewritten = remediate_stream(derived(stream, CONTACT_COLUMNS), found, common=False)
    run = write_remediated(rewritten, f"{out}/data", f"{out}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return _long(spark.read.parquet(f"{out}/data"), CONTACT_VALUES)


# --- expectations -----------------------------------------------------------


@query
def validate_contacts(spark, d):
    return expectations.validate(contacts(spark, d), order_by="rid", file_name="contacts").report


@query
def validate_findings(spark, d):
    return expectations.validate_findings(_contact_findings(spark, d), file_name="findings").report


@query
def input_suite_outcomes(spark, d):
    suite = expectations.build_input_suite(contacts(spark, d))
    return expectations.run_expectations(contacts(spark, d), suite, "rid").select(
        "index", "expectation", "column", "passed", "element_count", "missing_count", "unexpected_count"
    )


def _contact_specs() -> list[Expectation]:
    return [
        Expectation(expectations.ROW_COUNT, None, {"min_value": 1}),
        Expectation(expectations.EXISTS, "email"),
        Expectation(expectations.EXISTS, "fax"),
        Expectation(expectations.NOT_NULL, "email", {"mostly": 0.9}),
        Expectation(expectations.UNIQUE, "ssn"),
        Expectation(expectations.UNIQUE, "rid"),
        Expectation(expectations.LENGTHS, "zip_code", {"min_value": 5, "max_value": 10}),
        Expectation(expectations.IN_SET, "phone", {"value_set": ["unknown"]}),
        Expectation(expectations.BETWEEN, "rid", {"min_value": 10}),
        Expectation(expectations.BETWEEN, "zip_code", {"min_value": 30000, "max_value": 40000}),
        Expectation(expectations.REGEX, "zip_code", {"regex": "^[0-9]+$", "mostly": 0.5}),
    ]


@query
def expectation_outcomes(spark, d):
    return expectations.run_expectations(contacts(spark, d), _contact_specs(), "rid").select(
        "index", "expectation", "column", "passed", "missing_count", "unexpected_count",
        F.round("unexpected_percent", 6).alias("unexpected_percent"),
        F.element_at(F.col("partial_unexpected_list"), 1).alias("first_bad"),
    )


@query
def expectation_failures(spark, d):
    result = expectations.build_report(expectations.run_expectations(contacts(spark, d), _contact_specs(), "rid"))
    return result.failures.select(
        "index", "expectation", "column", F.map_keys("details").alias("k"), F.map_values("details").alias("v")
    ).select("index", "expectation", "column", F.array_join("k", "|").alias("detail_keys"), F.coalesce(F.get("v", F.lit(0)), F.lit("")).alias("first_detail"))


@query
def unique_ids(spark, d):
    lines = table(spark, d, "lineitem")
    orders = table(spark, d, "orders")
    parts = [
        ("lineitem.l_orderkey", expectations.duplicate_groups(lines, ["l_orderkey"])),
        ("lineitem.l_orderkey+l_linenumber", expectations.duplicate_groups(lines, ["l_orderkey", "l_linenumber"])),
        ("orders.o_orderkey", expectations.duplicate_groups(orders, ["o_orderkey"])),
    ]
    out = None
    for name, part in parts:
        row = part.select(F.lit(name).alias("key"), "rows", "duplicate_groups", "duplicate_rows")
        out = row if out is None else out.unionByName(row)
    return out


@query
def length_variance(spark, d):
    out = None
    for name, columns in (("documents", ["text", "lang", "source"]), ("pages", ["url", "html"])):
        part = expectations.length_variance(table(spark, d, name), columns).select(
            F.lit(name).alias("table"), "column", "non_null",
            F.round("mean_length", 4).alias("mean_length"), F.round("std_length", 4).alias("std_length"), "fired",
        )
        out = part if out is None else out.unionByName(part)
    return out


@query
def quality_scores(spark, d):
    report = expectations.build_report(
        expectations.run_expectations(contacts(spark, d), _contact_specs(), "rid", examples=False), "contacts"
    ).report
    return reports.quality_score(report).select("file_name", "evaluated", "successful", "score", "band")


@query
def failure_payload(spark, d):
    result = expectations.build_report(
        expectations.run_expectations(contacts(spark, d), [s for s in _contact_specs() if s.type != expectations.IN_SET], "rid"),
        "contacts",
    )
    return responses.failure_payload(result.report, result.failures)


# --- profiles and generated expectations --------------------------------------


@query
def profile_common(spark, d):
    return profile.common_profile(contacts(spark, d)).select(
        "column", "rows", "non_null", "null_pct", "distinct", "distinct_pct"
    )


@query
def profile_numeric(spark, d):
    out = None
    for name in ("lineitem", "part", "customer"):
        part = profile.numeric_profile(table(spark, d, name))
        out = part if out is None else out.unionByName(part)
    rounded = [F.round(c, 6).alias(c) for c in ("numeric_min", "numeric_max", "p01", "p99")]
    return out.select("column", "non_null", *rounded)


@query
def profile_merged(spark, d):
    """States of four parts of a table, merged; the exact fields."""
    rows = contacts(spark, d).withColumn("part", F.pmod("rid", F.lit(4)))
    states = profile_state(rows, ["rid", "email", "phone"], ["part"])
    return profile_of(merged_state(states)).select(
        "column", "rows", "non_null", "null_pct", "numeric_min", "numeric_max", "len_min", "len_max", "trimmed_pct",
        (F.abs(F.col("approx_distinct") / F.col("non_null") - 1) <= 0.05).alias("distinct_within"),
    )


@query
def profile_text(spark, d):
    out = None
    for name in ("documents", "pages", "part"):
        part = profile.text_profile(spread(table(spark, d, name)))
        out = part if out is None else out.unionByName(part.select(*out.columns))
    return out.withColumn("len_p95", F.round("len_p95", 6))


@query
def top_values(spark, d):
    out = None
    for name in ("lineitem", "part", "customer", "documents"):
        frame = table(spark, d, name)
        names = [c for c in ("l_returnflag", "l_linestatus", "p_brand", "p_type", "p_name", "c_mktsegment", "lang") if c in frame.columns]
        part = profile.top_values(frame, names)
        out = part if out is None else out.unionByName(part)
    return out.select("column", "value", "cnt", "rank")


@query
def first_values_per_column(spark, d):
    return first_cells(long_form(contacts(spark, d), CONTACT_VALUES, "rid"), 5).select(
        "column", F.array_join("values", "|").alias("sample_values")
    )


@query
def dataset_profile_customer(spark, d):
    return profile.dataset_profile(table(spark, d, "customer"), order_by="c_custkey", batch_size=8).select(
        "column", "batch", "position", "row_count", "profile_sample_rows", "column_count", "non_null", "distinct",
        F.array_join("sample_values", "|").alias("sample_values"),
    )


@query
def auto_specs(spark, d):
    source = contacts(spark, d)
    return autogen.specs_table(source, autogen.fallback_specs(source)).select(
        "index", "expectation_type", "column", "confidence", "generation_source"
    )


@query
def auto_outcomes(spark, d):
    return autogen.auto_expectations(contacts(spark, d), order_by="rid").outcomes.select(
        "index", "expectation", "column", "passed", "status"
    )


def _proposals(spark, d) -> DataFrame:
    """Reviewer answers derived from ``part``: fenced, wrapped, plain and broken ones."""
    size = F.col("p_size").cast("string")
    brand = F.col("p_brand")
    bounds = F.concat(
        F.lit('{"expectation_type":"expect_column_values_to_be_between","column":"p_size","kwargs":{"min_value":'),
        size, F.lit('},"confidence":"low","rationale":" size "}'),
    )
    members = F.concat(
        F.lit('{"expectation_type":"EXPECT_COLUMN_VALUES_TO_BE_IN_SET","column":"p_brand","kwargs":{"value_set":["'),
        brand, F.lit('",1]}}'),
    )
    filled = F.concat(
        F.lit('{"expectation_type":"expect_column_values_to_not_be_null","column":"p_name","kwargs":{"mostly":0.'),
        size, F.lit("}}"),
    )
    unknown = F.lit('{"expectation_type":"expect_table","column":"p_name"}')
    elsewhere = F.lit('{"expectation_type":"expect_column_values_to_be_unique","column":"p_missing"}')
    answer = (
        F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("```json\n["), bounds, F.lit(","), unknown, F.lit("]\n```")))
        .when(F.col("p_partkey") % 4 == 1, F.concat(F.lit('{"items":['), members, F.lit(","), elsewhere, F.lit("]}")))
        .when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("["), filled, F.lit(",7]")))
        .otherwise(F.lit("no answer"))
    )
    return table(spark, d, "part").select("p_partkey", answer.alias("response"))


PART_COLUMNS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


@query
def sanitised_specs(spark, d):
    accepted = responses.sanitised_specs(responses.proposal_items(_proposals(spark, d), "response"), PART_COLUMNS)
    return responses.deduplicated_specs(accepted, ["p_partkey"]).select(
        "p_partkey", "pos", "expectation_type", "column", "rationale", "confidence", "mostly",
        F.array_join("value_set", "|").alias("value_set"), "min_value",
    )


@query
def proposal_diagnostics(spark, d):
    answers = _proposals(spark, d)
    items = responses.proposal_items(answers, "response")
    accepted = responses.deduplicated_specs(responses.sanitised_specs(items, PART_COLUMNS), ["p_partkey"])
    return responses.proposal_diagnostics(answers, "response", items, accepted, PART_COLUMNS).drop("hint")


@query
def response_rows(spark, d):
    keyed = table(spark, d, "orders").select(
        "o_orderkey",
        F.when(
            F.col("o_orderstatus") == "F",
            F.concat(
                F.lit('```json\n[{"column":"o_totalprice","issue":"odd total","example":"'),
                F.col("o_orderkey").cast("string"),
                F.lit('","severity":"high"},{"column":"o_orderkey"},"x"]\n```'),
            ),
        )
        .when(F.col("o_orderstatus") == "O", F.lit('[{"column":"o_elsewhere","issue":"not listed"},{"column":"o_orderdate","issue":"late"}]'))
        .otherwise(F.lit('{"column":"o_totalprice","issue":"not a list"}')).alias("response"),
    )
    return responses.response_rows(
        keyed, "response", ["column", "issue"], ["example"], columns=["o_totalprice", "o_orderkey", "o_orderdate"]
    )


@query
def sample_payload(spark, d):
    return responses.sample_payload(contacts(spark, d), skip=["rid"], order_by="rid")


# --- privacy and quality ------------------------------------------------------


@query
def embedded_hits_documents(spark, d):
    return privacy.embedded_hits(_documents(spark, d), ["text"], entities=False)


@query
def semantic_pii_documents(spark, d):
    source = table(spark, d, "documents").select("doc_id", F.col("text").alias("body"), F.col("lang").alias("city"))
    return privacy.semantic_pii(spread(source)).select("column", "risk")


@query
def regulatory_flags(spark, d):
    return privacy.regulatory_flags(_contact_findings(spark, d)).select("column", "regulation", "category", "severity")


@query
def k_anonymity_customer(spark, d):
    groups = [("c_nationkey", "c_mktsegment"), ("c_nationkey",), ("c_mktsegment",)]
    return privacy.k_anonymity(table(spark, d, "customer"), groups, k=10).withColumn(
        "share_below_k", F.round("share_below_k", 6)
    )


@query
def quasi_identifiers_part(spark, d):
    return privacy.quasi_identifiers(
        table(spark, d, "part"), ["p_brand", "p_type", "p_size"], max_size=3
    ).select(F.array_join("columns", ",").alias("columns"), "risk", "reason")


@query
def minimal_identifiers(spark, d):
    """Columns cut out of a key: no one and no two of them identify where there are rows enough, some three do."""
    rows = derived(table(spark, d, "customer"), KEY_PARTS)
    return privacy.minimal_quasi_identifiers(rows).withColumn("columns", F.array_join("columns", ","))


@query
def format_rates(spark, d):
    return privacy.format_rates(contacts(spark, d)).withColumn("rate", F.round("rate", 6))


@query
def format_anomalies(spark, d):
    return privacy.format_anomalies(contacts(spark, d), threshold=0.95)


@query
def plausibility_counts(spark, d):
    out = None
    for name in ("lineitem", "customer", "orders"):
        part = quality.plausibility_counts(table(spark, d, name))
        out = part if out is None else out.unionByName(part)
    return out


@query
def plausibility_contacts(spark, d):
    source = contacts(spark, d).withColumn(
        "active", F.expr("CASE WHEN rid % 2 = 0 THEN 'Yes' WHEN rid % 3 = 0 THEN 'F' ELSE 'T' END")
    )
    return quality.plausibility(source)


@query
def date_order(spark, d):
    joined = table(spark, d, "orders").join(
        table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")
    )
    return quality.date_order_counts(joined.select("o_orderdate", "l_shipdate"), "o_orderdate", "l_shipdate")


@query
def functional_dependency(spark, d):
    out = None
    for left, right in ((["p_type"], "p_brand"), (["p_brand", "p_type"], "p_size"), (["p_partkey"], "p_name")):
        part = quality.dependency_counts(table(spark, d, "part"), left, right).select(
            F.lit("+".join(left)).alias("key"), F.lit(right).alias("value"), "groups", "violating_groups", "rows_involved"
        )
        out = part if out is None else out.unionByName(part)
    return out


@query
def consistency_customer(spark, d):
    source = table(spark, d, "customer").withColumn("half", F.col("c_acctbal") / 2).withColumnRenamed(
        "c_nationkey", "n_nationkey"
    )
    known = table(spark, d, "nation").where("n_regionkey <> 0").select("n_nationkey")
    return quality.consistency(
        source,
        [
            quality.SumOf("c_acctbal", ("half", "half")),
            quality.SumOf("c_acctbal", ("half", "n_nationkey")),
            quality.ListedIn(("n_nationkey",), known),
            quality.Determines(("n_nationkey",), "c_mktsegment"),
        ],
    )


@query
def completeness_rates(spark, d):
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    both = quality.completeness_rates(joined.select("doc_id", "lang", "quality", "toxic"))
    return both.unionByName(quality.completeness_rates(contacts(spark, d), CONTACT_VALUES))


@query
def completeness_contacts(spark, d):
    return quality.completeness(contacts(spark, d).drop("rid"))


def _shared(spark, d):
    """Suite, generated checks, completeness and scan of one table from one stored index of its cells."""
    return analyze(contacts(spark, d), SHARED, "contacts", order_by="rid", entities=False)


@query
def analyze_outcomes(spark, d):
    return _shared(spark, d).results["auto_expectations"].select("index", "expectation", "column", "passed", "status")


@query
def analyze_completeness(spark, d):
    return analyze(contacts(spark, d).drop("rid"), ["completeness", "regulatory"], entities=False).results["completeness"]


# --- anomalies ------------------------------------------------------------------


@query
def rarity_encoding(spark, d):
    return anomaly.rarity_encoding(table(spark, d, "events"), ["event_type"]).withColumn("code", F.round("code", 12))


@query
def anomalies_lineitem(spark, d):
    return anomaly.detect_anomalies(
        spread(table(spark, d, "lineitem")), columns=["l_quantity", "l_extendedprice", "l_discount"],
        order_by=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
    )


@query
def anomalies_text(spark, d):
    source = table(spark, d, "documents").withColumn("label", F.when(contains_any(F.col("text"), ["@"]), F.col("lang")).otherwise("plain"))
    return anomaly.detect_anomalies(source, columns=["label", "n_chars", "source"], order_by="doc_id")


@query
def planted_anomalies(spark, d):
    """Rows whose key leaves no remainder get values far above the rest; all are flagged, and few others."""
    planted = F.col("l_orderkey") % 401 == 0
    rows = table(spark, d, "lineitem").withColumn("l_quantity", F.when(planted, F.lit(1.0e6) + F.col("l_linenumber")).otherwise(F.col("l_quantity")))
    many = rows.where(planted).count()
    found = anomaly.detect_anomalies(rows, columns=["l_quantity"], order_by=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return found.select(
        "column", "total_rows",
        (F.col("anomalous_row_count") >= many).alias("found"),
        (F.col("anomaly_pct") <= 5.0).alias("within_share"),
        F.col("explanation").contains("above").alias("above"),
    )


@query
def planted_rare_text(spark, d):
    planted = F.col("o_orderkey") % 211 == 0
    label = F.when(planted, F.concat(F.lit("odd"), F.col("o_orderkey").cast("string"))).otherwise(F.col("o_orderpriority"))
    rows = table(spark, d, "orders").select("o_orderkey", label.alias("label"))
    many = rows.where(planted).count()
    found = anomaly.detect_anomalies(rows, columns=["label"], order_by="o_orderkey")
    return found.select(
        "column", "total_rows", (F.col("anomalous_row_count") == many).alias("found"),
        (F.col("anomaly_pct") <= 5.0).alias("within_share"),
    )


# --- samples, sources, combined runs ----------------------------------------------


@query
def hash_sample_events(spark, d):
    return hash_sample(table(spark, d, "events"), "event_id", 1000).select("event_id", "event_type")


@query
def head_mid_tail(spark, d):
    return representative_sample(table(spark, d, "orders"), "o_orderkey").select("o_orderkey", "o_custkey")


@query
def document_lines(spark, d):
    return text_lines(_documents(spark, d), "text").select("doc_id", "line_no", "value")


@query
def file_catalog(spark, d):
    return file_states(list_files(spark, d)).select(
        F.element_at(F.split("file", "/"), -1).alias("file"), "extension", "bytes", "size_mb", "state"
    )


def _by_table(found: DataFrame) -> DataFrame:
    """Findings by the table that a file is, or is a part of."""
    return found.select(
        F.regexp_extract("source", r"([^/]+\.parquet)(?:/[^/]+)?$", 1).alias("source"), "column", "pattern", "confidence", "risk",
        "matches", "sample_size", "match_pct", "detection_source",
    )


@query
def scan_directory(spark, d):
    return _by_table(scan_path(spark, d).findings)


@query
def scan_directory_rules(spark, d):
    return _by_table(scan_path(spark, d, entities=False).findings)


@query
def scan_directory_states(spark, d):
    """Files that were read, with the columns that a scan looked into."""
    done = scan_path(spark, d, entities=False)
    own = done.status.join(done.stats.withColumnRenamed("source", "file"), "file")
    return own.select(F.regexp_extract("file", r"([^/]+\.parquet)(?:/[^/]+)?$", 1).alias("file"), "state", "columns_scanned", "findings")


@query
def scan_entities_many(spark, d):
    """Entities over several tables at once."""
    tables = {"documents": (_documents(spark, d), "doc_id"), "talk": (talk(spark, d), ["conv_id", "turn"])}
    found = scan_tables(tables, {"documents": ["text"], "talk": ["text"]}).findings.where("confidence = 'AI'")
    return found.select("source", F.col("pattern").alias("entity"), "matches", "entity_score")


@query
def file_rollup(spark, d):
    found = _contact_findings(spark, d)
    report = expectations.validate(contacts(spark, d), order_by="rid", file_name="contacts").report
    audit = remediate(contacts(spark, d), found, common=False, file_name="contacts").audit
    return reports.file_rollup(found, report, audit)


@query
def first_seen_tokens(spark, d):
    """PRD-3 on a text column with hot values: first 500 distinct tokens of the collection."""
    cells = stripped_cells(long_form(doc_tokens(spark, d), ["token"], ["doc_id", "pos"]))
    return first_values(value_index(cells), 500).select("value", "cnt", "rn")


__all__ = ["QUERIES", "REGEX_SOURCE"]
