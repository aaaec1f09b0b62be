"""Many files rewritten in one plan give what each file gives alone."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from fieldwarden.operators.remediate import remediate
from fieldwarden.operators.remediate_files import remediate_files
from fieldwarden.operators.scan import scan, scan_files
from fieldwarden.sources import readers, sinks

COLUMNS = ["person_name", "contact", "note"]


@pytest.fixture(scope="module")
def table(spark):
    """Files whose columns hold different things: numbers, addresses, names, nothing, and one row without a file."""
    out = []
    for i in range(240):
        kind = i % 4
        name = ("Ada Stone", f"ID{i:07d}", "n/a", "Bruno Rivers")[kind]
        contact = (f"u{i}@example.com", f"615555{1000 + i}", f" {100 + i}-12-{1000 + i} ", "call the office")[kind]
        note = ("account 12345678", f"Ada Stone called about {i}", "4111 1111 1111 1111", None)[kind]
        out.append((i, f"dir/f{kind}.csv", name, contact, note if i % 5 else f"write to u{i}@example.com"))
    out.append((999, None, "Ada Stone", "u@example.com", "u@example.com"))
    return spark.createDataFrame(out, "rid long, file string, person_name string, contact string, note string")


@pytest.fixture(scope="module")
def findings(spark, table):
    """The findings of all files, worked out once."""
    made = scan_files(table, "file", columns=COLUMNS, order_by="rid").findings
    return spark.createDataFrame(made.collect(), made.schema)


def test_scan_of_files_equals_a_scan_of_each(table, findings):
    shown = ["column", "pattern", "confidence", "risk", "matches", "sample_size", "match_pct", "sample_match_1", "detection_source"]
    for name in ("dir/f1.csv", "dir/f2.csv"):
        alone = scan(table.where(F.col("file") == name), name, columns=COLUMNS, order_by="rid")
        assert rows(findings.where(F.col("source") == name), *shown) == rows(alone.findings, *shown)
    assert findings.where("source is null").count() == 0
    stats = scan_files(table, "file", columns=COLUMNS, order_by="rid", entities=False).stats
    assert [r[0] for r in rows(stats, "source")] == [f"dir/f{k}.csv" for k in range(4)]


@pytest.mark.parametrize(
    "options",
    [
        {"mode": "hash", "salt": "s", "include_review": False, "patterns": ["email", "ssn", "PERSON"]},
        {"mode": "mask_last4", "common": False, "person": False},
    ],
)
def test_each_file_is_rewritten_by_its_own_findings(table, findings, options):
    done = remediate_files(table, findings, "file", **options)
    assert done.data.columns == table.columns and done.data.count() == table.count()
    audit = {}
    for r in done.audit.collect():
        audit.setdefault(r["file_name"], []).append(tuple(r)[1:])
    for name in ("dir/f0.csv", "dir/f1.csv", "dir/f3.csv"):
        own = table.where(F.col("file") == name)
        alone = remediate(own, findings, source=name, file_name=name, **options)
        text = [F.coalesce(F.col(c).cast("string"), F.lit("null")).alias(c) for c in table.columns]
        assert rows(done.data.where(F.col("file") == name).select(*text), *table.columns) == rows(alone.data.select(*text), *table.columns)
        assert sorted(audit.get(name, [])) == sorted(tuple(r)[1:] for r in alone.audit.collect())
    assert set(audit) <= {"dir/f0.csv", "dir/f1.csv", "dir/f2.csv", "dir/f3.csv"}
    left = done.data.where("file is null").first()
    assert (left["person_name"], left["contact"]) == ("Ada Stone", "u@example.com")


def test_findings_of_other_origins_use_their_own_examples(spark, table):
    lines = [("dir/f0.csv", "note", "code", "LOW", "MANUAL", "12345678", ""), ("dir/f1.csv", "note", "code", "LOW", "MANUAL", "Ada", "called")]
    manual = spark.createDataFrame(lines, "source string, column string, pattern string, risk string, detection_source string, sample_match_1 string, sample_match_2 string")
    done = remediate_files(table, manual, "file", common=False)
    for name in ("dir/f0.csv", "dir/f1.csv", "dir/f2.csv"):
        alone = remediate(table.where(F.col("file") == name), manual, source=name, file_name=name, common=False)
        shown = lambda df: rows(df.fillna("-"), "rid", "note")
        assert shown(done.data.where(F.col("file") == name)) == shown(alone.data)
    assert rows(done.audit, "file_name", "pattern", "detection_source") == [("dir/f0.csv", "code", "MANUAL"), ("dir/f1.csv", "code", "MANUAL")]


def test_no_findings_and_no_rows(table, findings):
    same = remediate_files(table, findings.limit(0), "file")
    assert same.data.count() == table.count() and same.audit.count() == 0
    assert remediate_files(table.limit(0), findings, "file").data.count() == 0


def test_one_plan_for_any_number_of_files(spark):
    def plan(files):
        df = spark.range(600).select(
            F.concat(F.lit("f"), (F.col("id") % files).cast("string")).alias("file"), F.concat(F.lit("u"), F.col("id"), F.lit("@example.com")).alias("email")
        )
        findings = scan_files(df, "file", entities=False).findings
        done = remediate_files(df, findings, "file", common=False)
        assert done.data.where("email = '<PII_REDACT:email>'").count() == 600
        assert done.audit.count() == files
        return done.data._jdf.queryExecution().optimizedPlan().toString().count("\n")

    assert plan(3) == plan(300)


def test_bundle_of_many_files(spark, table, findings, tmp_path):
    done = remediate_files(table, findings, "file", common=False)
    out = str(tmp_path / "bundle")
    report = sinks.write_files(done, out, "csv")
    assert rows(report, *report.columns) == rows(done.audit, *report.columns)
    named = readers.read_csv(spark, f"{out}/files")
    assert named.count() == table.count()
    own = named.where("file = 'dir/f0_cloud_ready.csv'")
    assert own.where("contact = '<PII_REDACT:email>'").count() == 60
    manifest = json.loads(readers.read_text(spark, f"{out}/anonymization_manifest").first()[0])
    assert manifest["strategy"] == "REDACT" and manifest["files"] == 4
    assert rows(readers.read_text(spark, f"{out}/anonymized_files"), "value") == [(f"dir/f{k}.csv",) for k in range(4)]
