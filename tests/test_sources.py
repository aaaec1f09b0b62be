import json
import zipfile

import pytest
from conftest import rows
from pyspark.sql import functions as F

from fieldwarden.operators import reports
from fieldwarden.operators.remediate import remediate
from fieldwarden.operators.scan import scan
from fieldwarden.plans.tables import shared_dir
from fieldwarden.sources import catalog, readers, sinks
from fieldwarden.streaming import remediate_stream, write_remediated


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv(spark, tmp_path):
    path = put(tmp_path, "a.csv", 'n,t\n001,"x, ""y"""\nNA,n/a\n3,"two\nlines"\n')
    df = readers.read_csv(spark, path, multi_line=True)
    assert rows(df.fillna("-"), "n", "t") == [("-", "-"), ("001", 'x, "y"'), ("3", "two\nlines")]
    assert readers.read_csv(spark, put(tmp_path, "e.csv", "a,b\n")).count() == 0


@pytest.mark.parametrize(
    "text, want",
    [
        ('{"a": 1, "b": {"c": "x", "d": [1, 2]}}\n{"a": 2}\n', [(1, "x"), (2, None)]),
        ('﻿[{"a": 1, "b": {"c": "x"}},\n {"a": 2}]', [(1, "x"), (2, None)]),
        ('{"data": 5, "items": [{"a": 1, "b": {"c": "x"}}, {"a": 2}]}', [(1, "x"), (2, None)]),
        ('{\n "records": [{"a": 1, "b": {"c": "x"}},\n {"a": 2}]}', [(1, "x"), (2, None)]),
        ('{"a": 1, "b": {"c": "x"}}', [(1, "x")]),
    ],
)
def test_json_layouts(spark, tmp_path, text, want):
    df = readers.read_json(spark, put(tmp_path, "a.json", text))
    assert sorted((r["a"], r["b.c"]) for r in df.collect()) == want


def test_json_scalar_is_rejected(spark, tmp_path):
    with pytest.raises(readers.UnsupportedSource):
        readers.read_json(spark, put(tmp_path, "a.json", "not json at all\nreally"))


def test_inline_lines(spark):
    df = spark.createDataFrame([(1, "a\r\n\n b c"), (2, "  "), (3, "one")], "id int, text string")
    assert rows(readers.text_lines(df, "text"), "id", "line_no", "value") == [(1, 0, "a"), (1, 2, " b"), (1, 3, "c"), (3, 0, "one")]


def test_avro_is_gated(spark, tmp_path):
    if readers.has_avro(spark):
        pytest.skip("the Avro module is on the classpath")
    with pytest.raises(readers.UnsupportedSource):
        readers.read_avro(spark, "x.avro")
    with pytest.raises(readers.UnsupportedSource):
        sinks.write_avro(spark.range(1), str(tmp_path / "o"))


def test_directory_scan(spark, tmp_path):
    lines = "\n".join(f"{i},u{i}@example.com" for i in range(20))
    put(tmp_path, "a.csv", "id,email\n" + lines + "\n")
    put(tmp_path, "deep/b.csv", "id,email\n" + lines + "\n")
    put(tmp_path, "deep/c.txt", "\n".join(f"615555{1000 + i}" for i in range(5)))
    put(tmp_path, "d.json", "\n".join(json.dumps({"ssn": f"{100 + i}-12-{1000 + i}"}) for i in range(5)))
    put(tmp_path, "e.json", json.dumps([{"zip": "12345"}]))
    put(tmp_path, "skip.bin", "zzz")
    put(tmp_path, "empty.csv", "")
    put(tmp_path, "big.txt", "x" * 3_000_000)
    result = catalog.scan_path(spark, str(tmp_path), max_mb=2, entities=False)
    short = lambda c: F.element_at(F.split(c, "/"), -1)
    got = rows(result.findings.withColumn("f", short("source")), "f", "column", "pattern", "matches")
    assert [g for g in got if g[2] in ("email", "ssn", "zip", "phone")] == [
        ("a.csv", "email", "email", 20), ("b.csv", "email", "email", 20), ("c.txt", "value", "phone", 5),
        ("d.json", "ssn", "ssn", 5), ("e.json", "zip", "zip", 1),
    ]
    state = dict(rows(result.status.withColumn("f", short("file")), "f", "state"))
    assert state == {
        "a.csv": "SUCCESS", "b.csv": "SUCCESS", "c.txt": "SUCCESS", "d.json": "SUCCESS", "e.json": "SUCCESS",
        "skip.bin": "SKIPPED", "empty.csv": "FAILED", "big.txt": "SKIPPED",
    }
    scanned = dict(rows(result.stats.withColumn("f", short("source")), "f", "columns_scanned"))
    assert scanned["a.csv"] == 1 and scanned["c.txt"] == 1


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("in/a.txt", "one\r\ntwo\n")
        z.writestr("b.csv", "h\n1\n")
        z.writestr("c.png", "no")
        z.writestr("dir/", "")
    got = catalog.expand_archives(spark, str(tmp_path))
    assert rows(got, "member", "line_no", "line") == [("a.txt", 0, "one"), ("a.txt", 1, "two"), ("b.csv", 0, "h"), ("b.csv", 1, "1")]


def test_sinks_round_trip(spark, people, tmp_path):
    for ext, read in (("csv", readers.read_csv), ("json", readers.read_json_lines), ("parquet", readers.read_parquet)):
        path = str(tmp_path / f"o.{ext}")
        sinks.write_table(people, path, ext)
        assert rows(read(spark, path), "name", "ssn") == rows(people, "name", "ssn")
    sinks.write_text(people.select("name"), str(tmp_path / "o.txt"), order_by="name")
    assert rows(readers.read_text(spark, str(tmp_path / "o.txt")), "value") == rows(people, "name")


def test_bundle(spark, people, tmp_path):
    found = scan(people, "p.csv", columns=["email", "ssn"], order_by="rid").findings
    done = remediate(people, found, file_name="p.csv")
    out = str(tmp_path / "bundle")
    report = sinks.write_bundle({"p.csv": done}, out)
    assert rows(report, "pattern", "cells_changed") == [("email", 50), ("ssn", 50)]
    assert readers.read_csv(spark, f"{out}/p_cloud_ready.csv").where("ssn = '<PII_REDACT:ssn>'").count() == 50
    assert readers.read_csv(spark, f"{out}/remediation_report").count() == 2
    manifest = json.loads(readers.read_text(spark, f"{out}/anonymization_manifest").first()[0])
    assert manifest["strategy"] == "REDACT" and manifest["files"] == ["p.csv"]


def test_stream_equals_batch(spark, people, tmp_path):
    found = scan(people, "p", columns=["email", "phone"], order_by="rid").findings
    people.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(people.schema).parquet(str(tmp_path / "in"))
    rewritten = remediate_stream(stream, found, mode="hash", salt="s")
    run = write_remediated(rewritten, str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination()
    batch = remediate(people, found, mode="hash", salt="s").data
    assert rows(spark.read.parquet(str(tmp_path / "out")), *batch.columns) == rows(batch, *batch.columns)
    with pytest.raises(ValueError):
        remediate_stream(people, found)


def test_rollup_and_labels(spark, people):
    found = scan(people, "p", columns=["email", "ssn"], order_by="rid").findings
    label = lambda p, s: spark.range(1).select(reports.display_label(F.lit(p), F.lit(s))).first()[0]
    assert label("driver_license", "REGEX_RULE") == "Driver License(Regex)"
    assert label("US_SSN", "ENTITY_RULE") == "SSN(NLP)" and label("", "x") == "" and label("dob", "other") == "Dob"
    status = spark.createDataFrame([("p", "SUCCESS"), ("q", "FAILED")], "file string, state string")
    audit = remediate(people, found, file_name="p").audit
    report = spark.createDataFrame([("p", 4, 3)], "file_name string, evaluated long, successful long")
    got = reports.file_rollup(found, report, audit, status)
    assert rows(got.fillna(-1), "file", "pii_findings", "dq_score", "cells_remediated", "errors") == [("p", 2, 75, 100, 0), ("q", 0, -1, 0, 1)]


def test_shared_dir_follows_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == (named.rstrip("/") if named else shared_dir(spark))


def test_plans(spark, people):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    scanned = plan(scan(people, "p", columns=["email"], order_by="rid").findings)
    assert "WindowGroupLimit" in scanned and "Python" not in scanned
    assert "Cartesian" not in scanned and "BroadcastNestedLoop" not in scanned


def test_damaged_body_fails_alone(spark, tmp_path):
    for name, first in (("good", 0), ("bad", 50_000)):
        spark.range(first, first + 50_000).selectExpr("concat('user', id, '@example.com') AS email").coalesce(1).write.parquet(str(tmp_path / name))
    part = next((tmp_path / "bad").glob("part-*.parquet"))
    raw = bytearray(part.read_bytes())
    raw[200:4000] = bytes(3800)
    part.write_bytes(bytes(raw))
    for crc in (tmp_path / "bad").glob(".*.crc"):
        crc.unlink()
    result = catalog.scan_path(spark, str(tmp_path), entities=False)
    states = {r["file"].split("/")[-2]: (r["state"], r["details"]) for r in result.status.collect() if r["file"].endswith(".parquet")}
    assert states["bad"] == ("FAILED", "File body cannot be read") and states["good"][0] == "SUCCESS"
    assert [(r["pattern"], r["matches"]) for r in result.findings.collect()] == [("email", 50_000)]


def test_quoted_line_break_is_one_record(spark, tmp_path):
    (tmp_path / "notes.csv").write_text('email,note\na@b.co,"two\nlines"\nc@d.co,one\n')
    found = catalog.scan_path(spark, str(tmp_path), entities=False).findings.where("pattern = 'email'").first()
    assert (found["matches"], found["sample_size"]) == (2, 2)
