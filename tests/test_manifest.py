"""Directory scans as tables: many files, mixed layouts, quoted line breaks, JSON forms and failures."""

import json
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import rows
from pyspark.sql import functions as F

from fieldwarden.sources import catalog, manifest


def short(column):
    return F.element_at(F.split(column, "/"), -1)


def scanned(spark, path, **options):
    result = catalog.scan_path(spark, str(path), entities=options.pop("entities", False), **options)
    found = {}
    for r in result.findings.select(short("source").alias("f"), "column", "pattern", "matches").collect():
        found.setdefault(r["f"], set()).add((r["column"], r["pattern"], r["matches"]))
    states = {r["f"]: (r["state"], r["details"]) for r in result.status.select(short("file").alias("f"), "state", "details").collect()}
    stats = {r["f"]: r["columns_scanned"] for r in result.stats.select(short("source").alias("f"), "columns_scanned").collect()}
    return found, states, stats


def many(folder, files):
    folder.mkdir()
    for i in range(files):
        mails = [f"u{i}_{k}@example.com" for k in range(3)]
        (folder / f"a{i}.csv").write_text("email,ssn\n" + "".join(f"{m},{100 + i % 800}-12-3456\n" for m in mails))
        (folder / f"b{i}.csv").write_text("id;x,contact_email\n" + "".join(f"1,{m}\n" for m in mails))
        (folder / f"c{i}.jsonl").write_text("".join(json.dumps({"user": {"email": m}, "n": i}) + "\n" for m in mails))
        (folder / f"d{i}.txt").write_text("\n".join(mails))
        if i % 10 == 0:
            pq.write_table(pa.table({"email": mails}), folder / f"e{i}.parquet")
            pq.write_table(pa.table({"email": [1, 2, 3], "zip_code": ["12345"] * 3}), folder / f"g{i}.parquet")


def jobs_of(spark, work):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_jobs_do_not_grow_with_files(spark, tmp_path):
    many(tmp_path / "few", 10)
    many(tmp_path / "many", 250)
    counts = {}
    for name in ("few", "many"):
        counts[name] = jobs_of(spark, lambda: catalog.scan_path(spark, str(tmp_path / name), entities=False).findings.count())
    # adaptive execution makes some jobs of its own for larger exchanges
    assert counts["many"] <= counts["few"] + 10
    found, states, stats = scanned(spark, tmp_path / "many")
    assert len(states) == 250 * 4 + 50 and {s[0] for s in states.values()} == {"SUCCESS"}
    assert found["a7.csv"] >= {("email", "email", 3), ("ssn", "ssn", 1)} and stats["a7.csv"] == 2
    assert found["b249.csv"] == {("contact_email", "email", 3)}
    assert found["c200.jsonl"] == {("user.email", "email", 3)}
    assert found["d11.txt"] == {("value", "email", 3)}
    assert found["e50.parquet"] == {("email", "email", 3)}
    assert ("zip_code", "zip", 1) in found["g50.parquet"] and stats["g50.parquet"] == 2


def test_quoted_line_breaks_only_slow_their_own_file(spark, tmp_path):
    (tmp_path / "plain.csv").write_text("email,note\n" + "".join(f"p{i}@b.co,one\n" for i in range(50)))
    (tmp_path / "broken.csv").write_text('email,note\n"a@b.co","two\nlines, ""quoted"""\nc@d.co,"x\n\ny"\ne@f.co,last\n')
    (tmp_path / "header.csv").write_text('"my\nemail",note,note\ng@h.co,1,2\n')
    survey = {r["f"]: r["quoted"] for r in manifest.delimited_survey(manifest._lines(spark, str(tmp_path), None, "csv")).select(short("file").alias("f"), "quoted").collect()}
    assert survey == {"plain.csv": False, "broken.csv": True, "header.csv": True}
    found, states, _ = scanned(spark, tmp_path)
    assert found["plain.csv"] == {("email", "email", 50)} and found["broken.csv"] == {("email", "email", 3)}
    assert found["header.csv"] == {("my\nemail", "email", 1)}
    held = manifest.delimited_held(spark, str(tmp_path), None, manifest.file_states(manifest.list_files(spark, str(tmp_path))))
    cells = held.cells.where(F.col("source").contains("broken") & F.col("column").isin("m:0", "m:1"))
    assert rows(cells, "column", "value") == [("m:0", "a@b.co"), ("m:0", "c@d.co"), ("m:0", "e@f.co"), ("m:1", "last"), ("m:1", 'two\nlines, "quoted"'), ("m:1", "x\n\ny")]
    assert rows(held.names.where(F.col("file").contains("header")), "raw", "column") == [("0", "my\nemail"), ("1", "note1"), ("2", "note2")]


def test_headers_and_ragged_rows(spark, tmp_path):
    (tmp_path / "a.CSV").write_text("﻿email,,Email,x\na@b.co,1\nc@d.co,2,e@f.co,y,too many\n\nNA,n/a,null,\n")
    held = manifest.delimited_held(spark, str(tmp_path), None, manifest.file_states(manifest.list_files(spark, str(tmp_path))))
    assert rows(held.names, "raw", "column") == [("0", "email0"), ("1", "_c1"), ("2", "Email2"), ("3", "x")]
    assert rows(held.cells, "column", "value") == [("s:0", "a@b.co"), ("s:0", "c@d.co"), ("s:1", "1"), ("s:1", "2"), ("s:2", "e@f.co"), ("s:3", "y")]


@pytest.mark.parametrize(
    "text, want",
    [
        ('{"email": "a@b.co", "b": {"c": "x@y.co", "d": [1, 2]}}\n{"email": null}\n', {"email": ["a@b.co"], "b.c": ["x@y.co"], "b.d": ["[1,2]"]}),
        ('﻿[{"a": 1.50, "b": {"c": {"d": true}}},\n {"a": 2}]', {"a": ["1.5", "2"], "b.c.d": ["True"]}),
        ('{"data": 5, "items": [{"a": 10000000.0}, {"a": "1e5"}]}', {"a": ["10000000.0", "1e5"]}),
        ('{\n "records": [{"a": 1},\n {"a": 2}]}', {"a": ["1", "2"]}),
        ('{"teas": ["x", "y"]}', {"0": ["x", "y"]}),
        ('{"a": {"b": 1}}', {"a.b": ["1"]}),
        ("[]", {}),
    ],
)
def test_json_cells(spark, tmp_path, text, want):
    (tmp_path / "a.json").write_text(text)
    files = manifest.file_states(manifest.list_files(spark, str(tmp_path)))
    held = manifest.json_held(spark, str(tmp_path), None, files)
    tag = held.tags.first()["tag"]
    got = {}
    for r in held.cells.where(F.col("column").startswith(f"{tag}:")).collect():
        got.setdefault(r["column"][2:], []).append(r["value"])
    assert {k: sorted(v) for k, v in got.items()} == want
    assert held.failed.count() == 0


def test_a_null_candidate_column_is_scanned(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"email": null, "n": 1}')
    (tmp_path / "b.csv").write_text("email,n\n,1\n")
    pq.write_table(pa.table({"email": pa.array([None, None], pa.string()), "n": [1, 2]}), tmp_path / "c.parquet")
    _, states, stats = scanned(spark, tmp_path)
    assert stats == {"a.json": 1, "b.csv": 1, "c.parquet": 1} and {s[0] for s in states.values()} == {"SUCCESS"}


def test_failures_are_told_apart(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"email": "a@b.co"}')
    (tmp_path / "bad.json").write_text("not json\nat all")
    (tmp_path / "scalar.json").write_text("5")
    (tmp_path / "blank.json").write_text(" \n \n")
    (tmp_path / "blank.csv").write_text("\n\n")
    (tmp_path / "empty 1+1%.txt").write_text("")
    (tmp_path / "no.parquet").write_bytes(b"PAR1 this is no parquet file PAR1")
    (tmp_path / "none.parquet").write_bytes(b"x")
    pq.write_table(pa.table({"email": pa.array([], pa.string())}), tmp_path / "zero.parquet")
    (tmp_path / "big.txt").write_text("x" * 3_000_000)
    (tmp_path / "other.bin").write_text("x")
    found, states, stats = scanned(spark, tmp_path, max_mb=2)
    state = {f: s[0] for f, s in states.items()}
    assert state == {
        "good.json": "SUCCESS", "bad.json": "FAILED", "scalar.json": "FAILED", "blank.json": "FAILED", "blank.csv": "FAILED",
        "empty%201+1%25.txt": "FAILED", "no.parquet": "FAILED", "none.parquet": "FAILED", "zero.parquet": "SUCCESS", "big.txt": "SKIPPED", "other.bin": "SKIPPED",
    }
    assert states["empty%201+1%25.txt"][1] == "File is empty" and "footer" in states["no.parquet"][1]
    assert found == {"good.json": {("email", "email", 1)}} and stats["zero.parquet"] == 1


def test_entities_and_samples_by_path(spark, tmp_path):
    (tmp_path / "a.csv").write_text("note\n" + "".join(f"Ada Stone called from office number {i} today\n" for i in range(30)))
    found, _, _ = scanned(spark, tmp_path, entities=True)
    assert ("note", "PERSON", 30) in found["a.csv"]
    (tmp_path / "b.csv").write_text("email\n" + "".join(f"u{i}@example.com\n" for i in range(30)))
    found, _, stats = scanned(spark, tmp_path, entities=False, sample_limit=10)
    assert found["b.csv"] == {("email", "email", 10)} and stats["b.csv"] == 1


def test_a_path_without_readable_files(spark, tmp_path):
    (tmp_path / "a.bin").write_text("x")
    with pytest.raises(catalog.UnsupportedSource):
        catalog.scan_path(spark, str(tmp_path))


def mixed(folder):
    """One folder of files that differ in columns and types, and two damaged ones."""
    folder.mkdir()
    mails = [f"u{k}@example.com" for k in range(3)]
    pq.write_table(pa.table({"email": mails}), folder / "a.parquet")
    pq.write_table(pa.table({"email": [1, 2, 3], "zip_code": ["12345"] * 3}), folder / "b.parquet")
    pq.write_table(pa.table({"id": [1, 2], "contact_email": mails[:2], "ssn": ["123-45-6789"] * 2}), folder / "c.PARQUET")
    pq.write_table(pa.table({"email": mails[1:]}), folder / "d.parquet")
    (folder / "e.parquet").write_bytes(b"PAR1 this is no parquet file PAR1")
    (folder / "f.parquet").write_bytes((folder / "a.parquet").read_bytes()[:-5])


MIXED_FINDINGS = {
    "a.parquet": {("email", "email", 3)}, "b.parquet": {("zip_code", "zip", 1)}, "c.PARQUET": {("contact_email", "email", 2), ("ssn", "ssn", 1)}, "d.parquet": {("email", "email", 2)},
}


@pytest.fixture(params=["small", "large", "many"])
def sizes(request, monkeypatch):
    """Files up to the size whose footers tasks read, or all over it; or more of them than were once picked by name."""
    if request.param == "large":
        monkeypatch.setattr(manifest, "FOOTER_BYTES", 0)
    if request.param == "many":
        monkeypatch.setattr(manifest, "NAMED", 0, raising=False)


def test_every_file_has_the_layout_of_its_own_footer(spark, tmp_path, sizes):
    mixed(tmp_path / "m")
    footers = {r["f"]: r for r in manifest.parquet_footers(spark, str(tmp_path / "m"), None).withColumn("f", short("file")).collect()}
    assert {f: r["columns"] for f, r in footers.items()} == {
        "a.parquet": ["email"], "b.parquet": ["email", "zip_code"], "c.PARQUET": ["id", "contact_email", "ssn"], "d.parquet": ["email"], "e.parquet": None, "f.parquet": None,
    }
    assert footers["a.parquet"]["layout"] == footers["d.parquet"]["layout"] != footers["b.parquet"]["layout"]
    assert {f for f, r in footers.items() if r["error"]} == {"e.parquet", "f.parquet"}


def test_footers_do_not_depend_on_the_size_of_files(spark, tmp_path, monkeypatch):
    mixed(tmp_path / "m")
    wide = pa.table({f"a column with a long name, number {k}": [k] for k in range(2000)})
    pq.write_table(wide, tmp_path / "m" / "wide & 100%.parquet")
    read = lambda: sorted(map(str, manifest.parquet_footers(spark, str(tmp_path / "m"), None).collect()))
    small = read()
    monkeypatch.setattr(manifest, "FOOTER_BYTES", 0)
    assert read() == small and len(small) == 7
    monkeypatch.setattr(manifest, "FOOTER_BYTES", 100_000)  # some of them are larger
    assert read() == small


def test_rules_of_each_file_whatever_its_size(spark, tmp_path, sizes):
    mixed(tmp_path / "m")
    found, _, _ = scanned(spark, tmp_path / "m")
    assert found == MIXED_FINDINGS


def test_states_of_each_file_whatever_its_size(spark, tmp_path, sizes):
    mixed(tmp_path / "m")
    _, states, stats = scanned(spark, tmp_path / "m")
    assert stats == {"a.parquet": 1, "b.parquet": 2, "c.PARQUET": 2, "d.parquet": 1}
    assert {f for f, s in states.items() if s[0] == "FAILED" and "footer" in s[1]} == {"e.parquet", "f.parquet"}
    assert {f for f, s in states.items() if s[0] == "SUCCESS"} == set(stats)
