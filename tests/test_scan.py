import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from fieldwarden.functions import patterns as P
from fieldwarden.functions.entities import luhn_valid, nhs_valid
from fieldwarden.functions.text import as_text, strip
from fieldwarden.operators import scan as S
from fieldwarden.operators.entities import entity_scan, entity_udf
from fieldwarden.operators.values import (
    hash_sample,
    representative_sample,
    rows_between,
    sample_values,
    top_n,
)

FINDING = ("column", "pattern", "confidence", "risk", "matches", "sample_size", "match_pct")

# Edge texts for the rules: whole matches, near misses, other scripts, padding.
CORPUS = [
    "12345\n", "12345", "12345-6789", "١٢٣٤٥", "123456789", "1234567890", "4111 1111 1111 1111", "1.1.1.1",
    "999.999.999.999", "a@b.co", "A@B.CO", "x@b", "(615) 555-1234", "+1-615-555-1234", "12/31/1999", "13/31/1999",
    "1-2-2000", "AB12CD", "AB12CD34", "ABCDEFGHIJKL", "abcdefgh", "12-3456789", "nan", "N/A", "é1", "é",
    "1234-5678", "12345678901234567", "123456789012345678", "a b@c.de",
]


def test_rules_agree_with_python(spark):
    df = spark.createDataFrame([(v,) for v in CORPUS], "v string")
    out = df.select("v", *[r.matches(F.col("v")).alias(r.name) for r in P.DEFAULT_REGISTRY]).collect()
    for row in out:
        for rule in P.DEFAULT_REGISTRY:
            assert row[rule.name] == bool(re.fullmatch(rule.regex, row["v"])), (rule.name, row["v"])


def test_strip_is_unicode(spark):
    values = ["  a\t", " b ", "c", "\x1cd\x1f", " e f ", "\n"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in df.select(strip(F.col("v"))).collect()] == [v.strip() for v in values]


@pytest.mark.parametrize(
    "number", [0.0, 1.5, -2.25, 1e7, 123456789.125, 1e15, 1e16, 1.5e22, 0.001, 0.0001, 0.00012345, 1e-5, 2.5e-10, 0.1]
)
def test_float_text_is_python_text(spark, number):
    df = spark.createDataFrame([(number,)], "x double")
    assert df.select(as_text(F.col("x"), df.schema["x"].dataType)).first()[0] == repr(number)


def test_checksums(spark):
    df = spark.createDataFrame([("4111 1111 1111 1111", "943 476 5919"), ("4111111111111112", "9434765918")], "c string, n string")
    assert [tuple(r) for r in df.select(luhn_valid(F.col("c")), nhs_valid(F.col("n"))).collect()] == [(True, True), (False, False)]


def test_people_findings(people):
    result = S.scan(people, "people.csv", columns=["name", "email", "phone", "ssn"], order_by="rid")
    assert rows(result.findings, *FINDING) == sorted(
        [
            ("email", "email", "HIGH", "HIGH", 50, 50, 100.0),
            ("phone", "phone", "HIGH", "HIGH", 50, 50, 100.0),
            ("phone", "driver_license", "LOW", "LOW", 50, 50, 100.0),
            ("phone", "bank_account", "LOW", "LOW", 50, 50, 100.0),
            ("ssn", "ssn", "HIGH", "CRITICAL", 50, 50, 100.0),
        ]
    )
    assert rows(result.stats, "source", "columns_scanned", "findings") == [("people.csv", 4, 5)]
    assert result.findings.columns == S.FINDING_COLUMNS
    first = result.findings.where("column = 'email'").first()
    assert [first[f"sample_match_{i}"] for i in range(1, 6)] == [f"user{i}@example.com" for i in range(1, 6)]


def test_mixed_text_file(spark):
    data = [(v,) for i in range(25) for v in (f"u{i}@example.com", f"615555{1000 + i}", "not_pii_value")]
    result = S.scan(spark.createDataFrame(data, "value string"), "mixed.TXT", entities=False)
    assert rows(result.findings, "pattern", "confidence", "risk", "matches", "sample_size", "match_pct") == sorted(
        (p, "LOW", "LOW", 25, 51, 49.02) for p in ("email", "phone", "driver_license", "bank_account")
    )


def test_notes_give_entities_only(spark):
    data = [
        (f"Alex Stone requested that papers be mailed to {i + 1} Pine Avenue, Savannah GA 3010{i % 10}. Thanks.",)
        for i in range(50)
    ]
    found = S.scan(spark.createDataFrame(data, "value string"), "notes.txt").findings
    assert rows(found, "pattern", "confidence", "risk", "matches", "detection_source") == [
        ("LOCATION", "AI", "REVIEW", 50, "ENTITY_RULE"),
        ("PERSON", "AI", "REVIEW", 50, "ENTITY_RULE"),
    ]


def test_empty_and_null_columns(spark):
    empty = S.scan(spark.createDataFrame([], "name string, email string, notes string"), "empty.csv")
    assert empty.findings.count() == 0
    assert rows(empty.stats, "columns_scanned", "findings") == [(2, 0)]


def test_greedy_hints():
    assert P.is_candidate_column("description") and P.is_candidate_column("rating") is True
    assert not P.is_candidate_column("price")
    assert P.is_priority_column("ip_address") and not P.is_priority_column("email")


def test_confidence_and_risk(spark):
    df = spark.createDataFrame(
        [("zip", "ip", 90.0), ("zip_code", "zip", 80.0), ("ssn", "ssn", 1.0), ("x", "ssn", 100.0), ("email", "email", 80.01)],
        "column string, pattern string, match_pct double",
    )
    reg = P.DEFAULT_REGISTRY
    rated = df.withColumn("c", reg.confidence(F.col("column"), F.col("pattern")))
    rated = rated.withColumn("r", reg.risk(F.col("pattern"), F.col("c"), F.col("match_pct")))
    assert [(r["c"], r["r"]) for r in rated.collect()] == [
        ("HIGH", "HIGH"), ("HIGH", "MEDIUM"), ("HIGH", "CRITICAL"), ("LOW", "LOW"), ("HIGH", "HIGH"),
    ]


def test_registry_extension(spark):
    reg = P.DEFAULT_REGISTRY.add("badge", r"B-\d{4}", hints=["badge"], high_risk=True)
    df = spark.createDataFrame([("B-1234",), ("B-9999",), ("zzz",)], "badge_no string")
    found = S.scan(df, "t", registry=reg, entities=False, columns=["badge_no"], sample_limit=None).findings
    assert found.count() == 0  # neither a candidate name nor free text
    found = S.scan(df, "t.txt", registry=reg, entities=False).findings
    assert rows(found, "pattern", "risk", "matches") == [("badge", "CRITICAL", 2)]


def test_sample_is_first_seen_and_limited(spark):
    data = [(i, f"v{i % 700}") for i in range(3000)]
    df = spark.createDataFrame(data, "rid long, name string").repartition(7)
    got = sample_values(df, ["name"], order_by="rid").orderBy("rn").collect()
    assert [(r["rn"], r["value"]) for r in got] == [(i + 1, f"v{i}") for i in range(500)]


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_findings_do_not_depend_on_partitioning(people, parts):
    found = S.scan(people.repartition(parts), "p", columns=["email", "phone"], order_by="rid").findings
    assert rows(found, *FINDING, "sample_match_1") == rows(
        S.scan(people, "p", columns=["email", "phone"], order_by="rid").findings, *FINDING, "sample_match_1"
    )


def test_sample_counts_all_rows_of_a_value(spark):
    df = spark.range(5000).selectExpr("id AS rid", "concat('v', id % 250) AS name").repartition(8)
    got = rows(sample_values(df, ["name"], 50, "rid"), "rn", "value", "cnt")
    assert got == [(i + 1, f"v{i}", 20) for i in range(50)]


def test_top_n_equals_single_ranking(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), F.xxhash64("id").alias("v"))
    got = rows(top_n(df, ["k"], [F.col("v")], 20, ["v"]), "k", "v", "rn")
    want = []
    for k in range(3):
        values = sorted(r["v"] for r in df.where(F.col("k") == k).collect())[:20]
        want += [(k, v, i + 1) for i, v in enumerate(values)]
    assert got == sorted(want)


def test_full_scan_sees_values_beyond_the_sample(spark):
    data = [(i, f"plain{i}") for i in range(600)] + [(600 + i, f"u{i % 2}@example.com") for i in range(10)]
    df = spark.createDataFrame(data, "rid long, name string")
    assert S.scan(df, "t", order_by="rid", columns=["name"], entities=False, sample_limit=500).findings.where("pattern='email'").count() == 0
    full = S.scan(df, "t", order_by="rid", columns=["name"], sample_limit=None).findings.where("pattern='email'").first()
    assert (full["matches"], full["sample_size"], full["sample_match_1"]) == (2, 602, "u0@example.com")


def test_full_counts_keep_long_values(spark):
    long_mail = "a" * 300 + "@example.com"
    df = spark.createDataFrame([(1, long_mail), (2, long_mail), (3, "x " * 400), (4, "x " * 400), (5, "y")], "rid long, t string")
    cells = S.stripped_cells(S.long_form(df, ["t"], "rid"))
    got = S.full_counts(cells).first()
    assert (got["pattern"], got["matches"], got["rows"], got["sample_size"], got["total_rows"]) == ("email", 1, 2, 3, 5)
    assert got["examples"] == [long_mail]


def test_entity_counts_values_not_spans(spark):
    values = spark.createDataFrame(
        [("s", "c", "mail a@b.co and c@d.co", 1), ("s", "c", "mail a@b.co http://x.y", 2), ("s", "c", "none", 3)],
        "source string, column string, value string, rn int",
    )
    got = {r["entity"]: (r["matches"], r["entity_score"], r["examples"]) for r in entity_scan(values).collect()}
    assert got["EMAIL_ADDRESS"] == (2, 1.0, ["a@b.co", "c@d.co"])
    assert got["URL"] == (1, 0.6, ["http://x.y"])


def test_entity_hook(spark):
    def factory():
        def model(text):
            if "boom" in text:
                raise ValueError(text)
            return [("ORG", w, 0.5 + 0.1234567) for w in text.split() if w.isupper()]

        return model

    schema = "source string, column string, value string, rn int"
    values = spark.createDataFrame([("s", "c", "ACME met ACME", 1), ("s", "c", "", 2), ("s", "c", "NASA", 3)], schema)
    got = entity_scan(values, entity_udf(factory)).first()
    assert (got["entity"], got["matches"], got["entity_score"], got["examples"]) == ("ORG", 2, 0.623, ["ACME", "NASA"])

    def broken():
        raise RuntimeError("no model")

    # texts that nobody read are no texts without entities
    with pytest.raises(Exception, match="no model"):
        entity_scan(values, entity_udf(broken)).count()
    with pytest.raises(Exception, match="boom"):
        entity_scan(values.withColumn("value", F.lit("boom")), entity_udf(factory)).count()


def test_hash_sample_is_stable_and_uniform(spark):
    df = spark.range(50_000).withColumnRenamed("id", "k")
    a = {r["k"] for r in hash_sample(df, "k", 200).collect()}
    assert a == {r["k"] for r in hash_sample(df.repartition(5), "k", 200).collect()} and len(a) == 200
    import hashlib

    ranked = sorted(range(50_000), key=lambda k: hashlib.md5(f"42|{k}".encode()).hexdigest())
    assert a == set(ranked[:200])


def test_head_middle_tail(spark):
    df = spark.range(5000).select((F.col("id") * 3).alias("k")).repartition(6)
    got = [r["k"] for r in representative_sample(df, "k").orderBy("k").collect()]
    index = list(range(333)) + list(range(2333, 2667)) + list(range(4667, 5000))
    assert got == [3 * i for i in index]
    assert representative_sample(df.limit(1000), "k").count() == 1000
    part = rows_between(df, "k", 5000, 1234, 10, span=50)
    assert [r["k"] for r in part.collect()] == [3 * i for i in range(1234, 1244)]


def test_scan_sees_values_after_the_first_500(spark):
    from fieldwarden.operators.remediate import remediate

    rows = [(i, f"user{i}@example.com" if i >= 4000 else f"plain{i}", f"Anna Stone called from {i}") for i in range(5000)]
    df = spark.createDataFrame(rows, "rid long, contact_email string, note string")
    result = S.scan(df, "people.csv", order_by="rid")
    found = {(r["column"], r["pattern"]): r for r in result.findings.collect()}
    assert found["contact_email", "email"]["matches"] == 1000
    assert found["contact_email", "email"]["sample_match_1"] == "user4000@example.com"
    assert found["note", "PERSON"]["matches"] == 5000 and found["note", "PERSON"]["sample_size"] == 5000
    clean = remediate(df, result.findings, file_name="people.csv").data
    assert clean.where("contact_email like '%@%'").count() == 0
    assert S.scan(df, "people.csv", order_by="rid", sample_limit=500, entities=False).findings.where("pattern = 'email'").count() == 0
