import json
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from fieldwarden.operators import anomaly as A
from fieldwarden.operators import autogen, privacy, quality, reports, responses
from fieldwarden.operators import expectations as E
from fieldwarden.operators import profile as PR
from fieldwarden.operators.expectations import Expectation
from fieldwarden.operators.scan import scan
from fieldwarden.plans.analyze import analyze

COLUMNS = ["name", "email", "phone", "ssn"]


@pytest.fixture()
def sparse(spark):
    data = [(f"Test User {i}", *(("u@example.com", "4045551001", "101-11-1001") if i == 0 else (None,) * 3), None) for i in range(100)]
    return spark.createDataFrame(data, "name string, email string, phone string, ssn string, notes string")


def totals(result):
    return tuple(result.report.select("evaluated", "failed", "success_rate").first())


def test_input_suites(people, sparse, spark):
    assert totals(E.validate(people.select(*COLUMNS))) == (7, 0, 1.0)
    result = E.validate(sparse, file_name="f")
    assert totals(result) == (8, 1, 0.875)
    failure = result.failures.first()
    assert (failure["column"], failure["expectation"], failure["details"]) == (
        "notes", "Column has too many nulls", {"null_count": "100", "null_pct": "100.0%"},
    )
    empty = E.validate(spark.createDataFrame([], "name string, email string, phone string, ssn string"))
    assert totals(empty) == (5, 1, 0.8)
    assert empty.failures.first()["details"] == {"rows_found": "0"}


def test_name_rules():
    assert E.ID_NAME.search("record_id") and E.ID_NAME.search("order id")
    assert not E.ID_NAME.search("customer_id")
    assert not any(rule.search("home_phone") for rule, _, _ in E.LENGTH_HINTS)


def test_length_outlier_rule(spark):
    df = spark.createDataFrame([("x",)] * 199 + [("y" * 2000,)], "t string")
    suite = E.build_input_suite(df)
    lengths = [1] * 199 + [2000]
    want = int(np.mean(lengths) + 4 * np.std(lengths, ddof=1))
    assert suite[-1] == Expectation(E.LENGTHS, "t", {"min_value": 1, "max_value": want})


def test_checks(spark):
    df = spark.createDataFrame(
        [(1, "a", 5.0, "2020-01-01"), (2, "b", float("nan"), "x"), (3, "a", 50.0, None), (4, None, -1.0, "2021-05-05")],
        "rid int, t string, x double, d string",
    )
    specs = [
        Expectation(E.UNIQUE, "t"),
        Expectation(E.IN_SET, "t", {"value_set": ["a"]}),
        Expectation(E.IN_SET, "rid", {"value_set": [1, 2]}),
        Expectation(E.BETWEEN, "x", {"min_value": 0, "max_value": 10}),
        Expectation(E.NOT_NULL, "x", {"mostly": 0.75}),
        Expectation(E.REGEX, "d", {"regex": r"^\d{4}"}),
        Expectation(E.BETWEEN, "d", {"min_value": "2020-06-01"}),
        Expectation(E.EXISTS, "nope"),
        Expectation(E.REGEX, "nope", {"regex": "x"}),
        Expectation(E.ROW_COUNT, None, {"min_value": 1, "max_value": 3}),
    ]
    got = E.run_expectations(df, specs, "rid").orderBy("index").collect()
    assert [(r["passed"], r["unexpected_count"]) for r in got] == [
        (False, 2), (False, 1), (False, 2), (False, 2), (True, 1), (False, 1), (False, 1), (False, 0), (False, 0), (False, 0),
    ]
    assert got[0]["partial_unexpected_list"] == ["a"]
    assert got[2]["partial_unexpected_list"] == ["3", "4"]
    report = E.build_report(E.run_expectations(df, specs, "rid"))
    details = {r["index"]: r["details"] for r in report.failures.collect()}
    assert details[2] == {"bad_values": "['b']"} and details[3] == {"bad_values": "[3, 4]"}
    assert details[4] == {"observed": ""} and details[8] == {}


def test_examples_are_first_twenty_in_row_order(spark):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(100)], "rid int, t string").repartition(6)
    out = E.run_expectations(df, [Expectation(E.IN_SET, "t", {"value_set": ["v3"]})], "rid").first()
    assert out["partial_unexpected_list"] == [f"v{i}" for i in range(21) if i != 3]


def test_output_suite(people):
    found = scan(people, "p", columns=COLUMNS, order_by="rid").findings
    assert totals(E.validate_findings(found)) == (13, 0, 1.0)
    entity = found.withColumn("risk", F.lit("REVIEW")).withColumn("confidence", F.lit("AI"))
    assert totals(E.validate_findings(entity))[1] == 2
    assert totals(E.validate_findings(entity, allow_entity=True))[1] == 0


def test_scores(spark):
    df = spark.createDataFrame([(10, 9), (10, 7), (10, 6), (0, 0)], "evaluated long, successful long")
    assert [(r["score"], r["band"]) for r in reports.quality_score(df).collect()] == [
        (90, "meets"), (70, "warn"), (60, "fail"), (0, "none run"),
    ]


# --- profiles --------------------------------------------------------------------


def test_quantiles_match_numpy_on_both_paths(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=3000), np.full(2000, 0.25), [float("inf"), float("-inf")]])
    y = rng.integers(0, 10, size=len(x)).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double").repartition(5)
    probs = [0.01, 0.3, 0.5, 0.99]
    for limit in (10**9, 100):
        got = PR.exact_quantiles(df, ["x", "y"], probs, max_rows=limit)
        assert np.allclose(got["x"], np.quantile(x, probs)) and np.allclose(got["y"], np.quantile(y, probs))


def test_profile(spark):
    df = spark.createDataFrame(
        [(1, " a", 1.0), (2, "12", float("nan")), (3, "a", None), (4, None, 4.0)], "rid int, t string, x double"
    )
    got = {r["column"]: r.asDict(recursive=True) for r in PR.profile(df, order_by="rid").collect()}
    t, x = got["t"], got["x"]
    assert (t["rows"], t["non_null"], t["null_pct"], t["distinct"], t["distinct_pct"]) == (4, 3, 25.0, 3, 100.0)
    assert t["sample_values"] == [" a", "12", "a"]
    assert (t["len_min"], t["len_max"], t["numeric_parse_pct"], t["trimmed_pct"]) == (1, 2, 33.33, 66.67)
    assert t["top_values"] == [{"value": " a", "count": 1}, {"value": "12", "count": 1}, {"value": "a", "count": 1}]
    assert (x["non_null"], x["numeric_min"], x["numeric_max"]) == (2, 1.0, 4.0)
    assert x["p99"] == pytest.approx(3.97) and x["top_values"] is None


def test_top_values_need_few_distinct(spark):
    df = spark.createDataFrame([(f"a{i % 51}", f"b{i % 50}") for i in range(300)], "a string, b string")
    got = PR.top_values(df)
    assert {r["column"] for r in got.collect()} == {"b"} and got.count() == 8


# --- generated expectations ----------------------------------------------------------


def test_fallback_specs(spark):
    df = spark.createDataFrame([(1, "2020-01-01", "5", "x"), (2, "no", "7.5", " y")], "`order id` int, `ship date` string, n string, t string")
    suite = autogen.fallback_specs(df)
    assert [(s.column, s.type) for s in suite if s.type != E.NOT_NULL] == [
        ("order id", E.UNIQUE), ("ship date", E.REGEX), ("n", E.REGEX), ("t", E.REGEX),
    ]
    run = autogen.auto_expectations(df)
    passed = {(r["column"], r["expectation"]): r["passed"] for r in run.outcomes.collect()}
    assert passed[("order id", E.UNIQUE)] and not passed[("ship date", E.REGEX)]
    assert passed[("n", E.REGEX)] and not passed[("t", E.REGEX)]
    failed = run.outcomes.where("column = 't' AND NOT passed").first()
    assert failed["failure_details"]["bad_values"] == "[' y']" and failed["status"] == "FAIL"


def test_proposals(sparse, spark):
    items = [
        {"expectation_type": "expect_column_values_to_not_be_null", "column": "name", "kwargs": {"mostly": 0.3}, "confidence": "high"},
        {"expectation_type": "x"},
        {"expectation_type": E.IN_SET, "column": "name", "kwargs": {"value_set": ["a", 1, True, None]}},
        {"expectation_type": E.IN_SET, "column": "name", "kwargs": {"value_set": []}},
        {"expectation_type": E.BETWEEN, "column": "zz", "kwargs": {"min_value": 1}},
        {"expectation_type": E.BETWEEN, "column": "name", "kwargs": {}},
        {"expectation_type": E.REGEX, "column": "name", "kwargs": {"regex": " "}},
        {"expectation_type": E.UNIQUE, "column": "name", "kwargs": "no"},
        3,
    ]
    again = {"items": [{"expectation_type": E.NOT_NULL, "column": "name", "kwargs": {"mostly": 0.2}}]}
    answers = spark.createDataFrame(
        [(1, "```json\n" + json.dumps(items) + "\n```"), (2, "nope"), (3, json.dumps(again))], "id long, response string"
    )
    run = autogen.auto_expectations(sparse, answers, order=["id"])
    proposed = [json.loads(r["params"]) for r in run.specs.where("generation_source = 'LLM'").orderBy("index").collect()]
    assert proposed == [{"column": "name", "mostly": 0.95}, {"column": "name", "value_set": ["a", "1", "True", "None"]}]
    d = run.diagnostics.first()
    assert (d["items_parsed"], d["proposed_specs_accepted"], d["rejected_unknown_type"], d["rejected_bad_column"]) == (9, 2, 1, 1)
    nothing = autogen.auto_expectations(sparse, answers.where("id = 2"), order=["id"]).diagnostics.first()
    assert nothing["hint"].startswith("No parseable JSON")


def test_response_rows(spark):
    answers = spark.createDataFrame(
        [(1, '```json\n[{"column":"a","issue":"bad","severity":"high"},{"column":"b"},{"issue":"c","column":"zz"}]\n```'),
         (2, '{"column":"a","issue":"x"}'), (3, "[broken")], "id long, response string",
    )
    got = responses.response_rows(answers, "response", ["column", "issue"], columns=["a", "b"])
    assert rows(got, "id", "column", "issue", "severity") == [(1, "a", "bad", "HIGH")]


def test_payloads(people, sparse):
    payload = json.loads(responses.sample_payload(people, rows=2, skip=["rid"], order_by="rid").first()[0])
    assert list(payload) == COLUMNS and payload["phone"] == ["4045551001", "4045551002"]
    result = E.validate(sparse, file_name="f.csv")
    sent = responses.failure_payload(result.report, result.failures).first()
    assert json.loads(sent["failures"])[0]["column"] == "notes"
    good = E.validate(people.select(*COLUMNS), file_name="p")
    assert responses.failure_payload(good.report, good.failures).count() == 0


# --- privacy and quality -------------------------------------------------------------


def test_k_anonymity_against_counting(spark):
    rng = random.Random(5)
    data = [(rng.choice("abc"), rng.randint(0, 4), rng.choice([None, "x"])) for _ in range(300)]
    df = spark.createDataFrame(data, "a string, b int, c string")
    groups = [("a", "b"), ("b", "c"), ("a", "b", "c"), ("c",)]
    got = {r["columns"]: r for r in privacy.k_anonymity(df, groups, k=12, sets_per_job=2).collect()}
    for g in groups:
        sizes = {}
        for row in data:
            key = tuple(row["abc".index(c)] for c in g)
            sizes[key] = sizes.get(key, 0) + 1
        r = got[",".join(sorted(g))]
        assert (r["classes"], r["min_class_size"], r["rows"]) == (len(sizes), min(sizes.values()), 300)
        assert r["rows_below_k"] == sum(n for n in sizes.values() if n < 12)


def test_privacy_checks(spark):
    df = spark.createDataFrame(
        [(f"write to u{i}@example.com", "abc" if i < 4 else "61555512%02d" % i, "x") for i in range(10)],
        "remarks string, phone string, surname string",
    )
    assert rows(privacy.semantic_pii(df, ["phone"]), "column", "risk") == [("remarks", "HIGH"), ("surname", "MEDIUM")]
    issue = privacy.format_anomalies(df).first()
    assert (issue["column"], issue["severity"]) == ("phone", "MEDIUM") and "4 of 10" in issue["observed_issue"]


def test_regulations(people):
    flags = privacy.regulatory_flags(scan(people, "p", columns=COLUMNS, order_by="rid").findings)
    assert {(r["column"], r["regulation"], r["severity"]) for r in flags.collect()} >= {
        ("ssn", "HIPAA", "HIGH"), ("email", "GDPR", "MEDIUM"), ("phone", "CCPA", "LOW"),
    }


def test_plausibility(spark):
    df = spark.createDataFrame(
        [(999, -5.0, "12A45", "Y", "2200-01-01"), (30, 10.0, "12345", "true", "2020-01-01")],
        "age int, salary double, zip string, active string, hire_date string",
    )
    got = {r["column"]: (r["example"], r["severity"]) for r in quality.plausibility(df).collect()}
    assert got == {
        "age": ("999", "HIGH"), "salary": ("-5.0", "HIGH"), "zip": ("12A45", "MEDIUM"),
        "active": ("Y/N, True/False", "MEDIUM"), "hire_date": ("2200-01-01", "HIGH"),
    }


def test_consistency(spark):
    df = spark.createDataFrame(
        [("2020-01-02", "2020-01-01", "1", "GA", 3.0, 1.0, 1.0), ("2020-01-01", "2020-01-03", "1", "TN", 2.0, 1.0, 1.0)],
        "start_date string, end_date string, zip string, state string, total double, a double, b double",
    )
    listed = spark.createDataFrame([("1", "GA")], "zip string, state string")
    found = quality.consistency(df, [*quality.implied_rules(df.columns), quality.SumOf("total", ("a", "b")), quality.ListedIn(("zip", "state"), listed)])
    assert {r["columns"] for r in found.collect()} == {"start_date, end_date", "zip, state", "total, a, b"}
    assert found.where("columns = 'zip, state'").count() == 2


def test_completeness(spark):
    df = spark.createDataFrame([("n/a", " "), ("x", None), ("TBD", "y"), ("z", "w")], "note string, address string")
    got = {r["column"]: r["severity"] for r in quality.completeness(df).collect()}
    assert got == {"note": "HIGH", "address": "HIGH", "dataset-level": "LOW"}


# --- anomalies ------------------------------------------------------------------------


def test_planted_outliers(spark):
    rng = random.Random(1)
    data = [(i, 100 + rng.gauss(0, 1), "common" if i % 50 else f"odd{i}") for i in range(980)]
    data += [(980 + i, 5000.0 + i, "common") for i in range(20)]
    df = spark.createDataFrame(data, "rid long, x double, t string").repartition(4)
    got = {r["column"]: r for r in A.detect_anomalies(df, columns=["x", "t"], order_by="rid").collect()}
    x = got["x"]
    assert 20 <= x["anomalous_row_count"] <= 50 and x["total_rows"] == 1000
    assert x["anomaly_pct"] == round(100 * x["anomalous_row_count"] / 1000, 1)
    assert "standard deviations above" in x["explanation"]
    assert got["t"]["anomalous_row_count"] == 20


def test_rare_text(spark):
    df = spark.createDataFrame([(i, "common" if i >= 3 else f"odd{i}") for i in range(100)], "rid long, t string")
    got = A.detect_anomalies(df, columns=["t"], order_by="rid").first()
    assert got["anomalous_row_count"] == 3 and got["sample_anomalous_values"] == ["odd0", "odd1", "odd2"]


def test_small_and_constant_columns(spark):
    df = spark.createDataFrame([(1.0, i) for i in range(9)], "x double, y int")
    assert A.detect_anomalies(df).count() == 0
    df = spark.createDataFrame([(1.0,) for _ in range(50)], "x double")
    assert A.detect_anomalies(df).count() == 0


def test_weighted_quantile_equals_numpy():
    rng = np.random.default_rng(0)
    values, weights = rng.normal(size=50), rng.integers(1, 9, size=50)
    for p in (0.0, 0.05, 0.5, 1.0):
        assert A.weighted_quantile(values, weights, p) == pytest.approx(np.percentile(np.repeat(values, weights), 100 * p))


def test_forest_scores_extremes_highest():
    x = np.sort(np.random.default_rng(2).normal(size=2000))
    breaks, scores = A.fit_forest(lambda rng, k: rng.choice(x, k, replace=False), len(x))
    at = lambda v: scores[np.searchsorted(breaks, v, side="left")]
    assert at(6.0) > at(2.0) > at(0.0) and at(-6.0) > at(0.0)


def test_analyze_isolates_errors(people):
    out = analyze(people.select(*COLUMNS), ["consistency", "completeness", "regulatory"], source="p")
    assert out.checks_run == ["regulatory", "consistency", "completeness"] and out.errors == {}
    with pytest.raises(ValueError):
        analyze(people, ["nope"])
