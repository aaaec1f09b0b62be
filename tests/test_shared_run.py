"""Checks that share one index give what each gives alone, and read the table at most twice."""

import json

import pytest
from pyspark.sql import functions as F

from fieldwarden.operators.cell_index import CellIndex
from fieldwarden.plans.analyze import SHARED, analyze


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    long = F.concat(F.repeat(F.lit("word "), 80), F.col("id").cast("string"))
    made = spark.range(400).select(
        "id",
        F.when(F.col("id") % 9 == 0, F.lit("  ")).when(F.col("id") % 5 == 0, None).otherwise(F.concat(F.lit("u"), F.col("id") % 50, F.lit("@example.com"))).alias("email"),
        F.when(F.col("id") % 7 == 0, F.lit("bad zip")).otherwise((F.col("id") % 90 + 10000).cast("string")).alias("zip"),
        F.when(F.col("id") % 3 == 0, long).when(F.col("id") % 3 == 1, F.lit(" n/a")).otherwise(F.repeat(F.lit(" x"), 200)).alias("note"),
        F.when(F.col("id") % 4 == 0, float("nan")).otherwise(F.col("id") * 1e6).alias("amount"),
        (F.col("id") % 2 == 0).alias("flag"),
        F.concat(F.lit("k"), F.col("id") % 390).alias("key"),
        F.date_add(F.lit("2024-01-01"), (F.col("id") % 40).cast("int")).alias("date"),
    )
    path = str(tmp_path_factory.mktemp("shared") / "t")
    made.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def plain(df):
    return sorted(json.dumps(r.asDict(recursive=True), sort_keys=True, default=str) for r in df.drop("detection_timestamp").collect())


def test_shared_results_equal_single_runs(table):
    together = analyze(table, SHARED, order_by="id", entities=False)
    alone = analyze(table, SHARED, order_by="id", entities=False, shared=False)
    assert together.errors == alone.errors == {} and set(together.checks_run) == set(SHARED)
    for check in SHARED:
        assert plain(together.results[check]) == plain(alone.results[check]), check
        assert plain(alone.results[check])


def test_the_scan_of_the_index_equals_a_scan(table):
    from fieldwarden.operators.scan import scan

    index = CellIndex(table, "id")
    for entities in (False, True):
        assert plain(index.scan("t", entities).findings) == plain(scan(table, "t", order_by="id", entities=entities).findings)
    assert plain(index.scan("t", False).stats) == plain(scan(table, "t", order_by="id", entities=False).stats)


def test_the_table_is_read_at_most_twice(spark, table, monkeypatch):
    """Rows of the table are counted as tasks read them, over the building and the collecting of all results."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = table.count()
    watched = table.mapInArrow(counted, table.schema)
    done = analyze(watched, SHARED, order_by="id", entities=False)
    for frame in done.results.values():
        frame.collect()
    assert done.errors == {} and rows <= read.value <= 2 * rows


def test_empty_table(table):
    done = analyze(table.limit(0), SHARED, order_by="id", entities=False)
    alone = analyze(table.limit(0), SHARED, order_by="id", entities=False, shared=False)
    assert done.errors == {}
    for check in SHARED:
        assert plain(done.results[check]) == plain(alone.results[check]), check


def test_rules_of_the_caller_on_long_texts(spark, table):
    proposed = spark.createDataFrame([(json.dumps([
        {"expectation_type": "expect_column_values_to_match_regex", "column": "note", "kwargs": {"regex": "word"}},
        {"expectation_type": "expect_column_values_to_be_in_set", "column": "flag", "kwargs": {"value_set": ["True"]}},
        {"expectation_type": "expect_column_values_to_be_between", "column": "amount", "kwargs": {"min_value": 0, "max_value": 5e6}},
        {"expectation_type": "expect_column_value_lengths_to_be_between", "column": "note", "kwargs": {"min_value": 1, "max_value": 300}},
    ]),)], "response string")
    both = [analyze(table, SHARED, order_by="id", proposed=proposed, entities=False, shared=s).results["auto_expectations"] for s in (True, False)]
    assert plain(both[0]) == plain(both[1])
    assert any('"passed": false' in r and '"note"' in r for r in plain(both[0]))
