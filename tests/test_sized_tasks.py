"""Work dealt by the number of cells: one reading of a directory, tasks of a bounded size, examples without long rankings."""

import json
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fieldwarden.operators import cell_index, entities, values
from fieldwarden.plans.analyze import SHARED, analyze
from fieldwarden.sources import catalog


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("sized")
    n = 3000
    long = "filler " * 50 + "write to a{}@example.com"
    table = {
        "email": [f" user{i}@example.com" if i % 4 else None for i in range(n)],
        "note": [long.format(i % 20) if i % 3 else "Alice Stone called" for i in range(n)],
        "amount": [i * 0.5 for i in range(n)],
        "phone": [4045550000 + i % 900 for i in range(n)],
    }
    pq.write_table(pa.table(table), path / "people.parquet", row_group_size=n)
    return str(path)


def spied(monkeypatch, module):
    """The plans of the tables that a module keeps."""
    plans, real = [], module.kept

    def kept(df, name):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return real(df, name)

    monkeypatch.setattr(module, "kept", kept)
    return plans


def found(df):
    return sorted(json.dumps(r.asDict(), sort_keys=True) for r in df.drop("detection_timestamp").collect())


def dealt_to(plan):
    return max(int(n) for n in re.findall(r"RepartitionByExpression \[[^\]]*\], (\d+)", plan))


def test_directory_is_read_once_for_the_rules(spark, folder, monkeypatch):
    plans = spied(monkeypatch, catalog)
    catalog.scan_path(spark, folder, entities=False)
    assert [name for name, plan in plans if re.search(r"Relation \[.*email#", plan)] == ["cells"]


def test_entities_read_only_long_texts_again(spark, folder, monkeypatch):
    plans = spied(monkeypatch, catalog) if not hasattr(entities, "kept") else spied(monkeypatch, entities)
    result = catalog.scan_path(spark, folder)
    again = [plan for _, plan in plans if re.search(r"Relation \[.*email#", plan)]
    assert len(again) == 1 and "amount" not in re.sub(r"Relation \[.*", "", again[0])
    rows = {(r["column"], r["pattern"]): r for r in result.findings.where("confidence = 'AI'").collect()}
    assert rows["note", "EMAIL_ADDRESS"]["matches"] == 20 and rows["note", "EMAIL_ADDRESS"]["sample_match_1"] == "a1@example.com"
    assert rows["note", "PERSON"]["matches"] == 1 and rows["note", "PERSON"]["sample_size"] == 21


def test_one_small_file_is_dealt_by_its_cells(spark, folder, monkeypatch):
    whole = found(catalog.scan_path(spark, folder).findings)
    monkeypatch.setattr(values, "CELLS_PER_TASK", 500)
    plans = spied(monkeypatch, catalog)
    assert found(catalog.scan_path(spark, folder).findings) == whole and whole
    assert dealt_to(dict(plans)["cells"]) == 30  # 3000 rows of 4 columns and a sign


@pytest.mark.parametrize("order_by", ["phone", None])
def test_index_of_one_small_file_is_dealt_by_its_cells(spark, folder, monkeypatch, order_by):
    df = spark.read.parquet(folder)
    alone = analyze(df, SHARED, order_by=order_by, entities=False, shared=False)
    monkeypatch.setattr(values, "CELLS_PER_TASK", 500)
    plans = spied(monkeypatch, cell_index)
    together = analyze(df, SHARED, order_by=order_by, entities=False)
    assert together.errors == alone.errors == {}
    for check in SHARED:
        assert found(together.results[check]) == found(alone.results[check]), check
    assert [dealt_to(plan) for name, plan in plans if name in ("cell-index", "bad-rows")] == [30, 30]


def test_shuffle_partitions_are_raised_and_given_back(spark):
    key = "spark.sql.shuffle.partitions"
    given = spark.conf.get(key)
    with values.reducers(spark, int(given) + 5):
        assert int(spark.conf.get(key)) == int(given) + 5
    with values.reducers(spark, 1):
        assert spark.conf.get(key) == given
    assert spark.conf.get(key) == given


def test_rows_near_the_first_hold_the_first(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 3).alias("k"),
        F.when(F.col("id") % 501 == 0, None).otherwise(5000 - F.col("id") / 4).cast("long").alias("at"),
        F.col("id").cast("string").alias("value"),
    )
    near = values.near_first(rows, ["k"], "at", 5, ["value"])

    def first(df):
        return sorted(map(str, values.top_n(df, ["k"], [F.col("at"), F.col("value")], 5, ["value"]).collect()))

    assert first(near) == first(rows) and near.count() < 2500
