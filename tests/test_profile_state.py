"""Merged profile states against the state of the whole table and against exact profiles."""

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from fieldwarden.operators import profile as PR
from fieldwarden.operators import profile_state as PS

EXACT = ["column", "dtype", "rows", "non_null", "null_pct", "numeric_min", "numeric_max", "len_min", "len_max", "numeric_parse_pct", "trimmed_pct"]


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(20_000).select(
        F.when(F.col("id") % 7 != 0, F.col("id") * 0.5).alias("x"),
        F.when(F.col("id") % 11 == 0, float("nan")).otherwise(F.sqrt("id")).alias("y"),
        F.concat(F.lit(" "), F.repeat(F.lit("a"), (F.col("id") % 9).cast("int"))).alias("t"),
        F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).alias("code"),
        (F.col("id") % 2 == 0).alias("even"),
        (F.col("id") % 5).alias("day"),
    )


def shown(df):
    return [tuple("-" if v is None else v for v in r) for r in df.select(*EXACT).orderBy("position").collect()]


def test_merge_equals_the_whole(spark, table, tmp_path):
    by_day = PS.profile_state(table, keys=["day"])
    assert by_day.count() == 5 * 5
    by_day.where("day < 3").write.parquet(str(tmp_path / "a"))
    by_day.where("day >= 3").write.parquet(str(tmp_path / "b"))
    kept = spark.read.parquet(str(tmp_path / "a"), str(tmp_path / "b"))
    merged = PS.profile_of(PS.merged_state(kept))
    whole = PS.profile_of(PS.profile_state(table.drop("day")))
    assert shown(merged) == shown(whole)
    seen = dict(rows(whole, "column", "approx_distinct"))
    assert all(n == pytest.approx(seen[c], rel=0.03) for c, n in rows(merged, "column", "approx_distinct"))
    sums = {r["column"]: r["numeric_mean"] for r in whole.collect()}
    assert all(r["numeric_mean"] is None or r["numeric_mean"] == pytest.approx(sums[r["column"]]) for r in merged.collect())


def test_exact_parts_equal_the_profile(table):
    df = table.drop("day")
    got = {r["column"]: r for r in PS.profile_of(PS.profile_state(df)).collect()}
    for r in PR.common_profile(df).collect():
        own = got[r["column"]]
        assert (own["rows"], own["non_null"], own["null_pct"]) == (r["rows"], r["non_null"], r["null_pct"])
        assert own["approx_distinct"] == pytest.approx(r["distinct"], rel=0.03)
    for r in PR.numeric_profile(df).collect():
        assert (got[r["column"]]["numeric_min"], got[r["column"]]["numeric_max"]) == (r["numeric_min"], r["numeric_max"])
    for r in PR.text_profile(df).collect():
        own = got[r["column"]]
        assert [own[c] for c in ("len_min", "len_max", "numeric_parse_pct", "trimmed_pct")] == [r[c] for c in ("len_min", "len_max", "numeric_parse_pct", "trimmed_pct")]


def test_quantiles_of_merged_states_stay_within_the_bound(spark, table):
    merged = PS.profile_of(PS.merged_state(PS.profile_state(table.withColumn("part", F.expr("pmod(xxhash64(x, y), 50)")), ["x", "y"], ["part"])))
    values = {c: np.sort([r[0] for r in table.select(c).where(f"{c} is not null and not isnan({c})").collect()]) for c in ("x", "y")}
    for r in merged.collect():
        own = values[r["column"]]
        for p, name in ((0.01, "approx_p01"), (0.99, "approx_p99")):
            assert abs(np.searchsorted(own, r[name]) / len(own) - p) <= 0.01


def test_state_by_keys_changed_types_and_empty_tables(spark, table):
    by_day = PS.profile_of(PS.merged_state(PS.profile_state(table, ["x"], ["day"]), ["day"]), ["day"])
    assert rows(by_day, "day", "rows") == [(d, 4000) for d in range(5)]
    both = PS.profile_state(table, ["x"]).unionByName(PS.profile_state(table.select(F.col("x").cast("string").alias("x")), ["x"]))
    assert rows(PS.profile_of(PS.merged_state(both)), "column", "dtype") == [("x", "double"), ("x", "string")]
    none = PS.profile_of(PS.profile_state(table.limit(0))).collect()
    assert all(r["rows"] == 0 and r["approx_distinct"] == 0 and r["approx_p01"] is None for r in none)
