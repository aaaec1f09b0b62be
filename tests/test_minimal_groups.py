"""Smallest identifying column groups against counting every group."""

from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from fieldwarden.operators import privacy


@pytest.fixture(scope="module")
def planted(spark):
    """Three digits of a number identify together only; one column is unique, one constant, one half null."""
    return spark.range(1000).select(
        (F.col("id") % 10).alias("a"), (F.floor(F.col("id") / 10) % 10).alias("b"), F.floor(F.col("id") / 100).alias("c"),
        F.concat(F.lit("u"), "id").alias("unique"), F.lit("x").alias("same"),
        F.when(F.col("id") % 2 == 0, F.lit("even")).alias("half"),
    )


def brute(rows, names, k, threshold):
    found = []
    for size in range(1, len(names) + 1):
        for group in combinations(sorted(names), size):
            if any(set(f) < set(group) for f in found):
                continue
            sizes = Counter(tuple(r[c] for c in group) for r in rows)
            if sum(n for n in sizes.values() if n < k) / len(rows) >= threshold:
                found.append(group)
    return sorted(found)


@pytest.mark.parametrize("k, threshold", [(5, 0.05), (2, 0.05), (12, 0.5)])
def test_equals_counting_every_group(planted, k, threshold):
    rows = planted.collect()
    got = privacy.minimal_quasi_identifiers(planted, k=k, threshold=threshold).collect()
    want = brute(rows, planted.columns, k, threshold)
    assert sorted(tuple(r["columns"]) for r in got) == want
    assert ("unique",) in want and (k != 5 or ("a", "b", "c") in want)


def test_no_group_above_a_known_one_is_measured(planted, monkeypatch):
    seen = []
    real = privacy.class_sizes
    monkeypatch.setattr(privacy, "class_sizes", lambda df, groups, k: (seen.extend(groups), real(df, groups, k))[1])
    found = [tuple(r["columns"]) for r in privacy.minimal_quasi_identifiers(planted).collect()]
    assert len(seen) == len(set(seen))
    assert not [g for g in seen for f in found if set(f) < set(g)]


def test_size_bound_nulls_and_empty_tables(spark, planted):
    assert [r["columns"] for r in privacy.minimal_quasi_identifiers(planted, max_size=2).collect()] == [["unique"]]
    pairs = spark.createDataFrame([("x", None)] * 5 + [(None, "x")] * 3, "p string, q string")
    sizes = privacy.class_sizes(pairs, [("p", "q")]).first()
    assert (sizes["rows"], sizes["classes"], sizes["min_class_size"], sizes["rows_below_k"]) == (8, 2, 3, 3)
    assert privacy.minimal_quasi_identifiers(planted.limit(0)).count() == 0
