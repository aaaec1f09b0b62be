"""Hard negatives against a plain search in Python integers, and their edge cases."""

import math
import random

import numpy as np
import pytest

from fieldwarden.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"
ANCHOR = "vec_id % 4 = 0"


def plain(rows, positives=5, negatives=10):
    real = [r for r in rows if None not in r and not any(x is None or not math.isfinite(x) for x in r[1])]
    real = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in real]
    out = []
    for i, v, label in real:
        if i % 4:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, other) for j, w, other in real if j != i]
        for p, positive, _ in sorted(s for s in scored if s[2] == label)[:positives]:
            inside = sorted(s for s in scored if s[2] != label and 30 * -p <= 100 * -s[0] <= 90 * -p)
            out += [(i, positive, k, j, -p, -s) for k, (s, j, _) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, **more):
    got = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA).repartition(5), ANCHOR, **more)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def vectors(n, width, labels, seed):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    near = lambda: [x + draw.gauss(0, 0.6) for x in draw.choice(centres)]
    return [(i * 3 - 50, near(), draw.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("n, width, labels", [(300, 7, 3), (120, 70, 4), (60, 1, 2), (40, 3, 1)])
def test_equals_a_plain_search(spark, n, width, labels):
    rows = vectors(n, width, labels, n)
    want = plain(rows)
    assert mined(spark, rows) == want
    assert want or labels == 1


def test_groups_of_anchors_and_copies(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHOR_BYTES", 9 * 8 * 8)
    rows = vectors(150, 9, 3, 1)
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(60)] + [(2000 + i, rows[0][1], 7) for i in range(60)]
    rows += [(3000 + i, [x * 0.7 for x in rows[0][1]], 8) for i in range(30)]
    assert mined(spark, rows) == plain(rows)


def test_rows_without_part(spark):
    rows = vectors(80, 5, 2, 2)
    odd = [(4, None, 1), (8, [1.0, None, 1.0, 1.0, 1.0], 1), (12, [math.nan] * 5, 0), (16, [math.inf] * 5, 0), (20, [9.0] * 5, None), (None, [1.0] * 5, 0)]
    huge = [(24, [3e30] * 5, 0)]
    shorter = [(28, [2.0, 2.0], 0), (32, [], 1), (36, [0.0] * 5, 1)]
    taken = [r for r in rows if r[0] not in (4, 8, 12, 16, 20, 24, 28, 32, 36)]
    assert mined(spark, taken + odd + huge + shorter) == plain([*taken, (28, [2.0, 2.0, 0, 0, 0], 0), (32, [0.0] * 5, 1), (36, [0.0] * 5, 1)])


def test_empty_and_clashing(spark):
    table = spark.createDataFrame(vectors(60, 4, 2, 3), SCHEMA).selectExpr("*", "1 as id", "2 as q", "3 as slot", "4 as _anchor")
    assert hard_negatives.mine(table, ANCHOR).count() > 0
    assert hard_negatives.mine(table.limit(0), ANCHOR).count() == 0
    assert hard_negatives.mine(table, "false").count() == 0


def test_repeated_rows_stand_for_themselves(spark):
    rows = [(0, [4.0, 4.0], 0), (0, [4.0, 4.0], 0), (1, [4.0, 4.0], 0), (2, [2.0, 2.0], 1), (2, [2.0, 2.0], 1)]
    got = mined(spark, rows)
    assert [r[:4] for r in got] == [(0, 1, 1, 2)] * 2 + [(0, 1, 2, 2)] * 2


@pytest.mark.parametrize("shape", [(1, 1, 1), (65, 64, 70), (33, 129, 257), (100, 40, 0)])
def test_strassen_is_exact(shape):
    m, k, n = shape
    draw = np.random.default_rng(1)
    a, b = draw.integers(-(2**28), 2**28, (m, k)), draw.integers(-(2**28), 2**28, (k, n))
    assert np.array_equal(hard_negatives.strassen(a, b), a @ b)
