"""The Merkle manifest against a plain tree, and its edge cases."""

import random

import pytest

from fieldwarden.llm import merkle
from tests.llm import plain

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def corpus(sizes, seed=1):
    draw = random.Random(seed)
    langs = [lang for lang, n in sizes.items() for _ in range(n)]
    draw.shuffle(langs)
    texts = (None, "", "É Ünï", "Plain Text", "lower only", "A" * 3000)
    return [(i * 7 - 40, draw.choice((None, "s", "web ß")), lang, draw.choice((None, 0, i)), draw.choice(texts)) for i, lang in enumerate(langs)]


def found(spark, rows, climb=merkle.CLIMB):
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return merkle.manifest(table, climb).collect()


@pytest.mark.parametrize(
    "sizes",
    [{"en": 1}, {"en": 8}, {"en": 9, None: 1}, {"en": 700, "de": 65, "fr": 64, None: 63, "": 1, "es": 513}, {f"l{i}": 1 + i % 3 for i in range(70)}],
)
def test_every_row_equals_a_plain_tree(spark, sizes):
    rows = corpus(sizes)
    want = plain.merkle(rows)
    got = found(spark, rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"]) == want[r["doc_id"]]
        assert r["verified"] == (r["folded_root"] == r["root"])
    assert {r["verified"] for r in got} == ({True, False} if len(rows) > 100 else {r["verified"] for r in got})


def test_several_rounds_of_blocks(spark):
    rows = corpus({"en": 600, "de": 9, None: 72})
    want = plain.merkle(rows)
    assert {r["doc_id"]: (r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"]) for r in found(spark, rows, 1)} == want


def test_repeated_and_null_ids(spark):
    row = (5, "s", "en", 3, "Abc")
    got = found(spark, [row] * 20 + [(None, None, None, None, None)] * 3 + [(5, "s", "en", 3, "other")])
    assert len(got) == 24 and len({r["root"] for r in got}) == 1
    assert len({r["leaf"] for r in got}) == 3
    assert all(r["verified"] for r in got if r["doc_id"] is None)


def test_empty_table_and_clashing_columns(spark):
    table = spark.createDataFrame(corpus({"en": 30}), SCHEMA).selectExpr("*", "1 as tree", "2 as idx", "3 as digest", "4 as block", "5 as n", "6 as _at")
    assert merkle.manifest(table).count() == 30
    assert merkle.manifest(table.limit(0)).count() == 0


def test_a_task_never_holds_more_than_a_block():
    grown = merkle.forward([(i, f"{i:064d}") for i in range(512)], 3)
    assert [len(level) for level in grown] == [512, 64, 8, 1]
    proofs = dict(merkle.backward(grown, ()))
    assert all(merkle.folded(f"{i:064d}", proofs[i]) == grown[-1][0] for i in (0, 77, 511))
