"""Nulls, empty and very long texts, repeated rows, empty tables and clashing column names, for every operator."""

import pytest
from pyspark.sql import functions as F

from fieldwarden.llm import bpe, chat_format, debruijn, decontaminate, html_text, langid, minhash, nn_descent, quality, toxicity
from fieldwarden.llm.queries import vocabulary

LONG = " ".join(f"word{i % 997}" for i in range(60_000))
EXTRA = "body string, ids int, score string, h int, tag string, carried int, component int, keys int, label int, stats int"
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away from here", "en"),
    (1, "the quick brown fox jumps over the lazy dog and runs far away from here", "en"),
    (1, "another text of the same id", None),
    (2, None, "en"),
    (3, "", "de"),
    (4, " \n\t ", None),
    (5, "one", "en"),
    (None, "the quick brown fox jumps over the lazy dog and runs far away from here", "en"),
    (None, None, None),
    (6, "the quick brown fox jumps over the lazy dog and runs far away from here", "fr"),
    (7, LONG, "en"),
    (8, LONG + " end", "en"),
    (9, "ÄÖ é ß 漢字 \U0001f600 <|endoftext|> % $ 12 \x00 x", "de"),
]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").repartition(3)
    return plain.select("*", *(F.lit(None).cast(e.split()[1]).alias(e.split()[0]) for e in EXTRA.split(", ")))


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in range(10)] + [(None, 1, 1), (3, None, None), (4, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def by_id(df, *columns):
    return sorted(([r["doc_id"], *(r[c] for c in columns)] for r in df.collect()), key=str)


def items(spark):
    rows = [(1, "quick brown fox"), (2, None), (None, "lazy dog"), (3, "far"), (3, "far"), (4, "")]
    return spark.createDataFrame(rows, "item_id long, text string")


RUNS = {
    "bpe": lambda d, spark, labels: bpe.decode(bpe.encode(d, vocabulary()), vocabulary()),
    "round_trip": lambda d, spark, labels: bpe.round_trip(d, vocabulary()),
    "quality": lambda d, spark, labels: quality.score(d, labels),
    "toxicity": lambda d, spark, labels: toxicity.score(d, labels),
    "langid": lambda d, spark, labels: langid.identify(d),
    "minhash": lambda d, spark, labels: minhash.near_duplicates(d),
    "debruijn": lambda d, spark, labels: debruijn.remove_repeats(d),
    "decontaminate": lambda d, spark, labels: decontaminate.contamination(d, items(spark)),
}


@pytest.mark.parametrize("name", RUNS)
def test_every_row_gets_a_row(spark, docs, labels, name):
    got = by_id(RUNS[name](docs, spark, labels))
    assert got == sorted(([r[0]] for r in ROWS), key=str)


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(spark, docs, labels, name):
    assert RUNS[name](docs.limit(0), spark, labels).count() == 0


@pytest.mark.parametrize("name", ["quality", "toxicity"])
def test_without_labels_scores_are_a_half(docs, spark, labels, name):
    got = RUNS[name](docs, spark, labels.limit(0))
    assert {r["score"] for r in got.collect()} == {0.5}


def test_null_and_repeated_rows(spark, docs, labels):
    found = by_id(minhash.near_duplicates(docs), "n_shingles", "component_id", "kept")
    assert [None, 0, None, True] in found and [None, 11, None, True] in found
    assert found.count([1, 11, 1, True]) == 2 and [1, 2, 1, True] in found and [6, 11, 1, False] in found
    assert [2, 0, 2, True] in found and [4, 0, 4, True] in found and [5, 1, 5, True] in found
    assert [7, 997, 7, True] in found and [8, 998, 7, False] in found
    cut = by_id(debruijn.remove_repeats(docs), "n_words", "n_removed")
    assert cut.count([1, 15, 0]) == 2 and [6, 15, 15] in cut and [None, 15, 0] in cut and [8, 60_001, 60_000] in cut
    hit = by_id(decontaminate.contamination(docs, items(spark)), "n_words", "n_hit", "item_ids")
    assert hit.count([1, 15, 4, ["1", "3"]]) == 2 and [2, 0, 0, []] in hit and [None, 15, 4, ["1", "3"]] in hit
    langs = by_id(langid.identify(docs), "lang_pred", "score")
    assert [2, "und", 0.0] in langs and [3, "und", 0.0] in langs and [None, "und", 0.0] in langs
    ids = by_id(bpe.encode(docs, vocabulary()), "ids")
    assert [2, []] in ids and [3, []] in ids


def test_benchmark_without_items(spark, docs):
    got = decontaminate.contamination(docs, items(spark).limit(0))
    assert got.count() == len(ROWS) and got.filter("n_hit > 0").count() == 0


def test_chat_edges(spark):
    schema = "pair_id long, side string, turn long, role string, text string, prompt string, n int"
    rows = [
        (1, "chosen", 0, "user", "hi", "x", 1), (1, "rejected", 0, "user", "hi", "x", 1),
        (1, "chosen", 1, "assistant", None, "x", 1), (1, "rejected", 1, None, "no", "x", 1),
        (2, "chosen", 0, "user", "alone", None, None),
        (None, "chosen", 0, "user", "lost", None, None), (3, None, 0, "user", "lost", None, None),
        (4, "chosen", 0, "a", "t", None, None), (4, "chosen", 0, "a", "t", None, None),
        (4, "rejected", None, "a", "t", None, None),
    ]
    turns = spark.createDataFrame(rows, schema)
    got = {r["pair_id"]: r for r in chat_format.preference_format(turns).collect()}
    assert set(got) == {1, 2, 4}
    assert got[1]["n_prompt_turns"] == 1 and got[1]["prompt"] == "<|im_start|>user\nhi<|im_end|>\n"
    assert got[1]["chosen"] == "<|im_start|>assistant\n<|im_end|>\n" and got[1]["rejected"] == "<|im_start|>\nno<|im_end|>\n"
    assert [tuple(s) for s in got[1]["chosen_spans"]] == [(22, 22)] and got[1]["rejected_spans"] == []
    assert got[2]["rejected"] == "" and got[2]["n_prompt_turns"] == 0
    assert got[4]["n_prompt_turns"] == 1 and got[4]["rejected"] == ""
    assert chat_format.preference_format(turns.limit(0)).count() == 0


def test_pages_edges(spark):
    schema = "page_id long, url string, html string, text string, body string"
    page = "<nav><a href=x>Menu</a></nav><article><h1>T</h1><p>Some body text, long enough.</p></article><footer>f</footer>"
    rows = [(1, "u", page, "a", "b"), (1, "u", page, "a", "b"), (2, None, None, None, None), (None, "v", "", None, None)]
    rows += [(3, "w", "<p>unclosed <b>bold & raw < 5", None, None), (4, "z", "<article>" + "<p>word</p>" * 5000, None, None)]
    pages = spark.createDataFrame(rows, schema)
    got = sorted(html_text.main_text(pages).collect(), key=str)
    assert len(got) == 6
    texts = {r["page_id"]: r["text"] for r in got}
    assert texts[1] == "T\nSome body text, long enough." and texts[2] == "" and texts[None] == ""
    assert texts[4].count("word") == 5000
    assert html_text.main_text(pages.limit(0)).count() == 0
    alone = html_text.main_text(pages.filter("page_id = 3")).first()["text"]
    assert alone == "unclosed bold & raw < 5"


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, float(i)], "x") for i in range(30)] + [(40, None, "x"), (41, [nan, 1.0], "x"), (42, [inf, 1.0], "x")]
    rows += [(43, [0.0, 0.0], "x"), (44, [None, 1.0], "x"), (45, [1.0], "x"), (None, [1.0, 1.0], "x"), (29, [1.0, 29.0], "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node string")
    got = nn_descent.neighbours(table, table.filter("vec_id in (0, 20, 40, 43)").select("vec_id"), k=3).collect()
    best = {q: [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 20)}
    assert {r["query_id"] for r in got} == {0, 20}
    assert best[20] == [(29, 581.0), (28, 561.0), (27, 541.0)]
    assert best[0] == [(1, 1.0), (2, 1.0), (3, 1.0)]
    assert nn_descent.neighbours(table.limit(0), table.limit(0).select("vec_id")).count() == 0
