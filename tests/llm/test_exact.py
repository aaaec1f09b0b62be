"""Operators with one right answer against plain versions, on texts made to repeat and to nearly repeat."""

import random

import pytest

from fieldwarden.llm import bpe, debruijn, decontaminate, minhash
from fieldwarden.llm.queries import vocabulary
from tests.llm import plain


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)


def test_minhash_finds_every_component(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 40)
    monkeypatch.setattr(minhash, "GROUP", 25)
    draw = random.Random(5)
    word = lambda: f"w{draw.randrange(20_000)}"
    docs, passage = {}, [word() for _ in range(60)]
    for family in range(12):
        base = [word() for _ in range(draw.choice((6, 40, 120)))]
        for _ in range(25):
            copy = list(base)
            for _ in range(draw.randrange(1 + len(base) // 20)):
                copy[draw.randrange(len(copy))] = word()
            docs[len(docs) * 3 % 1009] = " ".join(copy).title() if family % 2 else " ".join(copy)
    for _ in range(80):
        docs[len(docs) * 3 % 1009] = " ".join([*passage, *(word() for _ in range(draw.randrange(10, 40)))])
    want = plain.near_components(docs)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(frame(spark, docs)).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(plain.shingles(docs[i])) and r["kept"] == (want[i] == i) for i, r in got.items())


@pytest.mark.parametrize("others", [(None,), (None, "", " \t"), ("one of a kind {} and nothing like it anywhere", None)])
def test_repeated_ids_lend_each_other_nothing(spark, monkeypatch, others):
    monkeypatch.setattr(minhash, "TILE", 40)
    draw = random.Random(3)
    passage = [f"p{i}" for i in range(60)]
    docs = {i: " ".join([*passage, *(f"w{draw.randrange(10**6)}" for _ in range(20))]) for i in range(80)}
    docs |= {100 + i: docs[i] + " end" for i in range(0, 80, 4)}
    want = plain.near_components(docs)
    more = [(i, o.format(i) if o else o) for i in docs for o in others]
    table = spark.createDataFrame(list(docs.items()) + more, "doc_id long, text string").repartition(4)
    got = minhash.near_duplicates(table).collect()
    assert len(got) == len(docs) + len(more)
    sizes = {i: len(plain.shingles(t)) for i, t in docs.items()}
    assert {r["doc_id"]: r["component_id"] for r in got if r["n_shingles"] == sizes[r["doc_id"]]} == want
    assert all(r["component_id"] == r["doc_id"] and r["kept"] for r in got if r["n_shingles"] != sizes[r["doc_id"]])


def test_one_id_with_a_third_of_the_rows(spark):
    rows = [(7, f"text number {i} says {i * 31} things about {i * 17} others") for i in range(200)] + [(7, "same words in the same order again")] * 200
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == 400 and {r["component_id"] for r in got} == {7} and all(r["kept"] for r in got)


def repeating(seed, n=120, kinds=40):
    draw = random.Random(seed)
    word = lambda: f"v{draw.randrange(kinds)}"
    pool = [[word() for _ in range(draw.randrange(8, 60))] for _ in range(8)]
    docs = {}
    for i in range(n):
        parts = [draw.choice(pool) if draw.random() < 0.5 else [word() for _ in range(draw.randrange(20))] for _ in range(draw.randrange(5))]
        ws = [w for p in parts for w in (p if draw.random() < 0.7 else p[draw.randrange(len(p) + 1) :])]
        docs[i * 7 % 997] = draw.choice((" ", "\n", " \t ")).join(ws)
    return docs


@pytest.mark.parametrize("entries", [10**6, 0])
@pytest.mark.parametrize("kinds", [2, 40])
def test_repeats_are_cut(spark, monkeypatch, entries, kinds):
    monkeypatch.setattr(debruijn, "FILTER_ENTRIES", entries)
    docs = repeating(kinds, kinds=kinds)
    want = plain.without_repeats(docs)
    for r in debruijn.remove_repeats(frame(spark, docs)).collect():
        words, kept = want[r["doc_id"]]
        assert (r["n_words"], r["n_removed"], r["kept"]) == (len(words), len(words) - len(kept), " ".join(kept))


@pytest.mark.parametrize("rows", [10**6, 7])
def test_contamination(spark, monkeypatch, rows):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
    docs = repeating(3, n=60, kinds=6)
    draw = random.Random(9)
    texts = [docs[draw.choice(list(docs))].split()[a : a + n] for a, n in ((0, 1), (1, 2), (2, 3), (0, 9), (0, 10), (3, 25), (0, 40))]
    items = {i: " ".join(t).upper() + "!" for i, t in enumerate(texts)} | {90: None, 91: "...", 10: " ".join(texts[5])}
    want = plain.contaminated(docs, items)
    table = spark.createDataFrame(list(items.items()), "item_id long, text string")
    for r in decontaminate.contamination(frame(spark, docs), table).collect():
        assert (r["n_words"], r["n_hit"], r["item_ids"]) == want[r["doc_id"]]


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    library.no_padding()
    library.no_truncation()
    draw = random.Random(2)
    signs = "aaabcdehilnorstABÉéßΣσçÇ '.,!?%$0123456789\n\t漢字한글 é​\U0001f600Ᲊİı"
    docs = {i: "".join(draw.choice(signs) for _ in range(draw.randrange(200))) for i in range(300)}
    docs |= {900: "aaaaaaaaaaaaaaa don't we'll <|endoftext|>x<|startoftext|>", 901: "ΑΣ ΟΔΟΣ", 902: "z" * 3000}
    for r in bpe.decode(bpe.encode(frame(spark, docs), vocabulary()), vocabulary()).collect():
        ids = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)
