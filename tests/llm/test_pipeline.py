"""Every stage of the pipeline against a plain version of it on the stage's own input."""

import corpus_pipeline
from fieldwarden.llm import queries, toxicity
from fieldwarden.llm.shared import stored
from tests.llm import plain

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = queries.table(spark, SF, "documents")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, SF), "test")
        seen.append((name, docs, after))
        docs = after
    assert [n for n, _, _ in seen] == ["toxicity", "near-duplicates", "substring-dedup", "decontamination", "bpe"]
    assert all(a.columns == columns for _, _, a in seen[:-1])
    texts = [({r["doc_id"]: r["text"] for r in b.collect()}, a) for _, b, a in seen]
    kept = lambda a: {r["doc_id"] for r in a.select("doc_id").collect()}

    before, after = texts[0]
    scored = toxicity.score(seen[0][1], queries.table(spark, SF, "labels")).collect()
    assert kept(after) == {r["doc_id"] for r in scored if r["score"] < 0.5}

    before, after = texts[1]
    assert kept(after) == set(plain.near_components(before).values())

    before, after = texts[2]
    cut = plain.without_repeats(before)
    want = {i: " ".join(k) if len(k) < len(ws) else before[i] for i, (ws, k) in cut.items()}
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in after.collect()} == {i: (t, len(t)) for i, t in want.items()}

    before, after = texts[3]
    items = {r["item_id"]: r["text"] for r in queries.table(spark, SF, "benchmark").collect()}
    assert kept(after) == {i for i, found in plain.contaminated(before, items).items() if not found[1]}

    before, after = texts[4]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary())
    for r in after.collect():
        ids = library.encode(before[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == library.decode(ids, skip_special_tokens=False)
