"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

1. Labelled examples are a bounded sample, chosen by a hash of the id. Terms are runs of letters (A-Z folded)
   and their stems; those that a likelihood-ratio test ties to the toxic label make the vocabulary.
2. Inverse document frequencies of the vocabulary are counted over all documents.
3. Each example's postings go to blocks of neighbouring examples with the largest weight of each term in the block. For
   a document, the blocks' upper bounds are visited in descending order and scored exactly until no further block can
   reach the k-th neighbour, so the neighbours are those of a full search.
4. Neighbours vote with their similarity; the vote is calibrated on labelled rows kept out of the index.

A document with no vocabulary term (null, empty or unrelated text) is equally far from all examples; the examples
without such a term vote for it. Ties go to the smaller example id. Repeated rows get equal results. Rows without label
or id teach nothing. With no labelled rows at all every score is 0.5 by definition of the calibration; an empty table
gives an empty table. Extra columns are ignored. Texts are whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwarden.llm import calibrate, wordhash
from fieldwarden.llm.shared import bound_text_batches, carrying, record_batch, slices_by_bytes, stored, text_buffer, with_carried

#: Bound of the labelled examples; with more labelled rows, those with the smallest hash share are used.
EXAMPLES = 20_000
#: Bound of the vocabulary, and the least likelihood ratio (natural units), toxic examples and toxic share of a term.
TERMS, LEAST_RATIO, LEAST_EXAMPLES, LEAST_SHARE = 4096, 15.0, 4, 0.5
NEIGHBOURS, BLOCK = 24, 64
#: Lengths in bytes of the stems.
STEMS = (4, 5)
#: Weight of the prior vote.
PRIOR = 0.5
#: Neighbours shown as evidence.
EVIDENCE = 5


def term_counts(column: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term hash and count of every distinct term of each text, or of the ``wanted`` terms (sorted) only.

    Terms are the words and the stems of longer words, so that inflected forms meet.
    """
    data, offsets = text_buffer(column)
    starts, ends, at = wordhash.words(data, offsets, wordhash.LETTERS)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    maybe = None
    if wanted is not None:
        maybe = np.zeros(1 << 16, bool)
        maybe[wanted.view(np.uint64) >> np.uint64(48)] = True
    terms, row = [], []
    for stem in (0, *STEMS):
        longer = np.flatnonzero(ends - starts > stem) if stem else np.arange(len(starts))
        stop = starts[longer] + stem if stem else ends
        own = wordhash.word_hashes(data, starts[longer], stop, lower=True)
        own = wordhash.mixed(own + np.uint64(stem))
        if wanted is not None:
            some = np.flatnonzero(maybe[own >> np.uint64(48)])
            some = some[np.isin(own[some].view(np.int64), wanted)]
            own, longer = own[some], longer[some]
        terms.append(own)
        row.append(rows[longer])
    terms, row = np.concatenate(terms), np.concatenate(row)
    order = np.lexsort((terms, row))
    terms, row = terms[order], row[order]
    new = np.ones(len(terms), bool)
    new[1:] = (terms[1:] != terms[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    return row[first], terms[first].view(np.int64), np.diff(first, append=len(terms))


class BlockMaxIndex:
    """Inverted index over sparse unit vectors with the largest weight of each term in each block of examples."""

    def __init__(self, ids: np.ndarray, toxic: np.ndarray, row: np.ndarray, term: np.ndarray, count: np.ndarray, idf: np.ndarray):
        weight = (1 + np.log(np.maximum(count, 1))) * idf[term]
        norm = np.sqrt(np.bincount(row, weight**2, minlength=len(ids)))
        held = norm > 0
        self.zero_rows, self.zero_toxic = int((~held).sum()), int(toxic[~held].sum())
        # examples with the same strongest term lie together, which makes the block bounds tight
        strongest = np.full(len(ids), -1)
        best = np.lexsort((weight, row))
        strongest[row[best]] = term[best]
        order = [i for i in np.lexsort((ids, strongest)) if held[i]]
        place = np.full(len(ids), -1)
        place[order] = np.arange(len(order))
        self.ids, self.toxic = ids[order], toxic[order]
        self.blocks = -(-len(order) // BLOCK)
        by = np.lexsort((place[row], term))
        self.at, self.term = place[row[by]], term[by]
        self.weight = (weight / np.where(held, norm, 1)[row])[by]
        self.first = np.searchsorted(self.term, np.arange(len(idf) + 1))
        self.most = np.zeros((len(idf), self.blocks), np.float64)
        np.maximum.at(self.most, (self.term, self.at // BLOCK), self.weight)
        self.idf = idf

    def nearest(self, term: np.ndarray, count: np.ndarray, k: int = NEIGHBOURS) -> list[tuple[float, int, int]]:
        """The ``k`` best (similarity, id, label), exactly; ties to the smaller id."""
        query = (1 + np.log(count)) * self.idf[term]
        query = query / np.sqrt((query**2).sum())
        bound = query @ self.most[term]
        found: list[tuple[float, int, int]] = []
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or (len(found) == k and round(float(bound[b]), 9) < -found[-1][0]):
                break
            score = np.zeros(BLOCK)
            for t, q in zip(term.tolist(), query.tolist(), strict=True):
                own = slice(self.first[t], self.first[t + 1])
                x, y = np.searchsorted(self.at[own], (b * BLOCK, (b + 1) * BLOCK)) + self.first[t]
                score[self.at[x:y] - b * BLOCK] += q * self.weight[x:y]
            for i in np.flatnonzero(score > 0).tolist():
                j = b * BLOCK + i
                found.append((-round(float(score[i]), 9), int(self.ids[j]), int(self.toxic[j])))
            found = sorted(found)[:k]
        return [(-s, i, y) for s, i, y in found]

    def vote(self, near: list[tuple[float, int, int]]) -> float:
        """The distance-weighted share of toxic neighbours; with none, the share among unrelated examples."""
        if not near:
            return (self.zero_toxic + PRIOR) / (self.zero_rows + 2 * PRIOR)
        return (sum(s * y for s, _, y in near) + PRIOR * 0.5) / (sum(s for s, _, _ in near) + PRIOR)


class _Scorer:
    """Votes for texts, with one table of results for texts of equal term counts."""

    def __init__(self, vocabulary: np.ndarray, index: BlockMaxIndex):
        self.order = np.argsort(vocabulary)
        self.sorted, self.index, self.known = vocabulary[self.order], index, {}

    def batch(self, column: pa.Array) -> list[tuple[float, list[tuple[float, int, int]]]]:
        row, term, count = term_counts(column, self.sorted)
        term = self.order[np.searchsorted(self.sorted, term)]
        cut = np.searchsorted(row, np.arange(len(column) + 1))
        if len(self.known) > 50_000:
            self.known = {}
        out = []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            key = (term[a:b].tobytes(), count[a:b].tobytes())
            if key not in self.known:
                near = self.index.nearest(term[a:b], count[a:b]) if b > a else []
                self.known[key] = (self.index.vote(near), near)
            out.append(self.known[key])
        return out


def _examples(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """``doc_id, toxic, aside, terms, counts`` of the bounded sample of labelled rows outside the held-out fold."""
    remainder = F.crc32(F.col("doc_id").cast("string")) % 5
    wanted = labels.filter("doc_id is not null and toxic is not null").filter(remainder != 0)
    wanted = wanted.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    total = wanted.count()
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, bound / max(total, 1)))
    wanted = wanted.filter(share).limit(2 * bound).withColumn("aside", remainder == 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices_by_bytes(batch, "body"):
                row, term, count = term_counts(part.column("body"))
                cut = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x)) for x in (term, count.astype(np.int32))]
                names = ["doc_id", "toxic", "aside"]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *lists], [*names, "terms", "counts"])

    named = docs.join(F.broadcast(wanted), "doc_id")
    return stored(named.mapInArrow(run, "doc_id long, toxic int, aside boolean, terms array<long>, counts array<int>"), "examples")


def _vocabulary(examples: DataFrame) -> np.ndarray:
    """Terms that the toxic label favours by a likelihood-ratio test, strongest first."""
    learned = examples.filter("not aside")
    n, n_toxic = learned.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n_toxic or n == n_toxic:
        return np.zeros(0, np.int64)
    counts = learned.select("toxic", F.explode("terms").alias("term")).groupBy("term")
    counts = counts.agg(F.sum("toxic").cast("double").alias("x"), F.count("*").cast("double").alias("m"))
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    rate, x, m = n_toxic / n, F.col("x"), F.col("m")
    rest, others = F.lit(float(n_toxic)) - x, F.lit(float(n - n_toxic)) - (m - x)
    ratio = part(x, m * rate) + part(m - x, m * (1 - rate)) + part(rest, (n - m) * rate) + part(others, (n - m) * (1 - rate))
    favoured = counts.filter((x >= LEAST_EXAMPLES) & (x >= LEAST_SHARE * m) & (x > m * rate)).withColumn("ratio", ratio)
    rows = favoured.filter(F.col("ratio") >= LEAST_RATIO).orderBy(F.desc("ratio"), "term").limit(TERMS).select("term").collect()
    return np.array([r[0] for r in rows], np.int64)


def _document_frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many of all documents each term occurs, and the number of documents."""
    order = np.argsort(vocabulary)
    held = vocabulary[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(len(held) + 1, np.int64), 0
        for batch in batches:
            for part in slices_by_bytes(batch, "body"):
                _, term, _ = term_counts(part.column("body"), held)
                total += np.bincount(np.searchsorted(held, term), minlength=len(total))
                rows += part.num_rows
        total[-1] = rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

    sums = docs.select("body").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    count = np.zeros(len(held) + 1, np.int64)
    for r in sums:
        count[r["term"]] = r["n"]
    df = np.zeros(len(held), np.int64)
    df[order] = count[:-1]
    return df, int(count[-1])


def fit(docs: DataFrame, labels: DataFrame, bound: int = EXAMPLES) -> tuple[np.ndarray, BlockMaxIndex, np.ndarray]:
    """Vocabulary, index and calibration; the driver holds the vocabulary terms of the bounded sample only."""
    examples = _examples(docs, labels, bound)
    vocabulary = _vocabulary(examples)
    df, n = _document_frequencies(docs, vocabulary)
    idf = np.log((n + 1) / (df + 1)) + 1
    kept = F.array_intersect("terms", F.array(*[F.lit(int(t)) for t in vocabulary]).cast("array<long>"))
    rows = examples.select(
        "doc_id", "toxic", "aside", F.transform(kept, lambda t: F.struct(t.alias("t"), F.element_at("counts", F.array_position("terms", t).cast("int")).alias("c"))).alias("v")
    ).orderBy("doc_id").collect()
    place = {int(t): i for i, t in enumerate(vocabulary)}

    def sparse(some: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = [(i, place[e["t"]], e["c"]) for i, r in enumerate(some) for e in r["v"]]
        return tuple(np.array(c, np.int64) for c in (zip(*flat, strict=True) if flat else ((), (), ())))

    learned, aside = [r for r in rows if not r["aside"]], [r for r in rows if r["aside"]]
    index = BlockMaxIndex(np.array([r["doc_id"] for r in learned], np.int64), np.array([r["toxic"] for r in learned], np.int64), *sparse(learned), idf)
    row, term, count = sparse(aside)
    cut = np.searchsorted(row, np.arange(len(aside) + 1))
    votes = [index.vote(index.nearest(term[a:b], count[a:b]) if b > a else []) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    bins = calibrate.bin_of(np.array(votes))
    rows_in = np.bincount(bins, minlength=calibrate.BINS)
    toxic_in = np.bincount(bins, np.array([r["toxic"] for r in aside], float), minlength=calibrate.BINS)
    return vocabulary, index, calibrate.isotonic(rows_in, toxic_in)


def score(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    bound: int = EXAMPLES,
    carry: Sequence[str] = (),
    learn_from: DataFrame | None = None,
) -> DataFrame:
    """``doc_id, score, evidence`` for every row of ``docs``; evidence lists the nearest examples, nearest first.

    Columns named in ``carry`` come back in the struct ``carried``. Examples come from ``learn_from`` (``docs`` if none).
    """
    bound_text_batches(docs.sparkSession)
    named = [F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("body")]
    given = docs.select(*named, *carrying(docs, carry))
    taught = given.select("doc_id", "body") if learn_from is None else learn_from.select(*named)
    fitted = given.sparkSession.sparkContext.broadcast(fit(taught, labels, bound))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, index, levels = fitted.value
        scorer = _Scorer(vocabulary, index)
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))
        for batch in batches:
            for part in slices_by_bytes(batch, "body"):
                found = scorer.batch(part.column("body"))
                shown = [[{"doc_id": i, "similarity": s, "toxic": y} for s, i, y in near[:EVIDENCE]] for _, near in found]
                scores = levels[calibrate.bin_of(np.array([v for v, _ in found]))]
                found_columns = {"doc_id": part.column("doc_id"), "score": pa.array(scores), "evidence": pa.array(shown, kind)}
                yield record_batch(part, found_columns)

    schema = "doc_id long, score double, evidence array<struct<doc_id:long,similarity:double,toxic:int>>"
    return given.mapInArrow(run, with_carried(schema, given))
