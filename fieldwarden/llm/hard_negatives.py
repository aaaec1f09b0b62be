"""Hard negatives by exact integer scores: Strassen products of anchor and candidate tiles, then mergeable heaps.

A vector component x becomes floor(256 * x); a score is the integer inner product of two such vectors. For each anchor the
first positives (other rows of its label) are found, then, for each positive, the first rows of other labels whose score
lies in a window set by the positive's: ``30 * p <= 100 * s <= 90 * p``. Higher scores come first, ties by smaller id.

1. The anchors are a stated query set. They go out in groups of bounded bytes (``ANCHOR_BYTES``), each as a broadcast
   variable; every group meets every row of the table, in the task that reads the row. No row is shuffled, nothing is
   joined, and a label or a group of copies with a third of all rows is as many tiles as its rows need.
2. A task multiplies a block of anchors with a tile of candidates by Strassen's recursion over int64 matrices; odd sides
   are padded with zeros. Integer additions are exact, so the result does not depend on the order of the sums.
3. A task keeps one bounded heap for each anchor (``positives`` rows) or for each anchor and positive (``negatives``
   rows). Heaps are sorted arrays that merge; what leaves a task is one row for each anchor that it has rows for. Those
   are dealt by anchor and merged once more.

Rows with a null id, label or vector, or with a null or non-finite component, take no part. Vectors of other lengths are
padded with zeros; an empty vector scores 0. Components so large that scores might leave the range of a long
(``floor(256 * x)`` above the square root of 2^63 over the longest length) count as non-finite. Repeated rows are rows of
their own, but rows that share an anchor's id are neither positives nor negatives of it; repeated anchors get repeated
results. Extra columns are ignored. An empty table, or one without anchors, gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwarden.llm.shared import stored

#: Bytes of anchor vectors in one broadcast.
ANCHOR_BYTES = 32 << 20
#: Anchors and candidates of one product.
ANCHOR_TILE, CANDIDATE_TILE = 256, 1024
#: Sides up to which matrices are multiplied directly.
LEAF = 32
#: Bounds of the window in hundredths of the positive's score.
LOW, HIGH = 30, 90
LEAST = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` for integer matrices by seven half-sized products; odd sides are padded with zeros."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= LEAF:
        return a @ b
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    h, i, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    p1 = strassen(a11 + a22, b11 + b22)
    p2 = strassen(a21 + a22, b11)
    p3 = strassen(a11, b12 - b22)
    p4 = strassen(a22, b21 - b11)
    p5 = strassen(a11 + a12, b22)
    p6 = strassen(a21 - a11, b11 + b12)
    p7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * h, 2 * j), p1.dtype)
    out[:h, :j] = p1 + p4 - p5 + p7
    out[:h, j:] = p3 + p5
    out[h:, :j] = p2 + p4
    out[h:, j:] = p1 - p2 + p3 + p6
    return out[:m, :n]


class Heaps:
    """The first ``size`` (score, id) entries of each slot: higher scores first, ties by smaller id."""

    def __init__(self, slots: int, size: int):
        self.size = size
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        #: Score of the last entry of a full slot; lower ones cannot enter.
        self.floor = np.full(slots, LEAST)

    def merge(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, ids = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        place = np.arange(len(slot)) - np.repeat(starts, np.diff(np.r_[starts, len(slot)]))
        kept = place < self.size
        self.slot, self.score, self.id = slot[kept], score[kept], ids[kept]
        last = place[kept] == self.size - 1
        self.floor[self.slot[last]] = self.score[last]

    def offer(self, first_slot: int, step: int, scores: np.ndarray, ids: np.ndarray, able: np.ndarray) -> None:
        """Entries of a tile where ``able``; row r of the tile belongs to slot ``first_slot + step * r``."""
        rows = first_slot + step * np.arange(len(scores))
        able = able & (scores >= self.floor[rows][:, None])
        crowded = np.flatnonzero(able.sum(1) > self.size)
        if len(crowded):
            # only what is not below the size-th best of its own row can enter
            seen = np.where(able[crowded], scores[crowded], LEAST)
            able[crowded] &= scores[crowded] >= np.partition(seen, -self.size, axis=1)[:, [-self.size]]
        r, c = np.nonzero(able)
        self.merge(rows[r], scores[r, c], ids[c])

    def rows(self) -> Iterator[tuple[int, list[int], list[int]]]:
        starts = np.flatnonzero(np.r_[True, self.slot[1:] != self.slot[:-1]]) if len(self.slot) else np.zeros(0, int)
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(self.slot)], strict=False):
            yield int(self.slot[a]), self.score[a:b].tolist(), self.id[a:b].tolist()


def integers(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of ``width`` integers, shorter lists padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


ENTRIES = "slot long, scores array<long>, ids array<long>"


def _entry_batches(heaps: Heaps, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def out() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays(
            [pa.array([h[k] for h in held], t) for k, t in enumerate(kinds)], ["slot", "scores", "ids"]
        )

    for row in heaps.rows():
        held.append(row)
        if len(held) == size:
            yield out()
            held = []
    yield out()


def _searched(sent, positives: int, negatives: int | None):
    """A task's heaps: of positives where ``negatives`` is None, else of negatives in the windows of the positives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, matrix, lows, highs = sent.value
        heaps = Heaps(len(ids) * (positives if negatives else 1), negatives or positives)
        for batch in batches:
            own, label = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label"))
            rows = integers(batch.column("q"), matrix.shape[1])
            for c in range(0, len(own), CANDIDATE_TILE):
                tile = np.ascontiguousarray(rows[c : c + CANDIDATE_TILE].T)
                their, marks = own[c : c + CANDIDATE_TILE], label[c : c + CANDIDATE_TILE]
                for a in range(0, len(ids), ANCHOR_TILE):
                    b = a + ANCHOR_TILE
                    scores = strassen(matrix[a:b], tile)
                    other = their != ids[a:b, None]
                    alike = marks == labels[a:b, None]
                    if not negatives:
                        heaps.offer(a, 1, scores, their, other & alike)
                        continue
                    for p in range(positives):
                        inside = (scores >= lows[a:b, p, None]) & (scores <= highs[a:b, p, None])
                        heaps.offer(a * positives + p, positives, scores, their, other & ~alike & inside)
        yield from _entry_batches(heaps)

    return run


def _merged(size: int):
    """Heaps of the same slot, brought together by Spark, as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[int, int] = {}
        heaps = Heaps(0, size)
        for batch in batches:
            slots = [names.setdefault(s, len(names)) for s in batch.column("slot").to_pylist()]
            heaps.floor = np.concatenate([heaps.floor, np.full(len(names) - len(heaps.floor), LEAST)])
            lengths = batch.column("ids").value_lengths().to_numpy(zero_copy_only=False)
            heaps.merge(
                np.repeat(np.array(slots, np.int64), lengths),
                batch.column("scores").flatten().to_numpy(zero_copy_only=False),
                batch.column("ids").flatten().to_numpy(zero_copy_only=False),
            )
        back = list(names)
        for batch in _entry_batches(heaps):
            yield batch.set_column(0, "slot", pa.array([back[s] for s in batch.column(0).to_pylist()], pa.int64()))

    return run


def _best(rows: DataFrame, sent, positives: int, negatives: int | None) -> DataFrame:
    found = rows.mapInArrow(_searched(sent, positives, negatives), ENTRIES)
    return found.repartition("slot").mapInArrow(_merged(negatives or positives), ENTRIES)


def mine(
    vectors: DataFrame,
    anchors: Column | str,
    id_column: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    positives: int = 5,
    negatives: int = 10,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows where ``anchors`` (a column or SQL) holds.

    ``rank`` counts from 1 among the negatives that are returned for an anchor and a positive.
    """
    spark = vectors.sparkSession
    asked = F.expr(anchors) if isinstance(anchors, str) else anchors
    scaled = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * 256))
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    given = vectors.filter(F.col(id_column).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & finite)
    width = given.agg(F.max(F.size(vector))).first()[0]
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if width is None:
        return spark.createDataFrame([], schema)
    largest = math.isqrt((2**63 - 1) // max(width, 1))
    fits = ~F.exists(vector, lambda x: F.abs(x.cast("double") * 256) >= float(largest))
    rows = given.filter(fits).select(
        F.col(id_column).cast("long").alias("id"), F.col(label).cast("long").alias("label"), scaled.cast("array<long>").alias("q"), asked.alias("_anchor")
    )
    queries = stored(rows.filter("_anchor").drop("_anchor"), "anchors")
    groups = max(1, -(-queries.count() * max(width, 1) * 8 // ANCHOR_BYTES))
    rows = rows.drop("_anchor")
    found = None
    for g in range(groups):
        held = queries.filter(F.pmod(F.xxhash64("id", "q"), F.lit(groups)) == g).toArrow()
        if not held.num_rows:
            continue
        ids, labels = (held.column(c).to_numpy() for c in ("id", "label"))
        matrix = integers(held.column("q"), width)
        first = _best(rows, spark.sparkContext.broadcast((ids, labels, matrix, None, None)), positives, None).toArrow()
        # a score that no row reaches where an anchor has fewer positives
        lows = np.full((len(ids), positives), np.iinfo(np.int64).max)
        highs = np.full((len(ids), positives), LEAST)
        pairs = []
        for slot, scores, theirs in zip(*(first.column(c).to_pylist() for c in ("slot", "scores", "ids")), strict=True):
            for p, (score, their) in enumerate(zip(scores, theirs, strict=True)):
                lows[slot, p], highs[slot, p] = -(-LOW * score // 100), HIGH * score // 100
                pairs.append((slot * positives + p, int(ids[slot]), their, score))
        if not pairs:
            continue
        names = ["slot", "anchor_id", "positive_id", "positive_score"]
        known = spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in zip(*pairs, strict=True)], names))
        best = _best(rows, spark.sparkContext.broadcast((ids, labels, matrix, lows, highs)), positives, negatives)
        one = best.join(known, "slot").select(
            "anchor_id",
            "positive_id",
            F.posexplode(F.arrays_zip("ids", "scores")).alias("at", "x"),
            "positive_score",
        )
        one = stored(
            one.select(
                "anchor_id",
                "positive_id",
                (F.col("at") + 1).cast("int").alias("rank"),
                F.col("x.ids").alias("negative_id"),
                "positive_score",
                F.col("x.scores").alias("negative_score"),
            ),
            "negatives",
        )
        found = one if found is None else found.union(one)
    return spark.createDataFrame([], schema) if found is None else found
