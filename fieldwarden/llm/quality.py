"""Quality scores: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

1. One pass over the texts gives each document's statistics (byte classes, words, lines, repetition).
2. Means and deviations over all documents standardise them; random Fourier features (cosines of random projections)
   approximate a Gaussian kernel.
3. Labelled rows outside the held-out fold, a bounded sample, are summed to normal equations in each partition; the
   sums are added and solved for ridge weights.
4. Raw scores of labelled rows kept out of the fit are counted in bins and calibrated by isotonic regression.

Null and empty texts have zero statistics and are scored like any other. Rows without label or id teach nothing; with no
labelled rows every score is 0.5. Repeated rows get equal scores. Extra columns are ignored; empty tables are fine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwarden.llm import calibrate, wordhash
from fieldwarden.llm.shared import bound_text_batches, slices_by_bytes, stored, text_buffer

#: Bound of the labelled rows used for the fit and the calibration.
EXAMPLES = 100_000
FEATURES, RIDGE = 256, 1.0
_CLASSES = (
    [*range(65, 91)],  # upper case
    [*range(97, 123)],  # lower case
    [*range(48, 58)],  # digits
    [10],  # line ends
    [32, 9],  # blanks
    [44, 46],  # commas, full stops
    [33, 63],  # exclamation and question marks
    [124, 60, 62, 123, 125, 91, 93],  # table and markup signs
    [35, 36, 37, 38, 42, 43, 61, 64, 94, 126],  # symbols
    [47, 58, 95, 92],  # parts of links and paths
    [39, 34, 40, 41, 45, 59, 96],  # other marks
    [*range(128, 256)],  # bytes of non-ASCII characters
)
STATISTICS = len(_CLASSES) + 10


def _distinct(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row, and the count of the most frequent one."""
    order = np.lexsort((hashes, rows))
    r, h = rows[order], hashes[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    first = np.flatnonzero(new)
    most = np.zeros(n)
    np.maximum.at(most, r[first], np.diff(first, append=len(h)))
    return np.bincount(r[first], minlength=n), most


_LINE = np.ones(256, bool)
_LINE[10] = False


def statistics(column: pa.Array) -> np.ndarray:
    """The statistics of each text, one row each."""
    data, offsets = text_buffer(column)
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    of_byte = np.zeros(256, np.int64)
    for k, members in enumerate(_CLASSES, 1):
        of_byte[members] = k
    row = np.repeat(np.arange(n), sizes)
    width = len(_CLASSES) + 1
    shares = np.bincount(row * width + of_byte[data], minlength=n * width).reshape(n, width)[:, 1:] / np.maximum(sizes, 1)[:, None]
    starts, ends, at = wordhash.words(data, offsets)
    words = np.diff(at)
    of_word = np.repeat(np.arange(n), words)
    lens = ends - starts
    mean = np.bincount(of_word, lens, minlength=n) / np.maximum(words, 1)
    spread = np.sqrt(np.maximum(np.bincount(of_word, lens.astype(float) ** 2, minlength=n) / np.maximum(words, 1) - mean**2, 0))
    distinct, most = _distinct(of_word, wordhash.word_hashes(data, starts, ends), n)
    marked = np.bincount(of_word, (of_byte[data[ends - 1]] >= 8) & (of_byte[data[ends - 1]] <= 9), minlength=n) if len(ends) else np.zeros(n)
    ls, le, lat = wordhash.words(data, offsets, _LINE)
    lines = np.diff(lat)
    kinds, most_line = _distinct(np.repeat(np.arange(n), lines), wordhash.word_hashes(data, ls, le), n)
    return np.column_stack([
        shares,
        np.log1p(sizes),
        np.log1p(words),
        mean,
        spread,
        distinct / np.maximum(words, 1),
        most / np.maximum(words, 1),
        marked / np.maximum(words, 1),
        np.log1p(lines),
        kinds / np.maximum(lines, 1),
        most_line / np.maximum(lines, 1),
    ]).astype(np.float64)


def document_statistics(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, stats`` for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices_by_bytes(batch, "body"):
                found = statistics(part.column("body")).astype(np.float32)
                offsets = pa.array(np.arange(0, found.size + 1, STATISTICS, dtype=np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "stats"])

    bound_text_batches(docs.sparkSession)
    given = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("body"))
    return given.mapInArrow(run, "doc_id long, stats array<float>")


class FourierMap:
    """Standardised statistics to random Fourier features of a Gaussian kernel, with a constant and the linear terms."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int = FEATURES, seed: int = 11):
        draw = np.random.default_rng(seed)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.directions = draw.normal(0, 1 / np.sqrt(len(mean)), (len(mean), features))
        self.phases = draw.uniform(0, 2 * np.pi, features)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.deviation, -6, 6)
        waves = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.column_stack([np.ones(len(z)), z / len(self.mean), waves])


def _stats_of(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS).astype(np.float64)


def _moments(stats: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of every statistic over all documents."""
    at = [F.col("stats")[k].cast("double") for k in range(STATISTICS)]
    row = stats.agg(*(F.avg(a) for a in at), *(F.stddev_pop(a) for a in at)).first()
    values = np.array([v if v is not None else 0.0 for v in row], float)
    return values[:STATISTICS], values[STATISTICS:]


def _normal_equations(rows: DataFrame, features: FourierMap) -> tuple[np.ndarray, np.ndarray]:
    """Sums of x x' and x y: added in each partition, then entry by entry over the partitions."""
    size = 1 + STATISTICS + FEATURES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            x = features(_stats_of(batch))
            total[:, :-1] += x.T @ x
            total[:, -1] += x.T @ batch.column("label").to_numpy()
        i, j = np.divmod(np.arange(total.size), size + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())], ["i", "j", "v"])

    # the rows are a bounded sample, so a few partitions hold them
    sums = rows.coalesce(16).mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    table = np.zeros((size, size + 1))
    table[sums.column("i").to_numpy(), sums.column("j").to_numpy()] = sums.column("v").to_numpy()
    return table[:, :-1], table[:, -1]


def score(
    docs: DataFrame, labels: DataFrame, label: str = "quality", id_column: str = "doc_id", text: str = "text", bound: int = EXAMPLES
) -> DataFrame:
    """``doc_id, score, raw`` for every row of ``docs``; ``labels`` holds ``doc_id`` and the 0/1 ``label``."""
    spark = docs.sparkSession
    stats = stored(document_statistics(docs, id_column, text), "statistics")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 5
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label"))
    named = named.filter("doc_id is not null and label is not null").filter(remainder != 0)
    named = named.groupBy("doc_id").agg(F.max("label").alias("label"))
    share = int(1_000_000 * min(1.0, bound / max(named.count(), 1)))
    named = named.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share).limit(2 * bound)
    known = stored(stats.join(F.broadcast(named), "doc_id").withColumn("aside", remainder == 4), "labelled")
    features = FourierMap(*_moments(stats))
    learned = known.filter("not aside")
    if learned.limit(1).count():
        square, product = _normal_equations(learned, features)
        weights = np.linalg.solve(square + RIDGE * np.eye(len(square)), product)
    else:
        weights = np.zeros(1 + STATISTICS + FEATURES)
    fitted = spark.sparkContext.broadcast((features, weights))

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, w = fitted.value
        for batch in batches:
            names = [n for n in batch.schema.names if n != "stats"]
            value = np.clip(own(_stats_of(batch)) @ w, 0, 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(value)], [*names, "raw"])

    aside = known.filter("aside").select("label", "stats").mapInArrow(raw, "label double, raw double")
    binned = aside.withColumn("bin", F.least(F.floor(F.col("raw") * calibrate.BINS), F.lit(calibrate.BINS - 1)))
    counts = binned.groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("y")).collect()
    rows_in, labels_in = np.zeros(calibrate.BINS), np.zeros(calibrate.BINS)
    for r in counts:
        rows_in[r["bin"]], labels_in[r["bin"]] = r["n"], r["y"]
    levels = F.array(*[F.lit(float(v)) for v in calibrate.isotonic(rows_in, labels_in)])
    scored = stats.mapInArrow(raw, "doc_id long, raw double")
    place = F.least(F.floor(F.col("raw") * calibrate.BINS), F.lit(calibrate.BINS - 1)).cast("int")
    return scored.select("doc_id", F.element_at(levels, place + 1).alias("score"), "raw")
