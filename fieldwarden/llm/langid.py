"""Language identification with hyperdimensional profiles.

Every letter has a random vector of signs. An n-gram's vector binds its letters: the vectors, rotated by their place, are
multiplied. A text's vector bundles (adds) the vectors of its n-grams; a language's prototype bundles the unit vectors of
its training texts, from which the mean prototype is taken off so that what all languages share does not count. A text
belongs to the language whose prototype has the largest cosine with it.

Letters are lower-cased; anything else is one blank between words. Null texts and texts without letters give ``und`` and
score 0. Rows without language or id teach nothing; without any training row every text is ``und``. Ties go to the
language first by name. Repeated rows get equal results; extra columns are ignored; empty tables are fine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwarden.llm.shared import bound_text_batches, broadcast_if_small, slices_by_bytes, stored

#: Bound of the training texts; with more, those with the smallest hash share are used.
EXAMPLES = 30_000
DIMENSIONS, GRAM = 512, 3
#: Sharpness of the score: the share of the best language in a softmax over cosines.
SHARPNESS = 12.0
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() if not 0xD800 <= c <= 0xDFFF else False for c in range(0x110000)])


def _sign_vectors(codes: np.ndarray) -> np.ndarray:
    """The fixed random sign vector of each letter code."""
    return np.array([np.random.default_rng(int(c)).integers(0, 2, DIMENSIONS) * 2 - 1 for c in codes], np.int8).reshape(-1, DIMENSIONS)


class Profiles:
    """N-gram vectors of the texts seen by a task; the table starts anew beyond ``most`` n-grams."""

    def __init__(self, most: int = 60_000):
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.letters = np.zeros(0, np.int64)
        self.signs = np.zeros((0, DIMENSIONS), np.int8)
        self.grams = np.zeros(0, np.int64)
        self.vectors = np.zeros((0, DIMENSIONS), np.float32)

    def _learn(self, grams: np.ndarray) -> None:
        if len(self.grams) > self.most:
            self._clear()
        fresh = np.setdiff1d(grams, self.grams, assume_unique=True)
        if not len(fresh):
            return
        codes = [(fresh >> (21 * k)) & 0x1FFFFF for k in (2, 1, 0)]
        new = np.setdiff1d(np.unique(np.concatenate(codes)), self.letters, assume_unique=True)
        letters = np.concatenate([self.letters, new])
        signs = np.concatenate([self.signs, _sign_vectors(new)])
        order = np.argsort(letters)
        self.letters, self.signs = letters[order], signs[order]
        bound = np.ones((len(fresh), DIMENSIONS), np.int8)
        for turn, code in zip((2, 1, 0), codes, strict=True):
            bound *= np.roll(self.signs, turn, axis=1)[np.searchsorted(self.letters, code)]
        grams = np.concatenate([self.grams, fresh])
        vectors = np.concatenate([self.vectors, bound.astype(np.float32)])
        order = np.argsort(grams)
        self.grams, self.vectors = grams[order], vectors[order]

    def bundles(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The unit vector of every text (zero without n-grams), and whether it holds a letter."""
        joined = " \n ".join((t or "").lower() for t in texts) + " "
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        row = np.cumsum(codes == 10)
        inner = [(t or "").count("\n") for t in texts]
        of_line = np.repeat(np.arange(len(texts)), np.array(inner, np.int64) + 1)
        row = of_line[row]
        letter = _letters()[codes]
        has = np.bincount(row[letter], minlength=len(texts)) > 0
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[0] = True
        codes, row = np.where(letter, codes, 0)[keep], row[keep]
        if len(codes) < GRAM:
            return np.zeros((len(texts), DIMENSIONS), np.float32), has
        gram = codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:]
        held = codes[1:-1] > 0
        gram, row = gram[held], row[1:-1][held]
        kinds, which = np.unique(gram, return_inverse=True)
        self._learn(kinds)
        pair, count = np.unique(row * len(kinds) + which, return_counts=True)
        row, which = np.divmod(pair, max(len(kinds), 1))
        at = np.searchsorted(self.grams, kinds)[which]
        cut = np.searchsorted(row, np.arange(len(texts) + 1))
        total = np.zeros((len(texts), DIMENSIONS), np.float32)
        weight = count.astype(np.float32)
        for i in np.flatnonzero(np.diff(cut)).tolist():
            own = slice(cut[i], cut[i + 1])
            total[i] = weight[own] @ self.vectors[at[own]]
        return total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9), has


def prototypes(docs: DataFrame, bound: int = EXAMPLES) -> tuple[list[str], np.ndarray]:
    """Languages in order of name and their centred unit prototypes, from ``doc_id, body, lang``.

    The rows that teach are at most about ``bound``, shared out by language, so that a rare language keeps all of its rows.
    """
    wanted = docs.filter("doc_id is not null and lang is not null")
    wanted = wanted.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    shares = stored(wanted.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    own = bound / max(shares.count(), 1)
    shares = shares.select(F.col("lang").alias("_lang"), F.least(F.lit(1.0), F.lit(own) / F.col("n")).alias("_share"))
    # a row for each language: texts stay where they are
    wanted = wanted.join(broadcast_if_small(stored(shares, "shares")), F.col("lang") == F.col("_lang"))
    wanted = wanted.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < 1_000_000 * F.col("_share")).select("body", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = Profiles(), {}
        for batch in batches:
            for part in slices_by_bytes(batch, "body"):
                vectors, _ = own.bundles(part.column("body").to_pylist())
                langs = np.array(part.column("lang").to_pylist())
                for lang in np.unique(langs):
                    sums[lang] = sums.get(lang, 0) + vectors[langs == lang].sum(0, dtype=np.float64)
        names = np.repeat(list(sums), DIMENSIONS) if sums else []
        values = np.concatenate(list(sums.values())) if sums else np.zeros(0)
        place = np.tile(np.arange(DIMENSIONS, dtype=np.int32), len(sums))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(place), pa.array(values)], ["lang", "place", "value"])

    summed = wanted.mapInArrow(run, "lang string, place int, value double").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    rows = summed.collect()  # languages times dimensions
    langs = sorted({r["lang"] for r in rows})
    table = np.zeros((len(langs), DIMENSIONS))
    at = {lang: i for i, lang in enumerate(langs)}
    for r in rows:
        table[at[r["lang"]], r["place"]] = r["value"]
    table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)
    if len(langs) > 1:
        table -= table.mean(0)
        table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)
    return langs, table.astype(np.float32)


def identify(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang", bound: int = EXAMPLES) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row of ``docs``."""
    bound_text_batches(docs.sparkSession)
    given = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("body"), F.col(lang).cast("string").alias("lang")
    )
    fitted = given.sparkSession.sparkContext.broadcast(prototypes(given, bound))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = fitted.value
        own = Profiles()
        names = np.array([*langs, UNKNOWN], object)
        for batch in batches:
            for part in slices_by_bytes(batch, "body"):
                vectors, has = own.bundles(part.column("body").to_pylist())
                best, score = np.full(part.num_rows, len(langs)), np.zeros(part.num_rows)
                if langs:
                    cosine = (vectors @ table.T).astype(np.float64)
                    share = np.exp(SHARPNESS * (cosine - cosine.max(1, keepdims=True)))
                    best = np.where(has, cosine.argmax(1), len(langs))
                    score = np.where(has, share.max(1) / share.sum(1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(names[best].tolist(), pa.string()), pa.array(score)],
                    ["doc_id", "lang_pred", "score"],
                )

    return given.select("doc_id", "body").mapInArrow(run, "doc_id long, lang_pred string, score double")
