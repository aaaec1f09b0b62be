"""Repeated passages removed with a compacted De Bruijn graph of token k-mers.

Each window of 13 words is an edge of the graph. Windows that also start in a document with a smaller id are removed,
word by word. The steps:

1. Exact copies of a text are set aside with the smallest id; all their windows repeat, so copies never enter the graph.
2. Minimizers: the least of the eight 6-word hashes in a window. Equal windows have equal minimizers, and one minimizer
   serves about four windows, so counting minimizers is the cheap first look at what can repeat at all.
3. Windows with a repeated minimizer become edge occurrences. Grouping them gives the repeated edges: source (smallest
   document and place there), occurrences, and two fingerprints of the sets of places and of the places before.
4. An edge continues its predecessor's path where both occur equally often and the fingerprints say that one always
   follows the other (no branch, no end in between). Such paths are compacted along their source coordinates.
5. Only path heads are joined with the occurrences: one row for each occurrence of a whole path.
6. The last pass reads the texts again, checks every span against the source's windows by an independent hash, and
   drops the covered words.

Words are runs outside ASCII white space, unchanged. Null texts have no words; texts of fewer than 13 words have no
window. Rows without id are no source and stay as they are. Repeated rows share an id, so neither is smaller; rows that
repeat an id with another text are judged by their own text. Extra columns are ignored; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldwarden.llm import wordhash
from fieldwarden.llm.shared import bound_text_batches, broadcast_if_small, carrying, record_batch, slices_by_bytes, stored, text_buffer, with_carried

WINDOW = 13
SEED_WORDS = 6
#: Up to so many repeated minimizers go to the tasks as a bit filter (16 bits each); more are joined to the documents.
FILTER_ENTRIES = 6_000_000
_PROBES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


class _Windows:
    """Windows of a text column: hash and minimizer of each, and the range of each row."""

    def __init__(self, column: pa.Array, check: bool = False):
        data, offsets = text_buffer(column)
        self.data = data
        self.starts, self.ends, self.at = wordhash.words(data, offsets)
        hashes = wordhash.word_hashes(data, self.starts, self.ends)
        self.hash = wordhash.window_hashes(hashes, WINDOW)
        least = wordhash.window_hashes(hashes, SEED_WORDS)
        for step in (1, 2, 4):
            least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
        self.least = least
        if check:
            other = wordhash.word_hashes(data, self.starts, self.ends, lane=1)
            self.check = (wordhash.window_hashes(other, WINDOW) >> np.uint64(33)).astype(np.int64)

    def rows(self, i: int) -> tuple[int, int]:
        a, b = int(self.at[i]), int(self.at[i + 1])
        return a, max(a, b - WINDOW + 1)


def _minimizers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices_by_bytes(batch, "body"):
            seen = _Windows(part.column("body"))
            own = [np.unique(seen.least[slice(*seen.rows(i))]) for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64))], ["seed"])


def _probes(seeds: np.ndarray, bits: int) -> list[np.ndarray]:
    shift = np.uint64(64 - bits)
    return [(seeds * np.uint64(p)) >> shift for p in _PROBES]


def _filter_bits(seeds: DataFrame, entries: int) -> tuple[bytes, int]:
    """The bit filter over ``seeds``: words of 64 bits, made by the executors; at most 16 MB reach the driver."""
    bits = max(16, int(16 * entries).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("seed").to_numpy().view(np.uint64)
            at = np.unique(np.concatenate(_probes(own, bits)))
            word = (at >> np.uint64(6)).astype(np.int64)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(first) else at
            yield pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array(value.view(np.int64))], ["word", "value"])

    rows = seeds.mapInArrow(run, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[rows.column("word").to_numpy()] = rows.column("value").to_numpy().view(np.uint64)
    return table.tobytes(), bits


def _occurrences(given: DataFrame, seeds: DataFrame) -> DataFrame:
    """``h, check, doc_id, pos`` of every window whose minimizer is repeated (and of a few others)."""
    schema = "h long, check long, doc_id long, pos int"
    entries = seeds.count()

    def rows(part: pa.RecordBatch, wanted) -> pa.RecordBatch:
        seen = _Windows(part.column("body"), check=True)
        n = len(seen.hash)
        row = np.full(n, -1)
        for i in range(part.num_rows):
            row[slice(*seen.rows(i))] = i
        at = np.flatnonzero((row >= 0) & wanted(seen, row))
        row = row[at]
        ids = part.column("doc_id").to_numpy(zero_copy_only=False)[row] if len(row) else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(seen.hash[at].view(np.int64)),
                pa.array(seen.check[at]),
                pa.array(ids.astype(np.int64)),
                pa.array((at - seen.at[row]).astype(np.int32)),
            ],
            ["h", "check", "doc_id", "pos"],
        )

    if entries <= FILTER_ENTRIES:
        table, bits = _filter_bits(seeds, entries)
        shared = given.sparkSession.sparkContext.broadcast(table)

        def by_filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = np.frombuffer(shared.value, np.uint64)

            def wanted(seen: _Windows, row: np.ndarray) -> np.ndarray:
                new = np.flatnonzero(np.diff(seen.least, prepend=~seen.least[:1]))
                hit = np.ones(len(new), bool)
                for p in _probes(seen.least[new], bits):
                    hit &= (words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) > 0
                return np.repeat(hit, np.diff(new, append=len(seen.least)))

            for batch in batches:
                for part in slices_by_bytes(batch, "body"):
                    yield rows(part, wanted)

        return given.mapInArrow(by_filter, schema)

    def by_list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices_by_bytes(batch, "body"):
                lists = part.column("seeds")

                def wanted(seen: _Windows, row: np.ndarray, lists=lists) -> np.ndarray:
                    hit = np.zeros(len(row), bool)
                    for i in range(len(lists)):
                        own = slice(*seen.rows(i))
                        hit[own] = np.isin(seen.least[own].view(np.int64), lists[i].values.to_numpy())
                    return hit

                yield rows(part, wanted)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices_by_bytes(batch, "body"):
                seen = _Windows(part.column("body"))
                own = [np.unique(seen.least[slice(*seen.rows(i))]).view(np.int64) for i in range(part.num_rows)]
                ids = np.repeat(part.column("doc_id").to_numpy(), [len(o) for o in own])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(own))], ["doc_id", "seed"])

    held = given.mapInArrow(listed, "doc_id long, seed long").join(seeds, "seed")
    lists = held.groupBy("doc_id").agg(F.collect_set("seed").alias("seeds"))
    return given.join(lists, "doc_id").mapInArrow(by_list, schema)


def _paths(found: DataFrame) -> DataFrame:
    """Heads of the compacted repeated paths: ``h, src_doc, src_pos, len, check_sum``."""
    place = lambda shift: F.sum(F.hash("doc_id", F.col("pos") - shift).cast("long"))
    edges = (
        found.groupBy("h")
        .agg(
            F.min("doc_id").alias("src_doc"),
            F.max("doc_id").alias("last_doc"),
            F.min_by("pos", "doc_id").alias("src_pos"),
            F.min_by("check", "doc_id").alias("check"),
            F.count("*").alias("n"),
            place(0).alias("places"),
            place(1).alias("places_before"),
        )
        .filter("src_doc < last_doc")
        .drop("last_doc")
    )
    along = Window.partitionBy("src_doc").orderBy("src_pos", "h")
    before = lambda c: F.lag(c).over(along)
    goes_on = (
        (before("src_pos") == F.col("src_pos") - 1)
        & (before("n") == F.col("n"))
        & (before("places") == F.col("places_before"))
    )
    marked = edges.withColumn("head", F.when(goes_on, 0).otherwise(1)).withColumn("path", F.sum("head").over(along))
    return marked.groupBy("src_doc", "path").agg(
        F.max(F.when(F.col("head") == 1, F.col("h"))).alias("h"),
        F.min("src_pos").alias("src_pos"),
        F.count("*").cast("int").alias("len"),
        F.sum("check").alias("check_sum"),
    )


def repeated_spans(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, pos, len, src_doc, src_pos, check_sum``: runs of ``len`` windows that repeat an earlier document's.

    Exact copies of a text are represented by the smallest id; see ``copies``. Null ids are left out.
    """
    bound_text_batches(docs.sparkSession)
    given = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("body"))
    given = given.filter("doc_id is not null and body is not null")
    counts = given.mapInArrow(_minimizers, "seed long").groupBy("seed").agg(F.count("*").alias("n"))
    seeds = stored(counts.filter("n > 1").select("seed"), "seeds")
    found = stored(_occurrences(given, seeds), "windows")
    heads = stored(_paths(found), "paths")
    occur = found.select("h", "doc_id", "pos").join(broadcast_if_small(heads), "h").filter("doc_id > src_doc")
    return occur.select("doc_id", "pos", "len", "src_doc", "src_pos", "check_sum")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices_by_bytes(batch, "body"):
            spans, copied = part.column("spans").to_pylist(), part.column("copied").to_pylist()
            seen = _Windows(part.column("body"), check=any(spans))
            counts, gone, texts = [], [], []
            for i in range(part.num_rows):
                a, b = int(seen.at[i]), int(seen.at[i + 1])
                drop = np.zeros(b - a + 1, np.int64)
                windows = seen.rows(i)[1] - a
                if copied[i]:
                    drop[0] += windows > 0
                elif spans[i]:
                    upto = np.concatenate([[0], np.cumsum(seen.check[a : a + windows])])
                    for s in spans[i]:
                        end = s["pos"] + s["len"]
                        if end <= windows and upto[end] - upto[s["pos"]] == s["check_sum"]:
                            drop[s["pos"]] += 1
                            drop[min(end + WINDOW - 1, b - a)] -= 1
                kept = np.flatnonzero(np.cumsum(drop[:-1]) <= 0) + a
                counts.append(b - a)
                gone.append(b - a - len(kept))
                pieces = zip(seen.starts[kept].tolist(), seen.ends[kept].tolist(), strict=True)
                raw = seen.data[seen.starts[a] : seen.ends[b - 1]].tobytes() if b > a else b""
                base = int(seen.starts[a]) if b > a else 0
                texts.append(b" ".join([raw[x - base : y - base] for x, y in pieces]).decode())
            found = {
                "doc_id": part.column("doc_id"),
                "n_words": pa.array(counts, pa.int64()),
                "n_removed": pa.array(gone, pa.int64()),
                "kept": pa.array(texts, pa.string()),
            }
            yield record_batch(part, found)


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` (the kept words joined by one space), one row for each row of ``docs``.

    Columns named in ``carry`` come back in the struct ``carried``.
    """
    bound_text_batches(docs.sparkSession)
    whole = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("body"), *carrying(docs, carry)
    )
    given = whole.select("doc_id", "body")
    same = [F.xxhash64("body").alias("h"), F.hash("body").alias("h2"), F.length("body").alias("l")]
    hashed = stored(given.filter("doc_id is not null and body is not null").select("doc_id", *same), "texts")
    firsts = hashed.groupBy("h", "h2", "l").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    groups = firsts.filter("first_id < last_id").drop("last_id")
    copies = hashed.join(groups, ["h", "h2", "l"]).filter("doc_id > first_id").select("doc_id", "h").distinct()
    copies = broadcast_if_small(stored(copies, "copies"))
    spans = given.withColumn("h", F.xxhash64("body"))
    spans = stored(repeated_spans(spans.join(copies, ["doc_id", "h"], "left_anti"), "doc_id", "body"), "spans")
    by_doc = spans.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "len", "check_sum")).alias("spans"))
    marked = whole.withColumn("h", F.xxhash64("body")).join(copies.withColumn("copied", F.lit(True)), ["doc_id", "h"], "left").join(by_doc, "doc_id", "left")
    held = ["carried"] if carry else []
    marked = marked.select("doc_id", "body", "spans", F.coalesce("copied", F.lit(False)).alias("copied"), *held)
    return marked.mapInArrow(_cut, with_carried("doc_id long, n_words long, n_removed long, kept string", marked))
