"""Near-duplicate documents: one-permutation MinHash with optimal densification, banded buckets, star candidates.

Words are runs outside ASCII white space with A-Z folded; a document's set holds its distinct five-word shingles (with
fewer words, the whole sequence is the only one). Documents are linked where 100 * intersection >= 75 * union; the
component of a document is named by the smallest id reachable over links.

1. Rows with equal sets are one class, so copies never become pairs. A class is known by a number of its own and by the
   text of its row with the smallest id; rows that share an id with other texts are in other classes.
2. One hash of each shingle fills 128 bins with their least value; an empty bin borrows from the bin that its own
   fixed random sequence meets first. 32 bands of 4 bins give bucket keys: a pair at similarity 0.75 shares no bucket
   with a chance of 5e-6 (5e-5 for sets of four shingles), and less above.
3. A bucket yields edges from its smallest class to the others only. Edges are confirmed on full sets: first one edge for
   each document, then those that would still join two components.
4. Members of a bucket that still lie in several components were not all compared with each other. Such buckets are
   cut into tiles of bounded size; in a tile, members of different components whose signatures agree in 74 of 128 bins
   (4.4 standard deviations below what similarity 0.75 gives) are compared on full sets; where one of them has at most
   64 shingles, whose bins depend on each other, they are compared in any case. Only links leave a tile.
5. A row finds its class over a join that is salted by the row's place, so a class with a third of all rows is spread.

Null text, empty text and text without words have an empty set and link with nothing. Rows without id link with
nothing, have no component and are kept. Repeated rows get equal results; rows that repeat an id with another text are
judged by their own text. Texts are whole. Extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwarden.llm import wordhash
from fieldwarden.llm.components import components
from fieldwarden.llm.shared import bound_text_batches, broadcast_if_small, carrying, record_batch, slices_by_bytes, stored, text_buffer, with_carried

SHINGLE = 5
BINS, BANDS = 128, 32
PERCENT = 75
#: Documents compared with one centre by one task; more are spread over copies of the centre.
GROUP = 1000
#: Members of a bucket in one part; a tile compares two parts.
TILE = 500
#: Bins in which two signatures must agree before full sets are compared: 0.75 less 4.4 standard deviations.
ALIKE_BINS = 74
#: Sets up to this size are compared without a look at the signatures.
SMALL_SET = 64
#: Parts of the rows of one class in the join that names its component.
SALTS = 64
_TRIES = np.random.default_rng(7).integers(0, BINS, (BINS, 4 * BINS))


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = text_buffer(column)
    starts, ends, at = wordhash.words(data, offsets)
    hashes = wordhash.word_hashes(data, starts, ends, lower=True)
    windows = wordhash.window_hashes(hashes, size)
    found = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= size:
            found.append(np.unique(windows[a : b - size + 1]))
        else:
            whole = wordhash.window_hashes(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64)
            found.append(wordhash.mixed(whole + np.uint64(b - a)))
    return found


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Densified one-permutation signatures of non-empty sorted sets: the top bits choose the bin."""
    width = np.uint64(64 - BINS.bit_length() + 1)
    edges = np.arange(BINS, dtype=np.uint64) << width
    values = np.zeros((len(sets), BINS), np.uint64)
    full = np.zeros((len(sets), BINS), bool)
    for i, s in enumerate(sets):
        at = np.searchsorted(s, edges)
        full[i] = np.diff(at, append=len(s)) > 0
        values[i] = s[np.minimum(at, len(s) - 1)]
    row, column = np.nonzero(~full)
    for k in range(_TRIES.shape[1]):
        if not len(row):
            return values
        lender = _TRIES[column, k]
        able = full[row, lender]
        values[row[able], column[able]] = values[row[able], lender[able]]
        row, column = row[~able], column[~able]
    for i, j in zip(row.tolist(), column.tolist(), strict=True):
        values[i, j] = values[i, (j + int(np.argmax(np.roll(full[i], -j)))) % BINS]
    return values


def band_keys(values: np.ndarray) -> np.ndarray:
    rows = BINS // BANDS
    split = values.reshape(len(values), BANDS, rows)
    total = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(rows):
        total = wordhash.mixed(total + split[:, :, k])
    return total.view(np.int64)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices_by_bytes(batch, "body"):
            sets = shingle_sets(part.column("body"))
            one = [int(s.sum().view(np.int64)) if len(s) else 0 for s in sets]
            two = [int(wordhash.mixed(s ^ np.uint64(0x5BF03635)).sum().view(np.int64)) if len(s) else 0 for s in sets]
            held = [i for i, s in enumerate(sets) if len(s)]
            keys: list[np.ndarray | None] = [None] * len(sets)
            for i, k in zip(held, band_keys(signatures([sets[i] for i in held])), strict=True):
                keys[i] = k
            found = {
                "doc_id": part.column("doc_id"),
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "d1": pa.array(one, pa.int64()),
                "d2": pa.array(two, pa.int64()),
                "keys": pa.array(keys, pa.list_(pa.int64())),
                "tag": part.column("tag"),
                "salt": pa.array([i % SALTS for i in range(len(sets))], pa.int32()),
            }
            yield record_batch(part, found)


def _sets_for_roles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each group that a document takes part in, with its set as bytes."""
    for batch in batches:
        for part in slices_by_bytes(batch, "body"):
            sets = [s.tobytes() for s in shingle_sets(part.column("body"))]
            ids, roles = part.column("node").to_pylist(), part.column("roles").to_pylist()
            rows = [(r["a"], r["salt"], r["centre"], i, s) for i, s, own in zip(ids, sets, roles, strict=True) for r in own]
            columns = list(zip(*rows, strict=True)) if rows else [(), (), (), (), ()]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            for at in range(0, len(rows), 512):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[at : at + 512], t) for c, t in zip(columns, kinds, strict=True)],
                    ["a", "salt", "centre", "b", "held"],
                )


def _near(one: np.ndarray, two: np.ndarray) -> bool:
    if not len(one) or not len(two) or min(len(one), len(two)) * 100 < PERCENT * max(len(one), len(two)):
        return False
    at = np.searchsorted(one, two)
    both = int((one[np.minimum(at, len(one) - 1)] == two).sum())
    return 100 * both >= PERCENT * (len(one) + len(two) - both)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group, centres first; members near a centre of their group are returned."""
    group, centres = None, []
    for batch in batches:
        kept: list[tuple[int, int]] = []
        held = batch.column("held")
        rows = zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "centre", "b")), strict=True)
        for i, (a, salt, centre, b) in enumerate(rows):
            own = np.frombuffer(held[i].as_buffer(), np.uint64)
            if (a, salt) != group:
                group, centres = (a, salt), []
            if centre == 0:
                centres.append(own.copy())
            elif any(_near(c, own) for c in centres):
                kept.append((a, b))
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.int64())], ["a", "b"]
        )


def _with_roles(docs: DataFrame, classes: DataFrame, roles: DataFrame, name: str) -> DataFrame:
    """The text of each class that has a role, with its number and its roles."""
    known = roles.groupBy("node").agg(F.collect_list("role").alias("roles"))
    known = stored(known.join(classes.select("node", F.col("first_id").alias("doc_id"), "tag"), "node"), name)
    return docs.join(broadcast_if_small(known, weight=F.size("roles") + 2), ["doc_id", "tag"])


def confirmed(docs: DataFrame, classes: DataFrame, edges: DataFrame) -> DataFrame:
    """Those of ``edges`` (``a, b``) whose full sets are near. Only documents on an edge are read into Python."""
    per = edges.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("salts"))
    members = edges.join(per, "a").select(
        F.col("b").alias("node"), F.struct("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("centre")).alias("role")
    )
    centres = per.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).select(
        F.col("a").alias("node"), F.struct("a", "salt", F.lit(0).alias("centre")).alias("role")
    )
    sets = _with_roles(docs, classes, members.union(centres), "roles").mapInArrow(
        _sets_for_roles, "a long, salt int, centre int, b long, held binary"
    )
    groups = sets.repartition("a", "salt").sortWithinPartitions("a", "salt", "centre")
    return stored(groups.mapInArrow(_compared, "a long, b long").distinct(), "links")


def _labelled(rows: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """``rows`` with ``component``: the label of ``column``, or its own value where it has none."""
    names = labels.select(F.col("node").alias(column), F.col("component").alias("_label"))
    return rows.join(names, column, "left").withColumn("component", F.coalesce("_label", column)).drop("_label")


def _tile_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each tile that a document takes part in, with its set and its signature's low bytes."""
    names = ["key", "i", "j", "part", "component", "doc", "held", "sketch"]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    for batch in batches:
        for part in slices_by_bytes(batch, "body"):
            sets = shingle_sets(part.column("body"))
            sketches = signatures(sets).astype(np.uint8)
            ids, roles = part.column("node").to_pylist(), part.column("roles").to_pylist()
            rows = [
                (r["key"], min(r["part"], o), max(r["part"], o), r["part"], r["component"], ids[k], own.tobytes(), sketches[k].tobytes())
                for k, own in enumerate(sets)
                for r in roles[k]
                for o in range(r["parts"])
            ]
            for at in range(0, len(rows), 512):
                columns = zip(*rows[at : at + 512], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def _tile_links(tile: list[tuple]) -> list[tuple[int, int]]:
    """Near pairs of different components in one tile, confirmed on full sets."""
    part = np.array([r[3] for r in tile])
    component = np.array([r[4] for r in tile])
    sets = [np.frombuffer(r[6], np.uint64) for r in tile]
    size = np.array([len(s) for s in sets])
    sketch = np.frombuffer(b"".join(r[7] for r in tile), np.uint8).reshape(len(tile), BINS)
    whole = tile[0][1] == tile[0][2]
    found = []
    for x in range(len(tile) - 1):
        rest = np.arange(x + 1, len(tile))
        rest = rest[(component[rest] != component[x]) & (whole | (part[rest] != part[x]))]
        rest = rest[np.minimum(size[rest], size[x]) * 100 >= np.maximum(size[rest], size[x]) * PERCENT]
        alike = (sketch[rest] == sketch[x]).sum(1) >= ALIKE_BINS
        for y in rest[alike | (np.minimum(size[rest], size[x]) <= SMALL_SET)].tolist():
            if _near(sets[x], sets[y]):
                found.append((min(tile[x][5], tile[y][5]), max(tile[x][5], tile[y][5])))
    return found


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by tile; a tile holds at most two parts of one bucket."""

    def out(tile: list[tuple]) -> pa.RecordBatch:
        found = _tile_links(tile)
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    tile: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if tile and row[:3] != tile[0][:3]:
                yield out(tile)
                tile = []
            tile.append(row)
    if tile:
        yield out(tile)


def _left_out(docs: DataFrame, classes: DataFrame, links: DataFrame, labels: DataFrame) -> DataFrame:
    """Links between different components among members of one bucket, found tile by tile; no pair is a row."""
    seen = _labelled(links, "doc", labels)
    mixed = seen.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n"))
    several = mixed.filter("x < y and n > 2").select("key", F.ceil(F.col("n") / TILE).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int").alias("part")
    members = seen.join(several, "key").select(F.col("doc").alias("node"), F.struct("key", part, "parts", "component").alias("role"))
    rows = _with_roles(docs, classes, members, "members").mapInArrow(
        _tile_rows, "key long, i int, j int, part int, component long, doc long, held binary, sketch binary"
    )
    tiles = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return stored(tiles.mapInArrow(_tiles, "a long, b long").distinct(), "links")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row for each row of ``docs``.

    Columns named in ``carry`` (they should be narrow) come back in the struct ``carried``.
    """
    bound_text_batches(docs.sparkSession)
    body = F.col(text).cast("string")
    given = docs.select(F.col(id_column).cast("long").alias("doc_id"), body.alias("body"), F.xxhash64(body).alias("tag"), *carrying(docs, carry))
    schema = with_carried("doc_id long, n_shingles long, d1 long, d2 long, keys array<long>, tag long, salt int", given)
    described = stored(given.mapInArrow(_described, schema), "signatures")
    held = ["carried"] if carry else []
    linkable = described.filter("n_shingles > 0 and doc_id is not null")
    digest = ["n_shingles", "d1", "d2"]
    classes = linkable.groupBy(*digest).agg(F.min(F.struct("doc_id", "tag")).alias("first"), F.any_value("keys").alias("keys"))
    classes = classes.select(*digest, F.col("first.doc_id").alias("first_id"), F.col("first.tag").alias("tag"), "keys")
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    bands = classes.select(F.col("node").alias("doc"), F.explode("keys").alias("key"))
    buckets = bands.groupBy("key").agg(F.min("doc").alias("centre"), F.count("*").alias("n")).filter("n > 1").drop("n")
    links = stored(bands.join(buckets, "key"), "buckets")
    stars = links.filter("doc <> centre").groupBy(F.col("centre").alias("a"), F.col("doc").alias("b")).agg(F.count("*").alias("n"))
    stars = stored(stars, "stars")
    full = given.select("doc_id", "body", "tag").filter("doc_id is not null")
    best = stars.groupBy("b").agg(F.max(F.struct("n", (-F.col("a")).alias("a"))).alias("x")).select((-F.col("x.a")).alias("a"), "b")
    near = confirmed(full, classes, best)
    labels = stored(components(near), "labels")
    apart = _labelled(stars.select("b", F.col("a")), "a", labels).withColumnRenamed("component", "ca")
    apart = _labelled(apart, "b", labels).filter("component <> ca").select("a", "b")
    near = near.union(confirmed(full, classes, apart.join(best, ["a", "b"], "left_anti")))
    labels = stored(components(near), "labels")
    near = near.union(_left_out(full, classes, links, labels))
    labels = stored(components(near), "labels")
    named = _labelled(classes.select(*digest, "node", "first_id"), "node", labels)
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(least, "component").select(*digest, "component_id")
    parts = linkable.select(*digest, "salt").distinct().join(named, digest)
    of_row = described.join(parts, [*digest, "salt"], "left").withColumn(
        "component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    )
    return of_row.select(
        "doc_id",
        "n_shingles",
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
        *held,
    )
