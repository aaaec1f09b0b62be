"""Merkle manifest of a document table: digests, proofs and a check against tampering, by time-forward processing.

A document is a leaf: the SHA-256 of its fields. The leaves of one language, in the order of their ids, form a tree of
arity 8; the roots of the languages, null first and then bytewise, form the top tree.

1. Leaves are ranked by a range partitioning over (lang, doc_id): a row's place is its place in its part plus the rows of
   its language in earlier parts. A language with most of the rows is spread over many parts.
2. Forward sweep. Nodes are labelled by the end of the leaf range that they cover, then by level, so that children come
   before parents. A task meets its leaves in label order; a priority queue ordered by label delivers each digest to its
   parent, which is settled once the sweep has passed its label. The queue is external: within 512 consecutive nodes
   (three levels) it is a heap in the task, between such blocks Spark's sorted shuffle carries the messages on, block by
   block, so a queue never holds more than a block. A round is one 512th of the one before.
3. Reversed sweep. From the top root down, the queue ordered by falling label delivers to every child its proof: the
   siblings in its own run, followed by its parent's proof. A block gets one message, not one for each leaf.

Nulls are the field ``-``; a null id comes first in its language and is never chosen for tampering. Rows that share an
id are ordered by their digests, and repeated rows are leaves of their own with equal digests. Empty texts are the field
``0:``; texts are hashed whole, in Spark's own functions, and do not leave the first stage. Extra columns are ignored. An
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from fieldwarden.llm.shared import stored

ARITY = 8
#: Levels that one sweep of a block climbs; a block has 8 to this power nodes at most.
CLIMB = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One level of a proof: the place of the node in its run and the joined digests of the others.
Proof = tuple[tuple[int, str], ...]
MESSAGE = "tree long, idx long, subroot binary, proof string"


def leaf_digest(*fields: Column) -> Column:
    """Hexadecimal SHA-256 of the joined fields, each ``-`` if null, else byte count, colon and value."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def joined_digest(digests: str) -> str:
    return hashlib.sha256(digests.encode()).hexdigest()


def height(n: int) -> int:
    """Levels above ``n`` nodes until one remains."""
    found = 0
    while n > 1:
        n, found = -(-n // ARITY), found + 1
    return found


def forward(nodes: list[tuple[int, str]], levels: int) -> list[dict[int, str]]:
    """Digests by index for each level, the given nodes (in order) being level 0."""
    grown: list[dict[int, str]] = [dict(nodes), *({} for _ in range(levels))]
    queue: list[tuple[int, int, int, str]] = []  # label of the parent (end, level), child, the child's digest

    def send(level: int, index: int, digest: str) -> None:
        if level < levels:
            heappush(queue, ((index // ARITY + 1) * ARITY ** (level + 1), level + 1, index, digest))

    def settle(until: int | None) -> None:
        while queue and (until is None or queue[0][0] <= until):
            label, children = queue[0][:2], []
            while queue and queue[0][:2] == label:
                children.append(heappop(queue))
            index = children[0][2] // ARITY
            grown[label[1]][index] = joined_digest("".join(c[3] for c in children))
            send(label[1], index, grown[label[1]][index])

    for index, digest in nodes:
        settle(index)
        send(0, index, digest)
    settle(None)
    return grown


def backward(grown: list[dict[int, str]], above: Proof) -> Iterator[tuple[int, Proof]]:
    """Index and proof of every node of level 0, last first, given the proof of the only node on top."""
    (top,) = grown[-1]
    queue: list[tuple[int, int, int, Proof]] = [(0, 1 - len(grown), top, above)]
    while queue:
        _, level, index, proof = heappop(queue)
        if level == 0:
            yield index, proof
            continue
        below = grown[-level - 1]
        run = [i for i in range(index * ARITY, (index + 1) * ARITY) if i in below]
        for place, i in enumerate(run):
            others = "".join(below[k] for k in run if k != i)
            heappush(queue, (-(i + 1) * ARITY ** (-level - 1), level + 1, i, ((place, others), *proof)))


def folded(digest: str, proof: Proof) -> str:
    """The root that follows from a leaf and its proof."""
    for place, others in proof:
        digest = joined_digest(others[: 64 * place] + digest + others[64 * place :])
    return digest


def _written(proof: Proof) -> str:
    return ";".join(f"{place}:{others}" for place, others in proof)


def _read(text: str) -> Proof:
    return tuple((int(p), others) for p, _, others in (part.partition(":") for part in text.split(";"))) if text else ()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows that share tree and block; they come sorted, and there are at most a block's nodes and one message."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["tree"], row["block"]) != (held[0]["tree"], held[0]["block"]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _climbed(rows: list[dict], climb: int) -> list[dict[int, str]]:
    nodes = [(r["idx"], r["digest"].hex()) for r in rows]
    return forward(nodes, min(climb, height(rows[0]["n"])))


def _batch(rows: list[tuple], **kinds: pa.DataType) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))


def _upward(climb: int):
    """The top digest of every block, with the number of nodes of its tree at that level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for block in _blocks(batches):
            ((index, digest),) = _climbed(block, climb)[-1].items()
            n = block[0]["n"]
            for _ in range(min(climb, height(n))):
                n = -(-n // ARITY)
            found.append((block[0]["tree"], index, n, bytes.fromhex(digest)))
            if len(found) == ARITY**CLIMB:
                yield _batch(found, tree=pa.int64(), idx=pa.int64(), n=pa.int64(), digest=pa.binary())
                found = []
        yield _batch(found, tree=pa.int64(), idx=pa.int64(), n=pa.int64(), digest=pa.binary())

    return run


def _downward(climb: int):
    """Proofs of a block's nodes as messages for the blocks below them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            tree, subroot, above = block[0]["tree"], block[0]["subroot"], _read(block[0]["proof"])
            found = [(tree, i, subroot, _written(p)) for i, p in backward(_climbed(block[1:], climb), above)]
            yield _batch(found, tree=pa.int64(), idx=pa.int64(), subroot=pa.binary(), proof=pa.string())

    return run


def _checked(id_type: pa.DataType, climb: int):
    """The last reversed sweep: proofs of the leaves, each folded at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            message, nodes = block[0], {r["idx"]: r for r in block[1:]}
            found = []
            subroot = message["subroot"].hex()
            for i, proof in backward(_climbed(block[1:], climb), _read(message["proof"])):
                leaf = nodes[i]["digest"].hex()
                given = nodes[i]["tampered"].hex() if nodes[i]["tampered"] is not None else leaf
                found.append((nodes[i]["doc_id"], leaf, subroot, joined_digest("".join(o for _, o in proof)), folded(given, proof)))
            yield _batch(found, doc_id=id_type, **dict.fromkeys(("leaf", "subroot", "proof_sha256", "folded_root"), pa.string()))

    return run


def _ranked(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` stored, with ``tree`` (a number for each value of ``group``, in its order), ``idx`` from 0 and ``n``.

    Rows that are equal in ``order`` are told apart by their place in the input, so that they can be spread too.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(parts, group, *order, "_tie").sortWithinPartitions(group, *order, "_tie")
    placed = stored(dealt.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "leaves")
    part = F.shiftright("_at", 33).alias("_part")
    runs = placed.groupBy(F.col(group).alias("_group"), part).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    one = Window.partitionBy("_group")
    before = F.coalesce(F.sum("_rows").over(one.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stored(
        runs.select(
            "_group", "_part", (before - F.col("_first")).alias("_shift"), F.min("_first").over(one).alias("tree"), F.sum("_rows").over(one).alias("n")
        ),
        "runs",
    )
    same = (F.shiftright(placed["_at"], 33) == starts["_part"]) & placed[group].eqNullSafe(starts["_group"])
    return placed.join(starts, same).withColumn("idx", F.col("_at") + F.col("_shift")).drop("_at", "_shift", "_part", "_group", group)


def _in_blocks(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "idx")


def _block(climb: int) -> Column:
    return F.expr(f"idx div {ARITY**climb}").alias("block")


def _grown(leaves: DataFrame, climb: int) -> list[DataFrame]:
    """``tree, idx, n, digest`` after each round of the forward sweep, until every tree has one node."""
    rounds = [leaves.select("tree", "idx", "n", "digest")]
    while (rounds[-1].agg(F.max("n")).first()[0] or 0) > 1:
        blocks = _in_blocks(rounds[-1].filter("n > 1").select("*", _block(climb)))
        rounds.append(stored(blocks.mapInArrow(_upward(climb), "tree long, idx long, n long, digest binary"), "nodes"))
    return rounds


def _roots(rounds: list[DataFrame]) -> DataFrame:
    found = rounds[0].filter("n = 1")
    for nodes in rounds[1:]:
        found = found.union(nodes.filter("n = 1"))
    return found.select("tree", "digest")


def _delivered(nodes: DataFrame, messages: DataFrame, climb: int) -> DataFrame:
    """Each block's message (its idx is null, so it comes first) and nodes, in label order."""
    return _in_blocks(
        messages.withColumnRenamed("idx", "block").unionByName(nodes.select("*", _block(climb)), allowMissingColumns=True)
    )


def _lowered(rounds: list[DataFrame], roots: DataFrame, climb: int) -> DataFrame:
    """The messages for the blocks of the leaves, given those for the trees' roots (``tree, subroot, proof``)."""
    down = None
    for k in range(len(rounds) - 1, -1, -1):
        own = rounds[k].filter("n = 1").select("tree").join(roots, "tree").select("tree", F.lit(0).cast("long").alias("idx"), "subroot", "proof")
        down = own if down is None else down.unionByName(own)
        if k:
            down = stored(_delivered(rounds[k], down, climb).mapInArrow(_downward(climb), MESSAGE), "proofs")
    return down


def manifest(docs: DataFrame, climb: int = CLIMB) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``, one row for each row of ``docs``.

    ``docs`` has ``doc_id, source, lang, n_chars, text``. ``folded_root`` is recomputed from the leaf and its proof; for a
    third of the ids (crc32 of the decimal id is a multiple of 3) from a leaf whose text's A-Z were lower-cased.
    """
    names = ("doc_id", "source", "lang", "n_chars", "text")
    given = docs.select(*names)
    fields = [F.col(c) for c in names]
    chosen = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    leaves = given.select(
        "doc_id",
        "lang",
        F.unhex(leaf_digest(*fields)).alias("digest"),
        F.when(chosen, F.unhex(leaf_digest(*fields[:-1], F.translate("text", UPPER, LOWER)))).alias("tampered"),
    )
    leaves = stored(leaves, "digests")  # a range partitioning reads its input twice
    base = stored(_ranked(leaves, "lang", "doc_id", "digest"), "leaves")
    rounds = _grown(base, climb)
    subroots = _roots(rounds).select(F.lit(0).alias("forest"), F.col("tree").alias("child"), "digest")
    subroots = stored(_ranked(subroots, "forest", "child"), "subroots")
    upper = _grown(subroots, climb)
    top = _roots(upper).withColumnRenamed("digest", "subroot").withColumn("proof", F.lit(""))
    found = top.first()
    root = F.lit(bytes(found["subroot"]).hex() if found else None).cast("string")
    proofs = _delivered(upper[0], _lowered(upper, top, climb), climb).mapInArrow(_downward(climb), MESSAGE).drop("subroot")
    trees = proofs.join(subroots, ["tree", "idx"]).select(F.col("child").alias("tree"), F.col("digest").alias("subroot"), "proof")
    messages = _lowered(rounds, stored(trees, "proofs"), climb)
    id_type = given.schema["doc_id"]
    texts = [T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "proof_sha256", "folded_root")]
    nodes = base.select("tree", "idx", "n", "digest", "tampered", "doc_id")
    done = _delivered(nodes, messages, climb).mapInArrow(_checked(to_arrow_type(id_type.dataType), climb), T.StructType([id_type, *texts]))
    return done.select(
        "doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified")
    )
