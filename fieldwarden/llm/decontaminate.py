"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

A window is ten consecutive words of a benchmark item (the whole item where it has fewer); its set holds its three-word
shingles with their places. A document holds a window exactly if it holds all of them at consecutive places, so:

1. One pass over the texts finds the places of all benchmark shingles (a join with the distinct shingles).
2. Shingles are ordered by rarity in the documents. Full containment needs every shingle, so the necessary prefix of a
   window is its rarest one; a window with a shingle that no document holds is settled at once.
3. Places of prefix shingles give the only possible starts; the window must begin at word 1 or later and end within the
   document.
4. A candidate is confirmed if all shingles of its window are found at their places.

Every document is led by three marks that no word can equal, found like a shingle: one row for each document, whatever
it holds. Null texts and texts without words have no hits. Repeated rows get equal results; rows that repeat an id with
another text are told apart by a hash of the text. Null ids are kept as a document of their own text; benchmark rows
without id or words are no item; equal item ids count once. Extra columns are ignored; empty tables are fine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldwarden.llm.shared import BROADCAST_ROWS, broadcast_if_small, stored

WINDOW = 10
SHINGLE = 3
#: What is not part of a word, and the letters folded.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARK = "\x00"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _windows(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct windows ``win, ws, len``, and the items of each: ``win, item_id``."""
    held = items.select(F.col("item_id"), words(F.col("text")).alias("all")).filter("item_id is not null and size(all) > 0")
    held = held.withColumn("len", F.least(F.size("all"), F.lit(WINDOW)))
    starts = held.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("all") - F.col("len") + 1)))
    cut = stored(starts.select("item_id", F.slice("all", F.col("at"), F.col("len")).alias("ws"), "len"), "item-windows")
    named = stored(cut.select("ws", "len").distinct().withColumn("win", F.monotonically_increasing_id()), "named-windows")
    return named, cut.join(named, ["ws", "len"]).select("win", F.col("item_id").cast("string").alias("item_id")).distinct()


def _shingles(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct shingles ``token, size, w1, w2, w3``, and their places in the windows ``win, len, off, token``."""
    sized = windows.withColumn("size", F.least("len", F.lit(SHINGLE)))
    places = sized.withColumn("off", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("size"))))
    word = lambda k: F.when(F.col("size") >= k, F.try_element_at("ws", F.col("off") + k))
    cut = stored(places.select("win", "len", "size", "off", *(word(k).alias(f"w{k}") for k in (1, 2, 3))), "window-shingles")
    marks = cut.sparkSession.range(1).select(F.lit(SHINGLE).alias("size"), *(F.lit(MARK).alias(f"w{k}") for k in (1, 2, 3)))
    parts = ["size", "w1", "w2", "w3"]
    named = cut.select(*parts).unionByName(marks).distinct().withColumn("token", F.monotonically_increasing_id())
    named = stored(named, "shingles")
    same = (cut["size"] == named["size"]) & (cut["w1"] == named["w1"])
    same = same & cut["w2"].eqNullSafe(named["w2"]) & cut["w3"].eqNullSafe(named["w3"])
    return named, cut.join(named, same).select("win", "len", cut["size"], "off", "token")


def _found(docs: DataFrame, shingles: DataFrame) -> DataFrame:
    """``doc_id, tag, n_words, pos, token, marked`` of every place of a shingle; word 1 is at place 1.

    The shingles are broadcast; beyond the bound they go in blocks of bounded size, each against all documents.
    """
    own = docs.select(
        F.col("doc_id"),
        F.xxhash64("text").alias("tag"),
        F.concat(F.array(*[F.lit(MARK)] * SHINGLE), words(F.col("text"))).alias("ws"),
    )
    from_place = lambda k: F.slice(F.col("ws"), F.lit(k), F.size("ws"))
    spread = own.select(
        "doc_id",
        "tag",
        (F.size("ws") - SHINGLE).alias("n_words"),
        F.posexplode(F.arrays_zip(F.col("ws").alias("a"), from_place(2).alias("b"), from_place(3).alias("c"))).alias("at", "s"),
    ).select("doc_id", "tag", "n_words", F.col("at"), F.col("s.a").alias("a"), F.col("s.b").alias("b"), F.col("s.c").alias("c"))
    sizes = [r[0] for r in shingles.select("size").distinct().collect()]  # at most three numbers
    blocks = -(-shingles.count() // BROADCAST_ROWS)
    found = None
    for size in sorted(sizes):
        for block in range(blocks):
            wanted = shingles.filter((F.col("size") == size) & (F.pmod("token", F.lit(blocks)) == block))
            wanted = wanted.withColumn("key", F.xxhash64(*[f"w{k}" for k in range(1, size + 1)]))
            same = F.xxhash64(*["a", "b", "c"][:size]) == F.col("key")
            for mine, theirs in zip("abc"[:size], ("w1", "w2", "w3"), strict=False):
                same = same & (F.col(mine) == F.col(theirs))
            hits = spread.join(F.broadcast(wanted), same).select(
                "doc_id", "tag", "n_words", (F.col("at") + 1 - SHINGLE).alias("pos"), "token", (F.col("a") == MARK).alias("marked")
            )
            found = hits if found is None else found.unionByName(hits)
    return stored(found, "places")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, tag, n_words, n_hit, item_ids``, one row for each row of ``docs`` (``doc_id, text``).

    ``n_hit`` counts the words inside any occurrence of a window of ``items`` (``item_id, text``); ``item_ids`` holds the
    items with an occurring window, as sorted strings; ``tag`` is the text's ``xxhash64``.
    """
    windows, owners = _windows(items)
    shingles, places = _shingles(windows)
    found = _found(docs, shingles)
    rows = found.filter("marked").select("doc_id", "tag", "n_words")
    held = stored(found.filter(~F.col("marked")).drop("marked").distinct(), "hits")
    rarity = held.groupBy("token").agg(F.count("*").alias("df"))
    rated = places.join(rarity, "token", "left")
    prefix = rated.groupBy("win", "len", "size").agg(
        F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token", "off")).alias("least")
    )
    prefix = stored(prefix.filter("least.df > 0").select("win", "len", "size", "least.token", "least.off"), "prefix")
    candidates = held.join(broadcast_if_small(prefix), "token").select(
        "doc_id", "tag", "win", "len", "size", "n_words", (F.col("pos") - F.col("off")).alias("start")
    )
    candidates = candidates.filter("start >= 1 and start + len - 1 <= n_words").drop("n_words")
    parts = stored(places.select("win", "off", "token"), "parts")
    needed = candidates.join(broadcast_if_small(parts), "win").withColumn("pos", F.col("start") + F.col("off"))
    there = held.select(F.col("doc_id").alias("d"), F.col("tag").alias("g"), F.col("pos").alias("p"), F.col("token").alias("t"))
    met = needed.join(
        there,
        F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tag") == F.col("g")) & (F.col("pos") == F.col("p")) & (F.col("token") == F.col("t")),
    )
    hits = met.groupBy("doc_id", "tag", "win", "start", "len", "size").agg(F.count("*").alias("n"))
    hits = stored(hits.filter("n = len - size + 1").select("doc_id", "tag", "win", "start", "len"), "occurrences")
    return _summed(rows, hits, owners)


def _summed(rows: DataFrame, hits: DataFrame, owners: DataFrame) -> DataFrame:
    """The rows with their covered words and item ids."""
    spans = hits.select("doc_id", "tag", "start", (F.col("start") + F.col("len") - 1).alias("end")).distinct()
    earlier = Window.partitionBy("doc_id", "tag").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("end").over(earlier), F.lit(0))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start") - 1, F.col("reached")))
    covered = spans.withColumn("reached", reached).groupBy("doc_id", "tag").agg(F.sum(fresh).alias("n_hit"))
    owned = hits.select("doc_id", "tag", "win").distinct().join(owners, "win").groupBy("doc_id", "tag")
    owned = owned.agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    both = covered.join(owned.select(F.col("doc_id").alias("d"), F.col("tag").alias("g"), "item_ids"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tag") == F.col("g")))
    both = both.select(F.col("doc_id").alias("d"), F.col("tag").alias("g"), "n_hit", "item_ids")
    return rows.join(both, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tag") == F.col("g")), "left").select(
        "doc_id",
        "tag",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )
