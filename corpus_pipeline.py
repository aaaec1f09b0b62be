"""The corpus pipeline: filters, deduplicates, decontaminates and encodes ``documents``, stage by stage.

Every stage but the last returns the columns of its input. Rows are told apart by id and a hash of the text, so rows that
share an id, or have none, are judged by their own text. Tables that name rows to drop are broadcast within a checked
size and joined by shuffle beyond it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwarden.llm import bpe, debruijn, decontaminate, minhash, queries, toxicity
from fieldwarden.llm.shared import broadcast_if_small, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows named in ``gone`` (``doc_id, tag``)."""
    named = broadcast_if_small(stored(gone.select(F.col("doc_id").alias("_gone_id"), F.col("tag").alias("_gone_tag")).distinct(), "gone"))
    same = F.col("doc_id").eqNullSafe(F.col("_gone_id")) & (F.xxhash64("text") == F.col("_gone_tag"))
    return docs.join(named, same, "left_anti")


def _tagged(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("tag"))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go."""
    scored = toxicity.score(_tagged(docs), queries.table(spark, sf_dir, "labels"), carry=["tag"])
    return _without(docs, scored.filter("score >= 0.5").select("doc_id", "carried.tag"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    found = minhash.near_duplicates(_tagged(docs), carry=["tag"])
    return _without(docs, found.filter("not kept").select("doc_id", "carried.tag"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat an earlier document's go; other texts stay as they are, and so do all documents."""
    done = debruijn.remove_repeats(docs, carry=docs.columns)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("carried.text"))
    chars = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("carried.n_chars"))
    changed = {"text": text, "n_chars": chars.cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {"text": text}
    return done.select(*(changed.get(c, F.col("carried")[c]).alias(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontaminate.contamination(docs.select("doc_id", "text"), queries.table(spark, sf_dir, "benchmark"))
    return _without(docs, found.filter("n_hit > 0").select("doc_id", "tag"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every text, with the text that they decode to."""
    done = bpe.round_trip(docs, queries.vocabulary())
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("near-duplicates", one_of_each_group),
    ("substring-dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: The classifier and the tokenizer can't be written in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over all rows that its predecessor kept, each written as Parquet and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
