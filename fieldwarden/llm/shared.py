"""Helpers shared by the corpus operators: scratch tables on shared storage, checked broadcasts, Arrow columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a narrow id table (up to three numbers a row) that may be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000


#: Rows of text that Spark hands to Python at a time; its own default of 10,000 takes much memory with long texts.
TEXT_ROWS = 1000


def bound_text_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size to ``TEXT_ROWS`` where it is larger; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder is used on a local master only; a cluster without the setting is an error,
    as its executors would not see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="fieldwarden-scratch-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/fieldwarden/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """``df`` (already stored) with a broadcast hint if its counted rows are within ``limit``.

    ``weight`` says for how many narrow rows a row with lists counts.
    """
    size = df.count() if weight is None else df.agg(F.sum(weight)).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def with_carried(schema: str, given: DataFrame) -> str | T.StructType:
    """A result schema, with the type of the column ``carried`` of ``given`` where it has one."""
    if "carried" not in given.columns:
        return schema
    return T.StructType([*T.StructType.fromDDL(schema).fields, given.schema["carried"]])


def carrying(docs: DataFrame, carry: Sequence[str]) -> list[Column]:
    """The columns to hand through an operator, packed in one struct so that no name can clash."""
    return [F.struct(*(docs[f"`{c}`"].alias(c) for c in carry)).alias("carried")] if carry else []


def record_batch(part: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """A batch of ``columns``, with ``carried`` of ``part`` where it has one."""
    if "carried" in part.schema.names:
        columns = columns | {"carried": part.column("carried")}
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def is_held_out(id_column: str, folds: int, remainder: int):
    """True where crc32 of the id written as text leaves ``remainder`` when divided by ``folds``."""
    return F.coalesce((F.crc32(F.col(id_column).cast("string")) % folds) == remainder, F.lit(False))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows in them (nulls count as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices_by_bytes(batch: pa.RecordBatch, text: str, most: int = 1 << 21):
    """Parts of a batch with at most ``most`` bytes of text each, one row at least: bounds the work arrays."""
    sizes = text_buffer(batch.column(text))[1][1:]
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
