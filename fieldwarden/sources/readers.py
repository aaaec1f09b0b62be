"""Readers for single tables (SRC-1..8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from fieldwarden.functions.text import lines, strip
from fieldwarden.operators.values import q

# Cell texts that mean "missing" in delimited files.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Keys under which a JSON document may hold its records, in order of preference.
RECORD_KEYS = ("records", "items", "data", "teas")
SUPPORTED = ("csv", "avro", "json", "jsonl", "parquet", "txt")


class UnsupportedSource(ValueError):
    """The file cannot be read as a table."""


def missing_tokens_to_null(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            F.when(~q(f.name).isin(*NA_TOKENS), q(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else q(f.name)
            for f in df.schema.fields
        ]
    )


def read_csv(spark: SparkSession, path: str | Sequence[str], multi_line: bool = True) -> DataFrame:
    """SRC-1: header row, every column text, missing tokens as null.

    Quoted cells may hold line breaks, so a file is read by one task.  Set
    ``multi_line=False`` for files known to hold one record per line; those are split.
    """
    raw = spark.read.csv(
        path, header=True, inferSchema=False, quote='"', escape='"', multiLine=multi_line, enforceSchema=False
    )
    return missing_tokens_to_null(raw)


def has_avro(spark: SparkSession) -> bool:
    """Whether the external Avro module is on the classpath."""
    try:
        spark._jvm.java.lang.Class.forName("org.apache.spark.sql.avro.AvroFileFormat")
        return True
    except Exception:
        return False


def read_avro(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """SRC-2."""
    if not has_avro(spark):
        raise UnsupportedSource("Avro needs the spark-avro module on the classpath")
    return spark.read.format("avro").load(path)


def flatten(df: DataFrame) -> DataFrame:
    """Nested objects become dotted columns; lists stay as cells."""
    while any(isinstance(f.dataType, T.StructType) for f in df.schema.fields):
        out = []
        for f in df.schema.fields:
            if isinstance(f.dataType, T.StructType):
                out += [q(f.name).getField(c.name).alias(f"{f.name}.{c.name}") for c in f.dataType.fields]
            else:
                out.append(q(f.name))
        df = df.select(*out)
    return df


def json_layout(spark: SparkSession, path: str) -> str:
    """``lines`` or ``document``, judged from the first two non-blank lines of the file.

    Only two one-character-sized facts per line reach the driver.
    """
    text = F.regexp_replace(F.col("value"), "﻿", "")
    head = (
        spark.read.text(path)
        .where(F.trim(text) != "")
        .select(F.substring(F.trim(text), 1, 1).alias("first"), F.try_parse_json(text).isNotNull().alias("whole"))
        .head(2)
    )
    if not head:
        raise UnsupportedSource(f"empty JSON file: {path}")
    if len(head) == 2 and head[0]["whole"] and head[0]["first"] == "{":
        return "lines"
    return "document"


def read_json_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """SRC-4."""
    return flatten(_readable(spark.read.json(path)))


def _readable(df: DataFrame) -> DataFrame:
    if "_corrupt_record" in df.columns and len(df.columns) == 1:
        raise UnsupportedSource("not a JSON object, list of objects, or JSON Lines file")
    return df.drop("_corrupt_record")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """SRC-3: list of records, object wrapping one, single object, or JSON Lines."""
    if json_layout(spark, path) == "lines":
        return read_json_lines(spark, path)
    document = _readable(spark.read.json(path, multiLine=True))
    for key in RECORD_KEYS:
        if key in document.columns and isinstance(document.schema[key].dataType, T.ArrayType):
            # A wrapper is one top-level object; a list of records never explodes its own columns.
            first = spark.read.text(path).select(
                F.substring(F.ltrim(F.regexp_replace("value", "﻿", "")), 1, 1).alias("c")
            ).where(F.col("c") != "").head()
            if first["c"] != "{":
                break
            if not isinstance(document.schema[key].dataType.elementType, T.StructType):
                return document.select(F.explode(q(key)).alias("0"))
            return flatten(document.select(F.explode(q(key)).alias("r")).select("r.*"))
    return flatten(document)


def read_parquet(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """SRC-5."""
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


def read_text(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """SRC-6: whole lines in a column named ``value``."""
    return spark.read.text(path)


def text_lines(df: DataFrame, text: str, name: str = "value") -> DataFrame:
    """SRC-8: non-blank lines of a text column, with their line number and the other columns.

    A text without any line break is one line; blank texts give no row.
    """
    keep = [q(c) for c in df.columns if c != text]
    return (
        df.select(*keep, F.posexplode(lines(q(text))).alias("line_no", name))
        .where(strip(q(name)) != "")
    )


def extension_of(path: str) -> str:
    tail = path.rsplit("/", 1)[-1].lower()
    return tail.rsplit(".", 1)[-1] if "." in tail else ""


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Reader by file extension."""
    readers = {
        "csv": read_csv,
        "avro": read_avro,
        "json": read_json,
        "jsonl": read_json_lines,
        "parquet": read_parquet,
        "txt": read_text,
    }
    kind = extension_of(path)
    if kind not in readers:
        raise UnsupportedSource(f"unsupported file type: {kind or path}")
    try:
        return readers[kind](spark, path)
    except AnalysisException as error:
        raise UnsupportedSource(f"cannot read {path}: {str(error).splitlines()[0]}") from error
