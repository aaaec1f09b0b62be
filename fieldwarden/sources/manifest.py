"""Directories as data: the file manifest, what each file holds, and the cells of all files in one plan (SRC-9, SRC-11).

The names of files stay in DataFrames. Text formats of any number of files and layouts are one read each: header lines,
line kinds and quoted line breaks are surveyed per file by tasks, and names are joined to column numbers after the
aggregation. The footer of every Parquet file is read, and files are grouped by layout; one read for each layout picks its
files by their folders while Spark lists them.

Cells carry a two-character tag before the column: the kind of reading and a sign.

====== ==========================================================
``t:`` text lines
``s:`` delimited records, one line each; the rest is the column's number
``m:`` delimited records of files with quoted line breaks, likewise
``l:`` JSON Lines
``d:`` JSON documents
``p:`` Parquet (and ``a:`` Avro)
``x!`` (any kind) the column is there, whether or not it has values
``x=`` one for each row that was read
====== ==========================================================
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldwarden.functions.text import as_text, strip
from fieldwarden.operators.values import COLUMNS_PER_BATCH, dealt, q
from fieldwarden.sources.readers import NA_TOKENS, RECORD_KEYS, SUPPORTED, has_avro
from fieldwarden.sources.scratch import kept

Path = str | Sequence[str]
FILE = "_metadata.file_path"
CELLS = "source string, column string, value string, rid long"
#: Parquet files up to this size go whole to the tasks that read their footers; of larger ones only the last bytes are read.
FOOTER_BYTES = 64 << 20
#: Files over that size whose footers are read at the same time.
FOOTER_THREADS = 16
_MARK = "﻿"


def reading(spark: SparkSession, *kinds: str):
    """A reader for all files of some kinds below a path, whatever the case of their extension."""
    names = ",".join("".join(f"[{c}{c.upper()}]" for c in kind) for kind in kinds)
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{names}}}")


def within(df: DataFrame, max_mb: float | None) -> DataFrame:
    """Without the files over the size; Spark leaves them out while it lists."""
    return df if max_mb is None else df.where(F.col("_metadata.file_size") <= F.lit(int(max_mb * 1024 * 1024)))


def list_files(spark: SparkSession, path: Path) -> DataFrame:
    """Every file below ``path``: ``file, extension, bytes, size_mb``.  Contents are never read."""
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col(FILE).alias("file"), "length")
    )
    name = F.element_at(F.split(F.lower("file"), "/"), -1)
    return listed.select(
        "file",
        F.when(name.contains("."), F.element_at(F.split(name, r"\."), -1)).otherwise("").alias("extension"),
        F.col("length").alias("bytes"),
        F.bround(F.col("length") / (1024 * 1024), 2).alias("size_mb"),
    )


def file_states(files: DataFrame, max_mb: float | None = None) -> DataFrame:
    """SRC-11: SKIPPED for unknown kinds and oversized files, PENDING for the rest."""
    too_large = F.lit(False) if max_mb is None else F.col("bytes") > F.lit(int(max_mb * 1024 * 1024))
    state = (
        F.when(~F.col("extension").isin(*SUPPORTED), "SKIPPED").when(too_large, "SKIPPED").otherwise("PENDING")
    )
    detail = (
        F.when(~F.col("extension").isin(*SUPPORTED), "Unsupported file type")
        .when(too_large, F.format_string(f"File is larger than {max_mb} MB"))
        .otherwise("")
    )
    return files.select("file", "extension", "bytes", "size_mb", state.alias("state"), detail.alias("detail"))


def empty_files(spark: SparkSession, path: Path, listed: DataFrame) -> DataFrame | None:
    """Files without a byte (``file, extension``), which Spark lists but never reads; None where there are none.

    The names go from Spark's own listing into a table inside the JVM.
    """
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    names = every._jdf.inputFiles()
    if len(names) == listed.count():
        return None
    jvm = spark._jvm
    listing = jvm.scala.jdk.javaapi.CollectionConverters.asJava(jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(names))
    known = DataFrame(spark._jsparkSession.createDataset(listing, jvm.org.apache.spark.sql.Encoders.STRING()).toDF(), spark)
    plain = lambda c: F.regexp_replace(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")
    found = known.select(F.col("value").alias("file"), plain(F.col("value")).alias("plain"))
    found = found.join(listed.select(plain(F.col("file")).alias("plain")), "plain", "left_anti").select("file")
    return found.withColumn("extension", F.element_at(F.split(F.lower(F.element_at(F.split("file", "/"), -1)), r"\."), -1))


@dataclass(frozen=True)
class Held:
    """Cells of some files, and what the manifest knows of them.

    ``tags``: ``file, tag``, the kind of reading that counts for a file. ``names``: ``file, raw, column`` where cells hold a
    column's number. ``listing``: ``file, column`` as far as it is known without the cells. ``failed``: ``file, reason``.
    ``rows``: ``file, promised, batches`` where a file says how many rows it has. ``texts``: the cells of columns that can
    hold long texts, where others are known not to. ``size``: the number of cells, where files tell it. ``stripped``: whether
    cells are as the scanner sees them already.
    """

    cells: DataFrame
    tags: DataFrame
    names: DataFrame | None = None
    listing: DataFrame | None = None
    failed: DataFrame | None = None
    rows: DataFrame | None = None
    texts: DataFrame | None = None
    size: int = 0
    stripped: bool = False


def _lines(spark: SparkSession, path: Path, max_mb: float | None, *kinds: str) -> DataFrame:
    return within(reading(spark, *kinds).text(path), max_mb).select(
        F.col(FILE).alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("rid"), "value"
    )


def text_held(spark: SparkSession, path: Path, max_mb: float | None, files: DataFrame) -> Held:
    lines = _lines(spark, path, max_mb, "txt")
    cells = lines.select(F.col("file").alias("source"), F.lit("t:value").alias("column"), "value", "rid")
    own = files.where("extension = 'txt'").select("file")
    return Held(cells, own.withColumn("tag", F.lit("t")), listing=own.withColumn("column", F.lit("value")))


# --- delimited files ------------------------------------------------------------


def _quotes(value: Column) -> Column:
    return F.length(value) - F.length(F.replace(value, F.lit('"')))


def delimited_survey(lines: DataFrame) -> DataFrame:
    """``file, header, quoted``: the first line with text, and whether some record goes on in the next line.

    A record that starts outside quotes and ends inside them has an odd number of quotation marks.
    """
    first = F.when((F.col("at") == 0) & (F.trim("value") != ""), F.struct("rid", "value"))
    per = lines.groupBy("file").agg(F.min(first).alias("h"), F.max(_quotes(F.col("value")) % 2 == 1).alias("quoted"))
    return per.select("file", F.replace(F.col("h.value"), F.lit(_MARK), F.lit("")).alias("header"), "quoted")


def whole_records(lines: DataFrame) -> DataFrame:
    """``file, rid, value`` with lines joined to records; the lines of one file are read in order, by one task."""
    order = Window.partitionBy("file").orderBy("at", "rid")
    before = F.coalesce(F.sum(_quotes(F.col("value"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begun = lines.withColumn("begins", (before % 2 == 0).cast("int"))
    numbered = begun.withColumn("record", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = numbered.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("at", "rid", "value"))).alias("parts"))
    return joined.select("file", F.col("record").cast("long").alias("rid"), F.array_join("parts.value", "\n").alias("value")).where(F.trim("value") != "")


def _width(header: Column) -> Column:
    """Columns of a header line: separators outside quotes, and one."""
    bare = F.regexp_replace(header, r'"(?:[^"]|"")*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","))) + 1


def _wide(width: int) -> T.StructType:
    return T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])


def _as_array(width: int, record: Column) -> Column:
    return F.array(*[record[f"c{i}"] for i in range(width)])


def header_names(survey: DataFrame, width: int) -> DataFrame:
    """``file, place, column``: blank names are ``_c`` and the place, repeated ones get their place (letter case aside)."""
    parsed = F.from_csv("header", _wide(width).simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {"quote": '"', "escape": '"'})
    own = survey.where("header is not null").select("file", F.slice(_as_array(width, parsed), F.lit(1), _width(F.col("header"))).alias("names"))
    twice = lambda n: F.size(F.filter("names", lambda o: F.lower(o) == F.lower(n))) > 1
    shown = F.transform(
        "names",
        lambda n, i: F.when(F.coalesce(n, F.lit("")) == "", F.concat(F.lit("_c"), i)).when(twice(n), F.concat(n, i)).otherwise(n),
    )
    return own.select("file", F.posexplode(shown).alias("place", "column"))


def _numbered_cells(rows: DataFrame, tag: str) -> DataFrame:
    """Cells of ``file, rid, values``; missing tokens are no cells."""
    return (
        rows.select("file", "rid", F.posexplode("values").alias("place", "value"))
        .where(F.col("value").isNotNull() & ~F.col("value").isin(*NA_TOKENS))
        .select(F.col("file").alias("source"), F.concat(F.lit(f"{tag}:"), F.col("place").cast("string")).alias("column"), "value", "rid")
    )


def delimited_held(spark: SparkSession, path: Path, max_mb: float | None, files: DataFrame) -> Held:
    """All CSV files: those without quoted line breaks are split, the others are put together from their lines."""
    lines = _lines(spark, path, max_mb, "csv")
    survey = kept(delimited_survey(lines), "csv-survey")
    width, quoted = survey.agg(F.max(_width(F.col("header"))), F.max("quoted")).first()
    tags = survey.select("file", F.when(F.col("quoted"), "m").otherwise("s").alias("tag"))
    own = files.where("extension = 'csv'").select("file")
    blank = own.join(survey.where("header is not null").select("file"), "file", "left_anti")
    failed = blank.withColumn("reason", F.lit("File has no header line"))
    if not width:
        return Held(spark.createDataFrame([], CELLS), tags, failed=failed)
    options = {"header": "true", "quote": '"', "escape": '"', "multiLine": "false"}
    rows = within(reading(spark, "csv").options(**options).schema(_wide(width)).csv(path), max_mb)
    cells = _numbered_cells(
        rows.select(F.col(FILE).alias("file"), F.monotonically_increasing_id().alias("rid"), F.array(*[q(f"c{i}") for i in range(width)]).alias("values")), "s"
    )
    names = header_names(survey, width)
    if quoted:
        records = kept(whole_records(lines.join(survey.where("quoted").select("file"), "file", "left_semi")), "csv-records")
        first = records.groupBy("file").agg(F.min("rid").alias("first"), F.min_by("value", "rid").alias("header"))
        first = kept(first.withColumn("header", F.replace("header", F.lit(_MARK), F.lit(""))), "csv-headers")
        width = max(width, first.agg(F.max(_width(F.col("header")))).first()[0])
        parsed = F.from_csv("value", ", ".join(f"c{i} string" for i in range(width)), {"quote": '"', "escape": '"', "multiLine": "true"})
        body = records.join(first.select("file", "first"), "file").where("rid > first")
        cells = cells.unionByName(_numbered_cells(body.select("file", "rid", _as_array(width, parsed).alias("values")), "m"))
        whole = header_names(first, width)
        names = names.join(first.select("file"), "file", "left_anti").unionByName(whole)
    names = kept(names.select("file", F.col("place").cast("string").alias("raw"), "column"), "csv-names")
    return Held(cells, tags, names=names, listing=names.select("file", "column"), failed=failed)


# --- JSON -------------------------------------------------------------------------


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _depth(shape: Column) -> Column:
    """Levels of objects and lists in a shape text."""
    signs = F.regexp_extract_all(F.regexp_replace(shape, "`[^`]*`", ""), F.lit("<|>"), 0)
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(state: Column, sign: Column) -> Column:
        now = state["now"] + F.when(sign == "<", 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(state["most"], now).alias("most"))

    return F.aggregate(signs, start, step)["most"]


def json_survey(lines: DataFrame) -> DataFrame:
    """``file, tag, depth``: JSON Lines where every line of several is an object, else one document."""
    text = F.replace(F.col("value"), F.lit(_MARK), F.lit(""))
    parsed = F.try_parse_json(text)
    per = lines.where(F.trim(text) != "").groupBy("file").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(parsed.isNotNull() & F.ltrim(text).startswith("{")).alias("objects"),
        F.max(_depth(_kind(parsed))).alias("depth"),
    )
    return per.select("file", F.when((F.col("n") > 1) & (F.col("objects") == F.col("n")), "l").otherwise("d").alias("tag"), "depth")


def _entries(value: Column) -> Column:
    return F.map_entries(value.cast("map<string,variant>"))


def _records_of(document: Column) -> Column:
    """The records of a document: a list's elements, those under the first record key that holds a list, or itself."""
    is_list = lambda v: _kind(v).startswith("ARRAY")
    wrapped = F.when(F.lit(False), F.array(document))
    for key in RECORD_KEYS:
        inner = F.try_variant_get(document, f"$.{key}", "variant")
        wrapped = wrapped.when(is_list(inner), inner.cast("array<variant>"))
    return (
        F.when(is_list(document), document.cast("array<variant>"))
        .when(_kind(document).startswith("OBJECT"), F.coalesce(wrapped, F.array(document)))
    )


def _scalar_text(value: Column) -> Column:
    """Text of a variant as Python shows it; lists are JSON texts."""
    kind = _kind(value)
    number = as_text(F.try_variant_get(value, "$", "double"), T.DoubleType())
    return (
        F.when(kind == "VOID", None)
        .when(kind == "BOOLEAN", F.when(F.try_variant_get(value, "$", "boolean"), "True").otherwise("False"))
        # a whole number that fits a long and yet is a decimal was written with a point
        .when((kind == "DOUBLE") | (kind.startswith("DECIMAL") & (~kind.endswith(",0)") | F.try_variant_get(value, "$", "long").isNotNull())), number)
        .when(kind.startswith("ARRAY"), F.to_json(value))
        .otherwise(F.try_variant_get(value, "$", "string"))
    )


def json_cells(records: DataFrame, depth: int) -> DataFrame:
    """Cells of ``file, tag, rid, record``: nested objects become dotted names, level by level."""
    is_object = lambda v: _kind(v).startswith("OBJECT")
    record = F.col("record")
    top = F.when(is_object(record), _entries(record)).otherwise(F.array(F.struct(F.lit("0").alias("key"), record.alias("value"))))
    cells = records.select("file", "tag", "rid", F.explode(top).alias("e"))
    for _ in range(max(0, depth - 1)):
        inner = F.transform(_entries(F.col("e.value")), lambda x: F.struct(F.concat(F.col("e.key"), F.lit("."), x["key"]).alias("key"), x["value"].alias("value")))
        cells = cells.select("file", "tag", "rid", F.explode(F.when(is_object(F.col("e.value")), inner).otherwise(F.array("e"))).alias("e"))
    text = _scalar_text(F.col("e.value"))
    shown = cells.select("file", "tag", "rid", F.col("e.key").alias("name"), text.alias("value"))
    sign = F.when(F.col("value").isNull(), F.lit("!")).otherwise(F.lit(":"))
    return shown.select(
        F.col("file").alias("source"), F.concat("tag", sign, "name").alias("column"), F.coalesce("value", F.lit("1")).alias("value"), "rid"
    )


def json_held(spark: SparkSession, path: Path, max_mb: float | None, files: DataFrame) -> Held:
    lines = _lines(spark, path, max_mb, "json", "jsonl")
    survey = kept(json_survey(lines), "json-survey")
    depth, documents = survey.agg(F.max("depth"), F.count_if(F.col("tag") == "d")).first()
    text = F.replace(F.col("value"), F.lit(_MARK), F.lit(""))
    own = lines.where(F.ltrim(text).startswith("{")).select("file", F.lit("l").alias("tag"), "rid", F.try_parse_json(text).alias("record"))
    records = own.where(F.col("record").isNotNull())
    blank = files.where("extension in ('json', 'jsonl')").select("file").join(survey.select("file"), "file", "left_anti")
    failed = blank.withColumn("reason", F.lit("empty JSON file"))
    if documents:
        parts = lines.join(survey.where("tag = 'd'").select("file"), "file", "left_semi").groupBy("file").agg(
            F.array_sort(F.collect_list(F.struct("at", "rid", "value"))).alias("parts")
        )
        whole = F.replace(F.array_join("parts.value", "\n"), F.lit(_MARK), F.lit(""))
        read = parts.select("file", F.try_parse_json(whole).alias("document"))
        read = read.select("file", F.when(F.col("document").isNotNull(), _records_of(F.col("document"))).alias("records"), _depth(_kind("document")).alias("depth"))
        deep, bad = read.agg(F.max("depth"), F.count_if(F.col("records").isNull())).first()
        depth = max(depth or 0, deep or 0)
        if bad:
            unread = read.where(F.col("records").isNull()).select("file", F.lit("not a JSON object, list of objects, or JSON Lines file").alias("reason"))
            failed = failed.unionByName(kept(unread, "json-unread"))
        records = records.unionByName(
            read.select("file", F.lit("d").alias("tag"), F.posexplode("records").alias("place", "record")).select(
                "file", "tag", F.col("place").cast("long").alias("rid"), "record"
            )
        )
    return Held(json_cells(records, depth or 0), survey.select("file", "tag"), failed=failed)


# --- Parquet ----------------------------------------------------------------------


def _footer(file) -> tuple[str | None, tuple[str, ...] | None, str | None]:
    """Layout and column names by the footer at the end of a file, or what is wrong with it."""
    try:
        meta = pq.read_metadata(file)
        names = tuple(dict.fromkeys(meta.schema.column(i).path.split(".")[0] for i in range(meta.num_columns)))
        return str(meta.schema).split("\n", 1)[1], names, None
    except Exception as error:  # whatever is wrong with one file, the others are read
        return None, None, f"Parquet footer cannot be read: {str(error).splitlines()[0][:150]}"


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Layout and column names out of the last bytes of each file."""
    for batch in batches:
        found = [_footer(pa.BufferReader(tail.as_buffer())) for tail in batch.column("tail")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("file"), *(pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.list_(pa.string()), pa.string())))],
            ["file", "layout", "columns", "error"],
        )


class _Stream(io.RawIOBase):
    """A file of any store that Spark reads, read where it is asked for."""

    def __init__(self, stream, length: int):
        self.stream, self.length, self.place = stream, length, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.place

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.place = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.place, io.SEEK_END: self.length}[whence]
        return self.place

    def readinto(self, into) -> int:
        self.stream.seek(self.place)
        found = self.stream.readNBytes(min(len(into), self.length - self.place))
        into[: len(found)] = found
        self.place += len(found)
        return len(found)


def _large_footers(spark: SparkSession, files: list[tuple[str, int]]) -> DataFrame:
    """``file, layout, columns, error`` of files given by name and length, of which only the footers are read, by threads.

    A layout is held once, however many files have it.
    """
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()

    def read(file: tuple[str, int]) -> tuple:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file[0]))
        stream = path.getFileSystem(conf).open(path)
        try:
            return _footer(_Stream(stream, file[1]))
        finally:
            stream.close()

    known: dict[tuple, int] = {}
    with ThreadPoolExecutor(FOOTER_THREADS) as pool:
        numbered = [(name, known.setdefault(found, len(known))) for (name, _), found in zip(files, pool.map(read, files), strict=True)]
    layouts = spark.createDataFrame([(k, *found) for found, k in known.items()], "k long, layout string, columns array<string>, error string")
    return spark.createDataFrame(numbered, "file string, k long").join(F.broadcast(layouts), "k").drop("k")


def parquet_footers(spark: SparkSession, path: Path, max_mb: float | None) -> DataFrame:
    """``file, layout, columns, error`` of every Parquet file, by its own footer.

    Spark's reader cuts the footers out of files up to ``FOOTER_BYTES``; it cannot read a part of a file, so the driver asks
    the store for the last bytes of larger ones.
    """
    size = F.conv(F.concat(*[F.substring(F.hex(F.substring("content", -8, 4)), k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("int")
    every = within(reading(spark, "parquet").format("binaryFile").load(path), max_mb)
    raw = every.where(F.col("length") <= FOOTER_BYTES)
    tail = F.substring("content", -(F.least(size, F.col("length").cast("int") - 8) + 8), F.lit(FOOTER_BYTES))
    small = raw.select(F.col(FILE).alias("file"), tail.alias("tail")).mapInArrow(_footers, "file string, layout string, columns array<string>, error string")
    large = [tuple(r) for r in every.where(F.col("length") > FOOTER_BYTES).select(F.col(FILE), "length").collect()]
    return small.unionByName(_large_footers(spark, large)) if large else small


def _folder(file: Column) -> Column:
    return F.regexp_extract(file, r"^(.*)/[^/]*$", 1)


def _picked(df: DataFrame, folders: list[str], names: DataFrame | None) -> DataFrame:
    """Rows of the files in ``folders`` or named (``file``); a condition on the path alone, so Spark lists no others.

    The names, however many, go into the condition inside the JVM.
    """
    file = F.col(FILE)
    chosen = _folder(file).isin(folders)
    if names is not None:
        listing = getattr(names._jdf, "as")(df.sparkSession._jvm.org.apache.spark.sql.Encoders.STRING()).collectAsList()
        chosen = chosen | Column(file._jc.isInCollection(listing))
    return df.where(chosen)


#: Types whose texts never reach the length of a long one.
_SHORT = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _tagged_cells(df: DataFrame, tag: str, rows: int | None = None, texts_only: bool = False) -> DataFrame:
    """Stripped cells of a table and, for each batch of its columns, one more for every row read.

    Files of known ``rows`` are dealt to tasks by their cells: a compressed file may hold many more than one task should group.
    ``texts_only``: only cells of columns whose texts can be long.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    names = [n for n in types if not (texts_only and isinstance(types[n], _SHORT))]
    parts = [] if names or not texts_only else [df.sparkSession.createDataFrame([], CELLS)]
    for k in range(0, len(names) if texts_only else max(1, len(names)), COLUMNS_PER_BATCH):
        batch = names[k : k + COLUMNS_PER_BATCH]
        tags = {n: f"{tag}:{n}" for n in batch}
        wide = df.select(F.col(FILE).alias("__file"), F.monotonically_increasing_id().alias("__rid"), *[q(n).alias(t) for n, t in tags.items()])
        wide = wide if rows is None else dealt(wide, "__rid", rows * (len(batch) + 1))
        # numbers and times have nothing to strip
        texts = [(as_text(q(t), types[n]) if isinstance(types[n], _SHORT) else strip(as_text(q(t), types[n]))).alias(t) for n, t in tags.items()]
        wide = wide.select("__file", "__rid", *texts, *([] if texts_only else [F.lit("1").alias(f"{tag}={k}")]))
        columns = [q(t) for t in tags.values()] + ([] if texts_only else [q(f"{tag}={k}")])
        long = wide.unpivot(["__file", "__rid"], columns, "column", "value").where(F.col("value") != "")
        parts.append(long.select(F.col("__file").alias("source"), "column", "value", F.col("__rid").alias("rid")))
    return reduce(DataFrame.unionByName, parts)


def parquet_held(spark: SparkSession, path: Path, max_mb: float | None, files: DataFrame) -> Held:
    """All Parquet files, a read for each layout; damaged files end early and show it by the rows they miss."""
    footers = kept(parquet_footers(spark, path, max_mb), "footers").withColumn("folder", _folder(F.col("file")))
    failed = footers.where("error is not null").select("file", F.col("error").alias("reason"))
    sound = footers.where("error is null")
    groups = sound.groupBy("folder", "layout").agg(F.min("file").alias("one"))
    layouts: dict[str, list] = {}
    kinds: dict[str, int] = {}
    for r in groups.collect():  # a row for each table, not for each file
        layouts.setdefault(r["layout"], []).append(r)
        kinds[r["folder"]] = kinds.get(r["folder"], 0) + 1
    counted = within(reading(spark, "parquet").option("ignoreCorruptFiles", "true").schema("`no column` int").parquet(path), max_mb)
    promised = kept(counted.groupBy(F.col(FILE).alias("file")).agg(F.count(F.lit(1)).alias("promised")), "parquet-counts")
    many_rows = {r["layout"]: r["n"] for r in sound.join(promised, "file").groupBy("layout").agg(F.sum("promised").alias("n")).collect()}
    plain = spark.read.option("ignoreCorruptFiles", "true")
    cells, texts, size = spark.createDataFrame([], CELLS), spark.createDataFrame([], CELLS), 0
    listing, tags = [], sound.select("file", F.lit("p").alias("tag"))
    expected = []
    for layout, rows in layouts.items():
        schema = plain.parquet(rows[0]["one"]).schema
        read = reading(spark, "parquet").option("ignoreCorruptFiles", "true").schema(schema).parquet(path)
        folders = [r["folder"] for r in rows if kinds[r["folder"]] == 1]
        mixed = [r["folder"] for r in rows if kinds[r["folder"]] > 1]
        names = sound.where((F.col("layout") == layout) & F.col("folder").isin(mixed)).select("file") if mixed else None
        picked = _picked(read, folders, names)
        n = many_rows.get(layout, 0)
        cells = cells.unionByName(_tagged_cells(picked, "p", n))
        texts = texts.unionByName(_tagged_cells(picked, "p", n, texts_only=True))
        size += n * (len(schema.names) + 1)
        members = sound.where(F.col("layout") == layout).select("file")
        listing.append(members.select("file", F.explode(F.array(*[F.lit(n) for n in schema.names]).cast("array<string>")).alias("column")))
        expected.append(members.withColumn("batches", F.lit(-(-max(1, len(schema.names)) // COLUMNS_PER_BATCH))))
    rows = kept(reduce(DataFrame.unionByName, expected).join(promised, "file"), "parquet-rows") if expected else None
    return Held(cells, tags, listing=reduce(DataFrame.unionByName, listing) if listing else None, failed=failed, rows=rows, texts=texts, size=size, stripped=True)


def avro_held(spark: SparkSession, path: Path, max_mb: float | None, files: DataFrame) -> Held:
    own = files.where("extension = 'avro' and state = 'PENDING'").select("file")
    if not has_avro(spark):
        reason = F.lit("Avro needs the spark-avro module on the classpath")
        return Held(spark.createDataFrame([], CELLS), own.withColumn("tag", F.lit("a")), failed=own.withColumn("reason", reason))
    read = within(reading(spark, "avro").format("avro").load(path), max_mb)
    names = F.explode(F.array(*[F.lit(n) for n in read.columns]).cast("array<string>"))
    return Held(_tagged_cells(read, "a"), own.withColumn("tag", F.lit("a")), listing=own.select("file", names.alias("column")))


READERS = {("txt",): text_held, ("csv",): delimited_held, ("json", "jsonl"): json_held, ("parquet",): parquet_held, ("avro",): avro_held}


def held(spark: SparkSession, path: Path, max_mb: float | None, states: DataFrame) -> list[Held]:
    """What the readable files below a path hold, a part for each format that occurs."""
    there = {r["extension"] for r in states.where("state = 'PENDING'").select("extension").distinct().collect()}
    own = states.where("state = 'PENDING'")
    return [build(spark, path, max_mb, own) for kinds, build in READERS.items() if there & set(kinds)]


__all__ = ["list_files", "file_states", "empty_files", "held", "Held", "whole_records", "delimited_survey", "json_survey", "parquet_footers"]
