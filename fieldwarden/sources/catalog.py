"""Files as data: listing, size filter, directory scan, archives (SRC-9..11)."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldwarden.functions.entities import rule_spans
from fieldwarden.functions.patterns import DEFAULT_REGISTRY, PatternRegistry
from fieldwarden.operators.scan import ScanResult, distinct_cells, mask_tallies, masked_values, scan_cells, scan_sample, scan_tallies
from fieldwarden.operators.values import CELLS_PER_TASK, first_values, literal_rows, long_form, reducers, sample_values, stripped_cells, value_index
from fieldwarden.sources.manifest import empty_files, file_states, held, list_files
from fieldwarden.sources.readers import SUPPORTED, UnsupportedSource
from fieldwarden.sources.scratch import kept

# Members of these kinds hold one record per line (delimited ones below a header line).
LINE_MEMBERS = ("txt", "jsonl", "csv")
MEMBER_BATCH = 10_000
#: Bytes of files whose distinct cells one task groups after the shuffle, at most.
BYTES_PER_REDUCER = 32 << 20


@dataclass(frozen=True)
class PathScan:
    findings: DataFrame
    stats: DataFrame
    status: DataFrame


def scan_path(
    spark: SparkSession,
    path: str | Sequence[str],
    max_mb: float | None = None,
    sample_limit: int | None = None,
    entities: bool = True,
    spans=rule_spans,
    registry: PatternRegistry = DEFAULT_REGISTRY,
) -> PathScan:
    """SRC-9: scan every readable file below a path, one source per file.

    The names of files, their columns and the reasons of failures are tables from end to end (see
    :mod:`fieldwarden.sources.manifest`); the number of jobs follows the number of formats and Parquet layouts. Values are
    read once; the distinct ones, long texts as digests, and their tallies, a row for each file, column and rule, are kept in
    the shared folder: findings, statistics and status read them. Columns that can hold long texts are read once more for the
    entities, where the entity gate lets any through.

    A file that turns out to be damaged while it is scanned is reported as failed and gives no findings. Files that are
    empty, blank or of no known layout fail with the reason; a path without any readable file gives empty findings.
    """
    states = kept(file_states(list_files(spark, path), max_mb), "files")
    empty = empty_files(spark, path, states)
    if empty is not None:
        blank = empty.where(F.col("extension").isin(*SUPPORTED)).select(
            "file", "extension", F.lit(0).cast("long").alias("bytes"), F.lit(0.0).alias("size_mb"), F.lit("PENDING").alias("state"), F.lit("").alias("detail")
        )
        states = kept(states.unionByName(blank), "files")
    parts = held(spark, path, max_mb, states.where("bytes > 0"))
    if not parts:
        raise UnsupportedSource("no readable file was found")

    def stacked(name: str, schema: str) -> DataFrame:
        frames = [getattr(p, name) for p in parts if getattr(p, name) is not None]
        return reduce(DataFrame.unionByName, frames, spark.createDataFrame([], schema))

    cells = reduce(DataFrame.unionByName, [p.cells if p.stripped else stripped_cells(p.cells) for p in parts])
    tags = stacked("tags", "file string, tag string").select(F.col("file").alias("source"), "tag")
    names = stacked("names", "file string, raw string, column string").select(F.col("file").alias("source"), "raw", F.col("column").alias("given"))
    sign, raw = F.substring("column", 2, 1), F.expr("substring(column, 3)")

    def named(rows: DataFrame) -> DataFrame:
        """Cells' keys by the reading that counts for their file, with the column's ``name``."""
        own = rows.withColumn("tag", F.substring("column", 1, 1)).withColumn("raw", raw).join(tags, ["source", "tag"], "left_semi")
        shown = own.join(names, ["source", "raw"], "left").where(F.col("given").isNotNull() | ~F.col("tag").isin("s", "m"))
        return shown.withColumn("name", F.coalesce("given", "raw")).drop("tag", "raw", "given")

    if sample_limit is None:
        size = max(sum(p.size for p in parts) // CELLS_PER_TASK, (states.agg(F.sum("bytes")).first()[0] or 0) // BYTES_PER_REDUCER)
        with reducers(spark, size):
            masked = kept(masked_values(distinct_cells(cells, registry), registry), "cells")
        per_column, firsts = mask_tallies(masked, registry, stored=True)
        per_column, firsts = kept(per_column, "tallies"), kept(firsts, "examples")
    else:
        first = kept(first_values(value_index(cells), sample_limit), "samples")
        per_column, firsts = first.groupBy("source", "column").agg(F.sum("cnt").alias("total_rows")), None
    signs = named(per_column.where(sign != ":"))
    rows = stacked("rows", "file string, promised long, batches int")
    read = signs.where(F.substring("column", 2, 1) == "=").groupBy(F.col("source").alias("file")).agg(F.min("total_rows").alias("found"), F.count("*").alias("seen"))
    damaged = rows.join(read, "file", "left").where(
        (F.col("promised") > 0) & (F.col("found").isNull() | (F.col("found") < F.col("promised")) | (F.col("seen") < F.col("batches")))
    )
    none = states.where("state = 'PENDING' and bytes = 0").select("file", F.lit("File is empty").alias("reason"))
    failed = stacked("failed", "file string, reason string").unionByName(damaged.select("file", F.lit("File body cannot be read").alias("reason"))).unionByName(none)
    failed = kept(failed.groupBy("file").agg(F.min("reason").alias("reason")), "failed")
    gone = failed.select(F.col("file").alias("source"))
    own = named(per_column.where(sign == ":")).join(gone, "source", "left_anti")
    listing = stacked("listing", "file string, column string").select(F.col("file").alias("source"), "column")
    listing = listing.unionByName(own.select("source", F.col("name").alias("column")))
    listing = listing.unionByName(signs.where(F.substring("column", 2, 1) == "!").select("source", F.col("name").alias("column")))
    listing = listing.distinct().join(gone, "source", "left_anti")
    if sample_limit is None:
        texts = [(p.cells if p.texts is None else p.texts, p.stripped) for p in parts]
        texts = reduce(DataFrame.unionByName, [t if stripped else stripped_cells(t) for t, stripped in texts])
        result = scan_tallies(own, firsts, texts if spans is rule_spans else cells, listing, registry, entities, spans, masked)
    else:
        sample = named(first.where(sign == ":")).join(gone, "source", "left_anti").drop("column").withColumnRenamed("name", "column")
        result = scan_sample(sample, listing, registry, entities, spans)
    findings = kept(result.findings, "findings")
    stats = kept(result.build_stats(findings), "stats")
    status = (
        states.join(failed, "file", "left")
        .join(stats.withColumnRenamed("source", "file"), "file", "left")
        .select(
            "file",
            F.when(F.col("reason").isNotNull(), "FAILED").when(F.col("state") == "PENDING", "SUCCESS")
            .otherwise(F.col("state")).alias("state"),
            "size_mb",
            F.coalesce(
                "reason",
                F.when(
                    F.col("state") == "PENDING",
                    F.format_string("Scanned successfully with %d finding(s)", F.coalesce("findings", F.lit(0))),
                ),
                "detail",
            ).alias("details"),
        )
    )
    return PathScan(findings, stats, status)


def scan_many(results: Sequence[ScanResult]) -> ScanResult:
    """DET-6: findings and statistics of several scans."""

    def stacked(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    return ScanResult(stacked([r.findings for r in results]), lambda _: stacked([r.stats for r in results]))


def scan_tables(
    tables: dict[str, tuple[DataFrame, str | Sequence[str] | None]],
    columns: dict[str, Sequence[str]] | None = None,
    sample_limit: int | None = None,
    entities: bool = True,
    spans=rule_spans,
    registry: PatternRegistry = DEFAULT_REGISTRY,
) -> ScanResult:
    """DET-6 for tables given as ``name -> (frame, order)``: every distinct value, or the first of each column, in one plan.

    Without a sample limit, row keys of different types are compared as text only to choose examples.
    """
    chosen = {name: list((columns or {}).get(name) or df.columns) for name, (df, _) in tables.items()}
    parts = [
        stripped_cells(long_form(df, chosen[name], order_by, name)) if sample_limit is None
        else sample_values(df, chosen[name], sample_limit, order_by, name)
        for name, (df, order_by) in tables.items()
    ]
    if sample_limit is None and len({p.schema["rid"].dataType.simpleString() for p in parts}) > 1:
        numbers = all(isinstance(p.schema["rid"].dataType, T.NumericType) for p in parts)
        kind = "decimal(38,0)" if numbers else "string"
        parts = [p.withColumn("rid", F.col("rid").cast(kind)) for p in parts]
    sample = reduce(DataFrame.unionByName, parts)
    spark = next(iter(tables.values()))[0].sparkSession
    listing = literal_rows(
        spark, [(name, c) for name, names in chosen.items() for c in names], "source string, column string"
    )
    build = scan_cells if sample_limit is None else scan_sample
    return build(sample, listing, registry, entities, spans)


def expand_archives(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """SRC-10: lines of the supported members of ZIP archives: ``archive, member, line_no, line``.

    An archive is one sequential stream, so it is read by one task; its lines
    leave that task in small batches and are never held together.  Only member
    base names are kept, directories are skipped.
    """
    archives = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.zip")
        .load(path)
        .select("path", "content")
    )
    schema = pa.schema(
        [("archive", pa.string()), ("member", pa.string()), ("line_no", pa.int64()), ("line", pa.string())]
    )

    def batch(archive: str, member: str, start: int, found: list[str]) -> pa.RecordBatch:
        count = len(found)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([archive] * count, pa.string()),
                pa.array([member] * count, pa.string()),
                pa.array(range(start, start + count), pa.int64()),
                pa.array(found, pa.string()),
            ],
            schema=schema,
        )

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for archive, content in zip(rows.column(0).to_pylist(), rows.column(1)):
                with zipfile.ZipFile(io.BytesIO(memoryview(content.as_buffer()))) as bundle:
                    for info in bundle.infolist():
                        member = info.filename.rsplit("/", 1)[-1]
                        if info.is_dir() or member.lower().rsplit(".", 1)[-1] not in LINE_MEMBERS:
                            continue
                        with bundle.open(info) as stream:
                            text = io.TextIOWrapper(stream, encoding="utf-8-sig", errors="replace")
                            found: list[str] = []
                            start = 0
                            for line in text:
                                found.append(line.rstrip("\r\n"))
                                if len(found) == MEMBER_BATCH:
                                    yield batch(archive, member, start, found)
                                    start, found = start + len(found), []
                            if found:
                                yield batch(archive, member, start, found)

    return archives.mapInArrow(expand, "archive string, member string, line_no long, line string")


__all__ = [
    "list_files", "file_states", "scan_path", "scan_many", "scan_tables", "expand_archives", "PathScan",
]
