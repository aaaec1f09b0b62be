"""Writers for remediated tables and reports (SNK-1..6)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwarden.functions.text import as_text
from fieldwarden.functions.tokens import strategy_label
from fieldwarden.operators.remediate import RemediationResult
from fieldwarden.operators.remediate_files import FilesResult
from fieldwarden.operators.values import q
from fieldwarden.sources.readers import UnsupportedSource, has_avro
from fieldwarden.sources.scratch import kept


def as_text_table(df: DataFrame) -> DataFrame:
    return df.select(*[as_text(q(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """SNK-1."""
    as_text_table(df).write.mode(mode).csv(path, header=True, escape='"')


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """SNK-2; missing cells are written as null."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_text(df: DataFrame, path: str, mode: str = "errorifexists", order_by: str | None = None) -> None:
    """SNK-3: the first column; rows are put in key order when a key is given."""
    if not df.columns:
        raise ValueError("a text file needs a column")
    first = df.schema.fields[0]
    ordered = df.orderBy(q(order_by)) if order_by else df
    ordered.select(F.coalesce(as_text(q(first.name), first.dataType), F.lit("")).alias("value")).write.mode(mode).text(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """SNK-4."""
    df.write.mode(mode).parquet(path)


def write_avro(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """SNK-5: all fields nullable text."""
    if not has_avro(df.sparkSession):
        raise UnsupportedSource("Avro needs the spark-avro module on the classpath")
    as_text_table(df).write.mode(mode).format("avro").save(path)


WRITERS = {
    "csv": write_csv,
    "json": write_json_lines,
    "jsonl": write_json_lines,
    "txt": write_text,
    "parquet": write_parquet,
    "avro": write_avro,
}


def write_table(df: DataFrame, path: str, extension: str, mode: str = "errorifexists") -> None:
    if extension not in WRITERS:
        raise UnsupportedSource(f"unsupported output type: {extension}")
    WRITERS[extension](df, path, mode)


def write_bundle(
    results: dict[str, RemediationResult],
    out_dir: str,
    strategy: str = "redact",
    include_review: bool = True,
    extension: str | None = None,
    mode: str = "errorifexists",
) -> DataFrame:
    """SNK-6: remediated tables, the remediation report and a manifest in one directory.

    Every table is written once; its changed cells are counted while it is
    written.  Returns the remediation report.
    """
    if not results:
        raise ValueError("nothing to write")
    spark = next(iter(results.values())).data.sparkSession
    report = None
    for i, (file_name, result) in enumerate(results.items()):
        base = file_name.rsplit("/", 1)[-1]
        stem, _, own = base.rpartition(".") if "." in base else (base, "", "csv")
        data, watch = result.observed(f"remediation_{i}")
        write_table(data, f"{out_dir}/{stem}_cloud_ready.{extension or own}", extension or own, mode)
        audit = result.audit_of(watch)
        report = audit if report is None else report.unionByName(audit)
    write_csv(report, f"{out_dir}/remediation_report", mode)
    manifest = {
        "note": "Tables rewritten by the findings of a scan.",
        "strategy": strategy_label(strategy),
        "include_review_findings": include_review,
        "files": list(results),
    }
    spark.range(1, numPartitions=1).select(F.lit(json.dumps(manifest)).alias("value")).write.mode(mode).text(
        f"{out_dir}/anonymization_manifest"
    )
    return report


def write_files(
    result: FilesResult,
    out_dir: str,
    extension: str = "csv",
    include_review: bool = True,
    mode: str = "errorifexists",
) -> DataFrame:
    """SNK-6 for many files in one job: their rows under ``files/file=<name>_cloud_ready.<extension>``, report and manifest.

    Rows are dealt by file before they are written, large files over several tasks, so a file is not one part for each
    task that holds some of its rows. Names keep their folders; the manifest counts the files, ``anonymized_files`` lists
    them. Rows without a file name are in the partition that Spark names after nulls. Returns the remediation report.
    """
    if extension not in ("csv", "json", "jsonl", "parquet"):
        raise UnsupportedSource(f"unsupported output type: {extension}")
    spark = result.data.sparkSession
    name = q(result.source).cast("string")
    shown = F.when(name.isNotNull(), F.concat(F.regexp_replace(name, r"\.[^./]*$", ""), F.lit(f"_cloud_ready.{extension}")))
    own = result.data.drop(result.source)
    if "file" in own.columns:
        raise ValueError("a column named 'file' would clash with the folders' names")
    table = result.data.withColumn(result.source, shown).withColumnRenamed(result.source, "file").hint("rebalance", "file")
    table = as_text_table(table) if extension == "csv" else table
    writer = table.write.mode(mode).partitionBy("file")
    if extension == "csv":
        writer.csv(f"{out_dir}/files", header=True, escape='"')
    elif extension == "parquet":
        writer.parquet(f"{out_dir}/files")
    else:
        writer.option("ignoreNullFields", "false").json(f"{out_dir}/files")
    report = kept(result.audit, "files-report")
    write_csv(report, f"{out_dir}/remediation_report", mode)
    files = result.data.select(name.alias("value")).where("value is not null").distinct()
    files.write.mode(mode).text(f"{out_dir}/anonymized_files")
    manifest = F.to_json(
        F.struct(
            F.lit("Tables rewritten by the findings of a scan.").alias("note"),
            F.lit(result.strategy).alias("strategy"),
            F.lit(include_review).alias("include_review_findings"),
            F.col("files"),
        )
    )
    counted = spark.read.text(f"{out_dir}/anonymized_files").agg(F.count("*").alias("files"))
    counted.select(manifest.alias("value")).write.mode(mode).text(f"{out_dir}/anonymization_manifest")
    return report
