"""Remediation of streams (STR-1)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from fieldwarden.operators.remediate import DEFAULT_SALT, remediate


def remediate_stream(
    stream: DataFrame,
    findings: DataFrame,
    mode: str = "redact",
    salt: str = DEFAULT_SALT,
    patterns: Iterable[str] | None = None,
    **options,
) -> DataFrame:
    """Rewrite a stream with findings of a finished scan; stateless, so any output mode works."""
    if not stream.isStreaming:
        raise ValueError("remediate_stream needs a streaming table; use remediate for batches")
    return remediate(stream, findings, mode, salt, patterns=patterns, **options).data


def write_remediated(stream: DataFrame, path: str, checkpoint: str, file_format: str = "parquet") -> DataStreamWriter:
    """Append-only writer; the checkpoint must be in shared storage."""
    return stream.writeStream.format(file_format).outputMode("append").option("path", path).option(
        "checkpointLocation", checkpoint
    )
