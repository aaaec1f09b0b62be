"""Tables as (source, column, value) rows, the value index, and row samples.

The *value index* - one row per distinct (source, column, value) with its row
count and first position - is the frame most operators share.  It is a plain
aggregation, so repeated values collapse before the shuffle and a hot value
costs one row per task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldwarden.functions.text import as_text, strip

SAMPLE_LIMIT = 500
# Fan-out of the first of two top-n levels: no task ever ranks a whole column.
SALT_BUCKETS = 16
COLUMNS_PER_BATCH = 50
#: Cells whose distinct ones a task groups, on either side of a shuffle; a small file can hold many more.
CELLS_PER_TASK = 2_000_000
#: Buckets whose first rows bound the place of the first rows of all.
BUCKETS = 64


def q(name: str) -> Column:
    """Column by literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def literal_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small driver-known table as a plan of literals (metadata only, never data)."""
    struct = T._parse_datatype_string(schema)
    if not rows:
        return spark.createDataFrame([], struct)
    items = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, struct.fields)])
        for row in rows
    ]
    return spark.range(1, numPartitions=1).select(F.explode(F.array(*items)).alias("r")).select("r.*")


def row_key(order_by: str | Sequence[str] | None, types: dict[str, T.DataType] | None = None) -> Column:
    """Row position: the caller's key columns, or reading order.

    Two integer columns of which at most one is long are packed into one
    number, because minima of fixed-width cells aggregate by hashing and those
    of structs by sorting.  Other compound keys stay structs.
    """
    if order_by is None:
        return F.monotonically_increasing_id()
    names = [order_by] if isinstance(order_by, str) else list(order_by)
    if len(names) == 1:
        return q(names[0])
    kinds = [(types or {}).get(n) for n in names]
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if len(names) == 2 and all(isinstance(k, whole) for k in kinds):
        longs = [isinstance(k, T.LongType) for k in kinds]
        if sum(longs) <= 1:
            width, shift = (1 << 64, 1 << 63) if longs[1] else (1 << 32, 1 << 31)
            number = lambda c: q(c).cast("decimal(20,0)")
            lit = lambda n: F.lit(str(n)).cast("decimal(20,0)")
            packed = (number(names[0]) * lit(width)).cast("decimal(38,0)") + (number(names[1]) + lit(shift))
            return packed.cast("decimal(38,0)")
    return F.struct(*[q(n) for n in names])


def long_form(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    order_by: str | Sequence[str] | None = None,
    source: str | Column = "",
) -> DataFrame:
    """Every cell as ``(source, column, value, rid)``; missing cells are dropped."""
    names = list(columns) if columns is not None else list(df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    tag = F.lit(source) if isinstance(source, str) else source
    out = None
    for start in range(0, len(names), COLUMNS_PER_BATCH):
        batch = names[start : start + COLUMNS_PER_BATCH]
        texts = [as_text(q(n), types[n]).alias(n) for n in batch]
        part = (
            df.select(tag.alias("__source"), row_key(order_by, types).alias("__rid"), *texts)
            .unpivot(["__source", "__rid"], [q(n) for n in batch], "column", "value")
            .where(F.col("value").isNotNull())
            .select(F.col("__source").alias("source"), "column", "value", F.col("__rid").alias("rid"))
        )
        out = part if out is None else out.unionByName(part)
    return out


def stripped_cells(cells: DataFrame) -> DataFrame:
    """Cells as the scanner sees them: stripped, blank ones dropped."""
    return cells.withColumn("value", strip(F.col("value"))).where(F.col("value") != "")


def value_index(cells: DataFrame) -> DataFrame:
    """Distinct cells: ``source, column, value, cnt, first_rid``."""
    return cells.groupBy("source", "column", "value").agg(
        F.count(F.lit(1)).alias("cnt"), F.min("rid").alias("first_rid")
    )


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, salt: Sequence[str], rank: str = "rn") -> DataFrame:
    """First ``n`` rows per key by ``order``, ranked in two levels.

    Level one ranks inside salted slices of each key, level two ranks at most
    ``n * SALT_BUCKETS`` survivors, so a key holding a third of all rows is
    still spread over many tasks.  Both levels keep exactly the rows a single
    ranking would keep.
    """
    slice_id = F.pmod(F.xxhash64(*[F.col(c) for c in salt]), F.lit(SALT_BUCKETS))
    inner = Window.partitionBy(*keys, slice_id).orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(*order)
    survivors = df.select("*", F.row_number().over(inner).alias(rank)).where(F.col(rank) <= n)
    return survivors.withColumn(rank, F.row_number().over(outer)).where(F.col(rank) <= n)


def near_first(df: DataFrame, keys: Sequence[str], place: str, n: int, salt: Sequence[str]) -> DataFrame:
    """``df`` without rows that cannot be among the first ``n`` per key by ``place``, found by sums instead of a ranking.

    The first rows of ``n`` buckets are ``n`` rows, so none behind the last of them counts; keys with rows in fewer buckets
    keep them all. ``df`` is read twice. Rows with a null key or place come first in a ranking, and stay.
    """
    bucket = F.pmod(F.xxhash64(*[F.col(c) for c in salt]), F.lit(BUCKETS))
    lowest = df.groupBy(*keys, bucket.alias("__bucket")).agg(F.min(place).alias("__low"))
    bounds = lowest.groupBy(*keys).agg(F.get(F.sort_array(F.collect_list("__low")), F.lit(n - 1)).alias("__bound"))
    # a row for each key
    near = df.join(F.broadcast(bounds), list(keys), "left")
    return near.where(F.col("__bound").isNull() | F.col(place).isNull() | (F.col(place) <= F.col("__bound"))).select(*df.columns)


def dealt(rows: DataFrame, at: str, cells: int) -> DataFrame:
    """``rows`` in as many tasks as their cells ask for, however few splits their files have; ``at`` differs by row."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-cells // CELLS_PER_TASK)), at)


def rows_in_files(df: DataFrame) -> int:
    """Rows of the Parquet files that ``df`` reads, by their footers alone; 0 where it reads none."""
    files = [re.sub(r"([\\\[\]{}*?])", r"\\\1", unquote(f)) for f in df.inputFiles() if f.endswith(".parquet")]
    return df.sparkSession.read.schema("`no column` int").parquet(*files).count() if files else 0


@contextmanager
def reducers(spark: SparkSession, wanted: int) -> Iterator[None]:
    """At least so many shuffle partitions for what is run inside; Spark puts small ones together again."""
    key = "spark.sql.shuffle.partitions"
    given = spark.conf.get(key)
    spark.conf.set(key, str(max(int(given), wanted)))
    try:
        yield
    finally:
        spark.conf.set(key, given)


def first_values(index: DataFrame, limit: int) -> DataFrame:
    """First ``limit`` distinct values per column in row order."""
    return top_n(
        index, ["source", "column"], [F.col("first_rid"), F.col("value")], limit, ["value"]
    ).select("source", "column", "value", "cnt", "rn")


def spread(df: DataFrame) -> DataFrame:
    """Deal a table over the cores when its files give fewer tasks than there are cores.

    Text rules are bound by processors, so one unsplittable small file should
    not be one task.  Large inputs have more splits than cores and stay as read.
    Meant for plain reads: asking a plan with shuffles for its splits would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    return df.repartition(cores) if splits < cores else df


def sample_values(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    limit: int = SAMPLE_LIMIT,
    order_by: str | Sequence[str] | None = None,
    source: str | Column = "",
) -> DataFrame:
    """PRD-3: first ``limit`` distinct non-blank values per column, with all their rows counted."""
    return first_values(value_index(stripped_cells(long_form(df, columns, order_by, source))), limit)


def first_cells(cells: DataFrame, n: int) -> DataFrame:
    """First ``n`` cells per column in row order, repeats included: ``source, column, values``."""
    return (
        top_n(cells, ["source", "column"], [F.col("rid"), F.col("value")], n, ["rid"])
        .groupBy("source", "column")
        .agg(F.sort_array(F.collect_list(F.struct("rn", "value"))).alias("rows"))
        .select("source", "column", F.col("rows.value").alias("values"))
    )


def hash_sample(df: DataFrame, key: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """SRC-12: uniform sample of at most ``n`` rows, the same rows on every run.

    Rows are ranked by a seeded digest of their key.  Each task keeps only its
    own best ``n`` and a cut on the digest's leading bits, derived from the row
    count, drops nearly all rows before any ranking.
    """
    if n < 1:
        raise ValueError("n must be positive")
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), q(key).cast("string")))
    total = df.count()
    if total > 100 * n:
        # Keep rows whose 32-bit digest prefix is below four times the needed share;
        # the prefix order agrees with the digest order, so the best n rows all stay.
        bound = min(0xFFFFFFFF, int(4.0 * n / total * 0x100000000))
        cut = df.where(digest <= F.lit(f"{bound:08x}" + "f" * 24))
        if cut.limit(n).count() == n:
            df = cut
    return df.withColumn("__d", digest).orderBy("__d", q(key)).limit(n).drop("__d")


def representative_sample(df: DataFrame, order_by: str, max_rows: int = 1000) -> DataFrame:
    """SRC-13: head, middle and tail rows in the order of a unique key (all rows when few).

    Each part narrows the key range first, so no global row numbering and no
    top-k over the whole table is needed.
    """
    total = df.count()
    if total <= max_rows:
        return df
    head = max_rows // 3
    middle = max_rows - 2 * head
    spans = ((0, head), (max(0, (total - middle) // 2), middle), (total - head, head))
    parts = [rows_between(df, order_by, total, start, length) for start, length in spans]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def rows_between(df: DataFrame, order_by: str, total: int, start: int, length: int, span: int = 1_000_000) -> DataFrame:
    """Rows ``start .. start + length - 1`` in key order.

    Approximate quantiles bracket the wanted rows from both sides; the exact
    number of rows below the bracket turns the global offset into a small one.
    """
    low, below, inside = None, 0, total
    frame = df
    while inside > span:
        accuracy = 10_000
        margin = 2.0 / accuracy
        lo_p = max(0.0, (start - below) / inside - margin)
        hi_p = min(1.0, (start - below + length) / inside + margin)
        lo, hi = frame.agg(
            F.percentile_approx(q(order_by), F.array(F.lit(lo_p), F.lit(hi_p)), F.lit(accuracy)).alias("b")
        ).first()["b"]
        low, narrowed = lo, frame.where(q(order_by).between(F.lit(lo), F.lit(hi)))
        count = narrowed.count()
        if count >= inside:
            break
        below = df.where(q(order_by) < F.lit(low)).count()
        frame, inside = narrowed, count
    return frame.orderBy(q(order_by).asc()).offset(start - below).limit(length)
