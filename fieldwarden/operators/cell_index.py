"""One reading of a table for several checks: a stored index of its distinct cells (QLT-7).

The index has a row for each column and distinct text, with the rows that hold it, the first of them, and for texts over
256 characters a digest and what the checks ask of such texts. Scan, completeness, suites and generated checks are sums over
its rows. The table itself is read again only for what the index cannot tell: the first offending rows of failed checks (one
pass for all suites), entities in texts, and checks by rules of the caller's own on columns with long texts.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldwarden.functions.entities import rule_spans
from fieldwarden.functions.patterns import DEFAULT_REGISTRY, PatternRegistry
from fieldwarden.functions.text import has_more_than_three_words, strip
from fieldwarden.operators.autogen import DATE_VALUE, NUMERIC_VALUE, TRIMMED_TEXT
from fieldwarden.operators.expectations import (
    BETWEEN,
    EXAMPLES,
    IN_SET,
    LENGTHS,
    REGEX,
    Expectation,
    Prepared,
    bad_examples,
    duplicate_counts,
    python_search,
    suite_layout,
    unexpected,
)
from fieldwarden.operators.profile import NUMERIC_TEXT
from fieldwarden.operators.quality import PLACEHOLDERS
from fieldwarden.operators.scan import ScanResult, column_list, scan_tallies, value_tallies
from fieldwarden.operators.values import CELLS_PER_TASK, dealt, long_form, near_first, reducers, row_key, rows_in_files, stripped_cells, top_n
from fieldwarden.sources.scratch import kept

LONG = 256
#: Rules whose answer is kept for long texts.
KNOWN = (DATE_VALUE, NUMERIC_VALUE, TRIMMED_TEXT)
_ROWS, _RID, _AT = "\u0000rows", "\u0000rid", "\u0000at"


def _numeric(text: Column) -> Column:
    return F.regexp_extract(text, r"(?U)\A(?:" + NUMERIC_TEXT + r"\z|)", 0) != ""


class CellIndex:
    """The stored index of ``df``; building it is the only full reading of the table.

    Rows of Parquet files are dealt to tasks by the number that the footers tell, as a small file can hold millions of cells.
    """

    def __init__(
        self, df: DataFrame, order_by: str | Sequence[str] | None = None, registry: PatternRegistry = DEFAULT_REGISTRY
    ):
        self.table, self.order_by, self.registry = df, order_by, registry
        self.types = {f.name: f.dataType for f in df.schema.fields}
        self.names = list(self.types)
        value, bare = F.col("value"), F.col("stripped")
        is_long, bare_long = F.length(value) > LONG, F.length(bare) > LONG
        early = F.when(is_long & bare_long, registry.mask(bare))
        flags = F.lit(0).cast("long")
        for i, answer in enumerate([_numeric(value), *(value.rlike(python_search(rx)) for rx in KNOWN)]):
            flags = flags.bitwiseOR(F.when(answer, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
        size = rows_in_files(df) * (len(self.names) + 1)
        placed = df.select("*", row_key(order_by, self.types).alias(_RID), F.monotonically_increasing_id().alias(_AT))
        self.dealt = (dealt(placed, _AT, size) if size else placed).drop(_AT)
        marked = self.dealt.withColumn(_ROWS, F.lit("1"))
        cells = long_form(marked, [*self.names, _ROWS], _RID).select("*", strip(value).alias("stripped"))
        cells = cells.select("*", early.alias("early"))
        keyed = cells.select(
            "column", "rid", "early",
            F.when(~is_long, value).alias("value"),
            F.when(is_long, F.sha2(value, 256)).alias("digest"),
            F.when(is_long & (~bare_long | (F.col("early") > 0)), bare).alias("bare"),
            F.when(is_long & bare_long, F.sha2(bare, 256)).alias("bare_digest"),
            F.length(value).alias("chars"),
            F.when(is_long, F.length(bare)).alias("bare_chars"),
            F.when(is_long, has_more_than_three_words(bare).cast("int")).alias("wordy"),
            F.when(is_long, flags).alias("flags"),
        )
        grouped = keyed.groupBy("column", "value", "digest", "bare", "bare_digest").agg(
            F.count(F.lit(1)).alias("cnt"), F.min("rid").alias("first_rid"),
            *[F.max(c).alias(c) for c in ("early", "chars", "bare_chars", "wordy", "flags")],
        )
        with reducers(df.sparkSession, size // CELLS_PER_TASK):
            self.index = kept(grouped, "cell-index")

    @cached_property
    def cells(self) -> DataFrame:
        return self.index.where(F.col("column") != _ROWS)

    @cached_property
    def summary(self) -> dict[str, dict]:
        """A row for each column: filled cells, long ones, lengths, blanks, placeholders, numeric texts."""
        value, n = F.col("value"), F.col("cnt")
        bare = strip(value)
        count = lambda condition: F.coalesce(F.sum(F.when(condition, n)), F.lit(0))
        rows = self.index.groupBy("column").agg(
            F.sum("cnt").alias("filled"),
            count(value.isNull()).alias("long"),
            F.sum(n * F.col("chars")).cast("double").alias("total"),
            F.sum(n * F.col("chars").cast("decimal(19,0)") * F.col("chars")).alias("squares"),
            count((bare == "") | (F.col("bare_chars") == 0)).alias("blanks"),
            count(F.lower(bare).isin(*PLACEHOLDERS)).alias("placeholders"),
            count(_numeric(value) | (F.getbit("flags", F.lit(0)) == 1)).alias("numeric"),
            count(value.isNull() & (n > 1)).alias("long_repeated"),
        )
        return {r["column"]: r.asDict() for r in rows.collect()}

    @property
    def rows(self) -> int:
        return self.summary.get(_ROWS, {}).get("filled", 0)

    def _of(self, column: str, field: str) -> int:
        return self.summary.get(column, {}).get(field) or 0

    def scan(self, source: str, entities: bool = True, spans: Callable[[Column], Column] = rule_spans) -> ScanResult:
        """DET-5; the entity pass, if any finding asks for it, reads the texts of the table again."""
        value = F.col("value")
        short = value.isNotNull()
        own = self.cells.select(
            F.lit(source).alias("source"), "column", "cnt", "first_rid", "early",
            F.when(short, strip(value)).otherwise(F.col("bare")).alias("value"),
            F.col("bare_digest").alias("digest"),
            F.when(short, F.length(strip(value))).otherwise(F.col("bare_chars")).alias("chars"),
            F.when(short, has_more_than_three_words(strip(value)).cast("int")).otherwise(F.col("wordy")).alias("wordy"),
        )
        index = own.where("chars > 0").groupBy("source", "column", "value", "digest").agg(
            F.sum("cnt").alias("cnt"), F.min("first_rid").alias("first_rid"), F.max("early").alias("early"),
            F.max("chars").alias("chars"), F.max("wordy").alias("wordy"),
        )
        per_column, firsts = value_tallies(index, self.registry)
        cells = stripped_cells(long_form(self.table, self.names, self.order_by, source))
        listing = column_list(self.table, source, self.names)
        return scan_tallies(per_column.withColumn("name", F.col("column")), firsts, cells, listing, self.registry, entities, spans)

    def completeness_rates(self) -> DataFrame:
        """QLT-3: null, blank and placeholder cells of each column."""
        text = lambda c: isinstance(self.types[c], T.StringType)
        rows = [
            (c, self.rows, self.rows - self._of(c, "filled"), self._of(c, "blanks") if text(c) else 0, self._of(c, "placeholders") if text(c) else 0)
            for c in self.names
        ]
        return self.table.sparkSession.createDataFrame(rows, "column string, rows long, nulls long, blanks long, placeholders long")

    def suite_facts(self) -> dict:
        """What the suite for a raw table asks: filled cells, mean and deviation of lengths."""
        facts = {}
        for i, c in enumerate(self.names):
            n = facts[f"n_{i}"] = self._of(c, "filled")
            if n and isinstance(self.types[c], T.StringType):
                total, squares = int(self.summary[c]["total"]), int(self.summary[c]["squares"])
                facts[f"mean_{i}"] = total / n
                # whole numbers until the last step, so nothing cancels
                facts[f"std_{i}"] = ((n * squares - total * total) / (n * (n - 1))) ** 0.5 if n > 1 else None
        return facts

    def numeric_shares(self) -> dict[str, float]:
        return {c: self._of(c, "numeric") / self._of(c, "filled") if self._of(c, "filled") else 0.0 for c in self.names}

    def _typed(self, column: str) -> tuple[Column, T.DataType]:
        """A column's cells of the index in a type that checks treat as they treat the column's own."""
        dtype = self.types[column]
        if isinstance(dtype, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            return F.col("value").cast(dtype), dtype
        return F.col("value"), T.StringType()

    def _answers(self, spec: Expectation) -> bool:
        """Whether the index can tell a long text's answer."""
        if spec.type in (LENGTHS, IN_SET) or not self._of(spec.column, "long"):
            return True
        return spec.type == REGEX and spec.kwargs["regex"] in KNOWN

    def _bad(self, spec: Expectation, place: int) -> Column:
        own = replace(spec, column=f"__c{place}")
        _, dtype = self._typed(spec.column)
        if spec.type == LENGTHS:
            low, high = spec.kwargs.get("min_value"), spec.kwargs.get("max_value")
            wrong = (F.col("chars") < F.lit(low)) if low is not None else F.lit(False)
            long_bad = wrong | (F.col("chars") > F.lit(high)) if high is not None else wrong
        elif spec.type == IN_SET:
            members = [hashlib.sha256(str(v).encode()).hexdigest() for v in spec.kwargs["value_set"] if len(str(v)) > LONG]
            long_bad = ~F.col("digest").isin(members) if members else F.lit(True)
        elif spec.type == REGEX and spec.kwargs["regex"] in KNOWN:
            long_bad = F.getbit("flags", F.lit(1 + KNOWN.index(spec.kwargs["regex"]))) == 0
        else:
            long_bad = F.lit(False)
        here = F.col("column") == spec.column
        return here & F.when(F.col("value").isNull(), long_bad).otherwise(unexpected(own, dtype))

    def prepared(self, suites: dict[str, Sequence[Expectation]]) -> dict[str, Prepared]:
        """Counts and offending rows of several suites: sums over the index, and one more pass over the table for rows."""
        spark = self.table.sparkSession
        layouts = {name: suite_layout(suite, self.types) for name, suite in suites.items()}
        specs = [(name, i, s) for name, (cell_specs, _) in layouts.items() for i, s in cell_specs.items()]
        place = {c: k for k, c in enumerate(sorted({s.column for _, _, s in specs}))}
        wide = self.cells.select("*", *[F.when(F.col("column") == c, self._typed(c)[0]).alias(f"__c{k}") for c, k in place.items()])
        told = [(name, i, s) for name, i, s in specs if self._answers(s)]
        bad: dict[tuple[str, int], int] = {}
        if told:
            sums = [F.coalesce(F.sum(F.when(self._bad(s, place[s.column]), F.col("cnt"))), F.lit(0)).alias(f"b{k}") for k, (_, _, s) in enumerate(told)]
            counted = wide.agg(*sums).first()
            bad = {(name, i): counted[f"b{k}"] for k, (name, i, _) in enumerate(told)}
        left = [(name, i, s) for name, i, s in specs if (name, i) not in bad]
        if left:
            counted = self.table.agg(*[F.count_if(unexpected(s, self.types[s.column])).alias(f"b{k}") for k, (_, _, s) in enumerate(left)]).first()
            bad |= {(name, i): counted[f"b{k}"] for k, (name, i, _) in enumerate(left)}
        failing = [(name, i, s) for name, i, s in specs if bad[name, i]]
        rows = None
        if failing:
            rows = kept(bad_examples(self.dealt, {k: s for k, (_, _, s) in enumerate(failing)}, self.types, _RID), "bad-rows")
        out = {}
        for name, (cell_specs, position) in layouts.items():
            values = {"n": self.rows} | {f"missing_{k}": self.rows - self._of(c, "filled") for c, k in position.items()}
            values |= {f"bad_{i}": bad[name, i] for i in cell_specs}
            totals = spark.range(1, numPartitions=1).select(*[F.lit(v).cast("long").alias(k) for k, v in values.items()])
            mine = {k + 1: i + 1 for k, (owner, i, _) in enumerate(failing) if owner == name}
            shown = spark.createDataFrame([], "index int, bad_values array<string>")
            if mine:
                renamed = F.create_map(*[F.lit(x) for pair in mine.items() for x in pair])[F.col("index")]
                shown = rows.where(F.col("index").isin(list(mine))).withColumn("index", renamed)
            out[name] = Prepared(totals, self._duplicates, shown)
        return out

    def _duplicates(self, columns: Sequence[str]) -> DataFrame:
        """EXP-4 from the index; columns that repeat long texts, whose examples it does not hold, from the table."""
        long = [c for c in columns if self._of(c, "long_repeated")]
        repeated = self.cells.where(F.col("column").isin([c for c in columns if c not in long]) & (F.col("cnt") > 1))
        totals = repeated.groupBy("column").agg(F.sum("cnt").alias("duplicates"))
        firsts = (
            top_n(
                near_first(repeated.select("column", "value", "first_rid"), ["column"], "first_rid", EXAMPLES, ["value"]),
                ["column"], [F.col("first_rid"), F.col("value")], EXAMPLES, ["value"], "k",
            )
            .groupBy("column")
            .agg(F.sort_array(F.collect_list(F.struct("k", "value"))).alias("e"))
            .select("column", F.col("e.value").alias("duplicate_values"))
        )
        found = totals.join(firsts, "column")
        return found.unionByName(duplicate_counts(self.table, long, self.order_by)) if long else found


def described(specs: Sequence[Expectation]) -> str:
    """A suite as text, to compare suites."""
    return json.dumps([(s.type, s.params) for s in specs])


__all__ = ["CellIndex", "described"]
