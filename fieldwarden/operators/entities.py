"""Entity scan over sampled values (ENT-1) and the hook for a user's own model (ENT-4)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldwarden.functions.entities import SPAN_TYPE, rule_spans
from fieldwarden.operators.values import SALT_BUCKETS, top_n, value_index
from fieldwarden.sources.scratch import kept

EXAMPLES = 5


def entity_udf(factory: Callable[[], Callable[[str], list[tuple[str, str, float]]]]) -> Callable[[Column], Column]:
    """Wrap a model as a span function.

    ``factory`` builds the model once per Python worker; the model maps one
    text to ``(entity, text, score)`` tuples.  A factory or a model that raises
    fails the task: a scan never reports "no entities" for texts nobody read.
    """

    @F.pandas_udf(SPAN_TYPE)
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for batch in batches:
            yield batch.map(
                lambda text: [] if text is None else [{"entity": e, "text": t, "score": float(s)} for e, t, s in model(text)]
            )

    return spans


def entity_values(cells: DataFrame, spans: Callable[[Column], Column] = rule_spans) -> DataFrame:
    """Distinct values ``source, column, rn, spans`` of ``source, column, value, rid`` cells.

    The built-in recognisers read texts over 256 characters before the shuffle, which then carries a digest and the
    spans instead of the text.  A user's model reads each distinct value once, after it.
    """
    value, keys = F.col("value"), ["source", "column"]
    if spans is not rule_spans:
        return value_index(cells).select(*keys, F.col("first_rid").alias("rn"), spans(value).alias("spans"))
    is_long = F.length(value) > 256
    early = cells.select(
        *keys, "rid", F.when(is_long, spans(value)).alias("early"),
        F.when(is_long, F.sha2(value, 256)).alias("digest"), F.when(~is_long, value).alias("value"),
    )
    index = early.groupBy(*keys, "value", "digest").agg(F.min("rid").alias("rn"), F.first("early", ignorenulls=True).alias("early"))
    return index.select(*keys, "rn", F.coalesce("early", spans(value)).alias("spans"))


def entity_hits(values: DataFrame, spans: Callable[[Column], Column] = rule_spans) -> DataFrame:
    """One row per span of ``(source, column, rn)`` rows with their ``spans``, or with a ``value`` to read.

    ``lead`` marks the first span of its entity type within a value.  The outer generator keeps the optimizer from
    deriving a filter on the spans, which would run the recognisers once more below it.
    """
    own = F.col("spans") if "spans" in values.columns else spans(F.col("value"))
    tagged = values.select(
        "source", "column", "rn",
        F.array_sort(
            F.transform(
                own,
                lambda s, i: F.struct(s["entity"].alias("entity"), i.alias("pos"), s["text"].alias("text"), s["score"].alias("score")),
            )
        ).alias("spans"),
    )
    exploded = tagged.select("source", "column", "rn", "spans", F.posexplode_outer("spans").alias("at", "s"))
    return exploded.where(F.col("at").isNotNull()).select(
        "source", "column", "rn", "s.*",
        ((F.col("at") == 0) | (F.get("spans", F.col("at") - 1)["entity"] != F.col("s.entity"))).alias("lead"),
    )


def entity_scan(values: DataFrame, spans: Callable[[Column], Column] = rule_spans, stored: bool = False) -> DataFrame:
    """ENT-1: values holding each entity type, top score, first distinct examples.

    ``stored`` keeps the distinct spans in the shared folder, so that both are sums over them. Spans collapse per distinct ``(entity, text)``, partially in each task, so a hot entity type never gathers its spans.
    """
    keys = ["source", "column", "entity"]
    # First position as one number (value, then span): fixed-width minima aggregate by hashing.
    packed = (F.col("rn").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(17,0)")).cast("decimal(38,0)") + F.col("pos")
    place = packed if isinstance(values.schema["rn"].dataType, T.IntegralType) else F.struct("rn", "pos")
    texts = entity_hits(values, spans).groupBy(*keys, "text").agg(
        F.count_if("lead").alias("values"), F.max("score").alias("score"), F.min(place).alias("at")
    )
    texts = kept(texts, "entity-texts") if stored else texts
    # Both branches name every column of ``texts``; that keeps their plans equal and the exchange shared.
    counts = texts.groupBy(*keys).agg(
        F.sum(F.when(F.col("at").isNotNull(), F.col("values"))).alias("matches"),
        F.round(F.max("score"), 3).alias("entity_score"),
    )
    examples = (
        top_n(texts, keys, [F.col("at")], EXAMPLES, ["text"], "k")
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("k", "text", "values", "score"))).alias("e"))
        .select(*keys, F.col("e.text").alias("examples"))
    )
    return counts.join(examples, keys)


__all__ = ["entity_udf", "entity_values", "entity_hits", "entity_scan", "EXAMPLES", "SALT_BUCKETS"]
