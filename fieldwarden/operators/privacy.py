"""Privacy checks computed from the data (PRV-1..4).

Questions that are often put to a reviewer or a hosted model with a few sample
values are answered here by a stated rule evaluated over the whole table.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldwarden.functions import patterns as P
from fieldwarden.functions.entities import RECOGNISERS
from fieldwarden.functions.patterns import DEFAULT_REGISTRY, PatternRegistry
from fieldwarden.functions.text import as_text, strip
from fieldwarden.operators.values import literal_rows, q

# Our rule: words in a column name that point at a person although no rule matches its values.
NAME_SYNONYMS = (
    "surname", "forename", "firstname", "lastname", "fullname", "maiden", "nickname", "contact", "cell", "fax",
    "telephone", "mail", "street", "city", "nationality", "citizenship", "gender", "sex", "religion", "ethnicity",
    "race", "salary", "income", "diagnosis", "patient", "birthday", "birthplace", "username", "handle", "latitude",
    "longitude",
)

# Our mapping: pattern or entity -> regulation, data category, obligation, severity.
REGULATION_SCHEMA = "pattern string, regulation string, category string, obligation string, severity string"
REGULATIONS = (
    ("email", "GDPR", "PII", "Contact data needs a lawful basis and must be erasable on request.", "MEDIUM"),
    ("email", "CCPA", "PII", "Consumers may ask for disclosure and deletion of contact data.", "MEDIUM"),
    ("phone", "GDPR", "PII", "Contact data needs a lawful basis and must be erasable on request.", "MEDIUM"),
    ("phone", "CCPA", "PII", "Consumers may ask for disclosure and deletion of contact data.", "MEDIUM"),
    ("ip", "GDPR", "Online identifier", "Online identifiers count as personal data.", "MEDIUM"),
    ("ip", "CCPA", "Online identifier", "Online identifiers count as personal information.", "MEDIUM"),
    ("ssn", "CCPA", "Sensitive Personal Data", "Government identifiers must be secured and their use limited.", "HIGH"),
    ("ssn", "HIPAA", "PHI", "Social security numbers must be removed for de-identification.", "HIGH"),
    ("credit_card", "CCPA", "Sensitive Personal Data", "Account access data must be secured and its use limited.", "HIGH"),
    ("credit_card", "GDPR", "PII", "Payment data needs appropriate technical protection.", "HIGH"),
    ("zip", "HIPAA", "PHI", "Geographic units below a state must be generalised for de-identification.", "LOW"),
    ("dob", "HIPAA", "PHI", "Dates of birth must be reduced to the year for de-identification.", "HIGH"),
    ("dob", "GDPR", "PII", "Birth dates need a lawful basis and minimisation.", "MEDIUM"),
    ("driver_license", "CCPA", "Sensitive Personal Data", "Government identifiers must be secured and their use limited.", "HIGH"),
    ("driver_license", "HIPAA", "PHI", "Licence numbers must be removed for de-identification.", "HIGH"),
    ("passport", "CCPA", "Sensitive Personal Data", "Government identifiers must be secured and their use limited.", "HIGH"),
    ("passport", "GDPR", "PII", "National identifiers need appropriate technical protection.", "HIGH"),
    ("routing_number", "CCPA", "PII", "Financial account data must be secured.", "MEDIUM"),
    ("bank_account", "CCPA", "Sensitive Personal Data", "Account access data must be secured and its use limited.", "HIGH"),
    ("bank_account", "HIPAA", "PHI", "Account numbers must be removed for de-identification.", "HIGH"),
    ("ein", "CCPA", "PII", "Tax identifiers of sole traders count as personal information.", "LOW"),
    ("PERSON", "GDPR", "PII", "Names need a lawful basis and must be erasable on request.", "MEDIUM"),
    ("PERSON", "HIPAA", "PHI", "Names must be removed for de-identification.", "HIGH"),
    ("LOCATION", "HIPAA", "PHI", "Geographic units below a state must be generalised for de-identification.", "MEDIUM"),
    ("LOCATION", "GDPR", "PII", "Location data needs a lawful basis.", "MEDIUM"),
    ("EMAIL_ADDRESS", "GDPR", "PII", "Contact data needs a lawful basis and must be erasable on request.", "MEDIUM"),
    ("PHONE_NUMBER", "GDPR", "PII", "Contact data needs a lawful basis and must be erasable on request.", "MEDIUM"),
    ("US_SSN", "HIPAA", "PHI", "Social security numbers must be removed for de-identification.", "HIGH"),
    ("CREDIT_CARD", "GDPR", "PII", "Payment data needs appropriate technical protection.", "HIGH"),
    ("IP_ADDRESS", "GDPR", "Online identifier", "Online identifiers count as personal data.", "MEDIUM"),
    ("UK_NHS", "GDPR", "Health data", "Health identifiers need explicit consent or another special basis.", "HIGH"),
)

# Our rule: readable description per format.
FORMAT_NAMES = {
    "email": "name@domain.tld",
    "ip": "dotted IPv4 address",
    "phone": "10-digit phone number",
    "ssn": "nine digits, optionally 3-2-4 dashed",
    "credit_card": "13 to 19 digits",
    "zip": "5-digit code, optionally +4",
    "dob": "M/D/YYYY date",
    "driver_license": "6 to 12 capitals or digits",
    "passport": "8 or 9 capitals or digits",
    "routing_number": "nine digits",
    "bank_account": "8 to 17 digits",
    "ein": "2-7 dashed digits",
}


def name_words(column: str) -> list[str]:
    """Lower-cased words of a column name (underscores, dots and camel case split)."""
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", column)
    return [w for w in re.split(r"[^A-Za-z0-9]+", spaced.lower()) if w]


def _text_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in set(skip)]


def embedded_hits(df: DataFrame, columns: Sequence[str] | None = None, entities: bool = True) -> DataFrame:
    """Rows holding an embedded rule or entity, per column: one pass of conditional counts."""
    names = list(columns) if columns is not None else _text_columns(df)
    rules = [(n, lambda v, c=P.CUES[n], rx=P.unicode_regex(rx): v.rlike(c) & v.rlike(rx)) for n, rx in P.EMBEDDED_RULES]
    if entities:
        rules += [(r.entity, r.found_in) for r in RECOGNISERS]
    aggregates, rows = [], []
    for i, c in enumerate(names):
        aggregates.append(F.count(q(c)).alias(f"n{i}"))
        for j, (pattern, hit) in enumerate(rules):
            aggregates.append(F.count_if(hit(q(c))).alias(f"h{i}_{j}"))
            rows.append(
                F.struct(
                    F.lit(c).alias("column"),
                    F.lit(pattern).alias("pattern"),
                    F.col(f"h{i}_{j}").alias("rows_hit"),
                    F.col(f"n{i}").alias("rows"),
                )
            )
    return df.agg(*aggregates).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def semantic_pii(df: DataFrame, known_columns: Sequence[str] = (), max_columns: int | None = None) -> DataFrame:
    """PRV-1: unflagged columns whose values embed personal data or whose name says so.

    Risk: HIGH from half of the values, MEDIUM from a tenth, LOW below; a
    telling name alone is MEDIUM.
    """
    names = _text_columns(df, known_columns)[:max_columns]
    if not names:
        return literal_rows(df.sparkSession, [], "column string, risk string, reason string")
    telling = {c: [w for w in name_words(c) if w in NAME_SYNONYMS] for c in names}
    words = literal_rows(
        df.sparkSession, [(c, w[0] if w else None) for c, w in telling.items()], "column string, word string"
    )
    hits = embedded_hits(df, names).withColumn("share", F.col("rows_hit") / F.col("rows"))
    best = hits.groupBy("column").agg(F.max(F.struct("share", "pattern")).alias("b"))
    share = F.coalesce(F.col("b.share"), F.lit(0.0))
    risk = (
        F.when(share >= 0.5, "HIGH")
        .when((share >= 0.1) | F.col("word").isNotNull(), "MEDIUM")
        .when(share > 0, "LOW")
    )
    reason = F.when(
        share > 0,
        F.format_string("%.1f%% of the values contain %s.", share * 100, F.col("b.pattern")),
    ).otherwise(F.concat(F.lit("The column name contains '"), F.col("word"), F.lit("'.")))
    return (
        words.join(best, "column", "left")
        .select("column", risk.alias("risk"), reason.alias("reason"))
        .where(F.col("risk").isNotNull())
    )


def regulation_table(spark) -> DataFrame:
    return literal_rows(spark, REGULATIONS, REGULATION_SCHEMA)


def regulatory_flags(findings: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """PRV-2: obligations that follow from the findings; LOW-confidence findings lower the severity."""
    table = mapping if mapping is not None else regulation_table(findings.sparkSession)
    # The default mapping is the fixed table above; a user's own is joined without a hint.
    table = F.broadcast(table) if mapping is None else table
    severity = F.when(F.col("confidence") == "LOW", "LOW").otherwise(F.col("severity"))
    return findings.select("column", "pattern", "confidence").distinct().join(table, "pattern").select(
        "column", "regulation", "category", "obligation", severity.alias("severity")
    ).distinct()


def _batches(groups: Sequence[Sequence[str]], sets: int, columns: int) -> list[list[list[str]]]:
    """Groups in runs of at most ``sets`` that involve at most ``columns`` columns."""
    out: list[list[list[str]]] = []
    seen: set[str] = set()
    for g in groups:
        if not out or len(out[-1]) >= sets or len(seen | set(g)) > columns:
            out.append([])
            seen = set()
        out[-1].append(list(g))
        seen |= set(g)
    return out


def k_anonymity(df: DataFrame, groups: Sequence[Sequence[str]], k: int = 5, sets_per_job: int = 64) -> DataFrame:
    """Class sizes of column groups: rows, classes, smallest class, rows in classes below ``k``.

    The rows are first counted once by all columns of a batch of groups, so the
    grouping sets expand counted classes rather than rows.
    """
    out = None
    for part in _batches(groups, sets_per_job, 60):
        columns = sorted({c for g in part for c in g})
        base = df.groupBy(*[q(c) for c in columns]).agg(F.count(F.lit(1)).alias("__n"))
        sized = base.groupingSets([[q(c) for c in g] for g in part], *[q(c) for c in columns]).agg(
            F.sum("__n").alias("__size"), F.grouping_id().alias("__gid")
        )
        summary = sized.groupBy("__gid").agg(
            F.sum("__size").alias("rows"),
            F.count(F.lit(1)).alias("classes"),
            F.min("__size").alias("min_class_size"),
            F.sum(F.when(F.col("__size") < k, F.col("__size")).otherwise(0)).alias("rows_below_k"),
        )
        # A set bit marks a column that is not part of the group.
        ids = {
            sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in g): sorted(g) for g in part
        }
        names = literal_rows(
            df.sparkSession, [(gid, ",".join(g)) for gid, g in ids.items()], "__gid long, columns string"
        )
        rows = summary.join(F.broadcast(names), "__gid").select(
            "columns", "rows", "classes", "min_class_size", "rows_below_k"
        )
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("share_below_k", F.col("rows_below_k") / F.col("rows"))


def quasi_columns(df: DataFrame, columns: Sequence[str] | None = None, max_distinct_share: float = 0.5) -> list[str]:
    """Columns that can take part in a group: more than one value, not close to unique."""
    names = list(columns) if columns is not None else list(df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    seen = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.approx_count_distinct(as_text(q(c), types[c])).alias(f"d{i}") for i, c in enumerate(names)],
    ).first()
    limit = max_distinct_share * seen["n"]
    # The estimate is off by a few per cent; columns that near the limit are counted exactly.
    near = [i for i in range(len(names)) if seen[f"d{i}"] <= 2 or abs(seen[f"d{i}"] - limit) <= 0.2 * limit]
    exact = (
        df.agg(*[F.count_distinct(as_text(q(names[i]), types[names[i]])).alias(f"d{i}") for i in near]).first().asDict()
        if near else {}
    )
    count = lambda i: exact.get(f"d{i}", seen[f"d{i}"])
    return [c for i, c in enumerate(names) if 1 < count(i) <= limit]


def quasi_identifiers(
    df: DataFrame, columns: Sequence[str] | None = None, k: int = 5, max_size: int = 2
) -> DataFrame:
    """PRV-3: column groups that leave rows in classes smaller than ``k``.

    Every group of two up to ``max_size`` usable columns is measured.  Risk:
    HIGH from 20 % of the rows, MEDIUM from 5 %, LOW below.
    """
    usable = quasi_columns(df, columns)
    groups = [g for size in range(2, max_size + 1) for g in combinations(sorted(usable), size)]
    if not groups:
        return literal_rows(df.sparkSession, [], "columns array<string>, risk string, reason string")
    share = F.col("share_below_k")
    return (
        k_anonymity(df, groups, k)
        .where(share > 0)
        .select(
            F.split("columns", ",").alias("columns"),
            F.when(share >= 0.2, "HIGH").when(share >= 0.05, "MEDIUM").otherwise("LOW").alias("risk"),
            F.format_string(
                "%d of %d rows share their values with fewer than " + str(k) + " rows.", "rows_below_k", "rows"
            ).alias("reason"),
        )
    )


def class_sizes(df: DataFrame, groups: Sequence[Sequence[str]], k: int = 5) -> DataFrame:
    """``place, rows, classes, min_class_size, rows_below_k`` of each column group, the group by its place in ``groups``.

    A row sends two hashes of its values for each group; they are counted in each task before the shuffle, whatever the
    other groups and columns hold. Null is a value of its own.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    columns = sorted({c for g in groups for c in g})
    texts = {c: f"__t{i}" for i, c in enumerate(columns)}
    wide = df.select(*[as_text(q(c), types[c]).alias(texts[c]) for c in columns])
    keys = []
    for i, group in enumerate(groups):
        parts = [x for c in group for x in (F.col(texts[c]).isNull(), F.col(texts[c]))]
        keys.append(F.struct(F.lit(i).alias("place"), F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit("second"), *parts).alias("b")))
    counted = wide.select(F.explode(F.array(*keys)).alias("r")).groupBy("r.place", "r.a", "r.b").agg(F.count(F.lit(1)).alias("size"))
    return counted.groupBy("place").agg(
        F.sum("size").alias("rows"),
        F.count(F.lit(1)).alias("classes"),
        F.min("size").alias("min_class_size"),
        F.sum(F.when(F.col("size") < k, F.col("size")).otherwise(0)).alias("rows_below_k"),
    )


def _next_level(groups: Sequence[tuple[str, ...]]) -> list[tuple[str, ...]]:
    """Groups one column larger all of whose parts are among ``groups`` (sorted tuples of one size)."""
    known = set(groups)
    heads: dict[tuple[str, ...], list[str]] = {}
    for g in sorted(groups):
        heads.setdefault(g[:-1], []).append(g[-1])
    joined = (head + pair for head, tails in heads.items() for pair in combinations(tails, 2))
    return [g for g in joined if all(g[:i] + g[i + 1 :] in known for i in range(len(g)))]


def minimal_quasi_identifiers(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    k: int = 5,
    threshold: float = 0.05,
    max_size: int | None = None,
    sets_per_job: int = 64,
) -> DataFrame:
    """PRV-3 for groups of any size: the smallest column groups that leave ``threshold`` of the rows in classes below ``k``.

    A class of a group lies within a class of each of its parts, so what identifies goes on to identify with more columns.
    The search goes up level by level and measures a group only if none of its parts identifies. The levels end with the
    groups; ``max_size`` ends them before. The driver holds the groups of a level, which are names, never classes.
    """
    spark = df.sparkSession
    names = sorted(columns if columns is not None else df.columns)
    level = [(c,) for c in names]
    found: list[tuple] = []
    while level and (max_size is None or len(level[0]) <= max_size):
        left = []
        for at in range(0, len(level), sets_per_job):
            some = level[at : at + sets_per_job]
            for r in class_sizes(df, some, k).orderBy("place").collect():
                group, share = some[r["place"]], r["rows_below_k"] / r["rows"]
                if share >= threshold:
                    risk = "HIGH" if share >= 0.2 else "MEDIUM" if share >= 0.05 else "LOW"
                    found.append((list(group), len(group), risk, r["rows"], r["classes"], r["min_class_size"], r["rows_below_k"]))
                else:
                    left.append(group)
        level = _next_level(left)
    schema = "columns array<string>, size int, risk string, rows long, classes long, min_class_size long, rows_below_k long"
    return spark.createDataFrame(found, schema)


def expected_formats(columns: Sequence[str], registry: PatternRegistry = DEFAULT_REGISTRY) -> dict[str, list[str]]:
    """Rules whose hint is a whole word of the column name."""
    out = {}
    for c in columns:
        words = set(name_words(c))
        rules = [r.name for r in registry if words & set(r.hints)]
        if rules:
            out[c] = rules
    return out


def format_rates(df: DataFrame, registry: PatternRegistry = DEFAULT_REGISTRY) -> DataFrame:
    """Share of filled values in the format the column name implies, with the first bad value by text."""
    types = {f.name: f.dataType for f in df.schema.fields}
    aggregates, rows = [], []
    for i, (c, rules) in enumerate(expected_formats(df.columns, registry).items()):
        value = strip(as_text(q(c), types[c]))
        filled = F.when(value != "", value)
        aggregates.append(F.count(filled).alias(f"n{i}"))
        for j, rule in enumerate(rules):
            ok = registry[rule].matches(filled)
            aggregates.append(F.count_if(ok).alias(f"m{i}_{j}"))
            aggregates.append(F.min(F.when(~ok, filled)).alias(f"b{i}_{j}"))
            rows.append(
                F.struct(
                    F.lit(c).alias("column"),
                    F.lit(rule).alias("pattern"),
                    F.col(f"n{i}").alias("values"),
                    F.col(f"m{i}_{j}").alias("matched"),
                    F.col(f"b{i}_{j}").alias("bad_example"),
                )
            )
    if not rows:
        return literal_rows(
            df.sparkSession, [],
            "column string, pattern string, values long, matched long, bad_example string, rate double",
        )
    return (
        df.agg(*aggregates)
        .select(F.explode(F.array(*rows)).alias("r"))
        .select("r.*")
        .where(F.col("values") > 0)
        .withColumn("rate", F.col("matched") / F.col("values"))
    )


def format_anomalies(df: DataFrame, threshold: float = 0.9, registry: PatternRegistry = DEFAULT_REGISTRY) -> DataFrame:
    """PRV-4: columns whose best implied format covers less than ``threshold`` of the values."""
    best = format_rates(df, registry).groupBy("column").agg(
        F.max(F.struct("rate", "pattern", "values", "matched", "bad_example")).alias("b")
    ).select("column", "b.*")
    described = F.lit(None).cast("string")
    for rule in registry:
        described = F.when(F.col("pattern") == rule.name, FORMAT_NAMES.get(rule.name, rule.name)).otherwise(described)
    rate = F.col("rate")
    return best.where(rate < threshold).select(
        "column",
        described.alias("expected_format"),
        F.concat(
            F.format_string("%d of %d values do not match, for example '", F.col("values") - F.col("matched"), "values"),
            F.coalesce("bad_example", F.lit("")),
            F.lit("'."),
        ).alias("observed_issue"),
        F.when(rate < 0.5, "HIGH").when(rate < 0.75, "MEDIUM").otherwise("LOW").alias("severity"),
    )


__all__ = [
    "embedded_hits", "semantic_pii", "regulatory_flags", "regulation_table", "k_anonymity", "quasi_columns",
    "quasi_identifiers", "expected_formats", "format_rates", "format_anomalies", "name_words", "Column",
]
