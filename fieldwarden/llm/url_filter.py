"""URL filter: fixed host and path rules first, then association rules that Spark's FP-growth mines from labelled URLs.

1. A URL is split into host (after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased) and path (then
   up to ``?``, ``#`` or the end). A fixed rule fits its host and all subdomains if the path starts with the rule's path;
   the longest rule wins, then the longer host, then the smaller text.
2. Labelled URLs (a bounded sample of at most about ``SAMPLE`` rows, chosen by a hash) become transactions: their tokens
   and their label. FP-growth finds frequent combinations; association rules with a label as consequent stay if they have
   the wanted support and confidence and no part of their tokens gives the same label as surely.
3. Rules are indexed by their rarest token. A URL looks up its own tokens, checks the rules found there for the rest of
   their tokens, and takes the surest rule (then more support, then block before allow, then the smaller text). Where no
   rule matches, the default verdict holds.

A transaction keeps its ``ITEMS`` tokens that say most about the label, as FP-growth lists every combination; rules match on
all tokens of a URL, whatever its length. With ``ITEMS`` tokens and a minimum support s there are at most 2^ITEMS / s
frequent combinations, which bounds the index that goes to the tasks.

A null or empty URL and one without ``://`` have an empty host and path, fit no fixed rule and no mined one with a token,
and get the default verdict. Repeated rows get equal results. Rows with a null url or label teach nothing; without labelled
rows nothing is mined. Extra columns are ignored unless named in ``carry``. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwarden.llm.shared import record_batch, stored, with_carried

ALLOW, BLOCK = "allow", "block"
#: About the most labelled rows that are learned from.
SAMPLE = 200_000
#: Tokens of a transaction, least share of transactions and least confidence of a rule.
ITEMS, SUPPORT, CONFIDENCE = 10, 0.005, 0.9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LABEL = "label="
_NUMBER = re.compile(r"[0-9]+")


def host_of(url: Column) -> Column:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    at = F.locate("://", url)
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)


def fixed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The ``struct(rule, verdict)`` of the rule that wins, or null; ``rules`` are few: (verdict, ``host/path``)."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), -len(r[1].partition("/")[0]), r[1]))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in reversed(ordered):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens(url: str | None) -> list[str]:
    """Scheme, port, host parts by their place from the right, path parts by their place and parameter names.

    Digits in path parts count as one sign, so that pages of one kind share a token.
    """
    scheme, found, rest = (url or "").partition("://")
    if not found:
        return []
    rest, _, fragment = rest.partition("#")
    rest, _, query = rest.partition("?")
    host, _, path = rest.partition("/")
    host, _, port = host.translate(str.maketrans(UPPER, LOWER)).partition(":")
    out = {f"scheme={scheme.lower()}"}
    if port:
        out.add(f"port={port}")
    parts = host.split(".")
    out.update(f"host{k}={part}" for k, part in enumerate(reversed(parts), 1))
    out.update(f"domain={'.'.join(parts[-k:])}" for k in (2, 3) if len(parts) >= k)
    for k, part in enumerate(p for p in path.split("/") if p):
        out.add(f"path{min(k, 3)}={_NUMBER.sub('0', part)}")
    out.update(f"key={pair.partition('=')[0]}" for pair in query.split("&") if pair)
    if fragment:
        out.add("fragment")
    return sorted(out)


def _tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [tokens(u) for u in batch.column("url").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.list_(pa.string()))], ["label", "tokens"])


def mined_rules(
    labelled: DataFrame,
    support: float = SUPPORT,
    confidence: float = CONFIDENCE,
    items: int = ITEMS,
    sample: int = SAMPLE,
) -> DataFrame:
    """``tokens, verdict, confidence, support, key`` from rows of ``url, label``; ``key`` is the rule's rarest token."""
    known = labelled.select(F.col("url").cast("string").alias("url"), F.col("label").cast("string").alias("label")).dropna()
    total = known.count()
    if total > sample:
        known = known.filter(F.pmod(F.xxhash64("url", "label"), F.lit(1 << 30)) < int((1 << 30) * sample / total))
    seen = stored(known.mapInArrow(_tokenised, "label string, tokens array<string>"), "tokens")
    n = seen.count()
    schema = "tokens array<string>, verdict string, confidence double, support double, key string"
    if not n:
        return labelled.sparkSession.createDataFrame([], schema)
    single = seen.select("label", F.explode("tokens").alias("token")).groupBy("token", "label").agg(F.count("*").alias("n"))
    per = single.groupBy("token").agg(F.sum("n").alias("count"), F.max("n").alias("most"), F.max_by("label", F.struct("n", "label")).alias("leads"))
    rates = seen.groupBy("label").agg((F.count("*") / n).alias("rate")).withColumnRenamed("label", "leads")
    # how far the token's leading label stands above its share, in standard deviations
    told = (F.col("most") / F.col("count") - F.col("rate")) * F.sqrt("count")
    frequent = stored(per.filter(F.col("count") >= support * n).join(rates, "leads").select("token", "count", told.alias("told")), "frequent")
    own = seen.withColumn("row", F.monotonically_increasing_id())
    kept = (
        own.select("row", F.explode("tokens").alias("token"))
        .join(frequent, "token")
        .groupBy("row")
        .agg(F.slice(F.sort_array(F.collect_list(F.struct("told", "token")), asc=False), 1, items).alias("best"))
    )
    lines = stored(own.join(kept, "row").select(F.concat(F.col("best.token"), F.array(F.concat(F.lit(_LABEL), "label"))).alias("items")), "transactions")
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(lines)
    label = F.element_at("consequent", 1)
    rules = model.associationRules.filter(label.startswith(_LABEL)).select(
        F.array_sort("antecedent").alias("tokens"), F.substring(label, len(_LABEL) + 1, 1 << 20).alias("verdict"), "confidence", "support"
    )
    rules = stored(rules, "rules")
    # a rule says nothing new where a rule on fewer of its tokens is as sure of the same verdict
    parts = rules.withColumn("left", F.explode("tokens")).select(
        F.col("tokens").alias("whole"), "verdict", F.array_remove(F.col("tokens"), F.col("left")).alias("tokens"), F.col("confidence").alias("own")
    )
    plainer = parts.join(rules.select("tokens", "verdict", "confidence"), ["tokens", "verdict"]).filter("confidence >= own")
    fewest = rules.join(plainer.select(F.col("whole").alias("tokens"), "verdict").distinct(), ["tokens", "verdict"], "left_anti")
    keyed = fewest.withColumn("token", F.explode("tokens")).join(frequent.select("token", "count"), "token")
    return keyed.groupBy("tokens", "verdict", "confidence", "support").agg(F.min_by("token", F.struct("count", "token")).alias("key"))


def _index(rules: list) -> dict[str, list[tuple]]:
    """Postings by key token, the rule that would win first."""
    found: dict[str, list[tuple]] = defaultdict(list)
    for r in rules:
        rank = (-r["confidence"], -r["support"], r["verdict"] != BLOCK, r["tokens"])
        found[r["key"]].append((rank, frozenset(r["tokens"]), r["verdict"], r["confidence"]))
    return {key: sorted(rows, key=lambda x: x[0]) for key, rows in found.items()}


def _matched(sent, default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(sent.value)
        for batch in batches:
            verdicts, said, sure = [], [], []
            for url in batch.column("url").to_pylist():
                own = set(tokens(url))
                first = (next((r for r in index[t] if r[1] <= own), None) for t in own if t in index)
                best = min((r for r in first if r), key=lambda r: r[0], default=None)
                verdicts.append(best[2] if best else default)
                said.append(" & ".join(sorted(best[1])) if best else None)
                sure.append(best[3] if best else None)
            yield record_batch(
                batch,
                {
                    "url": batch.column("url"),
                    "mined_verdict": pa.array(verdicts, pa.string()),
                    "mined_rule": pa.array(said, pa.string()),
                    "confidence": pa.array(sure, pa.float64()),
                },
            )

    return run


def matched(pages: DataFrame, rules: DataFrame, carry: Sequence[str] = (), default: str = ALLOW) -> DataFrame:
    """``url, mined_verdict, mined_rule, confidence`` for each row, with the columns of ``carry`` in ``carried``."""
    given = pages.select(F.col("url").cast("string").alias("url"), F.struct(*[F.col(f"`{c}`") for c in carry] or [F.lit(0).alias("_")]).alias("carried"))
    sent = pages.sparkSession.sparkContext.broadcast(rules.collect())
    schema = with_carried("url string, mined_verdict string, mined_rule string, confidence double", given)
    return given.mapInArrow(_matched(sent, default), schema)


def judge(
    pages: DataFrame,
    fixed: Sequence[tuple[str, str]],
    labelled: DataFrame | None = None,
    carry: Sequence[str] = (),
    default: str = ALLOW,
) -> DataFrame:
    """``url, host, path, rule, verdict, mined_rule, confidence, carried``, one row for each row of ``pages`` (``url``).

    Without ``labelled`` (``url, label``) the pages that a fixed rule fits are the labelled ones: what the rules say about
    their part of the web is carried over to URLs of the same kind that no rule names.
    """
    if labelled is None:
        own = pages.select(F.col("url").cast("string").alias("url"))
        found = fixed_rule(host_of(F.col("url")), path_of(F.col("url")), fixed)
        labelled = own.select("url", found["verdict"].alias("label"))
    done = matched(pages, mined_rules(labelled), carry, default)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule = fixed_rule(host, path, fixed)
    return done.select(
        "url",
        host.alias("host"),
        path.alias("path"),
        rule["rule"].alias("rule"),
        F.coalesce(rule["verdict"], "mined_verdict").alias("verdict"),
        "mined_rule",
        "confidence",
        "carried",
    )
