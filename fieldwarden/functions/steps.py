"""Rewriting steps: small expression pairs applied in order to one text column.

A step first computes a *finding* from the current text (stage one) and then
the new text and the changed-flags from text and finding (stage two).  Keeping
the stages in separate projections makes Spark evaluate each regular
expression once per row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldwarden.functions import patterns as P
from fieldwarden.functions.entities import BY_ENTITY
from fieldwarden.functions.text import strip
from fieldwarden.functions.tokens import token, token_sub

Flag = tuple[str, str]  # (pattern, detection source)


@dataclass(frozen=True)
class Step:
    find: Callable[[Column], Column]
    rewrite: Callable[[Column, Column], Column]
    flags: dict[Flag, Callable[[Column], Column]]


def _searched(regex: str, pattern: str, source: str, mode: str, salt: str, cue: str | None = None) -> Step:
    return Step(
        find=lambda v: v.rlike(cue) & v.rlike(regex) if cue else v.rlike(regex),
        rewrite=lambda v, hit: F.when(hit, token_sub(v, regex, pattern, mode, salt)).otherwise(v),
        flags={(pattern, source): lambda hit: hit},
    )


def whole_cell_step(rules: Sequence[P.Rule], mode: str, salt: str) -> Step:
    """REM-5 for consecutive rules of one column: the first rule that matches wins.

    A replaced cell starts with ``<`` and no rule matches it again, so one
    first-match expression equals applying the rules one after another.
    """

    def find(v: Column) -> Column:
        bare = strip(v)
        label = F.when(F.lit(False), F.lit(None).cast("string"))
        for rule in rules:
            label = label.when(rule.matches(bare), rule.name)
        return F.when(bare != "", label)

    def rewrite(v: Column, label: Column) -> Column:
        bare, out = strip(v), F.when(F.lit(False), v)
        for rule in rules:
            out = out.when(label == rule.name, token(bare, rule.name, mode, salt))
        return out.otherwise(v)

    flags = {
        (rule.name, P.REGEX_SOURCE): (lambda label, name=rule.name: label == name) for rule in rules
    }
    return Step(find, rewrite, flags)


def sample_step(samples: Sequence[str], pattern: str, source: str, mode: str, salt: str) -> Step:
    """REM-6: replace literal examples, in order."""

    def rewrite(v: Column, hit: Column) -> Column:
        out = v
        for sample in samples:
            out = F.replace(out, F.lit(sample), token(F.lit(sample), pattern, mode, salt))
        return F.when(hit, out).otherwise(v)

    return Step(
        find=lambda v: P.contains_any(v, samples),
        rewrite=rewrite,
        flags={(pattern, source): lambda hit: hit},
    )


def person_steps(column: str, source: str, mode: str, salt: str) -> list[Step]:
    """REM-8: whole-cell full names in name-like columns, else names before a reporting verb."""
    in_context = _searched(P.unicode_regex(P.PERSON_IN_CONTEXT), "PERSON", source, mode, salt, P.PERSON_CUE)
    if not P.is_name_column(column):
        return [in_context]
    whole = Step(
        find=lambda v: F.when(strip(v) != "", P.full_match(strip(v), P.FULL_NAME)).otherwise(False),
        rewrite=lambda v, hit: F.when(hit, token(strip(v), "PERSON", mode, salt)).otherwise(v),
        flags={("PERSON", source): lambda hit: hit},
    )
    return [whole, in_context]


def location_steps(source: str, mode: str, salt: str) -> list[Step]:
    """REM-9: four place rules, widest first."""
    return [
        _searched(P.unicode_regex(rx), "LOCATION", source, mode, salt, P.LOCATION_CUE) for rx in P.LOCATION_RULES
    ]


def entity_steps(
    column: str, entity: str, source: str, mode: str, salt: str, person: bool, location: bool
) -> list[Step]:
    """REM-7: the optional context fallback, then the recogniser's own spans."""
    steps: list[Step] = []
    if entity == "PERSON" and person:
        steps += person_steps(column, source, mode, salt)
    if entity == "LOCATION" and location:
        steps += location_steps(source, mode, salt)
    recogniser = BY_ENTITY.get(entity)
    if recogniser is not None:
        steps.append(
            Step(
                find=recogniser.found_in,
                rewrite=lambda v, hit: F.when(hit, recogniser.replace(v, mode, salt)).otherwise(v),
                flags={(entity, source): lambda hit: hit},
            )
        )
    return steps


def context_digits(value: Column, mode: str, salt: str, selected: set[str] | None = None) -> Column:
    """REM-12 as ``struct(text, routing, account)``.

    Digit runs are visited from the right.  What stands left of a run is still
    the original text; what stands right of it already holds the tokens, so a
    token can give context to the run before it.
    """
    regex = P.unicode_regex(P.DIGIT_RUN)
    width = P.CONTEXT_CHARS
    pieces = F.split(value, regex, -1)
    runs = F.regexp_extract_all(value, F.lit(regex), 0)
    last = F.element_at(pieces, -1)
    paired = F.zip_with(
        F.slice(pieces, F.lit(1), F.size(runs)),
        runs,
        lambda piece, run: F.struct(piece.alias("piece"), run.alias("run")),
    )
    routing_on = not selected or "routing_number" in selected
    account_on = not selected or "bank_account" in selected

    def step(state: Column, item: Column) -> Column:
        run, piece = item["run"], item["piece"]
        before_end = F.length(value) - state["used"] - F.length(run)
        left = F.substring(
            value, F.greatest(F.lit(1), before_end - width + 1), F.least(F.lit(width), before_end)
        )
        near = F.lower(F.concat(left, run, F.substring(state["text"], 1, width)))
        is_routing = (F.length(run) == 9) & P.contains_any(near, P.ROUTING_CONTEXT)
        is_account = ~is_routing & P.contains_any(near, P.ACCOUNT_CONTEXT)
        shown = run
        if account_on:
            shown = F.when(is_account, token(run, "bank_account", mode, salt)).otherwise(shown)
        if routing_on:
            shown = F.when(is_routing, token(run, "routing_number", mode, salt)).otherwise(shown)
        return F.struct(
            F.concat(piece, shown, state["text"]).alias("text"),
            (state["used"] + F.length(run) + F.length(piece)).alias("used"),
            (state["routing"] | (is_routing & F.lit(routing_on))).alias("routing"),
            (state["account"] | (is_account & F.lit(account_on))).alias("account"),
        )

    start = F.struct(
        last.alias("text"),
        F.length(last).alias("used"),
        F.lit(False).alias("routing"),
        F.lit(False).alias("account"),
    )
    folded = F.aggregate(F.reverse(paired), start, step)
    return F.when(value.rlike(P.DIGIT_RUN_CUE) & value.rlike(regex), folded)


def common_steps(
    mode: str, salt: str, dates: bool = True, selected: set[str] | None = None, protect_tokens: bool = False
) -> list[Step]:
    """REM-13: embedded rules in order, contextual digit runs, dates near birth words."""

    def on(name: str) -> bool:
        return not selected or name in selected

    def shielded(regex: str) -> str:
        # Optionally never touch digits that are part of an earlier token.
        return P.unicode_regex(regex + (r"(?![^<>]*>)" if protect_tokens else ""))

    steps = [
        _searched(shielded(rx), name, P.FALLBACK_SOURCE, mode, salt, P.CUES[name])
        for name, rx in P.EMBEDDED_RULES
        if on(name)
    ]
    if on("routing_number") or on("bank_account"):
        flags: dict[Flag, Callable[[Column], Column]] = {}
        if on("routing_number"):
            flags[("routing_number", P.FALLBACK_SOURCE)] = lambda f: F.coalesce(f["routing"], F.lit(False))
        if on("bank_account"):
            flags[("bank_account", P.FALLBACK_SOURCE)] = lambda f: F.coalesce(f["account"], F.lit(False))
        steps.append(
            Step(
                find=lambda v: context_digits(v, mode, salt, selected),
                rewrite=lambda v, found: F.coalesce(found["text"], v),
                flags=flags,
            )
        )
    if dates and on("dob"):
        regex = shielded(P.EMBEDDED_DATE)
        steps.append(
            Step(
                find=lambda v: v.rlike(regex) & P.contains_any(F.lower(v), P.DATE_CONTEXT),
                rewrite=lambda v, hit: F.when(hit, token_sub(v, regex, "dob", mode, salt)).otherwise(v),
                flags={("dob", P.FALLBACK_SOURCE): lambda hit: hit},
            )
        )
    return steps
