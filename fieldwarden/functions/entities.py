"""Rule recognisers for entities inside free text (ENT-3).

Every recogniser is one search expression plus an optional acceptance test on
the matched text.  Scores are fixed per rule: checksummed or tightly shaped
rules score high, loosely shaped ones low.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldwarden.functions import patterns as P
from fieldwarden.functions.tokens import regex_sub, token, token_sub

SPAN_TYPE = "array<struct<entity:string,text:string,score:double>>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def luhn_valid(text: Column) -> Column:
    """Luhn checksum of the digits in ``text``."""
    reversed_digits = F.reverse(_digits(text))

    def add(total, position):
        digit = F.substring(reversed_digits, position, 1).cast("int")
        doubled = digit * 2
        folded = F.when(doubled > 9, doubled - 9).otherwise(doubled)
        return total + F.when(position % 2 == 0, folded).otherwise(digit)

    total = F.aggregate(F.sequence(F.lit(1), F.length(reversed_digits)), F.lit(0), add)
    return total % 10 == 0


def nhs_valid(text: Column) -> Column:
    """Modulus-11 check of a ten-digit health-service number."""
    digits = _digits(text)
    weighted = F.aggregate(
        F.sequence(F.lit(1), F.lit(9)),
        F.lit(0),
        lambda total, i: total + F.substring(digits, i, 1).cast("int") * (F.lit(11) - i),
    )
    check = (F.lit(11) - weighted % 11) % 11
    return check == F.substring(digits, 10, 1).cast("int")


@dataclass(frozen=True)
class Recogniser:
    """One entity type.

    ``cue`` is a cheap necessary condition: texts without it are not searched.
    ``whole`` is a second rule for texts that are nothing but the entity.
    """

    entity: str
    regex: str
    score: float
    accept: Callable[[Column], Column] | None = None
    cue: str | None = None
    whole: str | None = None

    def _searchable(self, value: Column) -> Column:
        hit = value.rlike(self.regex)
        return value.rlike(self.cue) & hit if self.cue else hit

    def _whole(self, value: Column) -> Column:
        return P.full_match(value, self.whole) if self.whole else F.lit(False)

    def texts(self, value: Column) -> Column:
        found = F.regexp_extract_all(value, F.lit(self.regex), 0)
        return F.filter(found, self.accept) if self.accept else found

    def spans(self, value: Column) -> Column:
        named = lambda t: F.struct(
            F.lit(self.entity).alias("entity"), t.alias("text"), F.lit(self.score).alias("score")
        )
        out = F.when(self._searchable(value), F.transform(self.texts(value), named)).otherwise(F.array().cast(SPAN_TYPE))
        return F.when(self._whole(value), F.array(named(value))).otherwise(out) if self.whole else out

    def replace(self, value: Column, mode: str, salt: str) -> Column:
        if self.accept is None:
            out = token_sub(value, self.regex, self.entity, mode, salt)
        else:
            out = regex_sub(
                value,
                self.regex,
                lambda hit: F.when(self.accept(hit), token(hit, self.entity, mode, salt)).otherwise(hit),
            )
        return F.when(self._whole(value), token(value, self.entity, mode, salt)).otherwise(out) if self.whole else out

    def found_in(self, value: Column) -> Column:
        hit = self._searchable(value)
        if self.accept is not None:
            hit = hit & (F.size(self.texts(value)) > 0)
        return self._whole(value) | hit if self.whole else hit


_EMBEDDED = {name: P.unicode_regex(rx) for name, rx in P.EMBEDDED_RULES}

RECOGNISERS = (
    Recogniser("PERSON", P.unicode_regex(P.PERSON_IN_CONTEXT), 0.85, cue=P.PERSON_CUE, whole=P.FULL_NAME),
    Recogniser(
        "LOCATION",
        P.unicode_regex("|".join((P.FULL_ADDRESS, P.CITY_STATE_ZIP, P.CITY_STATE))),
        0.85,
        cue=P.LOCATION_CUE,
    ),
    Recogniser("EMAIL_ADDRESS", _EMBEDDED["email"], 1.0, cue=P.CUES["email"]),
    Recogniser("PHONE_NUMBER", _EMBEDDED["phone"], 0.75, cue=P.CUES["phone"]),
    Recogniser(
        "DATE_TIME",
        P.unicode_regex(P.EMBEDDED_DATE + r"|(?<!\d)\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?!\d)"),
        0.6,
        cue=P.DATE_CUE,
    ),
    Recogniser("URL", P.unicode_regex(r"\bhttps?://[^\s<>\"']+"), 0.6, cue="://"),
    Recogniser("US_SSN", P.unicode_regex(r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)"), 0.85, cue=P.CUES["ssn"]),
    Recogniser("CREDIT_CARD", r"(?<!\d)(?:\d[ -]*?){13,19}(?!\d)", 1.0, luhn_valid, cue=P.CUES["credit_card"]),
    Recogniser("IP_ADDRESS", _EMBEDDED["ip"], 0.95, cue=P.CUES["ip"]),
    Recogniser("UK_NHS", r"(?<!\d)\d{3}[ -]?\d{3}[ -]?\d{4}(?!\d)", 0.9, nhs_valid, cue=P.CUES["phone"]),
)
BY_ENTITY = {r.entity: r for r in RECOGNISERS}


def rule_spans(value: Column) -> Column:
    """All entity spans of one text, in recogniser order then text order."""
    return F.concat(*[r.spans(value) for r in RECOGNISERS])
