"""Detection rules, column-name hints and the registry that holds them.

A rule is a regular expression that must match a whole (stripped) value.  The
texts are kept in a dialect both Java and Python read the same way; the
Java-only wrapping (anchors, Unicode classes) is added in one place here.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Substrings of a column name that make it worth scanning.
CANDIDATE_HINTS = (
    "name", "email", "phone", "ssn", "dob", "birth", "address", "zip", "postal", "account",
    "card", "customer", "employee", "user", "ip", "passport", "license", "driver", "tax",
    "tin", "ein", "routing", "bank", "iban",
)

# Substrings of a column name that always get the entity scan.
ENTITY_PRIORITY_HINTS = (
    "name", "address", "street", "city", "location", "note", "notes", "narrative", "comment",
    "comments", "description", "message", "text",
)

# Full-match rules in report order (name, expression, name hints, high risk).
_RULES = (
    ("email", r"(?i:[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,})", ("email",), False),
    ("ip", r"(?:\d{1,3}\.){3}\d{1,3}", ("ip",), False),
    ("phone", r"(?:\+?1[-.\s]?)?(?:\(\d{3}\)|\d{3})[-.\s]?\d{3}[-.\s]?\d{4}", ("phone", "mobile"), False),
    ("ssn", r"\d{3}-?\d{2}-?\d{4}", ("ssn", "social"), True),
    ("credit_card", r"(?:\d[ -]*?){13,19}", ("card", "credit"), True),
    ("zip", r"\d{5}(-\d{4})?", ("zip", "postal"), False),
    ("dob", r"(0?[1-9]|1[0-2])[/-](0?[1-9]|[12]\d|3[01])[/-]\d{4}", ("dob", "birth"), False),
    ("driver_license", r"[A-Z0-9]{6,12}", ("driver", "license", "dl"), False),
    ("passport", r"[A-Z0-9]{8,9}", ("passport",), True),
    ("routing_number", r"\d{9}", ("routing",), False),
    ("bank_account", r"\d{8,17}", ("account", "bank"), True),
    ("ein", r"\d{2}-\d{7}", ("ein", "tax"), False),
)

# Embedded (search) rules used on free text, in application order.
EMBEDDED_RULES = (
    ("email", r"(?<!\w)[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?!\w)"),
    ("phone", r"(?<!\d)(?:\+?1[-.\s]?)?(?:\(\d{3}\)|\d{3})[-.\s]?\d{3}[-.\s]?\d{4}(?!\d)"),
    ("ssn", r"(?<!\d)\d{3}-?\d{2}-?\d{4}(?!\d)"),
    ("credit_card", r"(?<!\d)(?:\d[ -]*?){13,19}(?!\d)"),
    ("ein", r"(?<!\d)\d{2}-\d{7}(?!\d)"),
    ("ip", r"(?<!\d)(?:\d{1,3}\.){3}\d{1,3}(?!\d)"),
)
DIGIT_RUN = r"(?<!\d)\d{8,17}(?!\d)"
EMBEDDED_DATE = r"(?<!\d)(?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12]\d|3[01])[/-]\d{4}(?!\d)"
DATE_CONTEXT = ("dob", "birth", "born")
ROUTING_CONTEXT = ("routing", "aba")
ACCOUNT_CONTEXT = ("account", "acct", "bank", "iban")
CONTEXT_CHARS = 28

# Person and place rules.
NAME_COLUMN_HINTS = ("name", "customer_name", "employee_name", "user_name", "full_name")
FULL_NAME = r"\s*[A-Z][a-z]+(?:[-'][A-Z][a-z]+)?(?:\s+[A-Z][a-z]+(?:[-'][A-Z][a-z]+)?){1,2}\s*"
PERSON_IN_CONTEXT = (
    r"\b[A-Z][a-z]+(?:[-'][A-Z][a-z]+)?\s+[A-Z][a-z]+(?:[-'][A-Z][a-z]+)?"
    r"(?=\s+(?:called|met|requested|asked|reported|stated|emailed|contacted)\b)"
)
_STREET = (
    r"\b\d{1,6}\s+[A-Za-z0-9.'-]+(?:\s+[A-Za-z0-9.'-]+){0,4}\s"
    r"(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Way|Court|Ct)"
)
_CITY = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:AL|GA|NC|TN)"
FULL_ADDRESS = _STREET + r"(?:,\s*" + _CITY + r"(?:\s+\d{5})?)?\b"
STREET = _STREET + r"\b"
CITY_STATE_ZIP = r"\b" + _CITY + r"\s+\d{5}\b"
CITY_STATE = r"\b" + _CITY + r"\b"
# Necessary parts of the search rules; a text without them needs no search.
CUES = {
    "email": "@",
    "phone": r"(?U)\d{3}",
    "ssn": r"(?U)\d{3}",
    "credit_card": r"(?U)\d[ -]*\d[ -]*\d",
    "ein": r"(?U)\d{2}-\d",
    "ip": r"(?U)\d\.\d",
}
DIGIT_RUN_CUE = r"(?U)\d{8}"
DATE_CUE = r"(?U)\d{4}"
PERSON_CUE = r"(?U)\s(?:called|met|requested|asked|reported|stated|emailed|contacted)\b"
LOCATION_CUE = (
    r"(?U)\s(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Way|Court|Ct|AL|GA|NC|TN)\b"
)
LOCATION_RULES = (FULL_ADDRESS, STREET, CITY_STATE_ZIP, CITY_STATE)

# Labels written into and read from findings.
REGEX_SOURCE = "REGEX_RULE"
ENTITY_SOURCE = "ENTITY_RULE"
FALLBACK_SOURCE = "STRICT_FALLBACK"
# Findings tables written elsewhere label model findings like this; both are read alike.
ENTITY_SOURCES = (ENTITY_SOURCE, "PRESIDIO_NLP")
ENTITY_TYPES = (
    "PERSON", "LOCATION", "EMAIL_ADDRESS", "PHONE_NUMBER", "DATE_TIME", "URL", "US_SSN",
    "CREDIT_CARD", "IP_ADDRESS", "UK_NHS",
)


def unicode_regex(text: str) -> str:
    """Java form of a search rule: ``\\d \\s \\w \\b`` follow Unicode."""
    return "(?U)" + text


def full_match(value: Column, text: str) -> Column:
    """True when the whole value matches (values are never empty here).

    The empty alternative makes the matcher succeed at offset 0 in every case,
    so a long text that does not match is not retried at each of its offsets.
    """
    return F.regexp_extract(value, r"(?U)\A(?:(?:" + text + r")\z|)", 0) != ""


@dataclass(frozen=True)
class Rule:
    name: str
    regex: str
    hints: tuple[str, ...] = ()
    high_risk: bool = False

    def matches(self, value: Column) -> Column:
        return full_match(value, self.regex)


@dataclass
class PatternRegistry:
    """Ordered set of full-match rules; users extend it with :meth:`add`."""

    rules: dict[str, Rule] = field(default_factory=dict)

    @classmethod
    def default(cls) -> "PatternRegistry":
        return cls({name: Rule(name, rx, hints, risky) for name, rx, hints, risky in _RULES})

    def add(self, name: str, regex: str, hints: Iterable[str] = (), high_risk: bool = False) -> "PatternRegistry":
        extended = dict(self.rules)
        extended[name] = Rule(name, regex, tuple(h.lower() for h in hints), high_risk)
        return PatternRegistry(extended)

    @property
    def names(self) -> list[str]:
        return list(self.rules)

    def mask(self, value: Column) -> Column:
        """Matching rules as bits of a long, in rule order: a fixed-width cell aggregates by hashing."""
        if len(self.rules) > 62:
            raise ValueError("at most 62 rules per registry")
        bits = [F.when(rule.matches(value), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, rule in enumerate(self)]
        out = bits[0]
        for bit in bits[1:]:
            out = out.bitwiseOR(bit)
        # One alternation of all rules first: most values match none of them.
        some = "|".join(r"(?:" + rule.regex + r")\z" for rule in self)
        return F.when(F.regexp_extract(value, r"(?U)\A(?:" + some + "|)", 0) != "", out).otherwise(F.lit(0).cast("long"))

    def rules_of(self, mask: Column) -> Column:
        """Rule positions set in a mask."""
        places = F.array(*[F.lit(i) for i in range(len(self.rules))])
        chosen = F.filter(places, lambda i: F.getbit(mask, i) == 1)
        return F.when(mask == 0, F.array().cast("array<int>")).otherwise(chosen)

    def __iter__(self):
        return iter(self.rules.values())

    def __getitem__(self, name: str) -> Rule:
        return self.rules[name]

    def __contains__(self, name: str) -> bool:
        return name in self.rules

    def confidence(self, column: Column, pattern: Column) -> Column:
        """HIGH when the column name carries a hint for the pattern, else LOW (DET-2)."""
        hinted = F.when(F.lit(False), F.lit(False))
        for rule in self:
            if rule.hints:
                hinted = hinted.when(pattern == rule.name, contains_any(F.lower(column), rule.hints))
        return F.when(hinted, "HIGH").otherwise("LOW")

    def risk(self, pattern: Column, confidence: Column, match_pct: Column) -> Column:
        """Risk tier of a rule finding (DET-4)."""
        risky = [r.name for r in self if r.high_risk]
        high = confidence == "HIGH"
        return (
            F.when(high & pattern.isin(risky), "CRITICAL")
            .when(high & (match_pct > 80), "HIGH")
            .when(high, "MEDIUM")
            .otherwise("LOW")
        )


def contains_any(text: Column, needles: Iterable[str]) -> Column:
    """True when some needle occurs in the text, as one alternation of literals."""
    return text.rlike("|".join(re.escape(n) for n in needles))


def is_candidate_column(name: str) -> bool:
    """PRD-1."""
    return any(h in name.lower() for h in CANDIDATE_HINTS)


def is_priority_column(name: str) -> bool:
    """PRD-2."""
    return any(h in name.lower() for h in ENTITY_PRIORITY_HINTS)


def is_name_column(name: str) -> bool:
    return any(h in name.lower() for h in NAME_COLUMN_HINTS)


DEFAULT_REGISTRY = PatternRegistry.default()
