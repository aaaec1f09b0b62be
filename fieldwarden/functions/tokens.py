"""Replacement tokens and regex substitution with per-match tokens (REM-1..5, REM-11)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rules whose mask keeps the last four digits, and strategy labels.
LAST4_PATTERNS = ("ssn", "credit_card", "bank_account", "routing_number", "phone")
STRATEGY_LABELS = {"redact": "REDACT", "hash": "HASH", "mask_last4": "MASK_LAST4", "tag": "TAG"}


def strategy_label(mode: str) -> str:
    """REM-4: unknown modes behave as, and are labelled as, redaction."""
    return STRATEGY_LABELS.get(mode, "REDACT")


def token(value: Column, pattern: str, mode: str = "redact", salt: str = "") -> Column:
    """Token that stands for ``value`` under the chosen strategy."""
    if mode == "hash":
        digest = F.substring(F.sha2(F.concat(F.lit(f"{salt}|{pattern}|"), value), 256), 1, 12)
        return F.concat(F.lit(f"<PII_HASH:{pattern}:"), digest, F.lit(">"))
    if mode == "mask_last4":
        if pattern not in LAST4_PATTERNS:
            return F.lit(f"<PII_MASK:{pattern}>")
        digits = F.regexp_replace(value, r"(?U)\D", "")
        shown = F.concat(F.lit(f"<PII_MASK:{pattern}:***"), F.substring(digits, -4, 4), F.lit(">"))
        return F.when(F.length(digits) >= 4, shown).otherwise(F.lit(f"<PII_MASK:{pattern}>"))
    if mode == "tag":
        return F.lit(f"<PII:{pattern}>")
    return F.lit(f"<PII_REDACT:{pattern}>")


def regex_sub(value: Column, regex: str, replace: Callable[[Column], Column]) -> Column:
    """Replace every match by ``replace(match)``.

    Pieces between matches and the matches themselves are zipped back together,
    which keeps look-around rules exact (nothing is matched out of its context).
    """
    pieces = F.split(value, regex, -1)
    hits = F.transform(F.regexp_extract_all(value, F.lit(regex), 0), replace)
    joined = F.zip_with(pieces, hits, lambda p, t: F.concat(p, F.coalesce(t, F.lit(""))))
    return F.array_join(joined, "")


def token_sub(value: Column, regex: str, pattern: str, mode: str, salt: str) -> Column:
    """Regex substitution by tokens; constant tokens need no per-match work."""
    constant = mode in ("redact", "tag") or mode not in STRATEGY_LABELS
    constant = constant or (mode == "mask_last4" and pattern not in LAST4_PATTERNS)
    if constant:
        text = {"tag": f"<PII:{pattern}>", "mask_last4": f"<PII_MASK:{pattern}>"}.get(
            mode, f"<PII_REDACT:{pattern}>"
        )
        quoted = text.replace("\\", "\\\\").replace("$", "\\$")
        return F.regexp_replace(value, regex, quoted)
    return regex_sub(value, regex, lambda hit: token(hit, pattern, mode, salt))
