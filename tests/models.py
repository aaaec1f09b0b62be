"""Plain Python statements of the rewriting rules, used to check the Spark expressions."""

import hashlib
import re

from fieldwarden.functions import patterns as P


def token(value, pattern, mode, salt):
    if mode == "hash":
        return f"<PII_HASH:{pattern}:{hashlib.sha256('|'.join((salt, pattern, value)).encode()).hexdigest()[:12]}>"
    if mode == "mask_last4":
        digits = "".join(ch for ch in value if ch.isdecimal())
        keep = pattern in ("ssn", "credit_card", "bank_account", "routing_number", "phone") and len(digits) > 3
        return f"<PII_MASK:{pattern}:***{digits[-4:]}>" if keep else f"<PII_MASK:{pattern}>"
    return f"<PII_REDACT:{pattern}>"


def digit_runs(text, mode, salt, selected=None):
    """Right-to-left: the tail is rewritten before the run in front of it is judged."""
    runs = [m.span() for m in re.finditer(P.DIGIT_RUN, text)]
    head, tail, kinds = text, "", set()
    while runs:
        start, end = runs.pop()
        run = text[start:end]
        tail = head[end:] + tail
        near = (text[max(0, start - 28) : start] + run + tail[:28]).lower()
        kind = None
        if len(run) == 9 and ("routing" in near or "aba" in near):
            kind = "routing_number"
        elif re.search("account|acct|bank|iban", near):
            kind = "bank_account"
        if kind and selected and kind not in selected:
            kind = None
        tail = (token(run, kind, mode, salt) if kind else run) + tail
        head = text[:start]
        kinds |= {kind} - {None}
    return head + tail, kinds


def common(text, mode, salt, dates=True, selected=None):
    kinds = set()
    for name, rx in P.EMBEDDED_RULES:
        if selected and name not in selected:
            continue
        after = re.sub(rx, lambda m, n=name: token(m.group(0), n, mode, salt), text)
        if after != text:
            kinds.add(name)
        text = after
    text, more = digit_runs(text, mode, salt, selected)
    kinds |= more
    if dates and (not selected or "dob" in selected) and re.search("dob|birth|born", text.lower()):
        after = re.sub(P.EMBEDDED_DATE, lambda m: token(m.group(0), "dob", mode, salt), text)
        if after != text:
            kinds.add("dob")
        text = after
    return text, kinds


def location(text, mode, salt):
    for rx in P.LOCATION_RULES:
        text = re.sub(rx, lambda m: token(m.group(0), "LOCATION", mode, salt), text)
    return text


def person(text, column, mode, salt):
    if P.is_name_column(column) and re.fullmatch(P.FULL_NAME, text.strip()):
        return token(text.strip(), "PERSON", mode, salt)
    return re.sub(P.PERSON_IN_CONTEXT, lambda m: token(m.group(0), "PERSON", mode, salt), text)
