"""ANSI SQL that states the expected result of the registered queries.

The SQL is written against the stock tables alone.  Search rules with
look-around are restated with explicit boundary characters.
"""

from __future__ import annotations

from fieldwarden.plans.fixed import (
    CANDIDATE_HINTS,
    ENTITY_PRIORITY_HINTS,
    PATTERN_PRIORITY,
    PLACEHOLDERS,
    REGULATIONS,
    RISK_LEVELS,
    RULE_ROWS,
)
from fieldwarden.plans.tables import CONTACT_COLUMNS, CONTACT_VALUES, IDENTITY_COLUMNS, KEY_PARTS, IDENTITY_VALUES, NOTE_COLUMNS, PERSON, PLACE, TALK_TEXT, TOKEN_BREAK

RULES = {name: rx for name, rx, _, _ in RULE_ROWS}
HINTS = {name: hints for name, _, hints, _ in RULE_ROWS}
RISKY = [name for name, _, _, risky in RULE_ROWS if risky]


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def select_list(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in columns.items())


IDENTITIES = f"identities AS (SELECT {select_list(IDENTITY_COLUMNS)} FROM customer)"
CONTACTS = f"contacts AS (SELECT {select_list(CONTACT_COLUMNS)} FROM customer)"
NOTES = f"notes AS (SELECT {select_list(NOTE_COLUMNS)} FROM customer)"


def cells(name: str, table: str, key: str, columns, source: str = "") -> str:
    parts = [
        f"SELECT {sql_text(source)} AS source, {key} AS rid, {sql_text(c)} AS \"column\", cast({c} AS VARCHAR) AS raw FROM {table} WHERE {c} IS NOT NULL"
        for c in columns
    ]
    return f"{name} AS ({' UNION ALL '.join(parts)})"


def sampled(name: str = "cells", limit: int = 500) -> str:
    """Value index and first distinct values of ``name``."""
    return (
        f"idx AS (SELECT source, \"column\", trim(raw) AS value, count(*) AS cnt, min(rid) AS first_rid FROM {name} "
        "WHERE trim(raw) <> '' GROUP BY ALL), "
        "sample AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, \"column\" ORDER BY first_rid, value) AS rn FROM idx) "
        f"WHERE rn <= {limit})"
    )


def hits(name: str, source: str, value: str = "value") -> str:
    """Rows of ``source`` once per matching rule."""
    parts = [
        f"SELECT *, {i} AS rule_order, {sql_text(p)} AS pattern FROM {source} WHERE regexp_full_match({value}, {sql_text(rx)})"
        for i, (p, rx) in enumerate(RULES.items())
    ]
    return f"{name} AS ({' UNION ALL '.join(parts)})"


def has_hint(column: str, hints) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), {sql_text(h)})" for h in hints) + ")"


CONFIDENCE = "CASE WHEN " + " OR ".join(
    f"(pattern = {sql_text(p)} AND {has_hint('\"column\"', h)})" for p, h in HINTS.items()
) + " THEN 'HIGH' ELSE 'LOW' END"
FREE_TEXT = "(avg(length(value)) > 15 OR avg(CASE WHEN regexp_matches(value, '[^ \\t\\n\\r\\f]+[ \\t\\n\\r\\f]+[^ \\t\\n\\r\\f]+[ \\t\\n\\r\\f]+[^ \\t\\n\\r\\f]+[ \\t\\n\\r\\f]+[^ \\t\\n\\r\\f]') THEN 1.0 ELSE 0.0 END) > 0.25)"
RISK = (
    f"CASE WHEN confidence = 'HIGH' AND pattern IN ({', '.join(map(sql_text, RISKY))}) THEN 'CRITICAL' "
    "WHEN confidence = 'HIGH' AND match_pct > 80 THEN 'HIGH' WHEN confidence = 'HIGH' THEN 'MEDIUM' ELSE 'LOW' END"
)


def findings(cell_sql: str, views: str) -> str:
    """CTEs up to ``findings`` for the given cells."""
    return (
        f"WITH {views}, {cell_sql}, {sampled(limit=10**12)}, "
        f"shape AS (SELECT source, \"column\", count(*) AS sample_size, "
        f"({has_hint('\"column\"', CANDIDATE_HINTS)} OR {FREE_TEXT}) AS scanned FROM sample GROUP BY source, \"column\"), "
        f"{hits('hit', 'sample')}, "
        "counted AS (SELECT source, \"column\", pattern, count(*) AS matches, "
        "list(value ORDER BY rn) AS ex FROM hit GROUP BY ALL), "
        f"rated AS (SELECT c.*, s.sample_size, round_even(c.matches / s.sample_size * 100, 2) AS match_pct, "
        f"{CONFIDENCE.replace('\"column\"', 'c.\"column\"').replace('pattern =', 'c.pattern =')} AS confidence FROM counted c JOIN shape s ON c.source = s.source AND c.\"column\" = s.\"column\" "
        "WHERE s.scanned), "
        f"findings AS (SELECT source, \"column\", pattern, confidence, {RISK} AS risk, matches, sample_size, match_pct, "
        + ", ".join(f"coalesce(ex[{i}], '') AS sample_match_{i}" for i in range(1, 6))
        + ", 'REGEX_RULE' AS detection_source FROM rated) "
    )


CONTACT_CELLS = cells("cells", "contacts", "rid", CONTACT_VALUES, "contacts")
CONTACT_FINDINGS = findings(CONTACT_CELLS, CONTACTS)
IDENTITY_FINDINGS = findings(cells("cells", "identities", "rid", IDENTITY_VALUES, "identities"), IDENTITIES)

STOCK = {
    "region": ("r_regionkey", ["r_regionkey", "r_name"]),
    "supplier": ("s_suppkey", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]),
    "part": ("p_partkey", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]),
}
_PARTS = [cells("contact_cells", "contacts", "rid", CONTACT_VALUES, "contacts")] + [
    cells(f"{t}_cells", t, k, cols, t) for t, (k, cols) in STOCK.items()
]
MANY_CELLS = ", ".join(_PARTS) + ", cells AS (" + " UNION ALL ".join(
    f"SELECT * FROM {n}_cells" for n in ("contact", *STOCK)
) + ")"
MANY_FINDINGS = findings(MANY_CELLS, CONTACTS)
STOCK_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
)
DIRECTORY_CELLS = "cells AS (" + " UNION ALL ".join(
    f"SELECT '{t}.parquet' AS source, 0 AS rid, \"column\", regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS raw "
    f"FROM (UNPIVOT (SELECT COLUMNS(*)::VARCHAR FROM {t}) ON COLUMNS(*) INTO NAME \"column\" VALUE raw)"
    for t in STOCK_TABLES
) + ")"
DIRECTORY_FINDINGS = findings(DIRECTORY_CELLS, CONTACTS)
MANY_COLUMNS = " UNION ALL ".join(
    f"SELECT {sql_text(t)} AS source, {sql_text(c)} AS \"column\""
    for t, cols in [("contacts", CONTACT_VALUES), *[(t, c) for t, (_, c) in STOCK.items()]]
    for c in cols
)

FULL = (
    f"WITH {CONTACTS}, {CONTACT_CELLS}, {sampled(limit=10**12)}, {hits('hit', 'sample')}, "
    "size AS (SELECT \"column\", count(*) AS sample_size FROM sample GROUP BY ALL), "
    "counted AS (SELECT h.\"column\", pattern, count(*) AS matches, any_value(sample_size) AS sample_size, list(value ORDER BY rn) AS ex FROM hit h JOIN size s ON h.\"column\" = s.\"column\" GROUP BY ALL), "
    f"rated AS (SELECT *, round_even(matches / sample_size * 100, 2) AS match_pct, {CONFIDENCE} AS confidence FROM counted) "
)

TOKENS = (
    f"tokens AS (SELECT doc_id, unnest(parts) AS raw, generate_subscripts(parts, 1) AS pos FROM (SELECT doc_id, regexp_split_to_array(text, '{TOKEN_BREAK}') AS parts FROM documents))"
)

# --- remediation --------------------------------------------------------------

PRIORITY = {p: (PATTERN_PRIORITY.get(p, 999), p) for p in RULES}
RANK = {p: i for i, p in enumerate(sorted(RULES, key=lambda p: PRIORITY[p]))}
RANK_CASE = "CASE h.pattern " + " ".join(f"WHEN {sql_text(p)} THEN {i}" for p, i in RANK.items()) + " END"
DIGITS = "regexp_replace(trim(raw), '[^0-9]', '', 'g')"
MASK = (
    f"CASE WHEN pattern IN ('ssn', 'credit_card', 'bank_account', 'routing_number', 'phone') AND length({DIGITS}) >= 4 "
    f"THEN concat('<PII_MASK:', pattern, ':***', right({DIGITS}, 4), '>') ELSE concat('<PII_MASK:', pattern, '>') END"
)
REDACT = "concat('<PII_REDACT:', pattern, '>')"
HASH = "concat('<PII_HASH:', pattern, ':', left(sha256(concat('s|', pattern, '|', trim(raw))), 12), '>')"


def remediated(token: str, tail: str) -> str:
    """Cells after whole-cell replacement by the first applicable finding."""
    return (
        CONTACT_FINDINGS
        + f", {hits('cell_hit', 'cells', 'trim(raw)')}, "
        f"first_hit AS (SELECT h.rid, h.\"column\", min({RANK_CASE}) AS k, arg_min(h.pattern, {RANK_CASE}) AS pattern "
        "FROM cell_hit h JOIN findings f ON h.\"column\" = f.\"column\" AND h.pattern = f.pattern GROUP BY h.rid, h.\"column\"), "
        f"rewritten AS (SELECT c.rid, c.\"column\", pattern, CASE WHEN pattern IS NULL THEN raw ELSE {token} END AS value "
        "FROM cells c LEFT JOIN first_hit h ON c.rid = h.rid AND c.\"column\" = h.\"column\") " + tail
    )


CELL_ROWS = "SELECT rid, \"column\", value FROM rewritten"
AUDIT = (
    "SELECT 'contacts.csv' AS file_name, \"column\", pattern, 'REGEX_RULE' AS detection_source, '{s}' AS strategy, "
    "count(*) AS cells_changed FROM rewritten WHERE pattern IS NOT NULL GROUP BY \"column\", pattern"
)

# Search rules as (boundary before)(rule)(boundary after); letters and digits of any script bound an address.
_WORD = "[\\pL\\pN_]"
_NOT_WORD = "[^\\pL\\pN_]"
_TEL = "(?:\\+?1[-.\\s]?)?(?:\\([0-9]{3}\\)|[0-9]{3})[-.\\s]?[0-9]{3}[-.\\s]?[0-9]{4}"
SEARCH = {
    "email": (f"(^|{_NOT_WORD})", "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}", f"($|{_NOT_WORD})"),
    "phone": ("(^|[^0-9])", _TEL, "($|[^0-9])"),
    "ssn": ("(^|[^0-9])", "[0-9]{3}-?[0-9]{2}-?[0-9]{4}", "($|[^0-9])"),
    "credit_card": ("(^|[^0-9])", "[0-9](?:[ -]*[0-9]){12,18}", "($|[^0-9])"),
    "ein": ("(^|[^0-9])", "[0-9]{2}-[0-9]{7}", "($|[^0-9])"),
    "ip": ("(^|[^0-9])", "(?:[0-9]{1,3}\\.){3}[0-9]{1,3}", "($|[^0-9])"),
}


def found(pattern: str, text: str = "text") -> str:
    return f"regexp_matches({text}, {sql_text(''.join(SEARCH[pattern]))})"


def replaced(pattern: str, text: str) -> str:
    """Two sweeps, so neighbours sharing one boundary character are both replaced."""
    before, rule, after = SEARCH[pattern]
    rx = sql_text(f"{before}(?:{rule}){after}")
    once = f"regexp_replace({text}, {rx}, '\\1<PII_REDACT:{pattern}>\\2', 'g')"
    return f"regexp_replace({once}, {rx}, '\\1<PII_REDACT:{pattern}>\\2', 'g')"


def redaction_stages(tail: str) -> str:
    stages, previous = [], "documents"
    for p in SEARCH:
        flags = ", ".join(f"f_{x}" for x in SEARCH if list(SEARCH).index(x) < list(SEARCH).index(p))
        keep = f", {flags}" if flags else ""
        stages.append(
            f"after_{p} AS (SELECT doc_id, {replaced(p, 'text')} AS text{keep}, {found(p)} AS f_{p} FROM {previous})"
        )
        previous = f"after_{p}"
    return f"WITH {', '.join(stages)} {tail.format(last=previous)}"


_CARD_LIST = "regexp_extract_all(text, '(?:^|[^0-9])([0-9](?:[ -]*[0-9]){12,18})(?:$|[^0-9])', 1)"
_LUHN = (
    "list_filter(list_transform({c}, lambda x: reverse(regexp_replace(x, '[^0-9]', '', 'g'))), "
    "lambda r: list_sum(list_transform(range(1, length(r) + 1), lambda i: "
    "CASE WHEN i % 2 = 0 THEN (CASE WHEN 2 * cast(r[i] AS INT) > 9 THEN 2 * cast(r[i] AS INT) - 9 ELSE 2 * cast(r[i] AS INT) END) ELSE cast(r[i] AS INT) END)) % 10 = 0)"
)
ENTITY_TESTS = {
    "EMAIL_ADDRESS": (found("email"), 1.0),
    "PHONE_NUMBER": (found("phone"), 0.75),
    "US_SSN": ("regexp_matches(text, '(^|[^0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}($|[^0-9])')", 0.85),
    "IP_ADDRESS": (found("ip"), 0.95),
    "CREDIT_CARD": (f"len({_LUHN.format(c=_CARD_LIST)}) > 0", 1.0),
    "URL": ("regexp_matches(text, '(^|[^\\pL\\pN_])https?://[^\\s<>\"'']')", 0.6),
    "DATE_TIME": (
        "(regexp_matches(text, '(^|[^0-9])(?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12][0-9]|3[01])[/-][0-9]{4}($|[^0-9])') OR "
        "regexp_matches(text, '(^|[^0-9])[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])($|[^0-9])'))", 0.6,
    ),
    "LOCATION": ("regexp_matches(text, '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*\\s+(?:AL|GA|NC|TN)\\b') OR regexp_matches(text, '\\b[0-9]{1,6}\\s+[A-Za-z0-9.''-]+(?:\\s+[A-Za-z0-9.''-]+){0,4}\\s(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Way|Court|Ct)\\b')", 0.85),
    "PERSON": ("regexp_matches(text, '\\b[A-Z][a-z]+(?:[-''][A-Z][a-z]+)?\\s+[A-Z][a-z]+(?:[-''][A-Z][a-z]+)?\\s+(?:called|met|requested|asked|reported|stated|emailed|contacted)\\b') OR regexp_full_match(text, '\\s*[A-Z][a-z]+(?:[-''][A-Z][a-z]+)?(?:\\s+[A-Z][a-z]+(?:[-''][A-Z][a-z]+)?){1,2}\\s*')", 0.85),
}


def entity_rows(distinct_texts: str) -> str:
    parts = [
        f"SELECT 'text' AS \"column\", '{e}' AS entity, count(*) AS matches, cast({score} AS DOUBLE) AS entity_score FROM t WHERE {test}"
        for e, (test, score) in ENTITY_TESTS.items()
    ]
    return f"WITH t AS ({distinct_texts}) SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE matches > 0"


_HASHED_PERSON = f"concat('<PII_HASH:PERSON:', left(sha256(concat('s|PERSON|', {PERSON})), 12), '>')"
_HASHED_PLACE = f"concat('<PII_HASH:LOCATION:', left(sha256(concat('s|LOCATION|', {PLACE})), 12), '>')"
_NOTE_TAIL = NOTE_COLUMNS["note"].split("), ' from ', ")[0]


def note_text(person: str, place: str) -> str:
    return NOTE_COLUMNS["note"].replace(PLACE, place).replace(PERSON, person)


# --- expectations ---------------------------------------------------------------

INPUT_SUITE_SQL = " UNION ALL ".join(
    [
        "SELECT 1 AS \"index\", 'expect_table_row_count_to_be_between' AS expectation, NULL AS \"column\", count(*) >= 1 AS passed, count(*) AS element_count, 0 AS missing_count, 0 AS unexpected_count FROM contacts"
    ]
    + [
        f"SELECT {i}, 'expect_column_values_to_not_be_null', '{c}', count(*) = 0 OR count({c}) / count(*) >= 0.01, count(*), count(*) - count({c}), count(*) - count({c}) FROM contacts"
        for i, c in ((2, "rid"), (3, "name"), (4, "email"), (5, "phone"), (7, "ssn"), (9, "zip_code"), (10, "account_no"))
    ]
    + [
        f"SELECT {i}, 'expect_column_value_lengths_to_be_between', '{c}', count(CASE WHEN length({c}) NOT BETWEEN {lo} AND {hi} THEN 1 END) = 0, count(*), count(*) - count({c}), count(CASE WHEN length({c}) NOT BETWEEN {lo} AND {hi} THEN 1 END) FROM contacts"
        for i, c, lo, hi in ((6, "phone", 7, 15), (8, "ssn", 9, 11))
    ]
)


def _cell_check(i: int, kind: str, column: str, bad: str, mostly: str = "1.0") -> str:
    return (
        f"SELECT {i} AS \"index\", 'expect_column_{kind}' AS expectation, '{column}' AS \"column\", "
        f"count(*) = 0 OR (count(*) - count(CASE WHEN {bad} THEN 1 END)) / count(*) >= {mostly} AS passed, "
        f"(SELECT count(*) - count({column}) FROM contacts) AS missing_count, count(CASE WHEN {bad} THEN 1 END) AS unexpected_count, "
        f"CASE WHEN count(*) = 0 THEN 0.0 ELSE round(count(CASE WHEN {bad} THEN 1 END) / count(*) * 100, 6) END AS unexpected_percent, "
        f"arg_min(CASE WHEN {bad} THEN cast({column} AS VARCHAR) END, CASE WHEN {bad} THEN rid END) AS first_bad FROM contacts WHERE {column} IS NOT NULL"
    )


def _unique_check(i: int, column: str) -> str:
    dup = f"(SELECT {column} AS v, count(*) AS n, min(rid) AS r FROM contacts WHERE {column} IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"
    filled = f"(SELECT count({column}) FROM contacts)"
    return (
        f"SELECT {i}, 'expect_column_values_to_be_unique', '{column}', coalesce(sum(n), 0) = 0, "
        f"(SELECT count(*) - count({column}) FROM contacts), cast(coalesce(sum(n), 0) AS BIGINT), round(coalesce(sum(n), 0) / {filled} * 100, 6), "
        f"cast(arg_min(v, r) AS VARCHAR) FROM {dup}"
    )


CONTACT_CHECKS = " UNION ALL ".join(
    [
        "SELECT 1 AS \"index\", 'expect_table_row_count_to_be_between' AS expectation, NULL AS \"column\", count(*) >= 1 AS passed, 0 AS missing_count, 0 AS unexpected_count, cast(0.0 AS DOUBLE) AS unexpected_percent, NULL AS first_bad FROM contacts",
        "SELECT 2, 'expect_column_to_exist', 'email', true, 0, 0, 0.0, NULL",
        "SELECT 3, 'expect_column_to_exist', 'fax', false, 0, 0, 0.0, NULL",
        "SELECT 4, 'expect_column_values_to_not_be_null', 'email', count(email) / count(*) >= 0.9, count(*) - count(email), count(*) - count(email), round((count(*) - count(email)) / count(*) * 100, 6), NULL FROM contacts",
        _unique_check(5, "ssn"),
        _unique_check(6, "rid"),
        _cell_check(7, "value_lengths_to_be_between", "zip_code", "length(zip_code) NOT BETWEEN 5 AND 10"),
        _cell_check(8, "values_to_be_in_set", "phone", "phone <> 'unknown'"),
        _cell_check(9, "values_to_be_between", "rid", "rid < 10"),
        _cell_check(10, "values_to_be_between", "zip_code", "coalesce(try_cast(zip_code AS DOUBLE) NOT BETWEEN 30000 AND 40000, true)"),
        _cell_check(11, "values_to_match_regex", "zip_code", "NOT regexp_matches(zip_code, '^[0-9]+$')", "0.5"),
    ]
)
CHECKS = f"WITH {CONTACTS}, checks AS ({CONTACT_CHECKS}) "
LABEL_CASE = (
    "CASE expectation WHEN 'expect_table_row_count_to_be_between' THEN 'Row count out of range' "
    "WHEN 'expect_column_to_exist' THEN 'Missing required column' "
    "WHEN 'expect_column_values_to_not_be_null' THEN 'Column has too many nulls' "
    "WHEN 'expect_column_values_to_be_in_set' THEN 'Column contains unexpected values' "
    "WHEN 'expect_column_values_to_be_between' THEN 'Column values out of allowed range' "
    "WHEN 'expect_column_values_to_be_unique' THEN 'Column values must be unique' "
    "WHEN 'expect_column_values_to_match_regex' THEN 'Column value format mismatch' "
    "ELSE 'Column value length out of range' END"
)
FIRST_BAD_PHONES = "(SELECT concat('[', string_agg(concat('''', phone, ''''), ', ' ORDER BY rid), ']') FROM (SELECT rid, phone FROM contacts WHERE phone <> 'unknown' ORDER BY rid LIMIT 20))"
NULL_PCT = "(SELECT printf('%.1f%%', (count(*) - count(email)) / count(*) * 100) FROM contacts)"
FIRST_DETAIL = (
    f"CASE WHEN expectation LIKE '%not_be_null' THEN cast(unexpected_count AS VARCHAR) WHEN expectation LIKE '%in_set' THEN {FIRST_BAD_PHONES} ELSE '' END"
)
DETAIL_KEYS = (
    "CASE WHEN expectation LIKE '%not_be_null' THEN 'null_count|null_pct' WHEN expectation LIKE '%in_set' THEN 'bad_values' "
    "WHEN expectation LIKE '%to_be_between' THEN 'observed' ELSE '' END"
)


def _numeric(table: str, column: str) -> str:
    return (
        f"SELECT '{column}' AS \"column\", count({column}) AS non_null, round(cast(min({column}) AS DOUBLE), 6) AS numeric_min, "
        f"round(cast(max({column}) AS DOUBLE), 6) AS numeric_max, round(quantile_cont(cast({column} AS DOUBLE), 0.01), 6) AS p01, "
        f"round(quantile_cont(cast({column} AS DOUBLE), 0.99), 6) AS p99 FROM {table}"
    )


NUMERIC = {
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"],
    "part": ["p_partkey", "p_size", "p_retailprice"],
    "customer": ["c_custkey", "c_nationkey", "c_acctbal"],
}
TEXT = {"documents": ["text", "lang", "source"], "pages": ["url", "html"], "part": ["p_name", "p_brand", "p_type"]}


def _text(table: str, column: str) -> str:
    return (
        f"SELECT '{column}' AS \"column\", count({column}) AS non_null, cast(min(length({column})) AS INTEGER) AS len_min, cast(max(length({column})) AS INTEGER) AS len_max, "
        f"round(quantile_cont(cast(length({column}) AS DOUBLE), 0.95), 6) AS len_p95, "
        f"round_even(avg(CASE WHEN regexp_full_match({column}, '[+-]?(?:[0-9]+(?:\\.[0-9]*)?|\\.[0-9]+)') THEN 1.0 ELSE 0.0 END) * 100, 2) AS numeric_parse_pct, "
        f"round_even(avg(CASE WHEN regexp_matches({column}, '^\\s') OR regexp_matches({column}, '\\s$') THEN 0.0 ELSE 1.0 END) * 100, 2) AS trimmed_pct FROM {table}"
    )


TOP = {
    "lineitem": ["l_returnflag", "l_linestatus"],
    "part": ["p_brand", "p_type", "p_name"],
    "customer": ["c_mktsegment"],
    "documents": ["lang"],
}


def _top(table: str, column: str) -> str:
    return (
        f"SELECT '{column}' AS \"column\", v AS value, n AS cnt, row_number() OVER (ORDER BY n DESC, v) AS rank, count(*) OVER () AS kinds "
        f"FROM (SELECT {column} AS v, count(*) AS n FROM {table} WHERE {column} IS NOT NULL GROUP BY 1)"
    )


def _completeness(table: str, column: str, text: bool) -> str:
    words = ", ".join(map(sql_text, PLACEHOLDERS))
    blank = f"count(CASE WHEN trim({column}) = '' THEN 1 END)" if text else "0"
    place = f"count(CASE WHEN lower(trim({column})) IN ({words}) THEN 1 END)" if text else "0"
    return (
        f"SELECT '{column}' AS \"column\", count(*) AS rows, count(*) - count({column}) AS nulls, {blank} AS blanks, {place} AS placeholders FROM {table}"
    )


def _severity(share: str) -> str:
    return f"CASE WHEN {share} >= 0.1 THEN 'HIGH' WHEN {share} >= 0.01 THEN 'MEDIUM' ELSE 'LOW' END"


def _violations(table: str, column: str, issue: str, severity: str, bad: str) -> str:
    return (
        f"SELECT '{column}' AS \"column\", '{issue}' AS issue, '{severity}' AS severity, count({column}) AS values, "
        f"count(CASE WHEN {bad} THEN 1 END) AS violations, min(CASE WHEN {bad} THEN cast({column} AS VARCHAR) END) AS example FROM {table}"
    )


FORMAT_RULES = {"email": ["email"], "phone": ["phone"], "ssn": ["ssn"], "zip_code": ["zip"], "account_no": ["bank_account"]}


def _format(column: str, pattern: str) -> str:
    ok = f"regexp_full_match(trim({column}), {sql_text(RULES[pattern])})"
    return (
        f"SELECT '{column}' AS \"column\", '{pattern}' AS pattern, count(*) AS values, count(CASE WHEN {ok} THEN 1 END) AS matched, "
        f"min(CASE WHEN NOT {ok} THEN trim({column}) END) AS bad_example, round(count(CASE WHEN {ok} THEN 1 END) / count(*), 6) AS rate "
        f"FROM contacts WHERE trim({column}) <> ''"
    )


FORMATS = f"WITH {CONTACTS}, rates AS ({' UNION ALL '.join(_format(c, p) for c, ps in FORMAT_RULES.items() for p in ps)}) "
FORMAT_TEXT = {"email": "name@domain.tld", "phone": "10-digit phone number", "ssn": "nine digits, optionally 3-2-4 dashed", "zip": "5-digit code, optionally +4", "bank_account": "8 to 17 digits"}


def _dependency(left: str, right: str) -> str:
    keys = left.replace("+", ", ")
    return (
        f"SELECT '{left}' AS key, '{right}' AS value, count(*) AS groups, count(CASE WHEN k > 1 THEN 1 END) AS violating_groups, "
        f"cast(coalesce(sum(CASE WHEN k > 1 THEN n END), 0) AS BIGINT) AS rows_involved FROM (SELECT count(*) AS n, count(DISTINCT {right}) AS k FROM part WHERE {right} IS NOT NULL GROUP BY {keys})"
    )


def _classes(columns: str, table: str, k: int) -> str:
    return (
        f"SELECT '{columns}' AS columns, cast(sum(n) AS BIGINT) AS rows, count(*) AS classes, min(n) AS min_class_size, "
        f"cast(coalesce(sum(CASE WHEN n < {k} THEN n END), 0) AS BIGINT) AS rows_below_k FROM (SELECT count(*) AS n FROM {table} GROUP BY {columns})"
    )


def _duplicates(label: str, table: str, keys: str) -> str:
    return (
        f"SELECT '{label}' AS key, cast(coalesce(sum(n), 0) AS BIGINT) AS rows, count(CASE WHEN n > 1 THEN 1 END) AS duplicate_groups, "
        f"cast(coalesce(sum(CASE WHEN n > 1 THEN n END), 0) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM {table} GROUP BY {keys})"
    )


def _variance(table: str, column: str) -> str:
    return (
        f"SELECT '{table}' AS \"table\", '{column}' AS \"column\", count({column}) AS non_null, round(avg(length({column})), 4) AS mean_length, "
        f"round(stddev_samp(length({column})), 4) AS std_length, count({column}) >= 10 AND avg(length({column})) > 0 AND coalesce(stddev_samp(length({column})) > 3 * avg(length({column})), false) AS fired FROM {table}"
    )


AUTO_COLUMNS = ["rid", "name", "email", "phone", "ssn", "zip_code", "account_no"]
NUMERIC_RX = "^[+-]?(?:[0-9]+(?:\\.[0-9]*)?|\\.[0-9]+)$"


def _auto_outcome(i: int, column: str) -> str:
    numeric = f"regexp_matches(cast({column} AS VARCHAR), {sql_text(NUMERIC_RX)})"
    trimmed = f"regexp_matches(cast({column} AS VARCHAR), '^\\S(?:.*\\S)?$')"
    shape = f"CASE WHEN avg(CASE WHEN {numeric} THEN 1.0 ELSE 0.0 END) >= 0.5 THEN bool_and({numeric}) ELSE bool_and({trimmed}) END"
    return (
        f"SELECT {2 * i + 1} AS \"index\", 'expect_column_values_to_not_be_null' AS expectation, '{column}' AS \"column\", count({column}) / count(*) >= 0.95 AS passed FROM contacts "
        f"UNION ALL SELECT {2 * i + 2}, 'expect_column_values_to_match_regex', '{column}', coalesce({shape}, true) FROM contacts WHERE {column} IS NOT NULL"
    )


PROPOSED = "SELECT p_partkey, p_size, p_brand, p_partkey % 4 AS kind FROM part"
BETWEEN_PARAMS = "p_size"

ORACLES: dict[str, str] = {
    "sample_values_contacts": f"WITH {CONTACTS}, {CONTACT_CELLS}, {sampled()} SELECT \"column\", value, cnt, cast(rn AS INTEGER) AS rn FROM sample",
    "column_shape": (
        f"WITH {CONTACTS}, {cells('c1', 'contacts', 'rid', CONTACT_VALUES, 'contacts')}, {cells('c2', 'documents', 'doc_id', ['text', 'lang', 'source'], 'documents')}, "
        f"cells AS (SELECT source, rid, \"column\", regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS raw FROM (SELECT * FROM c1 UNION ALL SELECT * FROM c2)), {sampled(limit=10**12)}, "
        "shape AS (SELECT source, \"column\", count(*) AS sample_size, round(avg(length(value)), 6) AS avg_length, "
        "round(avg(CASE WHEN regexp_matches(value, '\\S\\s+\\S+\\s+\\S+\\s+\\S') THEN 1.0 ELSE 0.0 END), 6) AS wordy_share FROM sample GROUP BY ALL) "
        f"SELECT *, (avg_length > 15 OR wordy_share > 0.25) AS free_text, {has_hint('\"column\"', CANDIDATE_HINTS)} AS candidate, {has_hint('\"column\"', ENTITY_PRIORITY_HINTS)} AS priority, "
        f"{has_hint('\"column\"', CANDIDATE_HINTS)} OR avg_length > 15 OR wordy_share > 0.25 AS scanned FROM shape"
    ),
    "pattern_counts": (
        f"WITH {CONTACTS}, {CONTACT_CELLS}, {sampled(limit=10**12)}, {hits('hit', 'sample')}, size AS (SELECT \"column\", count(*) AS sample_size FROM sample GROUP BY ALL) "
        "SELECT h.\"column\", pattern, count(*) AS matches, any_value(sample_size) AS sample_size, "
        "array_to_string((list(value ORDER BY rn))[1:5], '|') AS examples FROM hit h JOIN size s ON h.\"column\" = s.\"column\" GROUP BY h.\"column\", pattern"
    ),
    "scan_findings": MANY_FINDINGS + "SELECT * FROM findings",
    "scan_directory_rules": DIRECTORY_FINDINGS
    + "SELECT source, \"column\", pattern, confidence, risk, matches, sample_size, match_pct, detection_source FROM findings",
    "scan_directory_states": DIRECTORY_FINDINGS + (
        "SELECT s.source AS file, 'SUCCESS' AS state, count(CASE WHEN scanned THEN 1 END) AS columns_scanned, "
        "cast(coalesce(any_value(f.n), 0) AS BIGINT) AS findings FROM shape s "
        "LEFT JOIN (SELECT source, count(*) AS n FROM findings GROUP BY ALL) f ON s.source = f.source GROUP BY s.source"
    ),
    "scan_stats": MANY_FINDINGS + (
        f", listed AS ({MANY_COLUMNS}) SELECT l.source, count(CASE WHEN coalesce(s.scanned, {has_hint('l.\"column\"', CANDIDATE_HINTS)}) THEN 1 END) AS columns_scanned, "
        "cast(coalesce(sum(f.n), 0) AS BIGINT) AS findings FROM listed l LEFT JOIN shape s ON l.source = s.source AND l.\"column\" = s.\"column\" "
        "LEFT JOIN (SELECT source, \"column\", count(*) AS n FROM findings GROUP BY ALL) f ON l.source = f.source AND l.\"column\" = f.\"column\" GROUP BY l.source"
    ),
    "full_scan_contacts": FULL + (
        f"SELECT \"column\", pattern, confidence, {RISK} AS risk, matches, sample_size, match_pct, coalesce(ex[1], '') AS sample_match_1, coalesce(ex[5], '') AS sample_match_5 FROM rated"
    ),
    "full_scan_tokens": (
        f"WITH {TOKENS}, idx AS (SELECT regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS value, count(*) AS cnt FROM tokens GROUP BY 1 HAVING value <> ''), {hits('hit', 'idx')} "
        "SELECT pattern, count(*) AS matches, cast(sum(cnt) AS BIGINT) AS rows, (SELECT count(*) FROM idx) AS sample_size, (SELECT cast(sum(cnt) AS BIGINT) FROM idx) AS total_rows FROM hit GROUP BY pattern"
    ),
    "entity_scan_documents": entity_rows("SELECT DISTINCT regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM documents WHERE trim(text) <> ''"),
    "scan_entities_many": " UNION ALL ".join(
        f"SELECT '{name}' AS source, entity, matches, entity_score FROM ({entity_rows(texts)})"
        for name, texts in (
            ("documents", "SELECT DISTINCT regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM documents WHERE trim(text) <> ''"),
            ("talk", f"SELECT DISTINCT regexp_replace({TALK_TEXT}, '^\\s+|\\s+$', '', 'g') AS text FROM conversations"),
        )
    ),
    "entity_scan_conversations": entity_rows(
        f"SELECT DISTINCT regexp_replace({TALK_TEXT}, '^\\s+|\\s+$', '', 'g') AS text FROM conversations"
    ),
    "entity_findings_notes": (
        f"WITH {NOTES}, names AS (SELECT full_name AS v, min(rid) AS r FROM notes GROUP BY 1), texts AS (SELECT rid AS r, note AS v, "
        f"p AS place, full_name FROM (SELECT c.*, {PLACE} AS p, {PERSON} AS full_name, {NOTE_COLUMNS['note']} AS note, c_custkey AS rid FROM customer c)), "
        "places AS (SELECT place, min(r) AS r FROM texts GROUP BY 1), people AS (SELECT full_name, min(r) AS r FROM texts GROUP BY 1) "
        "SELECT 'notes' AS source, 'full_name' AS \"column\", 'PERSON' AS pattern, 'AI' AS confidence, 'REVIEW' AS risk, count(*) AS matches, count(*) AS sample_size, cast(100.0 AS DOUBLE) AS match_pct, "
        "cast(0.85 AS DOUBLE) AS entity_score, coalesce((list(v ORDER BY r))[1], '') AS sample_match_1, coalesce((list(v ORDER BY r))[2], '') AS sample_match_2, coalesce((list(v ORDER BY r))[3], '') AS sample_match_3, 'ENTITY_RULE' AS detection_source FROM names "
        "UNION ALL SELECT 'notes', 'note', 'PERSON', 'AI', 'REVIEW', (SELECT count(*) FROM texts), (SELECT count(*) FROM texts), 100.0, 0.85, coalesce((list(full_name ORDER BY r))[1], ''), coalesce((list(full_name ORDER BY r))[2], ''), coalesce((list(full_name ORDER BY r))[3], ''), 'ENTITY_RULE' FROM people "
        "UNION ALL SELECT 'notes', 'note', 'LOCATION', 'AI', 'REVIEW', (SELECT count(*) FROM texts), (SELECT count(*) FROM texts), 100.0, 0.85, coalesce((list(place ORDER BY r))[1], ''), coalesce((list(place ORDER BY r))[2], ''), coalesce((list(place ORDER BY r))[3], ''), 'ENTITY_RULE' FROM places"
    ),
    "scan_identities": IDENTITY_FINDINGS + "SELECT * FROM findings",
    "redact_identities": (
        "SELECT c_custkey AS rid, '<PII_REDACT:dob>' AS birth_dob, '<PII_REDACT:passport>' AS passport_no, "
        "'<PII_REDACT:routing_number>' AS routing_no, '<PII_REDACT:ein>' AS tax_ein FROM customer"
    ),
    "planted_anomalies": (
        "SELECT 'l_quantity' AS \"column\", count(*) AS total_rows, true AS found, true AS within_share, true AS above FROM lineitem"
    ),
    "planted_rare_text": "SELECT 'label' AS \"column\", count(*) AS total_rows, true AS found, true AS within_share FROM orders",
    "rule_findings_only": CONTACT_FINDINGS + "SELECT \"column\", pattern, risk FROM findings",
    "risk_summary": CONTACT_FINDINGS + "SELECT " + ", ".join(
        f"count(CASE WHEN risk = '{r}' THEN 1 END) AS {r}" for r in RISK_LEVELS
    ) + " FROM findings",
    "risk_counts": CONTACT_FINDINGS + "SELECT risk, count(*) AS findings FROM findings GROUP BY risk",
    "top_findings": CONTACT_FINDINGS + (
        "SELECT concat(array_to_string(list_transform(string_split(pattern, '_'), lambda w: concat(upper(w[1]), w[2:])), ' '), '(Regex)') AS pattern, risk, cast(sum(matches) AS BIGINT) AS matches FROM findings GROUP BY 1, 2 ORDER BY matches DESC, pattern, risk LIMIT 10"
    ),
    "distinct_findings": CONTACT_FINDINGS + "SELECT DISTINCT \"column\", pattern, risk, detection_source FROM findings",
    "findings_sorted": CONTACT_FINDINGS + "SELECT source, \"column\", pattern, risk, confidence, matches, match_pct, detection_source, sample_match_1 FROM findings",
    "display_labels": CONTACT_FINDINGS + (
        "SELECT \"column\", concat(array_to_string(list_transform(string_split(pattern, '_'), lambda w: concat(upper(w[1]), w[2:])), ' '), '(Regex)') AS pattern FROM findings"
    ),
    "known_columns": CONTACT_FINDINGS + "SELECT DISTINCT \"column\" FROM findings",
    "findings_without_samples": CONTACT_FINDINGS + "SELECT source, \"column\", pattern, confidence, risk, matches, sample_size, match_pct, detection_source FROM findings",
    "redact_cells": remediated(REDACT, CELL_ROWS),
    "mask_cells": remediated(MASK, CELL_ROWS),
    "hash_cells": remediated(HASH, CELL_ROWS),
    "stream_redacted_contacts": remediated(REDACT, CELL_ROWS),
    "remediation_audit": remediated(REDACT, AUDIT.format(s="REDACT")),
    "remediation_summary": remediated(HASH, f"SELECT file_name, pattern, strategy, cast(sum(cells_changed) AS BIGINT) AS cells_changed FROM ({AUDIT.format(s='HASH')}) GROUP BY ALL"),
    "total_cells": remediated(REDACT, "SELECT count(*) AS total_cells_changed FROM rewritten WHERE pattern IS NOT NULL"),
    "sample_literals": CONTACT_FINDINGS + (
        ", lits AS (SELECT sample_match_1 AS a, sample_match_2 AS b, sample_match_3 AS c, sample_match_4 AS d, sample_match_5 AS e FROM findings WHERE \"column\" = 'email' AND pattern = 'email') "
        "SELECT rid, " + "replace(" * 5 + "email, a, '<PII_REDACT:email>'), b, '<PII_REDACT:email>'), c, '<PII_REDACT:email>'), d, '<PII_REDACT:email>'), e, '<PII_REDACT:email>') AS email FROM contacts, lits"
    ),
    "remediate_many_files": "SELECT c_custkey AS rid, concat('part', c_custkey % 3, '.csv') AS file, "
    "CASE WHEN c_custkey % 3 = 1 THEN concat('write to user', c_custkey, '@example.com') "
    "WHEN c_custkey % 10 = 0 THEN 'write to <PII_REDACT:email>' ELSE '<PII_REDACT:email>' END AS email, "
    "CASE WHEN c_custkey % 3 <> 2 THEN '<PII_REDACT:ssn>' END AS ssn FROM customer",
    "remediate_many_audit": "SELECT concat('part', c_custkey % 3, '.csv') AS file_name, 'email' AS \"column\", 'email' AS pattern, "
    "CASE WHEN c_custkey % 10 = 0 THEN 'STRICT_FALLBACK' ELSE 'REGEX_RULE' END AS detection_source, 'REDACT' AS strategy, count(*) AS cells_changed "
    "FROM customer WHERE c_custkey % 3 <> 1 GROUP BY ALL UNION ALL "
    "SELECT concat('part', c_custkey % 3, '.csv'), 'ssn', 'ssn', 'REGEX_RULE', 'REDACT', count(*) FROM customer WHERE c_custkey % 3 <> 2 GROUP BY ALL",
    "redact_documents": redaction_stages("SELECT doc_id, text FROM {last}"),
    "redact_documents_audit": redaction_stages(
        "SELECT * FROM (" + " UNION ALL ".join(
            f"SELECT 'documents' AS file_name, 'text' AS \"column\", '{p}' AS pattern, 'STRICT_FALLBACK' AS detection_source, 'REDACT' AS strategy, count(CASE WHEN f_{p} THEN 1 END) AS cells_changed FROM {{last}}"
            for p in SEARCH
        ) + ") WHERE cells_changed > 0"
    ),
    "context_digits_orders": (
        "SELECT o_orderkey, 'Customer paid by account <PII_REDACT:bank_account> and then <PII_REDACT:bank_account> was booked on the ledger of the month, ABA <PII_REDACT:routing_number>.' AS text, true AS routing, true AS account FROM orders"
    ),
    "person_location_fallback": (
        f"SELECT c_custkey AS rid, {_HASHED_PERSON} AS full_name, {note_text(_HASHED_PERSON, _HASHED_PLACE)} AS note FROM customer"
    ),
    "review_findings_excluded": f"WITH {NOTES} SELECT rid, full_name, note FROM notes",
    "validate_contacts": (
        f"WITH {CONTACTS}, checks AS ({INPUT_SUITE_SQL}) SELECT 'contacts' AS file_name, bool_and(passed) AS passed, count(*) AS evaluated, count(CASE WHEN passed THEN 1 END) AS successful, "
        "count(CASE WHEN NOT passed THEN 1 END) AS failed, round_even(count(CASE WHEN passed THEN 1 END) / count(*), 4) AS success_rate FROM checks"
    ),
    "input_suite_outcomes": f"WITH {CONTACTS} {INPUT_SUITE_SQL}",
    "validate_findings": CONTACT_FINDINGS + (
        ", checks AS (SELECT count(*) >= 1 AS ok FROM findings UNION ALL SELECT true FROM range(8) "
        "UNION ALL SELECT coalesce(bool_and(confidence IN ('HIGH', 'LOW')), true) FROM findings UNION ALL SELECT coalesce(bool_and(risk IN ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL')), true) FROM findings "
        "UNION ALL SELECT coalesce(bool_and(matches >= 1), true) FROM findings UNION ALL SELECT coalesce(bool_and(match_pct BETWEEN 0 AND 100), true) FROM findings) "
        "SELECT 'findings' AS file_name, bool_and(ok) AS passed, count(*) AS evaluated, count(CASE WHEN ok THEN 1 END) AS successful, count(CASE WHEN NOT ok THEN 1 END) AS failed, round_even(count(CASE WHEN ok THEN 1 END) / count(*), 4) AS success_rate FROM checks"
    ),
    "expectation_outcomes": CHECKS + "SELECT * FROM checks",
    "expectation_failures": CHECKS + f"SELECT \"index\", {LABEL_CASE} AS expectation, \"column\", {DETAIL_KEYS} AS detail_keys, {FIRST_DETAIL} AS first_detail FROM checks WHERE NOT passed",
    "quality_scores": CHECKS + (
        "SELECT 'contacts' AS file_name, evaluated, successful, cast(round_even(successful / evaluated * 100, 0) AS BIGINT) AS score, "
        "CASE WHEN successful / evaluated * 100 >= 89.5 THEN 'meets' WHEN successful / evaluated * 100 >= 69.5 THEN 'warn' ELSE 'fail' END AS band FROM (SELECT count(*) AS evaluated, count(CASE WHEN passed THEN 1 END) AS successful FROM checks)"
    ),
    "failure_payload": CHECKS + (
        ", kept AS (SELECT *, row_number() OVER (ORDER BY \"index\") AS k FROM checks WHERE expectation NOT LIKE '%in_set') "
        "SELECT 'contacts' AS file_name, count(*) AS evaluated, count(CASE WHEN passed THEN 1 END) AS successful, count(CASE WHEN NOT passed THEN 1 END) AS failed, "
        "concat('[', string_agg(CASE WHEN NOT passed THEN concat('{\"issue\":\"', "
        f"{LABEL_CASE}, '\",\"column\":\"', coalesce(\"column\", '(table-level)'), '\"', "
        f"CASE WHEN expectation LIKE '%not_be_null' THEN concat(',\"null_count\":\"', cast(unexpected_count AS VARCHAR), '\",\"null_pct\":\"', {NULL_PCT}, '\"') "
        "WHEN expectation LIKE '%to_be_between' THEN ',\"observed\":\"\"' ELSE '' END, '}') END, ',' ORDER BY k), ']') AS failures FROM kept"
    ),
    "unique_ids": " UNION ALL ".join(
        [
            _duplicates("lineitem.l_orderkey", "lineitem", "l_orderkey"),
            _duplicates("lineitem.l_orderkey+l_linenumber", "lineitem", "l_orderkey, l_linenumber"),
            _duplicates("orders.o_orderkey", "orders", "o_orderkey"),
        ]
    ),
    "length_variance": " UNION ALL ".join(
        _variance(t, c) for t, cols in (("documents", ["text", "lang", "source"]), ("pages", ["url", "html"])) for c in cols
    ),
    "profile_common": f"WITH {CONTACTS} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS rows, count({c}) AS non_null, round_even((count(*) - count({c})) / count(*) * 100, 2) AS null_pct, count(DISTINCT {c}) AS \"distinct\", round_even(count(DISTINCT {c}) / count({c}) * 100, 2) AS distinct_pct FROM contacts"
        for c in AUTO_COLUMNS
    ),
    "profile_merged": f"WITH {CONTACTS} SELECT 'rid' AS \"column\", count(*) AS rows, count(rid) AS non_null, "
    "round_even((count(*) - count(rid)) / count(*) * 100, 2) AS null_pct, cast(min(rid) AS DOUBLE) AS numeric_min, cast(max(rid) AS DOUBLE) AS numeric_max, "
    "cast(NULL AS INTEGER) AS len_min, cast(NULL AS INTEGER) AS len_max, cast(NULL AS DOUBLE) AS trimmed_pct, true AS distinct_within FROM contacts UNION ALL "
    + " UNION ALL ".join(
        f"SELECT '{c}', count(*), count({c}), round_even((count(*) - count({c})) / count(*) * 100, 2), NULL, NULL, "
        f"cast(min(length({c})) AS INTEGER), cast(max(length({c})) AS INTEGER), 100.0, {within} FROM contacts"
        for c, within in (("email", "true"), ("phone", "abs(count(DISTINCT phone) / count(phone) - 1) <= 0.05"))
    ),
    "profile_numeric": " UNION ALL ".join(_numeric(t, c) for t, cols in NUMERIC.items() for c in cols),
    "profile_text": " UNION ALL ".join(_text(t, c) for t, cols in TEXT.items() for c in cols),
    "top_values": "SELECT \"column\", value, cnt, cast(rank AS INTEGER) AS rank FROM (" + " UNION ALL ".join(
        _top(t, c) for t, cols in TOP.items() for c in cols
    ) + ") WHERE kinds <= 50 AND rank <= 8",
    "first_values_per_column": f"WITH {CONTACTS}, {CONTACT_CELLS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY rid) AS k FROM cells) "
    "SELECT \"column\", string_agg(raw, '|' ORDER BY k) AS sample_values FROM ranked WHERE k <= 5 GROUP BY \"column\"",
    "dataset_profile_customer": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", 0 AS batch, {i} AS position, count(*) AS row_count, count(*) AS profile_sample_rows, 5 AS column_count, count({c}) AS non_null, count(DISTINCT {c}) AS \"distinct\", "
        f"(SELECT string_agg(cast({c} AS VARCHAR), '|' ORDER BY c_custkey) FROM (SELECT * FROM customer WHERE {c} IS NOT NULL ORDER BY c_custkey LIMIT 5)) AS sample_values FROM customer"
        for i, c in enumerate(["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])
    ),
    "auto_specs": " UNION ALL ".join(
        f"SELECT {2 * i + 1} AS \"index\", 'expect_column_values_to_not_be_null' AS expectation_type, '{c}' AS \"column\", 'MEDIUM' AS confidence, 'PROFILE_FALLBACK' AS generation_source "
        f"UNION ALL SELECT {2 * i + 2}, 'expect_column_values_to_match_regex', '{c}', 'MEDIUM', 'PROFILE_FALLBACK'"
        for i, c in enumerate(AUTO_COLUMNS)
    ),
    "auto_outcomes": f"WITH {CONTACTS}, o AS (" + " UNION ALL ".join(
        _auto_outcome(i, c) for i, c in enumerate(AUTO_COLUMNS)
    ) + ") SELECT *, CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END AS status FROM o",
    "sanitised_specs": (
        f"WITH p AS ({PROPOSED}) "
        "SELECT min(p_partkey) AS p_partkey, 0 AS pos, 'expect_column_values_to_be_between' AS expectation_type, 'p_size' AS \"column\", 'size' AS rationale, 'LOW' AS confidence, cast(NULL AS DOUBLE) AS mostly, cast(NULL AS VARCHAR) AS value_set, cast(p_size AS VARCHAR) AS min_value FROM p WHERE kind = 0 GROUP BY p_size "
        "UNION ALL SELECT min(p_partkey), 0, 'expect_column_values_to_be_in_set', 'p_brand', '', 'MEDIUM', NULL, concat(p_brand, '|1'), NULL FROM p WHERE kind = 1 GROUP BY p_brand "
        "UNION ALL SELECT min(p_partkey), 0, 'expect_column_values_to_not_be_null', 'p_name', '', 'MEDIUM', m, NULL, NULL FROM (SELECT p_partkey, greatest(0.95, cast(concat('0.', cast(p_size AS VARCHAR)) AS DOUBLE)) AS m FROM p WHERE kind = 2) GROUP BY m"
    ),
    "proposal_diagnostics": (
        f"WITH p AS ({PROPOSED}), a AS (SELECT count(CASE WHEN kind < 3 THEN 1 END) AS answered, count(CASE WHEN kind = 0 THEN 1 END) AS k0, count(CASE WHEN kind = 1 THEN 1 END) AS k1, count(CASE WHEN kind = 2 THEN 1 END) AS k2, count(CASE WHEN kind = 3 THEN 1 END) AS k3, "
        "count(DISTINCT CASE WHEN kind = 0 THEN p_size END) + count(DISTINCT CASE WHEN kind = 1 THEN p_brand END) + count(DISTINCT CASE WHEN kind = 2 THEN greatest(0.95, cast(concat('0.', cast(p_size AS VARCHAR)) AS DOUBLE)) END) AS kept, "
        "cast(sum(CASE kind WHEN 0 THEN length(concat('```json', chr(10), '[{\"expectation_type\":\"expect_column_values_to_be_between\",\"column\":\"p_size\",\"kwargs\":{\"min_value\":', cast(p_size AS VARCHAR), '},\"confidence\":\"low\",\"rationale\":\" size \"},{\"expectation_type\":\"expect_table\",\"column\":\"p_name\"}]', chr(10), '```')) "
        "WHEN 1 THEN length(concat('{\"items\":[{\"expectation_type\":\"EXPECT_COLUMN_VALUES_TO_BE_IN_SET\",\"column\":\"p_brand\",\"kwargs\":{\"value_set\":[\"', p_brand, '\",1]}},{\"expectation_type\":\"expect_column_values_to_be_unique\",\"column\":\"p_missing\"}]}')) "
        "WHEN 2 THEN length(concat('[{\"expectation_type\":\"expect_column_values_to_not_be_null\",\"column\":\"p_name\",\"kwargs\":{\"mostly\":0.', cast(p_size AS VARCHAR), '}},7]')) ELSE length('no answer') END) AS BIGINT) AS chars FROM p) "
        "SELECT 1 AS batches, k0 + k1 + k2 + k3 AS responses, chars AS response_chars, 2 * k0 + 2 * k1 + k2 AS items_parsed, kept AS specs_accepted, kept AS proposed_specs_accepted, cast(0 AS BIGINT) AS profile_fallback_specs, k0 AS rejected_unknown_type, k1 AS rejected_bad_column FROM a"
    ),
    "response_rows": (
        "SELECT o_orderkey, 0 AS pos, 'o_totalprice' AS \"column\", 'odd total' AS issue, cast(o_orderkey AS VARCHAR) AS example, 'HIGH' AS severity FROM orders WHERE o_orderstatus = 'F' "
        "UNION ALL SELECT o_orderkey, 1, 'o_orderdate', 'late', '', 'MEDIUM' FROM orders WHERE o_orderstatus = 'O'"
    ),
    "sample_payload": (
        f"WITH {CONTACTS}, {CONTACT_CELLS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY rid) AS k FROM cells), "
        "lists AS (SELECT \"column\", concat('[', string_agg(concat('\"', raw, '\"'), ',' ORDER BY k), ']') AS l FROM ranked WHERE k <= 5 GROUP BY \"column\") "
        "SELECT concat('{', string_agg(concat('\"', \"column\", '\":', l), ',' ORDER BY list_position([" + ", ".join(map(sql_text, CONTACT_VALUES)) + "], \"column\")), '}') AS payload FROM lists"
    ),
    "embedded_hits_documents": " UNION ALL ".join(
        f"SELECT 'text' AS \"column\", '{p}' AS pattern, count(CASE WHEN {found(p)} THEN 1 END) AS rows_hit, count(text) AS rows FROM documents" for p in SEARCH
    ),
    "semantic_pii_documents": (
        "WITH h AS (SELECT greatest(" + ", ".join(
            f"count(CASE WHEN {test} THEN 1 END)"
            for test in [*[found(p) for p in SEARCH], *[t for t, _ in ENTITY_TESTS.values()]]
        ) + ") / count(text) AS share FROM documents) "
        "SELECT 'body' AS \"column\", CASE WHEN share >= 0.5 THEN 'HIGH' WHEN share >= 0.1 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM h WHERE share > 0 UNION ALL SELECT 'city', 'MEDIUM'"
    ),
    "regulatory_flags": CONTACT_FINDINGS + (
        ", mapping AS (SELECT * FROM (VALUES " + ", ".join(
            "(" + ", ".join(map(sql_text, r)) + ")" for r in REGULATIONS
        ) + ") t(pattern, regulation, category, obligation, severity)) "
        "SELECT \"column\", regulation, category, severity FROM (SELECT DISTINCT f.\"column\", regulation, category, obligation, CASE WHEN confidence = 'LOW' THEN 'LOW' ELSE severity END AS severity FROM findings f JOIN mapping m ON f.pattern = m.pattern)"
    ),
    "k_anonymity_customer": "SELECT *, round(rows_below_k / rows, 6) AS share_below_k FROM (" + " UNION ALL ".join(
        _classes(c, "customer", 10) for c in ("c_mktsegment,c_nationkey", "c_nationkey", "c_mktsegment")
    ) + ")",
    "minimal_identifiers": f"WITH t AS (SELECT {select_list(KEY_PARTS)} FROM customer), measured AS (" + " UNION ALL ".join(
        f"SELECT {m} AS mask, '{','.join(g)}' AS columns, {len(g)} AS size, cast(sum(n) AS BIGINT) AS rows, count(*) AS classes, min(n) AS min_class_size, "
        f"cast(coalesce(sum(n) FILTER (n < 5), 0) AS BIGINT) AS rows_below_k FROM (SELECT count(*) AS n FROM t GROUP BY {', '.join(g)})"
        for m in range(1, 1 << len(KEY_PARTS))
        for g in [sorted(c for i, c in enumerate(KEY_PARTS) if m >> i & 1)]
    ) + "), found AS (SELECT * FROM measured WHERE rows_below_k / rows >= 0.05) "
    "SELECT columns, size, CASE WHEN rows_below_k / rows >= 0.2 THEN 'HIGH' ELSE 'MEDIUM' END AS risk, rows, classes, min_class_size, rows_below_k "
    "FROM found f WHERE NOT EXISTS (SELECT 1 FROM found o WHERE o.mask <> f.mask AND (o.mask & f.mask) = o.mask)",
    "quasi_identifiers_part": "SELECT columns, CASE WHEN rows_below_k / rows >= 0.2 THEN 'HIGH' WHEN rows_below_k / rows >= 0.05 THEN 'MEDIUM' ELSE 'LOW' END AS risk, "
    "concat(cast(rows_below_k AS VARCHAR), ' of ', cast(rows AS VARCHAR), ' rows share their values with fewer than 5 rows.') AS reason FROM (" + " UNION ALL ".join(
        _classes(c, "part", 5) for c in ("p_brand,p_type", "p_brand,p_size", "p_size,p_type", "p_brand,p_size,p_type")
    ) + ") WHERE rows_below_k > 0",
    "format_rates": FORMATS + "SELECT * FROM rates",
    "format_anomalies": FORMATS + (
        "SELECT \"column\", CASE pattern " + " ".join(f"WHEN '{p}' THEN '{t}'" for p, t in FORMAT_TEXT.items()) + " END AS expected_format, "
        "concat(cast(values - matched AS VARCHAR), ' of ', cast(values AS VARCHAR), ' values do not match, for example ''', bad_example, '''.') AS observed_issue, "
        "CASE WHEN rate < 0.5 THEN 'HIGH' WHEN rate < 0.75 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM rates WHERE matched / values < 0.95"
    ),
    "plausibility_counts": " UNION ALL ".join(
        [
            _violations("lineitem", "l_quantity", "Negative amounts.", "HIGH", "l_quantity < 0"),
            _violations("lineitem", "l_extendedprice", "Negative amounts.", "HIGH", "l_extendedprice < 0"),
            _violations("lineitem", "l_discount", "Fractions outside 0 to 1.", "MEDIUM", "l_discount < 0 OR l_discount > 1"),
            _violations("lineitem", "l_tax", "Fractions outside 0 to 1.", "MEDIUM", "l_tax < 0 OR l_tax > 1"),
            _violations("lineitem", "l_shipdate", "Dates before 1900 or more than 50 years ahead.", "HIGH", "l_shipdate < DATE '1900-01-01' OR l_shipdate > current_date + INTERVAL 50 YEAR"),
            _violations("customer", "c_acctbal", "Negative balances.", "MEDIUM", "c_acctbal < 0"),
            _violations("orders", "o_totalprice", "Negative amounts.", "HIGH", "o_totalprice < 0"),
            _violations("orders", "o_orderdate", "Dates before 1900 or more than 50 years ahead.", "HIGH", "o_orderdate < DATE '1900-01-01' OR o_orderdate > current_date + INTERVAL 50 YEAR"),
        ]
    ),
    "plausibility_contacts": (
        f"WITH {CONTACTS} SELECT 'zip_code' AS \"column\", 'Postal codes holding letters.' AS issue, min(zip_code) AS example, 'MEDIUM' AS severity FROM contacts WHERE regexp_matches(zip_code, '[A-Za-z]') "
        "UNION ALL SELECT 'active', 'Yes/no values are spelled in several ways.', 'Yes/No, T/F', 'MEDIUM' FROM contacts HAVING count(*) > 1"
    ),
    "date_order": "SELECT count(*) AS rows, count(CASE WHEN l_shipdate < o_orderdate THEN 1 END) AS violations FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "functional_dependency": " UNION ALL ".join(
        [_dependency("p_type", "p_brand"), _dependency("p_brand+p_type", "p_size"), _dependency("p_partkey", "p_name")]
    ),
    "consistency_customer": (
        "WITH a AS (SELECT count(c_acctbal + c_nationkey) AS n, count(CASE WHEN abs(c_acctbal - (c_acctbal / 2 + c_nationkey)) > 0.01 THEN 1 END) AS m FROM customer), "
        "b AS (SELECT count(*) AS n, count(CASE WHEN n_regionkey IS NULL OR n_regionkey = 0 THEN 1 END) AS m FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey), "
        "c AS (SELECT count(*) AS n, count(CASE WHEN k > 1 THEN 1 END) AS m FROM (SELECT count(DISTINCT c_mktsegment) AS k FROM customer GROUP BY c_nationkey)) "
        f"SELECT 'c_acctbal, half, n_nationkey' AS columns, concat(cast(m AS VARCHAR), ' of ', cast(n AS VARCHAR), ' totals differ from the sum of their parts.') AS issue, {_severity('m / n')} AS severity FROM a WHERE m > 0 "
        f"UNION ALL SELECT 'n_nationkey', concat(cast(m AS VARCHAR), ' of ', cast(n AS VARCHAR), ' rows hold a combination that is not listed.'), {_severity('m / n')} FROM b WHERE m > 0 "
        f"UNION ALL SELECT 'n_nationkey, c_mktsegment', concat(cast(m AS VARCHAR), ' of ', cast(n AS VARCHAR), ' key values have several values in the other column.'), {_severity('m / n')} FROM c WHERE m > 0"
    ),
    "completeness_rates": (
        f"WITH {CONTACTS}, j AS (SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) "
        + " UNION ALL ".join(
            [_completeness("j", c, c == "lang") for c in ("doc_id", "lang", "quality", "toxic")]
            + [_completeness("contacts", c, True) for c in CONTACT_VALUES]
        )
    ),
    "completeness_contacts": (
        f"WITH {CONTACTS}, r AS (" + " UNION ALL ".join(_completeness("contacts", c, True) for c in CONTACT_VALUES) + ") "
        "SELECT \"column\", concat(cast(nulls + blanks + placeholders AS VARCHAR), ' of ', cast(rows AS VARCHAR), ' values are missing: ', cast(nulls AS VARCHAR), ' null, ', cast(blanks AS VARCHAR), ' blank, ', cast(placeholders AS VARCHAR), ' placeholder.') AS issue, "
        "CASE WHEN (nulls + blanks + placeholders) / rows >= 0.5 THEN 'HIGH' WHEN (nulls + blanks + placeholders) / rows >= 0.2 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM r WHERE (nulls + blanks + placeholders) / rows > 0.05 "
        "UNION ALL SELECT 'dataset-level', 'A column about ''name'' has no companion about ''id or key or rid''.', 'LOW'"
    ),
    "rarity_encoding": "SELECT 'event_type' AS \"column\", event_type AS value, count(*) AS cnt, round(1.0 / (count(*) + 1), 12) AS code FROM events WHERE event_type IS NOT NULL GROUP BY event_type",
    "hash_sample_events": "SELECT event_id, event_type FROM events ORDER BY md5(concat('42|', cast(event_id AS VARCHAR))), event_id LIMIT 1000",
    "head_mid_tail": (
        "WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) "
        "SELECT o_orderkey, o_custkey FROM r WHERE n <= 1000 OR i < 333 OR i >= n - 333 OR (i >= (n - 334) // 2 AND i < (n - 334) // 2 + 334)"
    ),
    "document_lines": (
        "SELECT doc_id, cast(line_no AS INTEGER) AS line_no, value FROM (SELECT doc_id, unnest(p) AS value, generate_subscripts(p, 1) - 1 AS line_no FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c]|\\x{85}|\\x{2028}|\\x{2029}') AS p FROM documents)) WHERE regexp_matches(value, '\\S')"
    ),
    "file_rollup": remediated(REDACT, (
        f", checks AS ({INPUT_SUITE_SQL}) SELECT 'contacts' AS file, (SELECT count(*) FROM findings) AS pii_findings, "
        "(SELECT cast(round_even(count(CASE WHEN passed THEN 1 END) / count(*) * 100, 0) AS BIGINT) FROM checks) AS dq_score, "
        "(SELECT count(*) FROM rewritten WHERE pattern IS NOT NULL) AS cells_remediated, cast(0 AS BIGINT) AS errors"
    )),
    "first_seen_tokens": (
        f"WITH {TOKENS}, idx AS (SELECT regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS value, count(*) AS cnt, min((doc_id, pos)) AS spot FROM tokens GROUP BY 1 HAVING value <> '') "
        "SELECT value, cnt, cast(row_number() OVER (ORDER BY spot) AS INTEGER) AS rn FROM idx ORDER BY spot LIMIT 500"
    ),
}
# One pattern per column wins in the order findings are listed, not in remediation order.
_TAG_RANK = "CASE h.pattern " + " ".join(f"WHEN {sql_text(p)} THEN {i}" for i, p in enumerate(RULES)) + " END"
ORACLES["anonymised_cells"] = remediated("concat('<PII:', pattern, '>')", CELL_ROWS).replace(RANK_CASE, _TAG_RANK)
ORACLES["analyze_outcomes"] = ORACLES["auto_outcomes"]
ORACLES["analyze_completeness"] = ORACLES["completeness_contacts"]
