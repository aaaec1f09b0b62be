"""Input tables of the registered queries, and the views derived from them.

The stock tables hold hardly any personal data under the column gate, so two
views add some: ``contacts`` and ``notes`` restate ``customer``, ``doc_tokens``
splits ``documents``.  The column expressions read the same in Spark SQL and
ANSI SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwarden.operators.values import spread
from fieldwarden.sources.scratch import shared_dir

CONTACT_COLUMNS = {
    "rid": "c_custkey",
    "name": "concat('Person ', cast(c_custkey AS STRING))",
    "email": "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE concat('user', cast(c_custkey AS STRING), '@example.com') END",
    "phone": "CASE WHEN c_custkey % 11 = 0 THEN 'unknown' ELSE concat('615555', lpad(cast(c_custkey % 10000 AS STRING), 4, '0')) END",
    "ssn": "concat('900-', lpad(cast(c_custkey % 100 AS STRING), 2, '0'), '-', lpad(cast(c_custkey % 10000 AS STRING), 4, '0'))",
    "zip_code": "CASE WHEN c_custkey % 3 = 0 THEN concat('Z', cast(c_custkey AS STRING)) ELSE cast(30000 + c_custkey AS STRING) END",
    "account_no": "concat('77', lpad(cast(c_custkey AS STRING), 8, '0'))",
}
CONTACT_VALUES = [c for c in CONTACT_COLUMNS if c != "rid"]

IDENTITY_COLUMNS = {
    "rid": "c_custkey",
    "birth_dob": "concat(lpad(cast(c_custkey % 12 + 1 AS STRING), 2, '0'), '/', lpad(cast(c_custkey % 28 + 1 AS STRING), 2, '0'), '/', cast(1950 + c_custkey % 50 AS STRING))",
    "passport_no": "concat('P', lpad(cast(c_custkey AS STRING), 7, '0'))",
    "routing_no": "lpad(cast(c_custkey AS STRING), 9, '0')",
    "tax_ein": "concat(lpad(cast(c_custkey % 100 AS STRING), 2, '0'), '-', lpad(cast(c_custkey AS STRING), 7, '0'))",
}
IDENTITY_VALUES = [c for c in IDENTITY_COLUMNS if c != "rid"]

FILE_COLUMNS = {
    "rid": "c_custkey",
    "file": "concat('part', cast(c_custkey % 3 AS STRING), '.csv')",
    "email": "CASE WHEN c_custkey % 3 = 1 OR c_custkey % 10 = 0 THEN concat('write to user', cast(c_custkey AS STRING), '@example.com') "
    "ELSE concat('user', cast(c_custkey AS STRING), '@example.com') END",
    "ssn": f"CASE WHEN c_custkey % 3 <> 2 THEN {CONTACT_COLUMNS['ssn']} END",
}

KEY_PARTS = {
    "low": "c_custkey % 11",
    "middle": "cast(floor(c_custkey / 11) AS BIGINT) % 11",
    "high": "cast(floor(c_custkey / 121) AS BIGINT) % 11",
    "segment": "c_mktsegment",
}

FIRST_NAMES = "CASE c_custkey % 5 WHEN 0 THEN 'Alice' WHEN 1 THEN 'Bruno' WHEN 2 THEN 'Carla' WHEN 3 THEN 'Deren' ELSE 'Elena' END"
LAST_NAMES = "CASE c_nationkey % 3 WHEN 0 THEN 'Stone' WHEN 1 THEN 'Rivers' ELSE 'Marsh' END"
VERBS = "CASE c_custkey % 3 WHEN 0 THEN 'called' WHEN 1 THEN 'emailed' ELSE 'reported' END"
PERSON = f"concat({FIRST_NAMES}, ' ', {LAST_NAMES})"
PLACE = "concat(cast(c_custkey % 9999 + 1 AS STRING), ' Main Street, Savannah GA ', cast(30000 + c_custkey % 9999 AS STRING))"
NOTE_COLUMNS = {
    "rid": "c_custkey",
    "full_name": PERSON,
    "note": f"concat({PERSON}, ' ', {VERBS}, ' from ', {PLACE}, ' about ', lower(c_mktsegment))",
}

TALK_TEXT = (
    "concat(text, CASE turn % 5 WHEN 0 THEN concat(' Write to user', cast(conv_id AS STRING), '@example.com today.') "
    "WHEN 1 THEN concat(' Born 0', cast(conv_id % 9 + 1 AS STRING), '/12/1990.') "
    "WHEN 2 THEN concat(' See https://host.example.org/', cast(conv_id AS STRING), ' please.') "
    "WHEN 3 THEN concat(' My number is 123-45-', cast(1000 + conv_id % 9000 AS STRING), '.') ELSE ' Nothing.' END)"
)

TOKEN_BREAK = "[ \\t\\n\\r\\f]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def derived(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{expr} AS {name}" for name, expr in columns.items()])


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(table(spark, sf_dir, "customer"), CONTACT_COLUMNS)


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(table(spark, sf_dir, "customer"), IDENTITY_COLUMNS)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(table(spark, sf_dir, "customer"), NOTE_COLUMNS)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of three files: in one no cell is an address as a whole, in one a column is empty."""
    return derived(table(spark, sf_dir, "customer"), FILE_COLUMNS)


def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of ``conversations`` with an address, a date, a link or a number added."""
    return table(spark, sf_dir, "conversations").selectExpr("conv_id", "cast(turn AS INT) AS turn", f"{TALK_TEXT} AS text")


def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
        .select("doc_id", F.posexplode(F.split("text", TOKEN_BREAK)).alias("pos", "token"))
        .where(F.col("token") != "")
    )


__all__ = ["CONTACT_COLUMNS", "KEY_PARTS", "CONTACT_VALUES", "IDENTITY_VALUES", "contacts", "derived", "doc_tokens", "files", "identities", "notes", "shared_dir", "table", "talk"]
