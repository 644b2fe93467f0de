"""Sample-table bindings shared by the plans, in Spark and in SQL.

Every derived column is plain arithmetic or a string function that both engines read alike. Nothing
is random and nothing asks the clock: the run instant is a parameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconry.session import spread

#: Tables with much work per row: worth spreading when one file holds them.
HEAVY_TABLES = ("documents", "pages", "conversations", "events")
RUN_TS = "2024-01-31 00:00:00"
W_SQL = r"[\p{L}\p{N}_]"
NOT_W_SQL = r"[^\p{L}\p{N}_]"


def read(spark: SparkSession, sf_dir: str, name: str, spreading: bool = True) -> DataFrame:
    """A sample table; without ``spreading`` a heavy one stays as its files are split, for callers that deal it themselves."""
    table = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(table) if spreading and name in HEAVY_TABLES else table


def sql_literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, float):
        return f"CAST({value!r} AS DOUBLE)"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(sql_literal(v) for v in value) + "]"
    return str(value)


def sql_rows(name: str, columns: str, rows) -> str:
    """A common table expression with literal rows: the SQL twin of a dimension table."""
    body = ", ".join("(" + ", ".join(sql_literal(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collected items from ``documents``: title is the first line, the text is whole."""
    return read(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("https://"), "source", F.lit(".example.org/d/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("source").alias("feed"),
        "lang",
        F.substring_index("text", "\n", 1).alias("title"),
        "text",
        F.expr("timestampadd(DAY, cast(doc_id % 60 as int), timestamp'2024-01-01 00:00:00')").alias("published"),
    )


SIGNALS = """signals AS (
  SELECT doc_id, 'https://' || source || '.example.org/d/' || doc_id AS url, source AS feed, lang,
         split_part(text, chr(10), 1) AS title, text,
         TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 60 AS INTEGER)) AS published
  FROM documents)"""

WHITESPACE_SQL = r"[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"


def squash_sql(text: str) -> str:
    return f"trim(regexp_replace(nfc_normalize({text}), '{WHITESPACE_SQL}', ' ', 'g'))"


def fold_sql(text: str) -> str:
    return f"strip_accents(replace(lower({squash_sql(text)}), 'ß', 'ss'))"


def casefold_sql(text: str) -> str:
    return f"replace(lower({squash_sql(text)}), 'ß', 'ss')"


def words_sql(text: str) -> str:
    return f"regexp_extract_all({text}, '{W_SQL}+')"


def stamp(column):
    """Timestamps leave a query as text, to the second."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def stamp_sql(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"
