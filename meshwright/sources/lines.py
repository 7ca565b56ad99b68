"""Text as lines: split on line feeds, one trailing carriage return dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no from 1, line) for every line of every text; a null text has none."""
    at = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return at.select(key, (F.col("line_no") + 1).cast("bigint").alias("line_no"), F.regexp_replace("line", "\r$", "").alias("line"))


#: The same relation over ``documents`` for DuckDB.
LINES_SQL = "lines AS (SELECT doc_id, CAST(n AS BIGINT) AS line_no, parts[n] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL), LATERAL (SELECT unnest(generate_series(1, len(parts))) AS n))"
