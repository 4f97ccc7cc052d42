"""Questions to SQL: only a SELECT runs, and one failed statement may be put right once."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import rendered_row

ROWS = 20


class NotReadOnly(ValueError):
    pass


def extract_sql(answer: str) -> str:  # F28
    """The statement in a model's answer: inside a fence if there is one, without a closing semicolon."""
    fenced = re.search(r"```(?:\w+)?\s*(.*?)```", answer, re.S)
    return (fenced[1] if fenced else answer).strip().rstrip(";").strip()


def checked(spark: SparkSession, sql: str) -> str:  # P16
    """``sql`` if it is one SELECT and its plan runs no command."""
    if not re.match(r"(?is)^\s*(select|with)\b", sql) or ";" in sql:
        raise NotReadOnly("only a single SELECT may run")
    parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    if "Command" in parsed.getClass().getSimpleName() or "InsertIntoStatement" in parsed.toString():
        raise NotReadOnly("only a SELECT may run")
    return sql


def ask(spark: SparkSession, question: str, nl2sql: Callable[[str, str | None], str]) -> tuple[str, DataFrame]:  # LM04
    """The statement and its rows. nl2sql(question, error) is asked again, once, with the error's text."""
    error: str | None = None
    for last in (False, True):
        sql = checked(spark, extract_sql(nl2sql(question, error)))
        try:
            rows = spark.sql(sql)
            return sql, rows if re.search(r"(?i)\b(count|sum|avg|min|max)\s*\(", sql) else rows.limit(ROWS)
        except (AnalysisException, ParseException) as e:
            if last:
                raise
            error = str(e)
    raise AssertionError


def rendered(rows: DataFrame, limit: int = ROWS) -> DataFrame:  # F41, O03
    """At most 20 rows, tab-separated, for an answer's prompt."""
    return rows.limit(limit).select(rendered_row(*(F.col(c) for c in rows.columns)).alias("line"))
