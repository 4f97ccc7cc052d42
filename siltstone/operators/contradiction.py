"""Reported figures against statements: aligned by key, scored 0 to 10, ranked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.numeric import quarter_range, severity

DETECTED, HIGH = 3, 6


def relative_gap(figure: Column, statement: Column) -> Column:
    """The offline score: one point for each ten per cent by which the two differ, ten at most; a missing
    side scores 0."""
    gap = F.abs(figure - statement) / F.greatest(F.abs(figure), F.abs(statement))
    return F.when(figure.isNull() | statement.isNull() | (F.greatest(F.abs(figure), F.abs(statement)) == 0), 0).otherwise(F.least(F.lit(10), F.floor(F.round(gap * 10, 6)))).cast("int")


def sweep(figures: DataFrame, statements: DataFrame, on: list[str], score: Callable[[Column, Column], Column] = relative_gap) -> DataFrame:  # X01, J15, M05
    """figures: keys, figure; statements: keys, statement. Aligned by a full outer join."""
    s = figures.join(statements, on, "full_outer").withColumn("score", score(F.col("figure"), F.col("statement")))
    return s.withColumns({"severity": severity(F.col("score")), "detected": F.col("score") >= DETECTED, "high_or_above": F.col("score") >= HIGH})


def questions(companies: DataFrame) -> DataFrame:  # X01
    """Both questions of every metric for each company, fiscal_year, quarter, with the span of days in
    which statements are looked for."""
    period = F.concat(F.lit("fiscal "), F.col("quarter"), F.lit(" "), F.col("fiscal_year").cast("string"))
    fill = lambda t: F.replace(F.replace(t, F.lit("{company}"), F.col("company")), F.lit("{period}"), period)
    table = F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(a).alias("a"), F.lit(b).alias("b")) for m, a, b in fixed.SWEEP))
    first, last = quarter_range(F.col("fiscal_year"), F.col("quarter"))
    rows = companies.select("company", "fiscal_year", "quarter", first.alias("period_start"), last.alias("period_end"), F.explode(table).alias("m"))
    return rows.select("company", "fiscal_year", "quarter", "period_start", "period_end", F.col("m.metric").alias("metric"), fill(F.col("m.a")).alias("figure_question"), fill(F.col("m.b")).alias("statement_question"))
