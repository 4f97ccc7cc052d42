"""Dates, numbers and conditions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def period_type(start: Column, end: Column) -> Column:  # M01
    days = F.datediff(end.cast("date"), start.cast("date"))
    return F.when(days <= 110, "quarterly").when(days <= 200, "semiannual").when(days <= 400, "annual").when(days.isNotNull(), "other")


def period_label(start: Column, end: Column, focus: Column | None = None) -> Column:  # M01
    kind, month = period_type(start, end), F.month(end.cast("date"))
    own = F.when(kind == "quarterly", F.concat(F.lit("Q"), F.quarter(end.cast("date")).cast("string"))).when(kind == "semiannual", F.when(month <= 6, "H1").otherwise("H2")).when(kind == "annual", "FY").when(kind == "other", "TTM")
    return own if focus is None else F.coalesce(F.upper(F.nullif(focus, F.lit(""))), own)


def fiscal_quarter(label: Column) -> Column:  # M02
    return F.when(F.upper(label).startswith("Q"), F.upper(label))


def unit_or_default(tag: Column, unit: Column) -> Column:  # M03
    return F.when(tag.startswith("us-gaap:") & (F.coalesce(unit, F.lit("")) == ""), "iso4217:USD").otherwise(unit)


#: quarter: month and day of the first, months and day of the last, years to add. Unknown quarters are FY.
_RANGES = {"Q1": (1, 1, 3, 31, 0), "Q2": (4, 1, 6, 30, 0), "Q3": (7, 1, 9, 30, 0), "Q4": (7, 1, 1, 31, 1), "FY": (1, 1, 3, 31, 1)}


def quarter_range(year: Column, quarter: Column, ranges: dict = _RANGES) -> tuple[Column, Column]:  # M04
    """First and last day in which a quarter's statements are looked for."""
    first = last = None
    for q, (m1, d1, m2, d2, more) in ranges.items():
        if q == "FY":
            continue
        a, b = F.make_date(year, F.lit(m1), F.lit(d1)), F.make_date(year + more, F.lit(m2), F.lit(d2))
        first = F.when(quarter == q, a) if first is None else first.when(quarter == q, a)
        last = F.when(quarter == q, b) if last is None else last.when(quarter == q, b)
    m1, d1, m2, d2, more = ranges["FY"]
    return first.otherwise(F.make_date(year, F.lit(m1), F.lit(d1))), last.otherwise(F.make_date(year + more, F.lit(m2), F.lit(d2)))


def severity(score: Column) -> Column:  # M05
    return F.when(score <= 2, "low").when(score <= 5, "medium").when(score <= 8, "high").otherwise("critical")


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(v), F.lit(0.0), lambda a, x: a + x * x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length 1 (a zero vector stays), so that a cosine is a dot product: the length is
    computed once per vector and not once per pair."""
    size = norm(v)
    return F.when(size == 0, _doubles(v)).otherwise(F.transform(_doubles(v), lambda x: x / size))


def cosine(a: Column, b: Column) -> Column:  # M06
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def blended(score: Column, via_summary: Column) -> Column:  # M07
    return F.when(via_summary.isNotNull(), score * 0.95).otherwise(score)


def lexical_overlap(query: Column, text: Column) -> Column:  # M08
    q, t = F.array_distinct(query), F.array_distinct(text)
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, t)) / F.size(q))


def reranked(semantic: Column, lexical: Column) -> Column:  # M08
    return 0.8 * semantic + 0.2 * lexical


def confidence(cached: Column, grounded: Column, useful: Column) -> Column:  # M09
    return F.when(cached, 0.85).when((grounded == "yes") & (useful == "yes"), 0.90).when(grounded == "yes", 0.60).when(grounded == "no", 0.30)


def diligence_score(**metrics: Column) -> Column:  # M10
    total = F.lit(0.0)
    for name, weight in fixed.SCORE_WEIGHTS.items():
        total = total + F.lit(weight) * metrics[name]
    return total


def tier(plan: Column, route: Column) -> Column:  # M11
    return F.when(plan == "multi", "tier_2").when(route == "llm_direct", "tier_0").otherwise("tier_1")


def period_year(period: Column) -> Column:  # M12
    return F.coalesce(F.regexp_extract(F.coalesce(period, F.lit("")), r"(\d{4})\s*$", 1).try_cast("int"), F.lit(2024))


def period_quarter(period: Column) -> Column:  # M12
    return F.coalesce(F.nullif(F.upper(F.regexp_extract(F.coalesce(period, F.lit("")), r"(?i)\b(Q[1-4]|FY)\b", 1)), F.lit("")), F.lit("Q4"))


def int_or_null(c: Column) -> Column:  # M13
    return c.try_cast("int")


def number_or_null(c: Column) -> Column:  # F35
    """The number of a text with thousands separators; letters that the cast alone would take do not count."""
    t = F.trim(F.replace(c, F.lit(","), F.lit("")))
    return F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))
