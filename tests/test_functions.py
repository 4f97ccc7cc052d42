"""Text and numeric functions against stated values."""

import pytest
from pyspark.sql import functions as F

from siltstone.functions import numeric, text


def value(spark, column, **row):
    import datetime

    kinds = {str: "string", int: "long", float: "double", bool: "boolean", type(None): "string", datetime.date: "date"}
    ddl = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else kinds[type(v)]}" for k, v in row.items()) or "x int"
    return spark.createDataFrame([tuple(row.values()) or (1,)], ddl).select(column.alias("v")).first()["v"]


def test_tokens_and_white_space(spark):
    assert value(spark, text.tokens("t"), t="Revenue, AI-growth!") == ["revenue", "ai", "growth"]
    assert value(spark, text.normalize_whitespace("t"), t=" a \t b\n") == "a b"
    assert value(spark, text.normalize_whitespace("t"), t=None) == ""
    assert value(spark, text.word_count("t"), t="  ") == 0


@pytest.mark.parametrize("line,item,section,kind", [
    ("Item 1A. Risk Factors", True, True, "item"), ("PART II", False, True, "part"), ("Note 3 - Leases", False, True, "note"), ("NOTE 3 – LEASES", False, True, "subsection"),
    ("Notional Amount", False, False, "subsection"), ("this sentence, which ends with a full stop; is not one.", False, False, "subsection"), ("Foreign Currency Risk", False, True, "subsection"),
])
def test_headings(spark, line, item, section, kind):
    assert value(spark, text.is_item_heading("t"), t=line) is item
    assert value(spark, text.is_section_heading("t"), t=line) is section
    assert value(spark, text.classify_heading("t"), t=line) == kind


def test_titles_and_fixed_lines(spark):
    assert value(spark, text.subsection_title("t"), t="Foreign Exchange Risk (1)") == "Foreign Exchange Rate Risk"
    assert value(spark, text.subsection_title("t"), t="September 28, 2024") is None
    assert value(spark, text.is_page_footer("t"), t="Apple Inc. | 2024 Form 10-K | 12") is True
    assert value(spark, text.is_page_footer("t", F.col("c"), F.col("f")), t="Ünion | Form 8-K | 3", c="Ünion", f="8-k") is True
    assert value(spark, text.is_boilerplate("t"), t="Indicate by check mark whether") is True
    assert value(spark, text.is_table_label("t"), t="Total (1)") is True
    assert value(spark, text.is_date_heading("t"), t="For the fiscal year ended September 28, 2024") is True
    assert value(spark, text.is_page_stamp("t"), t="Apple Inc. | 2021 Form 10-K | 7") is True
    assert value(spark, text.is_title_block("t"), t="Foreign Currency Risk") is True
    assert value(spark, text.is_title_block("t"), t="the company says.") is False


def test_names_and_ids(spark):
    assert value(spark, text.board_name("t"), t="Art Levinson  Board Chair") == "Art Levinson"
    assert value(spark, text.board_name("t"), t="board chair") == ""
    assert value(spark, text.person_id(F.lit("aapl"), F.col("t")), t="Art D. Levinson") == "AAPL_art_d_levinson"
    assert value(spark, text.subsidiary_id(F.lit("aapl"), F.col("t")), t="Apple Operations Int'l (Ltd.)") == "AAPL_apple_operations_int_l_ltd"
    assert value(spark, text.cpc_codes("t"), t='{A61B5/02,"G01C22/006",H04L9/32}') == ["A61B5/02", "G01C22/006", "H04L9/32"]
    assert value(spark, text.cpc_prefixes(text.cpc_codes("t")), t="{A61B5/02,H04W72/00,G06F1/00,Y02D30/70,H04L9/32}") == ["A61", "G06", "H04"]
    assert value(spark, text.cpc_label(F.col("t")), t="Z99") == "Other (Z99)"
    assert value(spark, text.filing_id(F.lit("aapl"), F.lit("10-K"), F.lit(2021))) == "AAPL_10-K_2021"
    assert value(spark, text.filing_year(F.col("a"), F.col("b"), F.lit(1)), a="2024-09-28", b="2025-11-01") == 2024
    assert value(spark, text.company("t", "transcripts"), t="Apple Inc.") == "Apple Inc."
    assert value(spark, text.company("t", "transcripts"), t="Microsoft") == "MICROSOFT CORP"
    assert value(spark, text.ticker("t"), t="What did NVIDIA say?") == "NVDA"
    assert value(spark, text.legal_name("t"), t="the deal with Acme Holdings closed") == "Acme Holdings"


def test_numbers(spark):
    assert value(spark, text.numbers("t"), t="FY2024 revenue of $391.0 billion in 2024") == [391.0]
    assert value(spark, text.numbers("t"), t="1,234.5 and 1999") == [1234.5]
    assert value(spark, numeric.number_or_null(F.col("t")), t="1,234.50") == 1234.5
    assert value(spark, numeric.number_or_null(F.col("t")), t="1d") is None
    assert value(spark, text.strip_fence("t"), t="```sql\nSELECT 1;\n```") == "SELECT 1"


def test_periods_and_scores(spark):
    import datetime as d

    row = {"a": d.date(2024, 1, 1), "b": d.date(2024, 3, 30)}
    assert value(spark, numeric.period_label(F.col("a"), F.col("b")), **row) == "Q1"
    assert value(spark, numeric.period_type(F.col("b"), F.col("a")), **row) == "quarterly"
    first, last = numeric.quarter_range(F.lit(2024), F.lit("Q4"))
    assert (value(spark, first), value(spark, last)) == (d.date(2024, 7, 1), d.date(2025, 1, 31))
    first, last = numeric.quarter_range(F.lit(2024), F.lit("?"))
    assert (value(spark, first), value(spark, last)) == (d.date(2024, 1, 1), d.date(2025, 3, 31))
    assert [value(spark, numeric.severity(F.lit(s))) for s in (2, 5, 8, 9)] == ["low", "medium", "high", "critical"]
    ones = dict.fromkeys(("faithfulness", "completeness", "numerical_accuracy", "citation_accuracy"), F.lit(1.0))
    assert value(spark, numeric.diligence_score(**ones)) == pytest.approx(1.0)
    assert value(spark, numeric.period_year(F.col("t")), t="fiscal Q4 2023") == 2023
    assert value(spark, numeric.period_quarter(F.col("t")), t="fiscal q3 2023") == "Q3"
    assert value(spark, numeric.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
