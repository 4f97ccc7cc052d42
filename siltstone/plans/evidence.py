"""Rows as the text that an answer is generated from, and results as they are handed out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import tier
from ..functions.text import context_key

#: kind of row: columns that tell it, start of its text, details (label, column), in order of precedence.
SHAPES: tuple[tuple[str, tuple[str, ...], tuple[tuple[str, str], ...]], ...] = (
    ("board member", ("board_member", "title"), (("Title", "title"), ("Years present", "years_present"))),
    ("subsidiary", ("subsidiary",), (("Source form", "source_form_type"),)),
    ("section", ("section_id", "text"), (("Section ID", "section_id"),)),
    ("filing", ("filing_id", "form_type"), (("Filing ID", "filing_id"), ("Source file", "source_file"))),
    ("patent", ("patent_id",), (("Title", "patent_title"), ("Grant date", "grant_date"), ("Domain", "domain"))),
    ("technology domain", ("cpc_prefix", "label"), ()),
)


def _text(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("string")
    kind = dict(df.dtypes)[name]
    return F.to_json(name) if kind.startswith(("array", "map", "struct")) else F.col(name).cast("string")


def row_text(df: DataFrame) -> Column:  # F38
    """The text of each row of a graph query, by the shape that its columns have; other rows as ``name: value`` lines."""
    some = lambda n: F.nullif(_text(df, n), F.lit(""))
    company = F.coalesce(some("company"), some("company_name"), some("ticker"), F.lit("Company"))
    year = some("year")
    for kind, marks, details in SHAPES:
        if not set(marks) <= set(df.columns):
            continue
        when = F.concat(company, F.lit(f" {kind}"), F.coalesce(F.concat(F.lit(" in "), year), F.lit("")), F.lit(": "))
        if kind == "board member":
            head = F.concat(when, F.coalesce(some("board_member"), F.lit("Unknown")))
        elif kind == "subsidiary":
            head = F.concat(when, F.coalesce(some("subsidiary"), F.lit("Unknown")))
        elif kind == "section":
            title = F.coalesce(some("section_title"), some("title"), F.lit("Untitled section"))
            head = F.when(year.isNotNull() & some("form_type").isNotNull(), F.concat(company, F.lit(" "), year, F.lit(" "), some("form_type"), F.lit(" section: "), title)).otherwise(F.concat(company, F.lit(" filing section: "), title))
        elif kind == "filing":
            head = F.concat(company, F.lit(" filing: "), F.concat_ws(" ", year, F.coalesce(some("form_type"), F.lit("Filing"))))
        elif kind == "patent":
            head = F.concat(company, F.lit(" patent: "), F.coalesce(some("patent_id"), F.lit("Unknown patent")))
        else:
            head = F.concat(company, F.lit(" technology domain: "), F.coalesce(some("cpc_prefix"), F.lit("Unknown")), F.lit(" | "), F.coalesce(some("label"), F.lit("Unknown domain")))
        out = F.concat_ws(" | ", head, *(F.concat(F.lit(f"{label}: "), some(c)) for label, c in details))
        return F.concat_ws("\n", out, some("text")) if kind == "section" else out
    return F.concat_ws("\n", *(F.concat(F.lit(f"{c}: "), F.coalesce(_text(df, c), F.lit("None"))) for c in df.columns))


def context_block(number: Column, content: Column, title: Column, page: Column, source: Column) -> Column:  # F39
    return F.concat(F.lit("[Document "), number.cast("string"), F.lit("]\nTitle: "), F.coalesce(title, source, F.lit("unknown")), F.lit("\nPage: "), F.coalesce(page.cast("string"), F.lit("None")), F.lit("\nSource: "), F.coalesce(source, F.lit("unknown")), F.lit("\n\nContent:\n"), F.trim(content), F.lit("\n"))


def short_context(number: Column, content: Column, title: Column, page: Column) -> Column:  # F39
    return F.concat(F.lit("[Document "), number.cast("string"), F.lit("] "), F.coalesce(title, F.lit("unknown")), F.coalesce(F.concat(F.lit(" (page "), page.cast("string"), F.lit(")")), F.lit("")), F.lit("\n"), F.trim(content))


def web_context(number: Column, content: Column, title: Column, url: Column) -> Column:  # F39
    return F.concat(F.lit("[Web Result "), number.cast("string"), F.lit("] "), F.coalesce(title, F.lit("unknown")), F.lit("\nURL: "), F.coalesce(url, F.lit("unknown")), F.lit("\n"), F.trim(content))


def finalized(results: DataFrame, cache_allowed: bool, cache_enabled: bool, strategy: str = "hierarchical") -> DataFrame:  # Q12
    """Results (plan_type, final_route, contexts) with tier, distinct contexts and their number."""
    plan = F.coalesce("plan_type", F.lit("single"))
    keyed = F.transform("contexts", lambda c: F.struct(context_key(c).alias("k"), c.alias("c")))
    once = F.transform(F.filter(F.transform(keyed, lambda x, i: F.struct(x["k"].alias("k"), x["c"].alias("c"), i.alias("i"))), lambda x: F.array_position(F.transform("contexts", lambda c: context_key(c)), x["k"]) == x["i"] + 1), lambda x: x["c"])
    out = results.withColumn("plan_type", plan).withColumn("retrieved_contexts", F.coalesce(once, F.array().cast("array<string>")))
    return out.withColumns({"tier": tier(F.col("plan_type"), F.col("final_route")), "retrieved_context_count": F.size("retrieved_contexts").cast("long"), "chunking_strategy": F.lit(strategy), "cache_allowed": F.lit(cache_allowed), "cache_enabled": F.lit(cache_enabled)}).drop("contexts")


def table_text(number: Column, caption: Column, headers: Column, n_rows: Column, n_cols: Column, rows: Column, limit: int = 120) -> Column:  # F20, O06
    """A table as text: caption, headers, dimensions and at most 120 rows, empty lines left out.
    rows: arrays of (name, value)."""
    line = lambda r: F.array_join(F.transform(F.filter(r, lambda x: F.trim(x["value"]) != ""), lambda x: F.concat(x["name"], F.lit(": "), x["value"])), "; ")
    lines = F.array_join(F.transform(F.slice(rows, 1, limit), line), "\n")
    named = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    return F.concat_ws("\n", F.concat(F.lit("Structured Financial Table "), number.cast("string")), named("Caption: ", caption), named("Headers: ", F.array_join(headers, ", ")), F.concat(F.lit("Dimensions: rows="), n_rows.cast("string"), F.lit(", cols="), n_cols.cast("string")), F.lit("Rows:"), F.when(lines == "", "(no data rows)").otherwise(lines))


def parsed_score(answer: Column) -> Column:  # F37
    """A model's JSON answer on a contradiction; what cannot be read counts as none found."""
    from ..functions.text import strip_fence

    kind = "contradiction_score INT, contradiction_detected BOOLEAN, severity STRING, xbrl_summary STRING, transcript_summary STRING, explanation STRING"
    got = F.from_json(strip_fence(answer), kind, {"mode": "PERMISSIVE"})
    return F.struct(
        F.coalesce(got["contradiction_score"], F.lit(0)).alias("contradiction_score"), F.coalesce(got["contradiction_detected"], F.lit(False)).alias("contradiction_detected"), F.coalesce(got["severity"], F.lit("low")).alias("severity"),
        F.coalesce(got["xbrl_summary"], F.lit("")).alias("xbrl_summary"), F.coalesce(got["transcript_summary"], F.lit("")).alias("transcript_summary"), F.coalesce(got["explanation"], answer, F.lit("")).alias("explanation"))


def first_segment(segments: Column, names: dict[str, str] | None = None) -> tuple[Column, Column]:  # F36
    """Dimension and member of the first entry, under their display names."""
    from ..functions.text import replace_by

    head = F.get(segments, F.lit(0))
    show = (lambda c: replace_by(c, names)) if names else (lambda c: c)
    return show(head["dimension"]), show(head["value"])


def repaired_heading(c: Column) -> Column:  # F08
    """A heading with spaces inside words joined: a single letter before a lower-case rest, and a capitalised
    start before a short rest, where two such pairs stand or the only one has a side of three letters or less."""
    from ..functions.text import normalize_whitespace

    t = F.regexp_replace(normalize_whitespace(c), r"\b([A-Za-z])\s+([a-z]{2,})\b", "$1$2")
    pair = r"(?<!\S)([A-Z][a-z]{1,4}) ([a-z]{2,4})(?!\S)"
    found = F.regexp_extract_all(t, F.lit(pair), F.lit(0))
    side = lambda p: (F.length(F.substring_index(p, " ", 1)) <= 3) | (F.length(F.substring_index(p, " ", -1)) <= 3)
    return F.when((F.size(found) >= 2) | ((F.size(found) == 1) & side(F.get(found, F.lit(0)))), F.regexp_replace(t, pair, "$1$2")).otherwise(t)


def escaped_tsv(columns: Sequence[str]) -> Column:  # F46
    """Columns as one line of a tab-separated load file: null as \\N, backslash, tab and line ends escaped."""
    esc = lambda c: F.coalesce(F.replace(F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\\N"))
    return F.concat_ws("\t", *map(esc, columns))
