"""Registered queries of ingestion, text functions, planning, caching and checks, and the same in DuckDB's SQL.

The driver's tables hold no filings, so a query makes its input from all rows of a table (a line, an order, a page that
has what a filing has), runs the engine's functions on it, and the SQL computes from the same rows what must come out.
Fixed word lists and patterns stand in the SQL as ``functions.fixed`` states them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, numeric, text
from ..operators import audit, cache, chunking, contradiction, evaluation, graph, relational, tree, validation
from ..sources import filings, html, rest, sinks
from ..sources.keyed import KeyedTable
from ..sources.tables import table
from ..sources.workspace import folder
from . import evidence, models, nlgraph, nlsql, planner
from .catalog import query


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(words) -> str:
    return "[" + ", ".join(map(quoted, words)) + "]"


def matches(c: str, patterns) -> str:
    return f"regexp_matches({c}, {quoted('(?i)' + '|'.join(f'(?:{p})' for p in patterns))})"


def contains_any(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, {quoted(w)})" for w in words) + ")"


def spaced(c: str) -> str:
    """White space as normalize_whitespace leaves it."""
    return f"trim(regexp_replace(replace(coalesce({c}, ''), chr(160), ' '), '\\s+', ' ', 'g'))"


def pick(values, index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def picked(values, index: str) -> str:
    return f"{listed(values)}[({index}) % {len(values)} + 1]"


# -- lines of filings ----------------------------------------------------------------------------

#: Lines as filings have them, dealt out over the lines of the documents.
LINES = (
    "Item 1A. Risk Factors", "ITEM 7.01", "item 2", "PART IV", "Part II", "part of it", "Note 3 - Leases", "Note 12 Revenue", "September 28, 2024", "For the fiscal year ended September 28, 2024",
    "For the quarterly period ended March 1, 2023", "2024", "Total (1)(2)", "Total Fair Value", "Fair Value", "Services (3)", "Cash and Cash Equivalents", "Derivative assets (1):", "Filing Date/ Period End Date",
    "Foreign Exchange Risk (1)", "Cash, cash equivalents and marketable securities", "Apple Inc. | Q3 2024 Form 10-Q | 12", "Apple Inc. | 2024 Form 10-K | 5", "chart.PNG", "☒ Yes ☐ No", "117", "UNITED STATES", "Indicate by check mark whether",
    "Commission File Number: 1-36743", "Yes ☒ No ☐", "TABLE OF CONTENTS", "Number of", "CONSOLIDATED STATEMENTS OF OPERATIONS", "Foreign Currency Risk", "a b", "R&D Spending/Costs", "Liquidity and Capital Resources", "", " ", "x",
)
_LINE = f"""CASE WHEN (doc_id + i) % 3 = 0 THEN {picked(LINES, '(doc_id + i) // 3')} ELSE line END"""
_LINES = f"""l AS (SELECT doc_id, i, {_LINE} AS line FROM (SELECT doc_id, unnest(range(0, len(ls))) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
t AS (SELECT doc_id, i, line, {spaced('line')} AS t FROM l),
n AS (SELECT *, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS n, regexp_replace(t, '[^A-Za-z]', '', 'g') AS letters FROM t)"""


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    k = F.col("doc_id") + F.col("i")
    return lines.select("doc_id", F.col("i").cast("long").alias("i"), F.when(k % 3 == 0, pick(LINES, F.floor(k / 3))).otherwise(F.col("line")).alias("line"))


_ITEM, _DATE, _LABEL = matches("t", (fixed.ITEM_HEADING,)), matches("t", fixed.DATE_HEADINGS), matches("t", fixed.TABLE_LABELS)
_BAD_SUB = f"(t = '' OR {_DATE} OR {_LABEL} OR regexp_matches(t, '^\\d+(\\.\\d+)?$') OR (n = 1 AND length(t) < 8))"
_FOOTER, _PAGE_NO, _BOILER = matches("t", fixed.PAGE_FOOTERS), "regexp_matches(t, '^\\d{1,3}$')", matches("t", fixed.BOILERPLATE)
_SECTION = f"(t NOT IN ({', '.join(map(quoted, fixed.BAD_HEADINGS))}) AND ({matches('t', fixed.SECTION_HEADINGS)} OR (length(letters) > 6 AND upper(t) = t AND length(t) < 120)))"
_KIND = f"CASE WHEN {_ITEM} THEN 'item' WHEN {matches('t', (fixed.PART_HEADING,))} THEN 'part' WHEN {matches('t', (fixed.NOTE_HEADING,))} THEN 'note' ELSE 'subsection' END"


@query(f"""WITH {_LINES} SELECT doc_id, i, {_ITEM} AS item, {_DATE} AS dated, {_LABEL} AS label, {_BAD_SUB} AS bad_subsection,
NOT {_BAD_SUB} AND NOT ends_with(t, '.') AND n BETWEEN 1 AND 12 AND length(t) <= 120 AS meaningful, {_FOOTER} AS footer, {matches('line', (fixed.IMAGE_NAME,))} AS image,
{contains_any('line', fixed.CHECKBOXES)} AS checkbox, {_PAGE_NO} AS page_number, {matches('line', fixed.BOILERPLATE)} AS boilerplate, {_SECTION} AS section, {_KIND} AS kind FROM n""")
def line_kinds(spark, sf_dir):
    """F04-F07, F09-F13 on every line of every document."""
    line = F.col("line")
    return lines_of(spark, sf_dir).select(
        "doc_id", "i", text.is_item_heading(line).alias("item"), text.is_date_heading(line).alias("dated"), text.is_table_label(line).alias("label"), text.is_bad_subsection(line).alias("bad_subsection"),
        text.is_meaningful_subsection(line).alias("meaningful"), text.is_page_footer(line).alias("footer"), text.is_image_caption(line).alias("image"), text.is_checkbox_line(line).alias("checkbox"),
        text.is_page_number(line).alias("page_number"), text.is_boilerplate(line).alias("boilerplate"), text.is_section_heading(line).alias("section"), text.classify_heading(line).alias("kind"))


def _bad_title(c: str) -> str:
    return f"({c} = '' OR {c} IN ({', '.join(map(quoted, fixed.BAD_TITLES))}) OR {matches(c, fixed.DATE_HEADINGS)})"


_NAMES = "CASE h " + " ".join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in fixed.TITLE_NAMES.items()) + " ELSE h END"
_WORDS = "regexp_extract_all(t, '[\\p{L}\\p{M}\\p{N}\\p{Pc}](?:[\\p{L}\\p{M}\\p{N}\\p{Pc}&/-]*[\\p{L}\\p{M}\\p{N}\\p{Pc}])?')"


@query(f"""WITH {_LINES}, h AS (SELECT *, {spaced("regexp_replace(line, '\\s*\\(\\d+\\)(\\(\\d+\\))*\\s*$', '')")} AS h, {_WORDS} AS words FROM n), s AS (SELECT *, CASE WHEN NOT {_bad_title('h')} THEN {_NAMES} END AS renamed, list_filter(words, lambda w: regexp_matches(w, '\\p{{L}}')) AS lettered FROM h)
SELECT doc_id, i, h AS heading, CASE WHEN NOT {_bad_title('renamed')} THEN renamed END AS title, regexp_matches(t, {quoted(fixed.PAGE_STAMP)}) AS stamp,
t <> '' AND NOT regexp_matches(t, {quoted(fixed.PAGE_STAMP)}) AND length(t) <= 80 AND NOT regexp_matches(t, '[.,!?;:]$') AND (regexp_matches(t, {quoted('(?i)' + fixed.ITEM_TITLE)})
  OR (len(words) <= 10 AND len(lettered) > 0 AND len(list_filter(lettered, lambda w: NOT (regexp_matches(w, '^\\p{{Lu}}') OR (upper(w) = w AND lower(w) <> w)))) = 0)) AS title_block FROM s""")
def line_titles(spark, sf_dir):
    """F14, F25 on every line of every document."""
    line = F.col("line")
    return lines_of(spark, sf_dir).select("doc_id", "i", text.normalize_heading(line).alias("heading"), text.subsection_title(line).alias("title"), text.is_page_stamp(line).alias("stamp"), text.is_title_block(line).alias("title_block"))


_LABELS, _LAYERS, _FORMS, _COMPANIES = ("text", "caption", "list"), ("body", "body", "furniture"), ("10-K", "8-K", "10-Q"), ("Apple Inc.", "Foreign Currency", "")


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") + F.col("i")
    t = lines_of(spark, sf_dir).withColumns({"label": pick(_LABELS, k), "layer": pick(_LAYERS, k), "form": pick(_FORMS, F.col("doc_id")), "company": pick(_COMPANIES, F.col("doc_id"))})
    return t.withColumns({"item": F.when(k % 2 == 0, "Item 1"), "note": F.when(k % 5 == 0, "Note 2"), "content_type": F.when(k % 4 == 0, "table").otherwise("text"), "n_rows": (k % 3).cast("int")})


_META = f"""{_LINES}, m AS (SELECT *, {picked(_LABELS, 'doc_id + i')} AS label, {picked(_LAYERS, 'doc_id + i')} AS layer, {picked(_FORMS, 'doc_id')} AS form, {picked(_COMPANIES, 'doc_id')} AS company,
CASE WHEN (doc_id + i) % 2 = 0 THEN 'Item 1' END AS item, CASE WHEN (doc_id + i) % 5 = 0 THEN 'Note 2' END AS note, CASE WHEN (doc_id + i) % 4 = 0 THEN 'table' ELSE 'text' END AS content_type, (doc_id + i) % 3 AS n_rows, lower(line) AS low FROM n)"""
_OWN_FOOTER = "(trim(company) <> '' AND regexp_matches(t, '(?i)^' || regexp_escape(trim(company)) || '\\s*\\|\\s*.*Form\\s+' || regexp_escape(upper(form)) || '\\s*\\|\\s*\\d+$'))"


@query(f"""WITH {_META} SELECT doc_id, i, t = '' OR {_FOOTER} OR {_OWN_FOOTER} OR {contains_any('t', fixed.CHECKBOXES)} OR {_PAGE_NO} OR {_BOILER} OR (n <= 1 AND NOT ({_ITEM} OR regexp_matches(t, '(?i)^Note\\s+\\d+')))
  OR layer = 'furniture' OR (label = 'caption' AND {matches('t', (fixed.IMAGE_NAME,))}) AS noise,
CASE WHEN content_type = 'table' THEN form = '8-K' AND {contains_any('low', fixed.LOW_VALUE_8K_TABLE)} ELSE (item IS NULL AND note IS NULL) OR {" OR ".join(f"starts_with(low, {quoted(w)})" for w in fixed.LOW_VALUE_STARTS)} OR (company <> '' AND starts_with(low, lower(company))) OR starts_with(low, 'form ' || lower(form)) END AS low_value,
CASE WHEN content_type = 'table' THEN (form <> '8-K' OR {contains_any('low', fixed.USEFUL_8K_TABLE)}) AND (n_rows > 0 OR n >= 20) ELSE n >= 40 AND (item IS NOT NULL OR note IS NOT NULL OR n >= 150) AND NOT starts_with(lower(trim(line)), {quoted(fixed.LOW_VALUE_STARTS[0])}) END AS kept FROM m""")
def chunk_quality(spark, sf_dir):
    """P10-P12 on every line of every document."""
    c = F.col
    none = F.lit(None).cast("array<string>")
    return _meta(spark, sf_dir).select(
        "doc_id", "i", chunking.is_noise(c("line"), c("label"), c("layer"), c("company"), c("form")).alias("noise"), chunking.is_low_value(c("line"), c("content_type"), c("form"), c("item"), c("note"), c("company")).alias("low_value"),
        chunking.is_kept(c("line"), c("content_type"), c("form"), c("item"), c("note"), F.lit(None).cast("string"), none, c("n_rows")).alias("kept"))


@query(f"""WITH {_META} SELECT doc_id, i, md5(CASE WHEN h = '' THEN line ELSE h || chr(10) || chr(10) || line END) AS h, d || '|' || b AS shown FROM (SELECT *, concat_ws(chr(10), CASE WHEN form <> '' THEN 'Part: ' || form END, CASE WHEN item <> '' THEN 'Item: ' || item END, CASE WHEN note <> '' THEN 'Note: ' || note END) AS h,
'[Document ' || i || ']' || chr(10) || 'Title: ' || coalesce(item, 'src', 'unknown') || chr(10) || 'Page: ' || coalesce(CASE WHEN i % 2 = 0 THEN i::VARCHAR END, 'None') || chr(10) || 'Source: src' AS d, '[Document ' || i || '] ' || coalesce(item, 'unknown') || coalesce(' (page ' || CASE WHEN i % 2 = 0 THEN i::VARCHAR END || ')', '') AS b FROM m)""")
def assembled_texts(spark, sf_dir):
    """F17, F39 on every line of every document."""
    c = F.col
    page = F.when(c("i") % 2 == 0, c("i"))
    long, short = evidence.context_block(c("i"), c("line"), c("item"), page, F.lit("src")), evidence.short_context(c("i"), c("line"), c("item"), page)
    whole = text.chunk_text(c("form"), c("item"), c("note"), F.lit(None).cast("string"), c("line"))
    return _meta(spark, sf_dir).select("doc_id", "i", F.md5(whole.cast("binary")).alias("h"), F.concat(F.substring_index(long, "\n", 4), F.lit("|"), F.substring_index(short, "\n", 1)).alias("shown"))


# -- names, ids and small text functions -----------------------------------------------------------

_PEOPLE = ("Art  Levinson Board Chair", "Board Chair", "Jane Doe lead independent director", "Bob Director", "Ann O'Neil-Smith", "Director of Things", "")
_FIRMS = ("Acme Tools Inc.", "the Beta & Co. Holdings", "nothing here", "Gamma-Ray Systems Corp. and Delta LLC", "PLC", "Apple", "MICROSOFT Corporation")
_ROLE = "|".join(sorted(fixed.ROLES, key=len, reverse=True))
_LEGAL = "([A-Z][A-Za-z0-9&.,'-]*(?:\\s+[A-Z][A-Za-z0-9&.,'-]*)*\\s+(?:" + "|".join(s.replace(".", r"\.") for s in fixed.LEGAL_SUFFIXES) + "))"
_TICKER = "CASE " + " ".join(f"WHEN contains(lower(firm), {quoted(a)}) THEN {quoted(b)}" for a, b in fixed.TICKERS) + " END"


def _alias(corpus: str) -> str:
    return "CASE trim(regexp_replace(lower(firm), '[^\\p{L}\\p{M}\\p{N}\\p{Pc}\\s]', '', 'g')) " + " ".join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in fixed.ALIASES[corpus].items()) + " ELSE firm END"


_PERSON = f"CASE WHEN regexp_matches(p, '(?i)^(?:{_ROLE})$') THEN '' ELSE {spaced(f"regexp_replace(p, '(?i) (?:{_ROLE})$', '')")} END"


@query(f"""WITH c AS (SELECT c_custkey, {picked(_PEOPLE, 'c_custkey')} AS person, {picked(_FIRMS, 'c_custkey')} || CASE WHEN c_custkey % 3 = 0 THEN ' ' || c_mktsegment ELSE '' END AS firm, c_name FROM customer), n AS (SELECT *, {spaced('person')} AS p FROM c), b AS (SELECT *, {_PERSON} AS name FROM n)
SELECT c_custkey, name, 'T_' || trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_+', '_', 'g'), '_') AS person_id, 'T_' || trim(regexp_replace(regexp_replace(lower(firm), '[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}]+', '_', 'g'), '_+', '_', 'g'), '_') AS subsidiary_id,
nullif(regexp_extract(firm, {quoted(_LEGAL)}, 1), '') AS legal, {_TICKER} AS ticker, {_alias('transcripts')} AS alias_t, {_alias('patents')} AS alias_p FROM b""")
def company_names(spark, sf_dir):
    """F21, F22, F27, F45, J08 on every customer."""
    c = table(spark, sf_dir, "customer").withColumn("person", pick(_PEOPLE, F.col("c_custkey")))
    c = c.withColumn("firm", F.concat(pick(_FIRMS, F.col("c_custkey")), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" "), "c_mktsegment")).otherwise("")))
    name = text.board_name("person")
    return c.select("c_custkey", name.alias("name"), text.person_id(F.lit("t"), name).alias("person_id"), text.subsidiary_id(F.lit("t"), F.col("firm")).alias("subsidiary_id"), text.legal_name("firm").alias("legal"),
                    text.ticker("firm").alias("ticker"), text.company("firm", "transcripts").alias("alias_t"), text.company("firm", "patents").alias("alias_p"))


_NUMBERS = ("1,234.50", "-3", "1d", "nan", ".5", "1e3", " 7 ", "12,", "", "n/a")
_REFS = ("#/texts/12", "x", "#/a/007", "", "9")
_PERIODS = ("fiscal Q3 2023", "FY 2021", "2024", "q1", "Q4 of 2022 ", "", "year 20256")


@query(f"""SELECT p_partkey, CASE WHEN regexp_matches(v, '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') THEN v::DOUBLE END AS number, try_cast(nullif(regexp_extract(ref, '(\\d+)$', 1), '') AS INTEGER) AS trailing,
coalesce(try_cast(nullif(regexp_extract(period, '(\\d{{4}})\\s*$', 1), '') AS INTEGER), 2024) AS period_year, coalesce(nullif(upper(regexp_extract(period, '(?i)\\b(Q[1-4]|FY)\\b', 1)), ''), 'Q4') AS period_quarter,
CASE WHEN tag LIKE 'us-gaap:%' AND coalesce(unit, '') = '' THEN 'iso4217:USD' ELSE unit END AS unit, round(0.35 * p_size / 50.0 + 0.30 + 0.25 * 0.5 + 0.10 * (p_size % 2), 6) AS score,
CASE p_size % 4 WHEN 0 THEN 0.85 WHEN 1 THEN 0.90 WHEN 2 THEN 0.60 ELSE 0.30 END::DOUBLE AS confidence, try_cast(p_brand[7:] AS INTEGER) AS brand
FROM (SELECT *, replace(trim({picked(_NUMBERS, 'p_partkey')}), ',', '') AS v, {picked(_REFS, 'p_partkey')} AS ref, {picked(_PERIODS, 'p_partkey')} AS period, CASE WHEN p_partkey % 2 = 0 THEN 'us-gaap:' ELSE 'dei:' END || p_type AS tag, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'shares' END AS unit FROM part)""")
def small_numbers(spark, sf_dir):
    """F26, F35, M03, M09, M10, M12, M13 on every part."""
    k, size = F.col("p_partkey"), F.col("p_size")
    p = table(spark, sf_dir, "part").withColumns({"v": pick(_NUMBERS, k), "self_ref": pick(_REFS, k), "period": pick(_PERIODS, k), "tag": F.concat(F.when(k % 2 == 0, "us-gaap:").otherwise("dei:"), "p_type"), "unit": F.when(k % 3 == 0, "").when(k % 3 == 1, "shares")})
    grounded, useful = F.when(size % 4 == 3, "no").otherwise("yes"), F.when(size % 4 == 1, "yes").otherwise("no")
    score = numeric.diligence_score(faithfulness=size / 50.0, completeness=F.lit(1.0), numerical_accuracy=F.lit(0.5), citation_accuracy=(size % 2).cast("double"))
    return p.select("p_partkey", numeric.number_or_null(F.col("v")).alias("number"), text.trailing_number("self_ref").alias("trailing"), numeric.period_year(F.col("period")).alias("period_year"), numeric.period_quarter(F.col("period")).alias("period_quarter"),
                    numeric.unit_or_default(F.col("tag"), F.col("unit")).alias("unit"), F.round(score, 6).alias("score"), numeric.confidence(size % 4 == 0, grounded, useful).alias("confidence"), numeric.int_or_null(F.substring("p_brand", 7, 9)).alias("brand"))


_SOURCES, _FILES = ("s1.html", "", None), ("AAPL_10-K.v2.json", "noext", "")


def _some(values) -> str:
    return "[" + ", ".join("NULL" if v is None else quoted(v) for v in values) + "]"


@query(f"""SELECT o_orderkey, coalesce(nullif(trim(src), ''), nullif(regexp_replace(file, '\\.[^.]*$', ''), ''), 'T' || o_custkey || '_' || year(o_orderdate) || '_' || o_orderstatus, 'unknown_document') AS source_id, 'T' || o_custkey || '_' || o_orderstatus || '_' || year(o_orderdate) AS filing_id,
o_orderkey || chr(9) || coalesce(o_orderstatus, '') || chr(9) || o_custkey AS rendered, o_orderkey || chr(9) || coalesce(note, '\\N') AS escaped, o_orderkey || '_claim_' || o_custkey AS claim_id, 'Patent: ' || o_orderpriority || chr(10) || 'Claim ' || o_custkey || ': x' AS claim,
left(o_orderpriority, 5) AS meta_title, sha256('q' || o_orderkey || '|tenant=' || o_custkey || '|v=any') AS scoped, sha256('q ' || o_orderkey) AS normalized
FROM (SELECT *, {_some(_SOURCES)}[o_orderkey % 3 + 1] AS src, {listed(_FILES)}[o_orderkey % 2 + o_custkey % 2 + 1] AS file, CASE o_orderkey % 4 WHEN 0 THEN 'a\\\\\\tb' WHEN 1 THEN 'x\\ny' WHEN 2 THEN 'plain' END AS note FROM orders)""")
def identifiers(spark, sf_dir):
    """F18, F23, F41-F43, F46, F48, F49 on every order."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    year, tick = F.year("o_orderdate"), F.concat(F.lit("t"), c.cast("string"))
    note = F.when(k % 4 == 0, "a\\\tb").when(k % 4 == 1, "x\ny").when(k % 4 == 2, "plain")
    src = F.when(k % 3 == 0, "s1.html").when(k % 3 == 1, "")
    file = F.element_at(F.array(*map(F.lit, _FILES)), (k % 2 + c % 2 + 1).cast("int"))
    o = table(spark, sf_dir, "orders").withColumns({"note": note, "src": src, "file": file})
    filled = F.nullif(F.trim("file"), F.lit(""))
    scope = text.cache_scope(("tenant", c), ("v", F.lit(None).cast("string")))
    meta = text.vector_metadata({"title": F.col("o_orderpriority"), "none": F.lit(None).cast("string")}, title_limit=5)
    return o.select("o_orderkey", text.source_id(F.col("src"), filled, F.upper(tick), year, F.col("o_orderstatus")).alias("source_id"), text.filing_id(tick, F.col("o_orderstatus"), year).alias("filing_id"), text.rendered_row(k, F.col("o_orderstatus"), c).alias("rendered"),
                    evidence.escaped_tsv(["o_orderkey", "note"]).alias("escaped"), text.claim_id(k.cast("string"), c).alias("claim_id"), text.claim_text(F.col("o_orderpriority"), c, F.lit("x")).alias("claim"), F.try_element_at(meta, F.lit("title")).alias("meta_title"),
                    text.query_hash(F.concat(F.lit("q"), k.cast("string")), scope).alias("scoped"), text.normalized_query_hash(F.concat(F.lit(" Q  "), k.cast("string"))).alias("normalized"))


# -- questions ----------------------------------------------------------------------------------

QUESTIONS = (
    "Who are the board members", "Compare what management said on the earnings call vs the 10-K filing on revenue", "What is the net income for 2024?", "Which patents does the company hold", "Is there a lawsuit in court", "What risk factors are in the 10-Q",
    "What was the guidance on the earnings call? What is the operating income?", "Any discrepancy between guidance and the 10-K disclosure", "Hello there", "List subsidiaries and the ownership structure", "What are current assets today", "Describe item 1a. Describe item 1a?",
    "Difference between revenue and cash flow in the footnote", "what management said on growth vs what the filing says", "Patent claim and lawsuit compare",
)
_Q = f"""q AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN {picked(QUESTIONS, 'conv_id + turn')} || ' ' || text ELSE text END AS q FROM conversations), w AS (SELECT *, lower(q) AS low, {matches('q', fixed.COMPARISONS)} AS compares FROM q)"""


def _routes(low: str = "low", compares: str = "compares") -> str:
    has = lambda r: contains_any(low, fixed.MARKERS[r])
    return f"CASE WHEN {compares} AND ({has('transcripts')} OR {has('filings')}) THEN 'contradiction' " + " ".join(f"WHEN {has(r)} THEN '{r}'" for r in ("graph", "sql", "filings", "transcripts", "patents", "litigation")) + " ELSE 'llm_direct' END"


def questions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    q = F.when(F.col("turn") % 2 == 0, F.concat(pick(QUESTIONS, F.col("conv_id") + F.col("turn")), F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", q.alias("q"))


_TOPIC_LIST = "list_filter([" + ", ".join(f"CASE WHEN {contains_any('low', p)} THEN {quoted(t)} END" for t, (p, _, _) in fixed.TOPICS.items()) + "], lambda x: x IS NOT NULL)"
_WEB = "CASE " + " ".join(f"WHEN route IN ({', '.join(map(quoted, sorted(r)))}) OR {contains_any('low', w)} THEN q || {quoted(' ' + s)}" for r, w, s in fixed.WEB_SUFFIXES) + f" ELSE q || {quoted(' ' + fixed.WEB_DEFAULT)} END"


@query(f"""WITH {_Q}, r AS (SELECT *, {_routes()} AS route, {contains_any('low', fixed.MARKERS['graph'])} AS on_graph FROM w)
SELECT conv_id, turn, route, compares, array_to_string({_TOPIC_LIST}, ',') AS topics, CASE WHEN turn % 7 = 6 THEN 'filings' WHEN on_graph THEN 'graph' WHEN turn % 3 = 2 THEN 'sql' ELSE route END AS routed, {_WEB} AS web, {contains_any('low', fixed.RECENCY)} AS recent, CASE WHEN route = 'llm_direct' THEN 'tier_0' ELSE 'tier_1' END AS tier FROM r""")
def question_routes(spark, sf_dir):
    """Q01, Q02, Q05, Q06, C05, G08, M11 with the real markers, on every turn."""
    q = F.col("q")
    t = F.col("turn")
    d = questions_of(spark, sf_dir).withColumn("route", planner.route_hint(q))
    return d.select("conv_id", "turn", "route", planner.is_comparison(q).alias("compares"), F.array_join(planner.topics(q), ",").alias("topics"), planner.route(q, F.when(t % 3 == 2, "sql"), t % 7 == 6, F.lit(None).cast("string")).alias("routed"),
                    planner.web_question(q, F.col("route")).alias("web"), cache.is_time_sensitive(q).alias("recent"), numeric.tier(F.lit("single"), F.col("route")).alias("tier"))


def _clean(c: str) -> str:
    return f"regexp_replace({spaced(c)}, '[?!.]+$', '')"


def _meaning(c: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]+')), lambda z: z NOT IN ({', '.join(map(quoted, fixed.STOPWORDS))}))"


_PARTS = f"list_filter(list_transform(regexp_split_to_array(q, '\\?+'), lambda x: {_clean('x')}), lambda x: x <> '')"
_SUMMARY = "CASE t " + " ".join(f"WHEN {quoted(t)} THEN {quoted(s)}" for t, (_, s, _) in fixed.TOPICS.items()) + " END"
_SUMMARY_ROUTE = "CASE t " + " ".join(f"WHEN {quoted(t)} THEN {quoted(r)}" for t, (_, _, r) in fixed.TOPICS.items()) + " END"
_HAS = {r: contains_any("low", fixed.MARKERS[r]) for r in fixed.MARKERS}


@query(f"""WITH {_Q}, p AS (SELECT *, {_PARTS} AS parts, {_TOPIC_LIST} AS topics FROM w),
u AS (SELECT conv_id, turn, unnest(parts) AS x, unnest(range(0, len(parts))) AS pos FROM p),
v AS (SELECT *, lower(x) AS lx, {matches('x', fixed.COMPARISONS)} AS cx, {_meaning('x')} AS m FROM u),
e AS (SELECT *, {_routes('lx', 'cx')} AS r FROM v),
o AS (SELECT b.conv_id, b.turn, bool_or(CASE WHEN len(a.m) = 0 OR len(b.m) = 0 THEN 0.0 ELSE len(list_intersect(a.m, b.m))::DOUBLE / len(list_distinct(list_concat(a.m, b.m))) END < 0.55) AS apart FROM e a JOIN e b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.pos = 0 AND b.pos > 0 GROUP BY ALL),
k AS (SELECT conv_id, turn, count(DISTINCT r) AS kinds FROM e GROUP BY ALL),
d AS (SELECT p.*, (len(parts) > 1 AND (kinds > 1 OR coalesce(apart, false))) OR (compares AND (len(topics) >= 2 OR ({_HAS['transcripts']} AND {_HAS['filings']}))) AS multi FROM p LEFT JOIN o USING (conv_id, turn) LEFT JOIN k USING (conv_id, turn)),
s AS (SELECT conv_id, turn, pos, x AS sub, r FROM e JOIN d USING (conv_id, turn) WHERE multi AND len(parts) > 1
  UNION ALL SELECT conv_id, turn, pos, {_clean(_SUMMARY)}, {_SUMMARY_ROUTE} FROM (SELECT conv_id, turn, unnest(topics) AS t, unnest(range(0, len(topics))) AS pos FROM d WHERE multi AND len(parts) <= 1)
  UNION ALL SELECT conv_id, turn, len(topics), {_clean(quoted(fixed.CONTRADICTION_QUESTION))}, 'contradiction' FROM d WHERE multi AND len(parts) <= 1 AND compares AND {_HAS['transcripts']} AND ({_HAS['filings']} OR {_HAS['sql']})),
f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY conv_id, turn, lower(sub) ORDER BY pos) = 1),
g AS (SELECT conv_id, turn FROM f GROUP BY ALL HAVING count(*) >= 2)
SELECT conv_id, turn, pos::BIGINT AS pos, sub AS subquestion, r AS route, 'multi' AS plan FROM f SEMI JOIN g USING (conv_id, turn)
UNION ALL SELECT conv_id, turn, 0, q, {_routes()}, 'single' FROM w ANTI JOIN g USING (conv_id, turn)""")
def question_plans(spark, sf_dir):
    """Q03, Q04 on every turn: the parts of questions that decompose, the others whole."""
    q = questions_of(spark, sf_dir).select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("qid"), F.col("q").alias("question"))
    key = lambda i: F.split_part("qid", F.lit("/"), F.lit(i)).cast("long")
    return planner.subquestions(q).select(key(1).alias("conv_id"), key(2).alias("turn"), "pos", "subquestion", "route", "plan")


@query("""SELECT event_id, CASE WHEN kept > 0 THEN 'generate' WHEN route = 'graph' THEN 'end' WHEN route = 'filings' AND NOT tried THEN 'graph_fallback' WHEN attempts < 3 THEN 'rewrite' ELSE 'web_search' END AS graded,
CASE WHEN g = 'yes' AND u = 'yes' THEN 'end' WHEN attempts >= 3 THEN 'end' WHEN g <> 'yes' THEN 'generate' ELSE 'web_search' END AS answered FROM (SELECT event_id, user_id % 3 AS kept, CASE event_id % 3 WHEN 0 THEN 'graph' WHEN 1 THEN 'filings' ELSE 'sql' END AS route, event_id % 2 = 0 AS tried, event_id % 5 AS attempts, CASE WHEN user_id % 2 = 0 THEN 'yes' ELSE 'no' END AS g, CASE WHEN event_id % 7 < 4 THEN 'yes' ELSE 'no' END AS u FROM events)""")
def answer_branches(spark, sf_dir):
    """Q09, Q10 on every event."""
    e, i, u = table(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id")
    route = F.when(i % 3 == 0, "graph").when(i % 3 == 1, "filings").otherwise("sql")
    yes = lambda c: F.when(c, "yes").otherwise("no")
    return e.select("event_id", planner.after_grading(u % 3, route, i % 2 == 0, i % 5).alias("graded"), planner.after_answer(yes(u % 2 == 0), yes(i % 7 < 4), i % 5).alias("answered"))


@query("""WITH r AS (SELECT conv_id AS qid, turn AS pos, [role, lower(text)] AS citations, [text] AS contexts FROM conversations), x AS (SELECT qid, pos, 'citation' AS kind, unnest(citations) AS value, unnest(range(0, 2)) AS n FROM r UNION ALL SELECT qid, pos, 'context', unnest(contexts), 0 FROM r)
SELECT qid, kind, value, pos, n::BIGINT AS n FROM x QUALIFY row_number() OVER (PARTITION BY qid, kind, value ORDER BY pos, n) = 1""")
def merged_results(spark, sf_dir):
    """Q11 on every conversation, whose turns stand for sub-questions."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("qid"), F.col("turn").alias("pos"), F.array("role", F.lower("text")).alias("citations"), F.array("text").alias("contexts"))
    return planner.merged(c).withColumn("n", F.col("n").cast("long"))


@query("""SELECT conv_id, turn, round(len(list_intersect(q, t))::DOUBLE / greatest(len(q), 1), 6) AS overlap, round(0.8 * 0.5 + 0.2 * (len(list_intersect(q, t))::DOUBLE / greatest(len(q), 1)), 6) AS reranked, len(list_intersect(q, t))::DOUBLE / greatest(len(q), 1) >= 0.2 AS graded FROM (SELECT conv_id, turn, list_distinct(regexp_extract_all(translate(left(text, 30), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')) AS q, list_distinct(regexp_extract_all(translate(coalesce(substr(text, 31), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')) AS t FROM conversations)""")
def lexical_rerank(spark, sf_dir):
    """A turn's beginning against its rest."""
    q, t = F.left("text", F.lit(30)), F.substring("text", 31, 1 << 30)
    over = numeric.lexical_overlap(text.tokens(q), text.tokens(t))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(over, 6).alias("overlap"), F.round(numeric.reranked(F.lit(0.5), over), 6).alias("reranked"), models.overlap_grade(q, t).alias("graded"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN (len(list_filter([role, 'x', left(text, 2)], lambda e: contains(lower(text || role), lower(e)))) / 3.0)::DOUBLE ELSE 1.0 END AS presence FROM conversations")
def eval_entities(spark, sf_dir):
    """E04 on every turn; a turn without expected entities has them all."""
    e = F.when(F.col("turn") % 2 == 0, F.array("role", F.lit("x"), F.left("text", F.lit(2))))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", evaluation.entity_presence(F.concat("text", "role"), e).alias("presence"))


def _length_judge(pairs):
    return [{"completeness": len(a) / 1000, "contradiction_rate": "x" if len(a) % 2 else 0.25} for a, _ in pairs]


@query("SELECT conv_id AS id, m AS metric, CASE WHEN turn % 3 = 0 THEN 1.0 WHEN m = 'completeness' THEN least(1.0, length(text) / 1000.0) WHEN length(text) % 2 = 1 THEN 0.0 ELSE 0.25 END::DOUBLE AS value FROM conversations, (VALUES ('completeness'), ('contradiction_rate')) v(m)")
def judged_answers(spark, sf_dir):
    """E06, E07 with a judge of lengths; what it cannot read scores 0."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("text").alias("answer"), F.when(F.col("turn") % 3 == 0, "").otherwise("y").alias("expected"))
    return evaluation.judged(c, _length_judge)


# -- scans and sinks -----------------------------------------------------------------------------


def written(df: DataFrame, what: str, fmt: str = "text", **options) -> str:
    path = folder(df.sparkSession, what)
    df.write.format(fmt).options(**options).save(path)
    return path


_FACTS = "SELECT 'a' || l_orderkey AS adsh, coalesce(CASE l_linenumber % 4 WHEN 0 THEN 'Revenue' WHEN 1 THEN 'NetIncome' WHEN 2 THEN 'TotalAssets' END, 'Other') AS tag, l_shipdate::DATE AS ddate, CASE WHEN l_linenumber % 5 <> 0 THEN l_extendedprice END AS value FROM lineitem"


@query(f"""WITH f AS (SELECT 'a' || o_orderkey AS adsh, o_custkey AS cik, year(o_orderdate)::BIGINT AS fiscal_year, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate::DATE END AS filed FROM orders WHERE o_custkey % 100 = 0)
SELECT f.adsh, f.cik, f.fiscal_year, f.filed, n.tag, count(*) AS n, max(n.value) AS top, min(n.ddate) AS first FROM ({_FACTS}) n JOIN f USING (adsh) GROUP BY ALL""")
def filing_facts(spark, sf_dir):
    """Tab-separated filings and facts, some values unreadable, joined and summed up."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("a"), F.col("o_orderkey").cast("string")).alias("adsh"), F.col("o_custkey").alias("cik"), F.lit("N").alias("name"), F.year("o_orderdate").alias("fy"),
                                              F.when(F.col("o_orderkey") % 3 == 0, "bad").otherwise(F.date_format("o_orderdate", "yyyyMMdd")).alias("filed"), F.lit("x").alias("extra"))
    tag = F.element_at(F.array(*map(F.lit, ("Revenues", "ProfitLoss", "Assets", "Other"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    li = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("a"), F.col("l_orderkey").cast("string")).alias("adsh"), tag.alias("tag"), F.date_format("l_shipdate", "yyyyMMdd").alias("ddate"), F.when(F.col("l_linenumber") % 5 != 0, F.col("l_extendedprice")).alias("value"))
    f = filings.filings(spark, written(o, "sub", "csv", sep="\t", header=True))
    asked = o.select("cik").where("cik % 100 = 0").distinct()
    kept, facts = filings.facts_of(filings.facts(spark, written(li, "num", "csv", sep="\t", header=True)), f, asked)
    facts = relational.replace_values(facts, "tag", fixed.TAGS)
    return facts.join(kept.select("adsh", "cik", "fiscal_year", "filed"), "adsh").groupBy("adsh", "cik", "fiscal_year", "filed", "tag").agg(F.count("*").alias("n"), F.max("value").alias("top"), F.min("ddate").alias("first"))


@query("""WITH p AS (SELECT 'p' || p_partkey AS patent_id, DATE '2019-01-01' + (p_partkey * 37 % 2500)::INTEGER AS patent_date, p_partkey FROM part WHERE p_size % 3 = 1), k AS (SELECT * FROM p WHERE patent_date BETWEEN '2021-01-01' AND '2024-12-31'),
c AS (SELECT patent_id, unnest(range(1, 5)) AS claim_number, p_partkey FROM k)
SELECT k.patent_id, patent_date, 'Org ' || (p_partkey % 7) AS assignee, CASE WHEN p_partkey % 2 = 0 THEN 'A61B' || (p_partkey % 3) || ',H04L' ELSE 'H04L' END AS cpc, (SELECT count(*) FROM c WHERE c.patent_id = k.patent_id AND claim_number % 3 <> 0 AND (claim_number <> 4 OR c.p_partkey % 2 = 0)) AS n_claims FROM k""")
def patent_bulk(spark, sf_dir):
    """The four bulk files of an assignee's patents in a span of days."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("patent_id"))
    k = F.col("p_partkey")
    root = folder(spark, "bulk")
    claim = F.explode(F.sequence(F.lit(1), F.lit(4))).alias("claim_number")
    claims = p.select("patent_id", "p_partkey", claim).select("patent_id", "claim_number", F.when(F.col("claim_number") == 4, F.when(k % 2 == 0, "A\tdevice").otherwise("  ")).otherwise("The method").alias("claim_text"), F.when(F.col("claim_number") == 3, "1").when(F.col("claim_number") == 1, "0.0").alias("dependent"))
    files = {
        "g_patent": p.select("patent_id", F.date_add(F.lit("2019-01-01").cast("date"), (k * 37 % 2500).cast("int")).alias("patent_date"), F.lit("T").alias("patent_title")),
        "g_assignee": p.select("patent_id", F.concat(F.lit("o"), (F.col("p_size") % 3).cast("string")).alias("assignee_id"), F.explode(F.array(F.concat(F.lit("Org "), (k % 7).cast("string")), F.lit("Zeta"))).alias("disambig_assignee_organization")),
        "g_cpc": p.select("patent_id", F.explode(F.when(k % 2 == 0, F.array(F.lit("H04L"), F.concat(F.lit("A61B"), (k % 3).cast("string")), F.lit("H04L"))).otherwise(F.array(F.lit("H04L"), F.lit(None).cast("string")))).alias("cpc_group")),
        "g_claims": claims,
    }
    for name, df in files.items():
        df.write.csv(f"{root}/{name}.tsv", sep="\t", header=True)
    t = filings.patents(spark, root, "o1", "2021-01-01", "2024-12-31")
    n = filings.independent_claims(t["claims"]).groupBy("patent_id").agg(F.count("*").alias("n_claims"))
    return filings.merged_patents(t).join(n, "patent_id", "left").select("patent_id", "patent_date", F.col("assignee_organization").alias("assignee"), F.array_join("cpc_codes", ",").alias("cpc"), F.coalesce("n_claims", F.lit(0)).alias("n_claims"))


_GRANTS = "CASE p_partkey % 4 WHEN 0 THEN (2018 + p_partkey % 10) || '-05-01' WHEN 1 THEN ' 2022' WHEN 2 THEN 'n/a' ELSE '2025-12-31' END"
_OWNERS = ("Apple Inc", "", "Other", " apple INC ")


@query(f"""WITH p AS (SELECT p_partkey, {_GRANTS} AS g, {picked(_OWNERS, 'p_size')} AS o, ['A61B5/02', 'h04w72/00', 'Y02E', 'G06F1', 'H0'][p_partkey % 5 + 1:] AS codes FROM part),
k AS (SELECT * FROM p WHERE try_cast(nullif(regexp_extract(trim(g), '^(\\d{{4}})', 1), '') AS INTEGER) BETWEEN 2021 AND 2025 AND lower(trim(o)) IN ('', 'apple inc')),
e AS (SELECT p_partkey::VARCHAR AS patent_id, unnest(list_distinct(list_transform(list_filter(codes, lambda c: length(c) >= 3 AND upper(c[1]) <> 'Y'), lambda c: c[1:3]))) AS cpc_prefix FROM k)
SELECT patent_id, cpc_prefix, CASE cpc_prefix WHEN 'A61' THEN 'Medical & Health Devices' WHEN 'G06' THEN 'Computing & Data Processing' ELSE 'Other (' || cpc_prefix || ')' END AS label FROM e""")
def patent_file(spark, sf_dir):
    """A CSV file of patents, its company's recent ones, and their classes."""
    k = F.col("p_partkey")
    day = F.when(k % 4 == 0, F.concat((2018 + k % 10).cast("string"), F.lit("-05-01"))).when(k % 4 == 1, " 2022").when(k % 4 == 2, "n/a").otherwise("2025-12-31")
    codes = F.slice(F.array(*map(F.lit, ("A61B5/02", "h04w72/00", "Y02E", "G06F1", "H0"))), (k % 5 + 1).cast("int"), 9)
    p = table(spark, sf_dir, "part").select(k.cast("string").alias("patent_id"), F.lit('say "x", y').alias("patent_title"), day.alias("grant_date"), pick(_OWNERS, F.col("p_size")).alias("assignee_organization"), F.concat(F.lit("{"), F.array_join(codes, ","), F.lit("}")).alias("cpc_codes"))
    got = filings.patent_csv(spark, written(p, "patents", "csv", header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False))
    return graph.domain_edges(graph.patents_in_scope(got, "Apple Inc"), "patent_id", text.cpc_codes("cpc_codes"))


@query("""SELECT lpad(o_custkey::VARCHAR, 10, '0') AS cik, 'a' || o_orderkey AS accession, CASE WHEN o_orderkey % 4 = 0 THEN year(o_orderdate) ELSE year(o_orderdate) + 1 END::INTEGER AS year, CASE o_orderstatus WHEN 'F' THEN '8-K' WHEN 'O' THEN 'DEF 14A' ELSE '10-K' END AS form,
o_orderstatus = 'F' AND o_orderkey % 3 = 0 AND year(o_orderdate) + 1 BETWEEN 1996 AND 1997 AS release, o_orderstatus = 'O' AND CASE WHEN o_orderkey % 4 = 0 THEN year(o_orderdate) ELSE year(o_orderdate) + 1 END BETWEEN 1995 AND 1998 AS annual FROM orders""")
def submission_rows(spark, sf_dir):
    """Parallel arrays of a JSON file as rows; releases and yearly statements among them."""
    k, y = F.col("o_orderkey"), F.year("o_orderdate")
    o = table(spark, sf_dir, "orders").select("o_custkey", F.struct(F.concat(F.lit("a"), k.cast("string")).alias("accessionNumber"), F.concat((y + 1).cast("string"), F.lit("-02-01")).alias("filingDate"), F.when(k % 4 == 0, F.concat(y.cast("string"), F.lit("-12-31"))).otherwise("").alias("reportDate"),
                                              F.when(F.col("o_orderstatus") == "F", "8-K").when(F.col("o_orderstatus") == "O", "DEF 14A").otherwise("10-K").alias("form"), F.when(k % 3 == 0, "2.02,9.01").otherwise("5.02").alias("items"), F.lit("d.htm").alias("primaryDocument")).alias("f"))
    per = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list("f")).alias("r"))
    recent = F.struct(*(F.expr(f"transform(r, x -> x.{n})").alias(n) for n in ("accessionNumber", "filingDate", "reportDate", "form", "items", "primaryDocument")))
    path = written(per.select(F.col("o_custkey").cast("string").alias("cik"), F.lit("N").alias("name"), F.struct(recent.alias("recent")).alias("filings")), "submissions", "json")
    from .. import schemas

    s = filings.submissions(spark.read.schema(schemas.SUBMISSIONS).json(path))
    release = filings.earnings_releases(s, "1996-01-01", "1997-12-31").select(F.col("accessionNumber").alias("accession"), F.lit(True).alias("release"))
    annual = filings.annual(s, "DEF 14A", 1995, 1998).select(F.col("accessionNumber").alias("accession"), F.lit(True).alias("annual"))
    out = s.select("cik", F.col("accessionNumber").alias("accession"), "year", "form").join(release, "accession", "left").join(annual, "accession", "left")
    return out.na.fill(False, ["release", "annual"])


@query("""SELECT 'p' || o_orderkey AS patent_id, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate::DATE END AS grant_date, l_linenumber AS claim_number,
row_number() OVER (ORDER BY CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate::DATE END DESC NULLS FIRST, 'p' || o_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS place FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority ILIKE '%URGENT%'""")
def claims_in_order(spark, sf_dir):
    """Claims of one owner's patents, newest patents first, undated ones before them, with their place."""
    name = lambda c: F.concat(F.lit("p"), F.col(c).cast("string")).alias("patent_id")
    p = table(spark, sf_dir, "orders").select(name("o_orderkey"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate").cast("date")).alias("grant_date"), F.col("o_orderpriority").alias("assignee_organization"))
    c = table(spark, sf_dir, "lineitem").select(name("l_orderkey"), F.col("l_linenumber").alias("claim_number"), "l_partkey", "l_suppkey", "l_quantity")
    joined = filings.joined_claims(p, c, "urgent")
    return relational.ranked(joined, [F.desc_nulls_first("grant_date"), F.col("patent_id"), F.col("claim_number"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity")], "place").select("patent_id", "grant_date", "claim_number", "place")


@query("""SELECT lpad(c_custkey::VARCHAR, 10, '0') AS cik, upper(c_mktsegment) AS ticker, CASE c_custkey % 3 WHEN 0 THEN 'ex21_' || c_custkey WHEN 1 THEN 'late_' || c_custkey END AS exhibit FROM customer""")
def company_files(spark, sf_dir):
    """Companies with ten-digit numbers, and the list of subsidiaries among the files of each one's filing."""
    k = F.col("c_custkey")
    item = lambda name, kind: F.struct(name.alias("name"), kind.alias("type"))
    first = item(F.concat(F.lit("main_"), k.cast("string")), F.when(k % 2 == 0, "10-K").otherwise("EX-2"))
    second = item(F.concat(F.lit("ex21_"), k.cast("string")), F.when(k % 3 == 0, "ex-21.1").otherwise("EX-31"))
    third = item(F.concat(F.lit("late_"), k.cast("string")), F.when(k % 3 == 2, "EX-99").otherwise("EX-21"))
    c = table(spark, sf_dir, "customer").select(k.alias("cik"), F.upper("c_mktsegment").alias("ticker"), F.struct(F.array(first, second, third).alias("item")).alias("directory"))
    return filings.exhibit_21(filings.tickers(c)).select("cik", "ticker", "exhibit")


_TRADES = ("Iron & Steel", "Textile", "Grain", "Shipping Lines", "Paper", "Motor-Works", "Glass")


@query(f"""WITH c AS (SELECT 'T' || s_suppkey AS ticker, {picked(_TRADES, 's_suppkey')} || ' ' || s_suppkey || ', Inc.' AS title FROM supplier), p AS (SELECT lower(ticker) AS t, regexp_replace(lower(title), '[^a-z0-9 ]', '', 'g') AS plain, ticker, title FROM c),
n AS (SELECT DISTINCT CASE c_custkey % 5 WHEN 0 THEN 't' || c_custkey % 977 WHEN 1 THEN upper({picked(_TRADES, 'c_custkey % 977')}) || ' ' || c_custkey % 977 || ' inc' WHEN 2 THEN lower({picked(_TRADES, 'c_custkey')}) || ' ' || c_custkey % 31 WHEN 3 THEN (c_custkey % 300)::VARCHAR ELSE c_name END AS name FROM customer),
h AS (SELECT name, ticker, title, CASE WHEN t = q THEN 1 WHEN plain = q THEN 2 WHEN q <> '' AND contains(plain, q) THEN 3 END AS "by" FROM (SELECT name, trim(regexp_replace(lower(name), '[^a-z0-9 ]', '', 'g')) AS q FROM n), p)
SELECT name, ticker, title, "by" FROM h WHERE "by" IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY "by", ticker, title) = 1""")
def company_resolution(spark, sf_dir):
    """Names that customers give against all suppliers as companies: ticker, name, part of a name."""
    k = F.col("c_custkey")
    s = lambda c: c.cast("string")
    name = F.when(k % 5 == 0, F.concat(F.lit("t"), s(k % 977))).when(k % 5 == 1, F.concat(F.upper(pick(_TRADES, k % 977)), F.lit(" "), s(k % 977), F.lit(" inc"))).when(k % 5 == 2, F.concat(F.lower(pick(_TRADES, k)), F.lit(" "), s(k % 31))).when(k % 5 == 3, s(k % 300)).otherwise(F.col("c_name"))
    n = F.col("s_suppkey")
    c = table(spark, sf_dir, "supplier").select(F.concat(F.lit("T"), s(n)).alias("ticker"), F.concat(pick(_TRADES, n), F.lit(" "), s(n), F.lit(", Inc.")).alias("title"))
    return filings.resolved(table(spark, sf_dir, "customer").select(name.alias("name")), c).select("name", "ticker", "title", "by")


@query("SELECT o_custkey AS k, min(o_totalprice) FILTER (o_orderkey % 2 = 0) AS first, count(*) FILTER (o_orderkey % 2 = 1) AS later, replace(max(o_orderpriority), '-', chr(10)) AS line FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderkey % 2 = 0) > 0 AND count(*) FILTER (o_orderkey % 2 = 1) > 0")
def stored_rows(spark, sf_dir):
    """Rows go to a table if their key is not there, others are appended, JSON lines leave nulls out."""
    o = table(spark, sf_dir, "orders")
    path, log = folder(spark, "stored"), folder(spark, "log")
    even = o.where("o_orderkey % 2 = 0").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_totalprice").alias("first"))
    sinks.insert_absent(even, path, ["k"])
    back = sinks.insert_absent(o.where("o_orderkey % 2 = 1").select(F.col("o_custkey").alias("k"), F.lit(-1.0).alias("first")), path, ["k"])
    sinks.append(o.select(F.col("o_custkey").alias("k"), "o_orderkey", F.regexp_replace("o_orderpriority", "-", "\n").alias("line"), "o_orderdate"), log, ["k", "o_orderkey", "line"])
    rows = spark.read.schema("k long, o_orderkey long, line string").parquet(log)
    lines = folder(spark, "lines")
    sinks.json_lines(rows.select("k", "line", F.when(F.col("o_orderkey") % 2 == 1, F.col("o_orderkey")).alias("odd")), lines)
    told = spark.read.schema("k long, line string, odd long").json(lines).groupBy("k").agg(F.count("odd").alias("later"), F.max("line").alias("line"))
    return back.where("first >= 0").join(told, "k").select("k", "first", "later", "line")


@query("""WITH f AS (SELECT o_custkey AS k, min(o_totalprice) AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), o AS (SELECT o_custkey AS k, max(o_totalprice) AS p, max(o_orderkey) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), p AS (SELECT o_custkey AS k, min(o_orderkey) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT k, coalesce(o.p, f.p, 0) AS price, CASE WHEN o.k IS NOT NULL THEN 'open' WHEN f.k IS NOT NULL THEN 'filled' ELSE 'partial' END AS said, f.k IS NOT NULL OR p.k IS NOT NULL AS first FROM f FULL JOIN o USING (k) FULL JOIN p USING (k)""")
def keyed_merge(spark, sf_dir):
    """orders' states go into one table by customer, as new keys, in place of old rows, and as new keys
    again; each commit rewrites the buckets that it touches."""
    o = table(spark, sf_dir, "orders")
    rows = lambda status, said, price: o.where(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("k"), price.alias("price"), F.lit(said).alias("said"), F.lit(said != "open").alias("first"))
    stored = KeyedTable(spark, folder(spark, "keyed"), ["k"])
    stored.insert_absent(rows("F", "filled", F.col("o_totalprice")), ["price"])
    opened = rows("O", "open", F.col("o_totalprice"))
    known = stored.read().select("k", F.col("first").alias("_first"))
    partial = rows("P", "partial", F.lit(0.0))
    first = known.unionByName(partial.select("k", F.col("first").alias("_first"))).groupBy("k").agg(F.max("_first").alias("_first"))
    stored.upsert(opened.join(first, "k", "left").withColumn("first", F.coalesce("_first", F.lit(False))).drop("_first"), [-F.col("price")])
    stored.insert_absent(partial)
    return stored.read()


@query("SELECT n_nationkey AS k, count(c_custkey) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey <> 3 GROUP BY 1")
def published_tables(spark, sf_dir):
    """Two tables shown together; a second publication with a broken reference changes nothing."""
    root = folder(spark, "published")
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    link = [("customer", "c_nationkey", "nation", "n_nationkey")]
    sinks.publish({"nation": n.where("n_nationkey <> 3"), "customer": c.where("c_nationkey <> 3")}, root, link)
    try:
        sinks.publish({"nation": n.limit(1), "customer": c}, root, link)
    except ValueError:
        pass
    both = sinks.read_published(spark, root, "customer").join(sinks.read_published(spark, root, "nation"), F.expr("c_nationkey = n_nationkey"))
    return both.groupBy(F.col("n_nationkey").alias("k")).agg(F.count("*").alias("n"))


@query("""SELECT label % 3 AS namespace, vec_id AS id, CASE WHEN vec_id % 5 = 0 THEN 'new' ELSE 'old' END AS v, count(*) OVER (PARTITION BY label % 3) AS in_namespace FROM embeddings QUALIFY label % 3 = 1""")
def vector_store(spark, sf_dir):
    """Vectors written twice, the last write holds; fetched by id and counted by namespace."""
    e = table(spark, sf_dir, "embeddings").select((F.col("label") % 3).alias("namespace"), F.col("vec_id").alias("id"), F.lit("old").alias("v"), F.lit(0).alias("seq"))
    new = e.where("id % 5 = 0").select("namespace", "id", F.explode(F.array(F.lit("mid"), F.lit("new"))).alias("v")).withColumn("seq", F.when(F.col("v") == "new", 2).otherwise(1))
    store = sinks.upsert_vectors(e, new, "seq")
    n = validation.namespace_counts(store)
    return validation.vectors_by_id(store, e, 1).join(n, "namespace").select("namespace", "id", "v", F.col("n").alias("in_namespace"))


def _pages(query_: str, cursor: str | None):
    at = int(cursor or 0)
    return [(query_, i) for i in range(at, at + 7)], str(at + 7) if at + 7 < 30 else None


@query("SELECT q, unnest(range(0, 20))::BIGINT AS item FROM (VALUES ('a'), ('b'), ('c')) v(q)")
def rest_search(spark, sf_dir):
    """Pages of a search until 20 results, a task per question."""
    rest.register(spark, rest.rest_source("siltstone_pages", "q string, item long", _pages, ["a", "b", "c"], 20, 0.0))
    return spark.read.format("siltstone_pages").load()


# -- HTML ----------------------------------------------------------------------------------------

_FACT_TAGS = ("us-gaap:Revenues", "us-gaap:PolicyTextBlock", "dei:Name", "us-gaap:Assets")


@query(f"""WITH d AS (SELECT *, date_diff('day', s, e) AS days FROM (SELECT o_orderkey AS k, o_orderdate::DATE AS s, (o_orderdate + INTERVAL (o_custkey % 500) DAY)::DATE AS e, {picked(_FACT_TAGS, 'o_orderkey')} AS tag, o_custkey, o_totalprice FROM orders))
SELECT k, tag, CASE WHEN tag LIKE 'us-gaap:%' THEN o_totalprice END AS value_num, CASE WHEN tag LIKE 'us-gaap:%' AND o_custkey % 2 = 0 THEN 'USD' WHEN tag LIKE 'us-gaap:%' THEN 'iso4217:USD' END AS unit, s::VARCHAR AS start_date, CASE WHEN tag LIKE 'us-gaap:%' THEN 'x:m' || o_custkey END AS member,
CASE WHEN days <= 110 THEN 'quarterly' WHEN days <= 200 THEN 'semiannual' WHEN days <= 400 THEN 'annual' ELSE 'other' END AS period_type, CASE WHEN days <= 110 THEN 'Q' || quarter(e) END AS fiscal_quarter FROM d WHERE tag <> 'us-gaap:PolicyTextBlock'""")
def inline_xbrl(spark, sf_dir):
    """A page of inline XBRL per order, with hidden parts, a nil fact and a repeated one."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    tag = pick(_FACT_TAGS, k)
    end = F.date_add(F.col("o_orderdate").cast("date"), (c % 500).cast("int")).cast("string")
    value = F.when(tag.startswith("us-gaap:"), F.format_number("o_totalprice", 2)).otherwise("Apple")
    fact = F.format_string('<ix:nonFraction name="%s" contextRef="c1" unitRef="u">%s</ix:nonFraction>', tag, value)
    unit = F.when((c % 2 == 0) & tag.startswith("us-gaap:"), '<xbrli:unit id="u"><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unit>').otherwise("")
    member = F.when(tag.startswith("us-gaap:"), F.format_string('<xbrli:segment><xbrldi:explicitMember dimension="x:axis">x:m%s</xbrldi:explicitMember></xbrli:segment>', c.cast("string"))).otherwise("")
    page = F.concat(F.lit('<html><ix:header><xbrli:context id="c1">'), member, F.format_string("<xbrli:startDate>%s</xbrli:startDate><xbrli:endDate>%s</xbrli:endDate></xbrli:context>", F.col("o_orderdate").cast("date").cast("string"), end), unit, F.lit("</ix:header><p>"), fact, fact,
                    F.lit('<ix:nonFraction name="us-gaap:Nil" contextRef="c1" xsi:nil="true"></ix:nonFraction><ix:nonNumeric name="dei:Lost" contextRef="none">z</ix:nonNumeric></p></html>'))
    raw = html.xbrl_facts(table(spark, sf_dir, "orders").select(k.alias("source"), page.alias("html")), ["source"])
    got = filings.cleaned_facts(raw)
    return got.select(F.col("source").alias("k"), "tag", "value_num", "unit", "start_date", "member", "period_type", "fiscal_quarter")


@query("""WITH s AS (SELECT s_nationkey AS k, s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'Holding' ELSE 'Unit ' || s_suppkey || ' Ltd' END AS name FROM supplier), f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY k, name ORDER BY s_suppkey) = 1)
SELECT k, (row_number() OVER (PARTITION BY k ORDER BY s_suppkey) - 1) AS pos, name, '/e' || k || '.htm' AS link, 'Nation ' || chr(65 + k) || ' Smith/Chair' AS director, 'Head ' || k || chr(10) || chr(10) || 'Tail' AS plain FROM f""")
def html_tables(spark, sf_dir):
    """Tables of subsidiaries, directors and exhibits in a page per nation."""
    k = F.col("s_nationkey")
    cell = F.when(F.col("s_suppkey") % 3 == 0, F.when(F.col("s_suppkey") % 2 == 0, "Holding").otherwise("Holding")).otherwise(F.concat(F.lit("Unit "), F.col("s_suppkey").cast("string"), F.lit(" Ltd")))
    rows = table(spark, sf_dir, "supplier").groupBy(k.alias("k")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", cell.alias("c")))).alias("r"))
    letter = F.expr("char(65 + k)")
    page = F.concat(F.lit("<table><tr><th>Name of Subsidiary</th></tr>"), F.array_join(F.transform("r", lambda x: F.concat(F.lit("<tr><td> "), x["c"], F.lit("</td><td>99</td></tr>"))), ""), F.lit("<tr><td>7</td></tr></table>"))
    board = F.concat(F.lit("<table><tr><th>Director</th><th>Position</th></tr><tr><td>Total 2024 fees</td><td>x</td></tr><tr><td>Nation "), letter, F.lit(" Smith</td><td>Chair</td></tr></table>"))
    exhibit = F.concat(F.lit('<table><tr><td>1</td><td>x</td><td><a href="/e'), F.col("k").cast("string"), F.lit('.htm">e</a></td><td>EX-99.1</td></tr></table>'))
    plain = F.concat(F.lit("<ix:header>no</ix:header><p>Head <ix:nonFraction name='a'>"), F.col("k").cast("string"), F.lit("</ix:nonFraction></p><script>x</script><p>Tail</p>"))

    def parse(h: str) -> dict:
        subsidiaries, board, exhibit, plain = h.split("\0")
        return {"names": html.subsidiary_names(subsidiaries), "director": "/".join(html.directors(board)[0]), "link": html.exhibit_link(exhibit), "plain": html.text_of(html.without_xbrl(plain))}

    got = html.parsed(rows.select("k", F.concat_ws("\0", page, board, exhibit, plain).alias("html")), ["k"], "html", parse, "struct<names:array<string>,director:string,link:string,plain:string>")
    return got.select(F.col("k"), F.posexplode("parsed.names").alias("pos", "name"), "parsed.link", "parsed.director", "parsed.plain").withColumn("pos", F.col("pos").cast("long"))


@query("""WITH c AS (SELECT o_custkey AS g, o_orderkey, o_orderpriority AS p, o_orderstatus AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders)
SELECT g, r, CASE WHEN g % 2 = 0 THEN 'Priority' ELSE 'col_0' END || '=' || p || ';' || CASE WHEN g % 2 = 0 THEN 'col_1' ELSE 'Status' END || '=' || s AS cells FROM c""")
def table_cells(spark, sf_dir):
    """cells of a table per customer; the header is the first row that is filled enough, a nameless column gets a number."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g"), "o_orderpriority", "o_orderstatus", F.row_number().over(_by("o_custkey", "o_orderkey")).alias("r"))
    body = o.select("g", "r", F.posexplode(F.array("o_orderpriority", "o_orderstatus")).alias("c", "text"))
    heads = o.select("g").distinct().select("g", F.lit(0).alias("r"), F.posexplode(F.array(F.when(F.col("g") % 2 == 0, "Priority").otherwise(" "), F.when(F.col("g") % 2 == 0, "").otherwise("Status"))).alias("c", "text"))
    rows = chunking.table_rows(heads.unionByName(body), ["g"])
    return rows.select("g", F.col("r").cast("long").alias("r"), F.array_join(F.transform("cells", lambda x: F.concat(x["name"], F.lit("="), x["value"])), ";").alias("cells"))


def _by(group: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(group).orderBy(order)


_BODY = "regexp_matches(t, '^.{50,}$')"


@query(f"""WITH l AS (SELECT doc_id, unnest(range(0, len(ls))) AS i, unnest(ls) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)), t AS (SELECT doc_id, i, CASE WHEN i % 4 = 0 THEN 'Foreign Currency Risk ' || i ELSE {spaced('x')} END AS t FROM l WHERE i % 6 <> 5),
k AS (SELECT *, length(t) >= 50 AS body FROM t WHERE t <> '' AND (length(t) >= 50 OR i % 4 = 0)),
b AS (SELECT *, lag(t) OVER w AS before, lag(body) OVER w AS was FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN row_number() OVER (PARTITION BY doc_id ORDER BY i) ELSE i END::INTEGER AS ordinal, CASE WHEN NOT was THEN before END AS title, md5(t) AS h FROM b WHERE body""")
def filing_sections(spark, sf_dir):
    """Sections of every document, with the title before each and an ordinal of its own."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x"))
    # lines that are neither a title of ours nor long would be titles or not by their letters: they are contents entries here
    t = F.when(F.col("i") % 4 == 0, F.concat(F.lit("Foreign Currency Risk "), F.col("i").cast("string"))).otherwise(F.col("x"))
    short = (F.col("i") % 4 != 0) & (F.length(text.normalize_whitespace("x")) < 50)
    blocks = lines.select("doc_id", F.struct("i", t.alias("text"), F.lit("text").alias("label"), F.when(F.col("i") % 6 == 5, "furniture").otherwise("body").alias("content_layer"), F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit("#/texts/"), F.col("i").cast("string"))).alias("self_ref"), F.when(short, "#toc").alias("hyperlink")).alias("b"))
    docs = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list("b"), lambda a, b: a["i"] - b["i"]).alias("b"))
    docling = F.struct(F.transform("b", lambda x: x.dropFields("i")).alias("texts"))
    s = chunking.sections(docs.select(F.col("doc_id").alias("source"), F.lit("t").alias("ticker"), F.lit("10-K").alias("form_type"), F.lit("2024-09-28").alias("report_date"), F.lit(None).cast("string").alias("filing_date"), F.lit(None).cast("int").alias("year"), docling.alias("docling")))
    return s.select(F.col("source").alias("doc_id"), "ordinal", "title", F.md5(F.col("text").cast("binary")).alias("h"))


# -- graph ---------------------------------------------------------------------------------------


@query("""SELECT DISTINCT 'C' || s_nationkey AS ticker, 1990 + s_suppkey % 5 AS year, 'Unit ' || (s_suppkey % 11) AS name, 'C' || s_nationkey || '_unit_' || (s_suppkey % 11) AS subsidiary_id FROM supplier""")
def subsidiary_graph(spark, sf_dir):
    """An edge per subsidiary and year, however often it is loaded."""
    k = F.col("s_suppkey")
    per = table(spark, sf_dir, "supplier").groupBy("s_nationkey", (1990 + k % 5).cast("int").alias("year")).agg(F.collect_list(F.concat(F.lit(" Unit  "), (k % 11).cast("string"))).alias("subsidiaries"))
    payload = per.groupBy("s_nationkey").agg(F.collect_list(F.struct("year", F.concat("subsidiaries", F.array(F.lit(" "))).alias("subsidiaries"))).alias("subsidiaries_by_year")).select(F.concat(F.lit("c"), F.col("s_nationkey").cast("string")).alias("ticker"), F.lit("10-K").alias("form_type"), "subsidiaries_by_year")
    edges = graph.subsidiary_edges(payload)
    twice = edges.withColumn("at", F.lit(0)).unionByName(edges.withColumn("at", F.lit(1)))
    return graph.merged(twice, ["ticker", "year", "subsidiary_id"], "at").select("ticker", F.col("year").cast("long").alias("year"), "name", "subsidiary_id")


def _asked(said: str) -> str:
    return "```cypher\nMATCH (r:Region)-[:HAS]->(n:Nation)-[e:TRADES {segment: 'BUILDING'}]->(c:Customer) WHERE n.size >= 3 AND c.balance < 5000 RETURN DISTINCT n.name AS nation, c.id AS customer, e.segment AS segment ORDER BY customer LIMIT 50\n```"


@query("SELECT n_name AS nation, c_custkey AS customer, c_mktsegment AS segment FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' AND n_nationkey >= 3 AND c_acctbal < 5000 ORDER BY c_custkey LIMIT 10")
def graph_question(spark, sf_dir):
    """LM05, O04, P17, G06: a question as a graph pattern, ten rows at most."""
    n, c, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "region")
    nodes = {"Region": r.select(F.col("r_regionkey").alias("id")), "Nation": n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("size")), "Customer": c.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))}
    edges = {"HAS": ("Region", "Nation", n.select(F.col("n_regionkey").alias("src"), F.col("n_nationkey").alias("dst"))), "TRADES": ("Nation", "Customer", c.select(F.col("c_nationkey").alias("src"), F.col("c_custkey").alias("dst"), F.col("c_mktsegment").alias("segment")))}
    return nlgraph.ask("Which customers build?", nodes, edges, _asked)[1]


_STATEMENTS = ("MATCH (n) RETURN n", "match (n) where n.x = 'SETTLE' return n", "MATCH (n) DELETE n RETURN n", "MATCH (n) RETURN n;", "RETURN 1", "MATCH (n) SET n.x = 1 RETURN n", "CALL db.x() MATCH (n) RETURN n")
_FENCE = "regexp_replace(trim(q, ' ' || chr(10)), '\\s*;$', '')"


@query(f"""SELECT c_custkey, NOT contains(s, ';') AND regexp_matches(s, '(?i)\\bMATCH\\b') AND regexp_matches(s, '(?i)\\bRETURN\\b') AND NOT regexp_matches(s, '(?i)\\b(?:{'|'.join(fixed.WRITE_WORDS)})\\b') AS read_only, s AS statement FROM (SELECT c_custkey, {_FENCE} AS s FROM (SELECT c_custkey, {picked(_STATEMENTS, 'c_custkey')} AS q FROM customer))""")
def graph_guard(spark, sf_dir):
    """P17, F28 on a statement per customer, half of them between fences."""
    q = pick(_STATEMENTS, F.col("c_custkey"))
    given = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("```cypher\n"), q, F.lit("\n```"))).otherwise(F.concat(F.lit("  "), q))
    return table(spark, sf_dir, "customer").select("c_custkey", graph.is_read_only(given).alias("read_only"), text.strip_fence(given).alias("statement"))


@query("SELECT r_regionkey || chr(9) || r_name AS line FROM region")
def sql_question(spark, sf_dir):
    """LM04, P16, O03, F41: a question as SQL; the first statement fails and is put right once."""
    table(spark, sf_dir, "region").createOrReplaceTempView("siltstone_region")
    _, rows = nlsql.ask(spark, "Which regions?", lambda q, e: "```sql\nSELECT r_key FROM siltstone_region;\n```" if e is None else "SELECT r_regionkey, r_name FROM siltstone_region")
    return nlsql.rendered(rows)


@query("""SELECT n_nationkey AS k, 'NATION ' || n_nationkey || ' board member in 2024: P' || n_regionkey || ' | Title: Chair | Years present: [2023,2024]' AS member, 'Company patent: ' || n_name || ' | Title: T' || n_nationkey AS patent, 'key: ' || n_nationkey || chr(10) || 'name: ' || coalesce(CASE WHEN n_nationkey % 2 = 0 THEN n_name END, 'None') AS other FROM nation""")
def evidence_texts(spark, sf_dir):
    """rows of graph queries as text, by their columns."""
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    member = n.select(k.alias("k"), F.concat(F.lit("NATION "), k.cast("string")).alias("company"), F.lit(2024).alias("year"), F.concat(F.lit("P"), F.col("n_regionkey").cast("string")).alias("board_member"), F.lit("Chair").alias("title"), F.array(F.lit(2023), F.lit(2024)).alias("years_present"))
    patent = n.select(k.alias("k"), F.col("n_name").alias("patent_id"), F.concat(F.lit("T"), k.cast("string")).alias("patent_title"), F.lit("").alias("grant_date"))
    other = n.select(k.alias("key"), F.when(k % 2 == 0, F.col("n_name")).alias("name"))
    a, b, c = (df.select(F.col(df.columns[0]).alias("k"), evidence.row_text(df).alias(t)) for df, t in ((member, "member"), (patent, "patent"), (other, "other")))
    return a.join(b, "k").join(c, "k")


# -- trees, cache, audit, checks -----------------------------------------------------------------


@query("""WITH l AS (SELECT conv_id, turn, conv_id || '-' || lpad(turn::VARCHAR, 4, '0') AS id, (conv_id // 10)::VARCHAR AS source, turn % 3 AS c FROM conversations), g AS (SELECT source, c, string_agg(id, ',' ORDER BY id) AS ids, count(*) AS n, list(id ORDER BY id)[1:10] AS ten FROM l GROUP BY ALL)
SELECT source, sha256('1|' || ids) AS id, n AS n_children, len(ten) AS n_texts, array_to_string(ten, ' ') AS text, 'summary' AS node_type, 1 AS level FROM g UNION ALL SELECT source, id, 0, 1, id, 'leaf', 0 FROM l""")
def summary_level(spark, sf_dir):
    """The first level of a tree over all turns, clustered by a given function."""
    leaves = table(spark, sf_dir, "conversations").select(F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.lpad(F.col("turn").cast("string"), 4, "0")).alias("id"), F.floor(F.col("conv_id") / 10).cast("string").alias("source_doc_id"))
    leaves = leaves.withColumn("text", F.col("id"))
    by = lambda df: df.withColumn("cluster", F.split_part("id", F.lit("-"), F.lit(2)).cast("int") % 3)
    t = tree.build(leaves, lambda df: df, lambda texts: F.array_join(texts, " "), levels=1, clusterer=by)
    n = F.when(F.col("node_type") == "summary", F.least(F.size("child_ids"), F.lit(tree.TEXTS_PER_SUMMARY))).otherwise(1)
    return t.select(F.col("source_doc_id").alias("source"), "id", F.coalesce(F.size("child_ids"), F.lit(0)).cast("long").alias("n_children"), n.cast("long").alias("n_texts"), "text", "node_type", "level").withColumn("n_children", F.greatest("n_children", F.lit(0)))


@query("""SELECT vec_id // 40 AS source, count(*) AS n, least(10, greatest(1, count(*) // 2)) AS clusters_at_most, true AS within, count(*) >= 4 AS fitted FROM embeddings GROUP BY 1""")
def mixture_clusters(spark, sf_dir):
    """T01, A18 with the default clusterer: a mixture of whole vectors for every source of forty. What the mixture's numbers
    are is held against NumPy in the tests; here, that every vector has one of its source's clusters."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.floor(F.col("vec_id") / 40).alias("source_doc_id"))
    c = tree.cluster(e)
    most = F.least(F.lit(10), F.greatest(F.lit(1), F.floor(F.count("*") / 2))).cast("long")
    return c.groupBy(F.col("source_doc_id").alias("source")).agg(F.count("*").alias("n"), most.alias("clusters_at_most"), ((F.min("cluster") >= 0) & (F.max("cluster") < most)).alias("within"), F.max("log_likelihood").isNotNull().alias("fitted"))


@query("""WITH e AS (SELECT md5(props) AS key, max(event_id) AS answer, max(ts) AS seen, max(user_id % 4) AS v FROM events WHERE event_type = 'view' GROUP BY 1), live AS (SELECT * FROM e WHERE seen + INTERVAL 14 DAY > (SELECT max(ts) FROM events) AND v >= 2),
p AS (SELECT md5(props) AS key, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1) SELECT key, answer, coalesce(n, 0)::BIGINT AS hit_count FROM live LEFT JOIN p USING (key)""")
def cache_lifecycle(spark, sf_dir):
    """Entries that have not expired and are of the current version, with their hits counted."""
    e = table(spark, sf_dir, "events").withColumn("key", F.md5(F.col("props").cast("binary")))
    entries = e.where("event_type = 'view'").groupBy("key").agg(F.max("event_id").alias("answer"), F.max("ts").alias("at"), F.max(F.col("user_id") % 4).alias("doc_version"))
    last = e.agg(F.max("ts").alias("now"))  # one row
    entries = entries.withColumn("expires_at", F.col("at") + F.expr("INTERVAL 14 DAYS")).withColumn("hit_count", F.lit(0).cast("long"))
    live = cache.live(entries.crossJoin(F.broadcast(last)), F.col("now"), F.lit(2))
    hits = cache.exact(live, e.where("event_type <> 'view'").select("key")).where("hit")
    return cache.counted(live, hits).select("key", "answer", "hit_count")


@query(f"""WITH {_Q}, r AS (SELECT *, {_routes()} AS route FROM w) SELECT conv_id, turn FROM r WHERE route NOT IN ('contradiction', 'graph', 'multi_hop') AND NOT {contains_any('low', fixed.RECENCY)}""")
def cache_gate(spark, sf_dir):
    """Turns whose answers may be kept."""
    q = questions_of(spark, sf_dir).withColumn("route", planner.route_hint(F.col("q"))).withColumnRenamed("q", "question")
    return cache.storable(q).select("conv_id", "turn")


@query("""SELECT p.vec_id AS probe_id, 'k' || p.vec_id AS key, 'a' || c.vec_id AS answer, c.vec_id % 3 AS doc_version FROM (SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0) p JOIN embeddings c ON c.vec_id = p.vec_id + 1""")
def cache_promotion(spark, sf_dir):
    """What a similar entry answered becomes an exact entry of its own."""
    e = table(spark, sf_dir, "embeddings").select("vec_id")
    probes = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("probe_id"), F.concat(F.lit("k"), F.col("vec_id").cast("string")).alias("key"), F.col("vec_id").cast("string").alias("question"))
    entries = e.select(F.col("vec_id").alias("entry_id"), F.concat(F.lit("a"), F.col("vec_id").cast("string")).alias("answer"), F.lit("s").alias("source_filter"), (F.col("vec_id") % 3).alias("doc_version"), F.lit(None).cast("timestamp").alias("expires_at"))
    got = cache.promoted(probes.select("probe_id", (F.col("probe_id") + 1).alias("entry_id")), probes, entries)
    return got.select(F.col("question").cast("long").alias("probe_id"), "key", "answer", "doc_version")


_CONTEXT = "CASE turn % 3 WHEN 0 THEN '[Document ' || turn || '] Head ' || role || chr(10) || text WHEN 1 THEN '[Document 1] x' || chr(10) || 'URL: http://a/' || role || ' z' ELSE role END"


@query(f"""WITH c AS (SELECT conv_id, turn, {_CONTEXT} AS c, 'n' || conv_id || ' -> n' || turn AS path FROM conversations), t AS (SELECT *, regexp_replace(c, '^\\[Document \\d+\\]\\s*', '') AS t FROM c)
SELECT conv_id, turn, CASE WHEN regexp_matches(t, '(?m)^URL:\\s*\\S') THEN regexp_extract(t, '(?m)^URL:\\s*(\\S+)', 1) ELSE string_split(t, chr(10))[1] || '|' || left({spaced("regexp_replace(t, '^[^\\n]*\\n?', '')")}, 180) END AS source, path, CASE turn % 4 WHEN 0 THEN 0.85 WHEN 1 THEN 0.90 WHEN 2 THEN 0.60 END::DOUBLE AS confidence FROM t""")
def audit_records(spark, sf_dir):
    """Audit rows with the identity of each context."""
    t, r = F.col("turn"), F.col("role")
    context = F.when(t % 3 == 0, F.concat(F.lit("[Document "), t.cast("string"), F.lit("] Head "), r, F.lit("\n"), "text")).when(t % 3 == 1, F.concat(F.lit("[Document 1] x\nURL: http://a/"), r, F.lit(" z"))).otherwise(r)
    said = F.when(t % 4 == 1, "yes").when(t % 4 == 2, "yes")
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), t.cast("string")).alias("query_id"), F.lit(None).cast("timestamp").alias("timestamp"), F.lit("a").alias("tenant_id"), F.lit("u").alias("user_id"), F.lit("q").alias("question"), F.lit("sql").alias("route"), F.array(context).alias("contexts"),
                                                     F.array(F.array(F.concat(F.lit("n"), F.col("conv_id").cast("string")), F.concat(F.lit("n"), t.cast("string")))).alias("graph_paths"), (t % 4 == 0).alias("cache_hit"), said.alias("grounded"), F.when(t % 4 == 1, "yes").alias("useful"), F.lit(1).alias("latency_ms"))
    a = audit.record(c)
    key = lambda i: F.split_part("query_id", F.lit("/"), F.lit(i)).cast("long")
    return a.select(key(1).alias("conv_id"), key(2).alias("turn"), F.get("sources_retrieved", F.lit(0)).alias("source"), F.get("graph_paths_traversed", F.lit(0)).alias("path"), "confidence")


@query("SELECT event_type AS route, count(*) AS n FROM events WHERE event_type = 'click' AND (user_id % 10) / 10.0 < 0.6 GROUP BY 1")
def audit_store(spark, sf_dir):
    """Audit rows kept by day, and the doubtful ones of a route."""
    path = folder(spark, "audit")
    e = table(spark, sf_dir, "events").select(F.col("ts").alias("timestamp"), F.when(F.col("event_type") == "click", "contradiction").otherwise("sql").alias("route"), ((F.col("user_id") % 10) / 10.0).alias("confidence"), "event_type")
    audit.append(e, path)
    return audit.doubtful(spark.read.parquet(path)).groupBy(F.col("event_type").alias("route")).agg(F.count("*").alias("n"))


_WANTED = ("The", "que", "zzzz none")


@query(f"""WITH s AS (SELECT source, bool_or(contains(lower(text), 'the')) AS a, bool_or(contains(lower(text), 'que')) AS b FROM documents GROUP BY source), m AS (SELECT source, unnest(list_filter([CASE WHEN NOT a THEN 'The' END, CASE WHEN NOT b THEN 'que' END, 'zzzz none'], lambda x: x IS NOT NULL)) AS section FROM s)
SELECT 'section' AS finding, source, section AS what, NULL::BIGINT AS n FROM m UNION ALL SELECT 'coverage', 'all', count(DISTINCT nullif(source, ''))::VARCHAR, count(*) FROM documents
UNION ALL SELECT 'tag', lang, t, NULL FROM (SELECT lang, unnest(list_filter(['us-gaap:Revenue', 'us-gaap:NetIncomeLoss', 'us-gaap:Assets'], lambda x: NOT list_contains(h, x))) AS t FROM (SELECT lang, list(CASE WHEN doc_id % 2 = 0 THEN 'us-gaap:Assets' WHEN source = 'src1' THEN 'us-gaap:Revenue' END) AS h FROM documents GROUP BY lang))
UNION ALL SELECT 'context', lang, 'none', count(*) FROM documents WHERE doc_id % 3 = 0 GROUP BY lang""")
def data_checks(spark, sf_dir):
    """What a corpus lacks."""
    d, none = table(spark, sf_dir, "documents"), F.lit(None).cast("long")
    tag = F.when(F.col("doc_id") % 2 == 0, "us-gaap:Assets").when(F.col("source") == "src1", "us-gaap:Revenue")
    facts = d.select(F.col("lang").alias("source"), F.lit(None).cast("string").alias("name"), tag.alias("tag"), F.when(F.col("doc_id") % 3 != 0, "c").alias("context"))
    parts = [
        validation.missing_sections(d.select("source", "text"), _WANTED).select(F.lit("section").alias("finding"), "source", F.col("section").alias("what"), none.alias("n")),
        validation.coverage(d).select(F.lit("coverage"), F.lit("all"), F.col("sources").cast("string"), "entries"),
        validation.missing_tags(facts).select(F.lit("tag"), "source", "tag", none),
        validation.without_context(facts).groupBy("source").agg(F.count("*").alias("n")).select(F.lit("context"), "source", F.lit("none"), "n"),
    ]
    return reduce(DataFrame.union, parts)


@query("SELECT page_id, len(regexp_extract_all(html, '(?i)<li[ >]'))::BIGINT AS in_html, (page_id % 3)::BIGINT AS parsed FROM pages")
def table_counts(spark, sf_dir):
    """Tables in the HTML (list items stand for them) and parsed ones, per page."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("source"), F.regexp_replace("html", "(?i)<li([ >])", "<table$1").alias("html"))
    parsed = p.select("source", F.explode(F.array_repeat(F.lit(1), (F.col("source") % 3).cast("int"))).alias("x"))
    return validation.table_counts(p, parsed).select(F.col("source").alias("page_id"), "in_html", F.col("parsed").cast("long").alias("parsed"))


@query("SELECT arg_max(user_id, struct_pack(t := t, u := user_id))::VARCHAR AS run_id FROM (SELECT user_id, max(ts) AS t FROM events GROUP BY 1)")
def latest_run(spark, sf_dir):
    """The run that was completed last."""
    runs = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("completed_at")).select(F.col("user_id").alias("run_id"), "completed_at")
    return evaluation.latest_run(runs).select(F.col("run_id").cast("string").alias("run_id"))


_SWEEP = "[" + ", ".join(f"struct_pack(m := {quoted(m)}, a := {quoted(a)}, b := {quoted(b)})" for m, a, b in fixed.SWEEP) + "]"


@query(f"""WITH c AS (SELECT 'N ' || n_nationkey AS company, (2020 + n_regionkey)::INTEGER AS y, CASE n_nationkey % 5 WHEN 4 THEN 'FY' ELSE 'Q' || (n_nationkey % 5 + 1) END AS q, unnest({_SWEEP}) AS s FROM nation)
SELECT company, y AS fiscal_year, q AS quarter, s.m AS metric, CASE q WHEN 'Q1' THEN make_date(y, 1, 1) WHEN 'Q2' THEN make_date(y, 4, 1) WHEN 'FY' THEN make_date(y, 1, 1) ELSE make_date(y, 7, 1) END AS period_start, CASE q WHEN 'Q1' THEN make_date(y, 3, 31) WHEN 'Q2' THEN make_date(y, 6, 30) WHEN 'Q3' THEN make_date(y, 9, 30) WHEN 'Q4' THEN make_date(y + 1, 1, 31) ELSE make_date(y + 1, 3, 31) END AS period_end,
replace(replace(s.a, '{{company}}', company), '{{period}}', 'fiscal ' || q || ' ' || y) AS figure_question, replace(replace(s.b, '{{company}}', company), '{{period}}', 'fiscal ' || q || ' ' || y) AS statement_question FROM c""")
def sweep_questions(spark, sf_dir):
    """Both questions of every metric for every company."""
    n = F.col("n_nationkey")
    c = table(spark, sf_dir, "nation").select(F.concat(F.lit("N "), n.cast("string")).alias("company"), (2020 + F.col("n_regionkey")).cast("int").alias("fiscal_year"), F.when(n % 5 == 4, "FY").otherwise(F.concat(F.lit("Q"), (n % 5 + 1).cast("string"))).alias("quarter"))
    return contradiction.questions(c).select("company", "fiscal_year", "quarter", "metric", "period_start", "period_end", "figure_question", "statement_question")


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN (o_orderkey % 11)::INTEGER ELSE 0 END AS score, CASE o_orderkey % 3 WHEN 0 THEN 'high' ELSE 'low' END AS severity, CASE o_orderkey % 3 WHEN 0 THEN 'e' || o_custkey WHEN 1 THEN 'not json ' || o_custkey ELSE '' END AS explanation, CASE WHEN o_orderkey % 2 = 0 THEN 'Axis' ELSE 'x:o' END AS dimension, 'm' || o_custkey AS member FROM orders""")
def parsed_answers(spark, sf_dir):
    """a model's JSON answers, some unreadable, and the first segment of a fact."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    answer = F.when(k % 3 == 0, F.concat(F.lit('```json\n{"contradiction_score": '), (k % 11).cast("string"), F.lit(', "severity": "high", "explanation": "e'), c, F.lit('"}\n```'))).when(k % 3 == 1, F.concat(F.lit("not json "), c)).otherwise(F.lit("{}"))
    got = evidence.parsed_score(answer)
    segments = F.array(F.struct(F.when(k % 2 == 0, "x:axis").otherwise("x:o").alias("dimension"), F.concat(F.lit("m"), c).alias("value")), F.struct(F.lit("z").alias("dimension"), F.lit("z").alias("value")))
    dimension, member = evidence.first_segment(segments, {"x:axis": "Axis"})
    shown = F.when(got["explanation"] == "{}", "").otherwise(got["explanation"])
    return table(spark, sf_dir, "orders").select("o_orderkey", got["contradiction_score"].alias("score"), got["severity"].alias("severity"), shown.alias("explanation"), dimension.alias("dimension"), member.alias("member"))
