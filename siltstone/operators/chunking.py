"""Cutting documents into chunks, and which pieces are worth keeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from . import relational

WORDS, OVERLAP, MIN_WORDS = 450, 80, 150
CHARS, CHAR_OVERLAP = 1600, 200


def word_windows(df: DataFrame, key: list[str], column: str = "text", size: int = WORDS, overlap: int = OVERLAP) -> DataFrame:  # F15, W07
    """Windows of ``size`` words that overlap by ``overlap``; the last ends with the text."""
    step = size - overlap
    words = df.select(*key, text.normalize_whitespace(column).alias("_t")).where("_t <> ''").select(*key, F.split("_t", " ").alias("_w"))
    starts = F.when(F.size("_w") <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.ceil((F.size("_w") - size) / step).cast("int") * step, F.lit(step)))
    cut = words.select(*key, "_w", F.posexplode(starts).alias("idx", "start"))
    piece = F.slice("_w", F.col("start") + 1, size)
    return cut.select(*key, F.col("idx").cast("long").alias("idx"), F.col("start").cast("long").alias("start"), F.size(piece).cast("long").alias("n_words"), F.array_join(piece, " ").alias("chunk"))


def packed_paragraphs(df: DataFrame, key: list[str], column: str = "text", sep: str = "\n\n", limit: int = CHARS, overlap: int = CHAR_OVERLAP) -> DataFrame:  # F16
    """Paragraphs joined greedily up to ``limit`` characters; the next chunk begins with the last
    ``overlap`` characters of the one before. A longer paragraph stays whole. A fold within the row."""
    paragraphs = F.filter(F.transform(F.split(F.coalesce(F.col(column), F.lit("")), sep), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("part"), F.lit(0).alias("len"))
    more = len(sep)

    def fold(a: Column, p: Column) -> Column:
        added = F.length(p) + F.when(a["part"].isNull(), 0).otherwise(more)
        full = a["part"].isNotNull() & (a["len"] + added > limit)
        seed = F.right(a["part"], F.lit(overlap))
        return F.struct(
            F.when(full, F.concat(a["done"], F.array(a["part"]))).otherwise(a["done"]).alias("done"),
            F.when(a["part"].isNull(), p).when(full, F.concat(seed, F.lit(sep), p)).otherwise(F.concat(a["part"], F.lit(sep), p)).alias("part"),
            F.when(full, F.length(seed) + added).otherwise(a["len"] + added).cast("int").alias("len"),
        )

    chunks = F.aggregate(paragraphs, start, fold, lambda a: F.when(a["part"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["part"]))))
    cut = df.select(*key, F.posexplode(chunks).alias("idx", "chunk"))
    return cut.withColumn("idx", F.col("idx").cast("long"))


def is_noise(column: Column, label: Column | None = None, layer: Column | None = None, company: Column | None = None, form: Column | None = None) -> Column:  # P10
    t = text.normalize_whitespace(column)
    tiny = (text.word_count(t) <= 1) & ~(text.is_item_heading(t) | t.rlike(r"(?i)^Note\s+\d+"))
    out = (t == "") | text.is_page_footer(t, company, form) | text.is_checkbox_line(t) | text.is_page_number(t) | text.is_boilerplate(t) | tiny
    if layer is not None:
        out = out | (F.coalesce(layer, F.lit("")) == "furniture")
    if label is not None:
        out = out | ((F.coalesce(label, F.lit("")) == "caption") & text.is_image_caption(t))
    return out


def is_low_value(body: Column, content_type: Column, form: Column, item: Column, note: Column, company: Column) -> Column:  # P11
    low, kind = F.lower(body), F.upper(text.normalize_whitespace(form))
    name = F.lower(text.normalize_whitespace(company))
    table = (kind == "8-K") & text.any_in(low, fixed.LOW_VALUE_8K_TABLE)
    starts = low.rlike("^(?:" + "|".join(fixed.LOW_VALUE_STARTS) + ")") | ((name != "") & F.startswith(low, name)) | ((kind != "") & F.startswith(low, F.concat(F.lit("form "), F.lower(kind))))
    return F.when(F.lower(F.coalesce(content_type, F.lit(""))) == "table", table).otherwise((item.isNull() & note.isNull()) | starts)


def is_kept(body: Column, content_type: Column, form: Column, item: Column, note: Column, subsection: Column, headers: Column, rows: Column) -> Column:  # P12
    words, low = text.word_count(body), F.lower(body)
    table = ((F.upper(text.normalize_whitespace(form)) != "8-K") | text.any_in(low, fixed.USEFUL_8K_TABLE)) & ((F.coalesce(F.size(headers), F.lit(0)) > 0) | (F.coalesce(rows, F.lit(0)) > 0) | (words >= 20))
    named = F.lit(False)
    for c in (item, note, subsection):
        named = named | (text.normalize_whitespace(c) != "")
    prose = (words >= 40) & (named | (words >= MIN_WORDS)) & ~F.startswith(F.lower(F.trim(body)), F.lit(fixed.LOW_VALUE_STARTS[0]))
    return F.when(F.lower(F.coalesce(content_type, F.lit(""))) == "table", table).otherwise(prose)


def blocks(lines: DataFrame, group: list[str], order: str, column: str, heading: Column, least: int = 20) -> DataFrame:  # W04
    """Runs of lines between headings, joined; short runs go."""
    numbered = relational.islands(lines.withColumn("_h", heading), group, order, F.col("_h"), "block")
    body = numbered.where(~F.col("_h")).groupBy(*group, "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, column))), lambda x: x[column]), " ").alias("body"))
    return body.withColumn("n_words", text.word_count("body")).where(F.col("n_words") >= least)


def table_rows(cells: DataFrame, group: list[str]) -> DataFrame:  # F19
    """Rows of a table as header-to-value maps. cells: r, c, text. The header is the first of the first
    three rows with enough filled cells; a column without a name is ``col_i``."""
    filled = F.when(text.normalize_whitespace("text") != "", 1).otherwise(0)
    wide = cells.groupBy(*group).agg((F.max("c") + 1).alias("n"))
    per_row = cells.groupBy(*group, "r").agg(F.sum(filled).alias("filled"))
    head = per_row.join(wide, group).where((F.col("r") < 3) & (F.col("filled") >= F.greatest(F.lit(1), F.floor(F.col("n") / 2)))).groupBy(*group).agg(F.min("r").alias("head"))
    placed = cells.join(head, group, "left").withColumn("head", F.coalesce("head", F.lit(-1)))
    names = placed.where("r = head").select(*group, "c", text.normalize_whitespace("text").alias("name"))
    body = placed.where("r > head").join(names, [*group, "c"], "left")
    name = F.when(F.coalesce("name", F.lit("")) == "", F.concat(F.lit("col_"), F.col("c").cast("string"))).otherwise(F.col("name"))
    return body.groupBy(*group, "r").agg(F.array_sort(F.collect_list(F.struct("c", name.alias("name"), text.normalize_whitespace("text").alias("value")))).alias("cells"))


def sections(docling: DataFrame) -> DataFrame:  # G03, W05, W06
    """Sections of parsed filings: body blocks of 50 characters or more with the title block before them;
    contents entries, page stamps and short blocks fall away. A missing or repeated ordinal becomes the
    smallest free one, which is a fold over one filing's few hundred blocks."""
    year = text.filing_year(F.col("report_date"), F.col("filing_date"), F.col("year"))
    rows = docling.select("source", F.upper("ticker").alias("ticker"), "form_type", year.alias("year"), F.posexplode("docling.texts").alias("pos", "b")).where("ticker is not null and form_type is not null and year is not null")
    rows = rows.select("source", "ticker", "form_type", "year", "pos", text.normalize_whitespace("b.text").alias("text"), F.col("b.content_layer").alias("layer"), F.col("b.self_ref").alias("self_ref"), F.coalesce("b.hyperlink", F.lit("")).alias("link"))
    rows = rows.where((F.col("text") != "") & (F.col("layer") == "body") & (F.col("link") == "") & ~text.is_page_stamp("text"))
    is_body, title = F.length("text") >= 50, (F.length("text") < 50) & text.is_title_block("text")
    group = ["source", "ticker", "form_type", "year"]
    rows = rows.where(is_body | title).withColumn("is_body", is_body)
    # a title waits for the next body block; a body block uses it up
    before = Window.partitionBy(*group).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    near = F.last(F.struct("is_body", "text")).over(before)
    rows = rows.withColumn("title", F.when(~near["is_body"], near["text"])).where("is_body").withColumn("ref", text.trailing_number("self_ref"))
    merged = rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("pos", "ref", "title", "text"))).alias("b"))
    free = lambda used: F.array_min(F.array_except(F.sequence(F.lit(1), F.size(used) + 1), used))
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<struct<ordinal:int,title:string,text:string>>").alias("out"))

    def fold(a: Column, x: Column) -> Column:
        n = F.when(x["ref"].isNull() | F.array_contains(a["used"], x["ref"]), free(a["used"])).otherwise(x["ref"])
        return F.struct(F.concat(a["used"], F.array(n)).alias("used"), F.concat(a["out"], F.array(F.struct(n.alias("ordinal"), x["title"].alias("title"), x["text"].alias("text")))).alias("out"))

    out = merged.select(*group, F.explode(F.aggregate("b", start, fold, lambda a: a["out"])).alias("s")).select(*group, "s.*")
    fid = text.filing_id(F.col("ticker"), F.col("form_type"), F.col("year"))
    return out.withColumn("filing_id", fid).withColumn("section_id", F.concat("filing_id", F.lit("_section_"), F.col("ordinal").cast("string")))
