"""Text functions as Column expressions; everything runs inside code generation on the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

#: Unicode white space, trimmed and collapsed.
_SPACES = r"(?U)[\s ]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_match(c: Column | str, patterns: Iterable[str]) -> Column:
    """Whether one of the patterns matches, upper or lower case: one alternation, one pass."""
    return _col(c).rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def any_in(c: Column | str, words: Iterable[str]) -> Column:
    """Whether one of the words is a substring."""
    return _col(c).rlike("|".join(r"\Q" + w + r"\E" for w in words))


#: ASCII capitals and their small forms: what counts as one letter is decided before lower-casing.
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokens(c: Column | str) -> Column:  # F01
    return F.regexp_extract_all(F.translate(_col(c), _CAPITALS, _SMALL), F.lit("[a-z0-9]+"), F.lit(0))


def lowered_tokens(c: Column | str) -> Column:
    """Tokens of the lower-cased text, in which other signs may have become letters of ASCII."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit("[a-z0-9]+"), F.lit(0))


def normalize_whitespace(c: Column | str) -> Column:  # F02
    return F.regexp_replace(F.regexp_replace(F.coalesce(_col(c).cast("string"), F.lit("")), _SPACES, " "), "^ | $", "")


def words_of(c: Column | str, sign: str) -> Column:
    """What stands between white space, without ``sign`` (a class of characters) at its end, in one pass; empty ones too."""
    return F.split(_col(c), sign + "*+(?:" + _SPACES + r"|\z)")


def word_count(c: Column | str) -> Column:  # F03
    t = normalize_whitespace(c)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " "))).cast("long")


def is_item_heading(c: Column | str) -> Column:  # F04
    return any_match(normalize_whitespace(c), (fixed.ITEM_HEADING,))


def is_date_heading(c: Column | str) -> Column:  # F05
    return any_match(normalize_whitespace(c), fixed.DATE_HEADINGS)


def is_table_label(c: Column | str) -> Column:  # F06
    return any_match(normalize_whitespace(c), fixed.TABLE_LABELS)


def is_bad_subsection(c: Column | str) -> Column:  # F07
    t = normalize_whitespace(c)
    return (t == "") | is_date_heading(t) | is_table_label(t) | t.rlike(r"^\d+(\.\d+)?$") | ((word_count(t) == 1) & (F.length(t) < 8))


def is_meaningful_subsection(c: Column | str) -> Column:  # F07
    t = normalize_whitespace(c)
    return ~is_bad_subsection(t) & ~t.endswith(".") & word_count(t).between(1, 12) & (F.length(t) <= 120)


def is_page_footer(c: Column | str, company: Column | None = None, form: Column | None = None) -> Column:  # F09
    t = normalize_whitespace(c)
    found = any_match(t, fixed.PAGE_FOOTERS)
    if company is None:
        return found
    quoted = lambda x: F.concat(F.lit(r"\Q"), x, F.lit(r"\E"))
    name = F.trim(F.coalesce(company, F.lit("")))
    kind = F.upper(F.trim(F.coalesce(form if form is not None else F.lit(None).cast("string"), F.lit(""))))
    own = F.concat(F.lit("(?i)^"), quoted(name), F.lit(r"\s*\|\s*.*Form\s+"), F.when(kind != "", quoted(kind)).otherwise(F.lit("10-[QK]")), F.lit(r"\s*\|\s*\d+$"))
    return found | ((name != "") & F.regexp_like(t, own))


def is_image_caption(c: Column | str) -> Column:  # F10
    return any_match(c, (fixed.IMAGE_NAME,))


def is_checkbox_line(c: Column | str) -> Column:  # F10
    return any_in(c, fixed.CHECKBOXES)


def is_page_number(c: Column | str) -> Column:  # F10
    return normalize_whitespace(c).rlike(r"^\d{1,3}$")


def is_boilerplate(c: Column | str) -> Column:  # F11
    return any_match(c, fixed.BOILERPLATE)


def is_section_heading(c: Column | str, real_dash: bool = False) -> Column:  # F12
    t = normalize_whitespace(c)
    letters = F.regexp_replace(t, "[^A-Za-z]", "")
    capitals = (F.length(letters) > 6) & (F.upper(t) == t) & (F.length(t) < 120)
    patterns = fixed.SECTION_HEADINGS + ((r"^Note\s+\d+\s*–\s+.+",) if real_dash else ())
    return ~t.isin(*fixed.BAD_HEADINGS) & (any_match(t, patterns) | capitals)


def classify_heading(c: Column | str) -> Column:  # F13
    t = normalize_whitespace(c)
    return F.when(is_item_heading(t), "item").when(any_match(t, (fixed.PART_HEADING,)), "part").when(any_match(t, (fixed.NOTE_HEADING,)), "note").otherwise("subsection")


def normalize_heading(c: Column | str) -> Column:  # F14
    return normalize_whitespace(F.regexp_replace(_col(c), r"\s*\(\d+\)(\(\d+\))*\s*$", ""))


def is_bad_title(c: Column | str) -> Column:  # F14
    t = normalize_whitespace(c)
    return (t == "") | t.isin(*fixed.BAD_TITLES) | is_date_heading(t)


def subsection_title(c: Column | str) -> Column:  # F14
    """The cleaned and renamed title, or null if it is none."""
    t = normalize_heading(c)
    t = F.when(~is_bad_title(t), replace_by(t, fixed.TITLE_NAMES))
    return F.when(~is_bad_title(t), t)


def replace_by(c: Column | str, names: Mapping[str, str]) -> Column:  # J07
    """The value's entry in a table of fixed names, else the value itself."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _col(c)), _col(c))


def chunk_text(part: Column, item: Column, note: Column, subsection: Column, body: Column) -> Column:  # F17
    """Titles line by line, a blank line, and the body; without titles, the body alone."""
    named = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{n}: "), c)) for n, c in (("Part", part), ("Item", item), ("Note", note), ("Subsection", subsection))]
    head = F.concat_ws("\n", *named)
    return F.when(head == "", body).otherwise(F.concat(head, F.lit("\n\n"), body))


def claim_id(patent: Column, number: Column) -> Column:  # F18
    return F.concat(patent, F.lit("_claim_"), number.cast("string"))


def claim_text(title: Column, number: Column, text: Column) -> Column:  # F18
    return F.concat(F.lit("Patent: "), F.coalesce(title, F.lit("")), F.lit("\nClaim "), number.cast("string"), F.lit(": "), text)


def board_name(c: Column | str) -> Column:  # F21
    """Without the longest role at its end; empty if there is nothing else."""
    t = normalize_whitespace(c)
    roles = "|".join(sorted(fixed.ROLES, key=len, reverse=True))
    return F.when(t.rlike(f"(?i)^(?:{roles})$"), "").otherwise(normalize_whitespace(F.regexp_replace(t, f"(?i) (?:{roles})$", "")))


def slug(c: Column | str, word: bool = False) -> Column:  # F22
    """Lower case, other characters as single underscores; word: letters of any script stay."""
    t = F.lower(F.coalesce(_col(c), F.lit("")))
    t = F.regexp_replace(t, r"(?U)\W+" if word else "[^a-z0-9]+", "_")
    return F.regexp_replace(F.regexp_replace(t, "_+", "_"), "^_|_$", "")


def person_id(ticker: Column, name: Column) -> Column:
    return F.concat(F.upper(ticker), F.lit("_"), slug(name))


def subsidiary_id(ticker: Column, name: Column) -> Column:
    return F.concat(F.upper(ticker), F.lit("_"), slug(name, word=True))


def filing_id(ticker: Column, form: Column, year: Column) -> Column:  # F23
    return F.concat_ws("_", F.upper(ticker), form, year.cast("string"))


def filing_year(report: Column, filed: Column, year: Column) -> Column:  # F23
    lead = lambda c: F.nullif(F.regexp_extract(F.coalesce(c.cast("string"), F.lit("")), r"^(\d{4})", 1), F.lit(""))
    return F.coalesce(lead(report), lead(filed), year.cast("string")).cast("int")


def cpc_codes(c: Column | str) -> Column:  # F24
    """``{a,b}`` as an array; quotes and blanks around codes go."""
    inner = F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"^\s*\{*|\}*\s*$", "")
    return F.filter(F.transform(F.split(inner, ","), lambda x: F.regexp_replace(x, "^[\\s\"']+|[\\s\"']+$", "")), lambda x: x != "")


def cpc_prefixes(codes: Column) -> Column:  # F24
    return F.array_sort(F.array_distinct(F.transform(F.filter(codes, lambda x: (F.length(x) >= 3) & ~F.upper(F.substring(x, 1, 1)).isin(*fixed.CPC_SKIPPED)), lambda x: F.substring(x, 1, 3))))


def cpc_label(prefix: Column) -> Column:
    pairs = [F.lit(x) for kv in fixed.CPC_LABELS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), prefix), F.concat(F.lit("Other ("), prefix, F.lit(")")))


def is_page_stamp(c: Column | str) -> Column:  # F25
    return normalize_whitespace(c).rlike(fixed.PAGE_STAMP)


def is_title_block(c: Column | str) -> Column:  # F25
    t = normalize_whitespace(c)
    words = F.regexp_extract_all(t, F.lit(r"(?U)\b[\w&/-]+\b"), F.lit(0))
    lettered = F.filter(words, lambda w: w.rlike(r"\p{L}"))
    proper = (F.size(words) <= 10) & (F.size(lettered) > 0) & F.forall(lettered, lambda w: F.substring(w, 1, 1).rlike(r"\p{Lu}") | (F.upper(w) == w) & (F.lower(w) != w))
    shaped = (t != "") & ~is_page_stamp(t) & (F.length(t) <= 80) & ~t.rlike("[.,!?;:]$")
    return shaped & (t.rlike("(?i)" + fixed.ITEM_TITLE) | proper)


def trailing_number(c: Column | str) -> Column:  # F26
    return F.expr("try_cast(nullif(regexp_extract({0}, '(\\\\d+)$', 1), '') as int)".format(c if isinstance(c, str) else "self_ref"))


def legal_name(c: Column | str) -> Column:  # F27
    """The first capitalised name that ends with a legal suffix, or null."""
    ends = "|".join(s.replace(".", r"\.") for s in fixed.LEGAL_SUFFIXES)
    return F.nullif(F.regexp_extract(_col(c), rf"([A-Z][A-Za-z0-9&.,'-]*(?:\s+[A-Z][A-Za-z0-9&.,'-]*)*\s+(?:{ends}))", 1), F.lit(""))


def strip_fence(c: Column | str) -> Column:  # F28
    """What stands between Markdown fences, else the text, trimmed; a closing semicolon goes."""
    t = _col(c)
    inner = F.regexp_extract(t, r"(?s)```(?:[A-Za-z]+)?\s*(.*?)```", 1)
    t = F.regexp_replace(F.when(inner != "", inner).otherwise(t), r"^\s+|\s+$", "")
    return F.regexp_replace(t, r"\s*;$", "")


def context_key(c: Column | str) -> Column:  # F40
    """Identity of a context: without its number, its URL line, or else its first line and 180 characters."""
    t = F.regexp_replace(_col(c), r"^\[Document \d+\]\s*", "")
    url = F.regexp_extract(t, r"(?m)^URL:\s*(\S+)", 1)
    head, body = F.substring_index(t, "\n", 1), F.regexp_replace(t, r"^[^\n]*\n?", "")
    return F.when(url != "", url).otherwise(F.concat(head, F.lit("|"), F.substring(normalize_whitespace(body), 1, 180)))


def rendered_row(*columns: Column) -> Column:  # F41
    return F.concat_ws("\t", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns))


def query_hash(question: Column, scope: Column) -> Column:  # F42
    return F.sha2(F.concat(question, F.lit("|"), scope), 256)


def normalized_query_hash(question: Column) -> Column:  # F42
    return F.sha2(F.lower(normalize_whitespace(question)), 256)


def cache_scope(*named: tuple[str, Column]) -> Column:  # F43, with the tenant in it
    return F.concat_ws("|", *(F.concat(F.lit(f"{n}="), F.coalesce(c.cast("string"), F.lit("any"))) for n, c in named))


def numbers(c: Column | str) -> Column:  # F44
    """Numbers of a text; whole ones from 1900 to 2100 are years and stay out."""
    found = F.transform(F.regexp_extract_all(_col(c), F.lit(fixed.NUMBER), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double"))
    return F.filter(found, lambda x: x.isNotNull() & ~((x == F.floor(x)) & x.between(1900, 2100)))


def ticker(c: Column | str) -> Column:  # F45
    t, out = F.lower(_col(c)), None
    for part, symbol in fixed.TICKERS:
        out = F.when(t.contains(part), symbol) if out is None else out.when(t.contains(part), symbol)
    return out


def clean_question(c: Column | str) -> Column:  # F47
    return F.regexp_replace(normalize_whitespace(c), "[?!.]+$", "")


def source_id(source: Column, filename: Column, ticker_: Column, year: Column, form: Column) -> Column:  # F48
    some = lambda c: F.nullif(F.trim(c.cast("string")), F.lit(""))
    stem = F.regexp_replace(some(filename), r"\.[^.]*$", "")
    return F.coalesce(some(source), stem, F.when(some(ticker_).isNotNull() & some(year).isNotNull() & some(form).isNotNull(), F.concat_ws("_", ticker_, year.cast("string"), form)), F.lit("unknown_document"))


def vector_metadata(fields: Mapping[str, Column], text_limit: int = 35_000, title_limit: int = 500) -> Column:  # F49
    """Fields as a map of strings; nulls drop out, the text and titles are cut."""
    cut = lambda k, c: F.left(c.cast("string"), F.lit(text_limit if k == "text" else title_limit if k.endswith("title") else 1 << 30))
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), cut(k, c).alias("v")) for k, c in fields.items()))
    return F.map_from_entries(F.filter(pairs, lambda x: x["v"].isNotNull()))


def company(c: Column | str, corpus: str) -> Column:  # J08
    """The name under which a corpus stores a company."""
    key = F.trim(F.regexp_replace(F.lower(_col(c)), r"(?U)[^\w\s]", ""))
    pairs = [F.lit(x) for kv in fixed.ALIASES[corpus].items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), _col(c))


def deterministic_id(*columns: Column) -> Column:
    """Content hash in place of a random identifier."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)), 256)
