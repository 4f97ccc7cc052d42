"""Scans of filings, facts, patents and other corpora. Schemas are stated; dates, quotes and missing columns are
read as the sources write them. Splitting large files is Spark's work, so nothing here reads in chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import numeric, text
from ..operators import relational, substrings


def tsv(spark: SparkSession, path: str, schema: str, dates: str = "yyyyMMdd") -> DataFrame:  # S01, S05
    return spark.read.csv(path, schema=schema, sep="\t", header=True, dateFormat=dates, enforceSchema=False, mode="PERMISSIVE")


def _present(spark: SparkSession, path: str, wanted: dict[str, str], renames: dict[str, str], dates: str) -> DataFrame:
    """The wanted columns (name: type) of a file whose header may lack or add some."""
    raw = spark.read.csv(path, sep="\t", header=True, inferSchema=False)
    back = {v: k for k, v in renames.items()}

    def one(name: str, kind: str) -> Column:
        source = back.get(name, name)
        if source not in raw.columns:
            return F.lit(None).cast(kind).alias(name)
        c = F.col(source)
        return (F.to_date(F.try_to_timestamp(c, F.lit(dates))) if kind == "date" else c.try_cast(kind)).alias(name)

    return raw.select(*(one(n, k) for n, k in wanted.items()))


def _columns(ddl: str) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in schemas.struct(ddl)}


def filings(spark: SparkSession, path: str) -> DataFrame:  # S02
    return _present(spark, path, _columns(schemas.FILINGS), {"fy": "fiscal_year", "fp": "fiscal_period"}, "yyyyMMdd")


def facts(spark: SparkSession, path: str) -> DataFrame:  # S03
    return _present(spark, path, _columns(schemas.FACTS), {}, "yyyyMMdd")


def facts_of(facts_: DataFrame, filings_: DataFrame, ciks: list[int] | DataFrame) -> tuple[DataFrame, DataFrame]:  # P01, J04
    """Filings of some companies (a few, or a table with ``cik``), and the facts of those filings."""
    kept = relational.semi(filings_, ciks, "cik") if isinstance(ciks, DataFrame) else filings_.where(F.col("cik").isin(*ciks))
    return kept, relational.semi(facts_, kept.select("adsh"), "adsh")


def patents(spark: SparkSession, folder: str, assignee: str, start: str | None = None, end: str | None = None) -> dict[str, DataFrame]:  # S05, S06, P02, P03
    """The four bulk files, cut down to an assignee's patents in a span of days: semi-joins that the scan's
    filters and Bloom filters follow."""
    t = {n: tsv(spark, f"{folder}/{n}.tsv", s, "yyyy-MM-dd") for n, s in schemas.BULK.items()}
    owned = t["g_assignee"].where(F.col("assignee_id") == assignee)
    p = relational.semi(t["g_patent"], owned.select("patent_id"), "patent_id")
    if start:
        p = p.where(F.col("patent_date") >= F.lit(start).cast("date"))
    if end:
        p = p.where(F.col("patent_date") <= F.lit(end).cast("date"))
    ids = p.select("patent_id")
    return {"patents": p, "assignees": relational.semi(owned, ids, "patent_id"), "cpc": relational.semi(t["g_cpc"], ids, "patent_id"), "claims": relational.semi(t["g_claims"], ids, "patent_id")}


def merged_patents(t: dict[str, DataFrame]) -> DataFrame:  # A01, A02, J03
    """One row per patent: its first assignee, and its classes as a sorted set."""
    who = relational.keep_first(t["assignees"].select("patent_id", "disambig_assignee_organization"), ["patent_id"], ["disambig_assignee_organization"])
    cpc = t["cpc"].where("cpc_group is not null").groupBy("patent_id").agg(F.array_sort(F.collect_set("cpc_group")).alias("cpc_codes"))
    return t["patents"].join(who, "patent_id", "left").join(cpc, "patent_id", "left").withColumnRenamed("disambig_assignee_organization", "assignee_organization")


def independent_claims(claims: DataFrame) -> DataFrame:  # P14, K06
    """Claims that depend on none, with text; line ends become spaces. Null texts go."""
    depends = F.col("dependent").try_cast("double")
    return claims.where((F.col("dependent").isNull() | (depends == 0)) & (F.trim(F.coalesce("claim_text", F.lit(""))) != "")).withColumn("claim_text", F.regexp_replace("claim_text", r"[\r\n]+", " ")).withColumn("is_independent", F.lit(True))


def patent_csv(spark: SparkSession, path: str) -> DataFrame:  # S07
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:  # S08
    """A JSON file that holds a list or a single object."""
    return spark.read.json(path, schema=schema, multiLine=True, mode="PERMISSIVE")


def html_files(spark: SparkSession, folder: str) -> DataFrame:  # S09
    return spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.input_file_name(), "[^/]+$", 0).alias("file"), F.col("value").alias("html"))


def submissions(rows: DataFrame) -> DataFrame:  # S10
    """Parallel arrays as rows, with the year of the report, else of the filing."""
    r = "filings.recent"
    zipped = F.arrays_zip(*(F.col(f"{r}.{c}").alias(c) for c in ("accessionNumber", "filingDate", "reportDate", "form", "items", "primaryDocument")))
    out = rows.select(F.lpad(F.col("cik").cast("string"), 10, "0").alias("cik"), "name", F.posexplode(zipped).alias("pos", "f")).select("cik", "name", "pos", "f.*")
    return out.withColumn("year", text.filing_year(F.nullif("reportDate", F.lit("")), F.col("filingDate"), F.lit(None)))


def earnings_releases(subs: DataFrame, start: str, end: str) -> DataFrame:  # S11
    return subs.where((F.col("form") == "8-K") & F.col("items").contains("2.02") & F.col("filingDate").between(start, end))


def annual(subs: DataFrame, form: str, first: int = 2021, last: int = 2025) -> DataFrame:  # P04
    return subs.where((F.col("form") == form) & F.col("year").between(first, last))


def tickers(rows: DataFrame) -> DataFrame:  # S12
    return rows.withColumn("cik", F.lpad(F.col("cik").cast("string"), 10, "0"))


def resolved(names: DataFrame, companies: DataFrame) -> DataFrame:  # J09
    """Each name with one company: equal ticker, else equal normalised name, else a name that contains it;
    the smallest ticker among equals. names: name; companies: ticker, title. Parts of names are found by trigrams."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", ""))
    n = names.select("name", plain(F.col("name")).alias("_n")).distinct()
    c = companies.select("ticker", "title", plain(F.col("title")).alias("_t"), F.lower("ticker").alias("_k"))
    exact = n.join(c, n["_n"] == c["_k"]).select("name", "ticker", "title", F.lit(1).alias("by")).unionByName(n.join(c, n["_n"] == c["_t"]).select("name", "ticker", "title", F.lit(2).alias("by")))
    rest = n.join(exact.select("name").distinct(), "name", "left_anti")
    parts = substrings.containing(rest, c, "_n", "_t").withColumnsRenamed({"pattern": "_n", "text": "_t"})
    within = rest.join(parts, "_n").join(c, "_t").select("name", "ticker", "title", F.lit(3).alias("by"))
    return relational.keep_first(exact.unionByName(within), ["name"], ["by", "ticker", "title"])


def exhibit_21(index: DataFrame) -> DataFrame:  # S14
    """The first file of an index whose type begins with EX-21."""
    hit = F.filter("directory.item", lambda x: F.upper(x["type"]).startswith("EX-21"))
    return index.withColumn("exhibit", F.get(hit, F.lit(0))["name"])


def cleaned_facts(raw: DataFrame, focus: Column | None = None) -> DataFrame:  # P13, A03, M01-M03, F35
    """Facts of a filing that are numbers or text of a period: text blocks, empty values, us-gaap facts that are
    no numbers, and facts without a period fall away; the first of each tag, context and period stays.
    raw: source, pos, tag, value, unit, context, start_date, end_date, instant."""
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    number = numeric.number_or_null(F.col("value"))
    f = raw.withColumn("value_num", number)
    f = f.where(~F.coalesce(F.col("tag").contains("TextBlock"), F.lit(False)) & F.col("value").isNotNull() & (~F.coalesce(F.col("tag").startswith("us-gaap:"), F.lit(False)) | F.col("value_num").isNotNull()) & (some("instant") | (some("start_date") & some("end_date"))))
    f = relational.keep_first(f, ["source", "tag", "context", "start_date", "end_date", "instant"], ["pos"])
    day = lambda c: F.col(c).try_cast("date")
    label = numeric.period_label(day("start_date"), day("end_date"), focus)
    return f.withColumns({"unit": numeric.unit_or_default(F.col("tag"), F.col("unit")), "period_type": numeric.period_type(day("start_date"), day("end_date")), "period_label": label, "fiscal_quarter": numeric.fiscal_quarter(label)})


def joined_claims(patents_: DataFrame, claims: DataFrame, company: str | None = None) -> DataFrame:  # J01, S16, O05, P05
    """Claims with their patent, newest patents first (undated ones before them)."""
    p = patents_ if company is None else patents_.where(F.col("assignee_organization").ilike(f"%{company}%"))
    return claims.join(p, "patent_id").orderBy(F.desc_nulls_first("grant_date"), "patent_id", "claim_number")
