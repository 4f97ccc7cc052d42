"""Registered queries: every operator on the tables that a driver provides, and the same in DuckDB's SQL.

The tables hold no filings, so an operator runs on a table of the same structure. Scores are rounded to six
digits before they are ranked, as sums may be added in another order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric, text
from ..operators import audit, cache, chunking, contradiction, evaluation, graph, relational, retrieval, tree
from ..sources import html as html_source
from ..sources.tables import table
from . import planner

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
BENCH: list[str] = []

TERMS = ("that", "and", "the")
#: Synthetic markers: the texts hold none of the real ones.
MARKERS = {"graph": ("thhe th",), "sql": ("ering", "eau de"), "filings": ("atre",), "transcripts": ("los de",), "patents": ("schein",), "litigation": ("eron", "ueja")}


def query(sql: str | None = None, bench: bool = False) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        if bench:
            BENCH.append(f.__name__)
        return f

    return register


def _first_vector(t: DataFrame) -> DataFrame:
    return t.where("vec_id = 0").select(F.col("embedding").alias("query"))


_COSINE = "round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"


# -- retrieval ---------------------------------------------------------------------------------


def _dense(t: DataFrame, k: int, spec: dict | None = None) -> DataFrame:
    # one question: its vector is one row, broadcast to an exact scan of the filtered vectors
    q = _first_vector(t)
    q = q.select(numeric.unit(F.col("query")).alias("query"))
    scored = t.where(retrieval.metadata_filter(spec)).crossJoin(F.broadcast(q)).select("vec_id", "label", F.round(numeric.dot(numeric.unit(F.col("embedding")), F.col("query")), 6).alias("score"))
    best = scored.orderBy(F.desc("score"), "vec_id").limit(k)
    return relational.top_per(best.withColumn("q", F.lit(0)), ["q"], [F.desc("score"), F.col("vec_id")], k).drop("q")


@query(f"SELECT e.vec_id, e.label, {_COSINE} AS score, row_number() OVER (ORDER BY {_COSINE} DESC, e.vec_id) AS rank FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q QUALIFY rank <= 10", bench=True)
def dense_topk(spark, sf_dir):
    return _dense(table(spark, sf_dir, "embeddings"), 10)


@query(f"SELECT e.vec_id, e.label, {_COSINE} AS score, row_number() OVER (ORDER BY {_COSINE} DESC, e.vec_id) AS rank FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label = 3 QUALIFY rank <= 10")
def dense_topk_filtered(spark, sf_dir):
    return _dense(table(spark, sf_dir, "embeddings"), 10, {"$and": [{"label": {"$eq": 3}}, {"vec_id": {"$gte": 0}}]})


_DATED = "CASE WHEN vec_id % 7 <> 3 THEN (DATE '2024-01-01' + (vec_id % 365)::INTEGER)::VARCHAR END"


@query(f"""SELECT vec_id, score, rank, {_DATED} AS date FROM (SELECT e.vec_id, {_COSINE} AS score, row_number() OVER (ORDER BY {_COSINE} DESC, e.vec_id) AS rank FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q QUALIFY rank <= 50)
WHERE coalesce({_DATED}, '') <= '2024-06-30' AND (vec_id % 2 = 0 OR coalesce({_DATED}, '') >= '2024-02-01')""")
def dense_topk_postfilter(spark, sf_dir):
    """A range of dates after top k: a missing date passes an upper bound and fails a lower one."""
    day = F.when(F.col("vec_id") % 7 != 3, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("vec_id") % 365).cast("int")).cast("string"))
    t = _dense(table(spark, sf_dir, "embeddings"), 50).select("vec_id", "score", "rank", day.alias("date"))
    d = F.col("date")
    return t.where(retrieval.date_filter(d, end="2024-06-30") & ((F.col("vec_id") % 2 == 0) | retrieval.date_filter(d, start="2024-02-01")))


_MANY = """SELECT q.vec_id AS qid, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q"""


@query(f"SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM ({_MANY}) QUALIFY rank <= 5", bench=True)
def dense_many(spark, sf_dir):
    t = table(spark, sf_dir, "embeddings")
    return retrieval.dense_many(t, t.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query")), 5, "vec_id")


_BM25 = """
d AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
bag AS (SELECT doc_id, unnest(regexp_extract_all(t, '[a-z0-9]+')) AS term FROM d),
dl AS (SELECT doc_id, len(regexp_extract_all(t, '[a-z0-9]+')) AS dl FROM d),
s AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM dl),
tf AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM bag GROUP BY ALL),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
idf0 AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, s),
idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idf0) ELSE idf END AS idf FROM idf0),
hit AS (SELECT doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS bm25 FROM tf JOIN idf USING (term) JOIN dl USING (doc_id), s WHERE term IN ('that', 'and', 'the') GROUP BY doc_id),
b AS (SELECT doc_id, coalesce(bm25, 0.0) AS bm25 FROM d LEFT JOIN hit USING (doc_id))"""


def _candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select(F.lit(0).alias("qid"), "doc_id", "text", "n_chars")
    terms = spark.range(1).select(F.lit(0).alias("qid"), F.explode(F.array(*map(F.lit, TERMS))).alias("term"))
    return docs, terms


@query(f"WITH {_BM25} SELECT doc_id, bm25 FROM b", bench=True)
def bm25_rank(spark, sf_dir):
    docs, terms = _candidates(spark, sf_dir)
    return retrieval.bm25(docs, terms, "doc_id").select("doc_id", "bm25")


_RANKS = f"""WITH {_BM25},
dense AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS dr FROM documents),
r AS (SELECT doc_id, dr, row_number() OVER (ORDER BY bm25 DESC, dr) AS lr FROM b JOIN dense USING (doc_id))"""


@query(f"{_RANKS} SELECT doc_id, round(1.0 / (60 + dr) + 1.0 / (60 + lr), 6) AS rrf FROM r")
def rrf_fuse(spark, sf_dir):
    """Both ranks of every document: places in orders of the whole table."""
    docs, terms = _candidates(spark, sf_dir)
    dense = relational.ranked(docs.select("qid", "doc_id", "n_chars"), [F.desc("n_chars"), F.col("doc_id")]).select("qid", "doc_id", "rank")
    lexical = retrieval.bm25(docs, terms, "doc_id").join(dense.withColumnRenamed("rank", "dr"), ["qid", "doc_id"])
    lexical = relational.ranked(lexical, [F.desc("bm25"), F.col("dr")]).select("qid", "doc_id", "rank")
    return retrieval.rrf(dense.unionByName(lexical), "doc_id").select("doc_id", "rrf")


def _ranked(spark: SparkSession, sf_dir: str, k: int | None) -> tuple[DataFrame, DataFrame]:
    """Candidates in dense order, for which the length stands in."""
    docs, terms = _candidates(spark, sf_dir)
    return relational.top_per(docs, ["qid"], [F.desc("n_chars"), F.col("doc_id")], k or 1 << 60), terms


_TOP = " FROM documents QUALIFY row_number() OVER (ORDER BY n_chars DESC, doc_id) <= 50)"
_HYBRID = _RANKS.replace(" FROM documents)", _TOP)
_HYBRID_SQL = f"{_HYBRID} SELECT doc_id, rrf, row_number() OVER (ORDER BY rrf DESC, dr) AS final_rank FROM (SELECT doc_id, dr, round(1.0 / (60 + dr) + 1.0 / (60 + lr), 6) AS rrf FROM r) QUALIFY final_rank <= 10"


@query(_HYBRID_SQL, bench=True)
def hybrid_rrf(spark, sf_dir):
    ranked, terms = _ranked(spark, sf_dir, 50)
    return retrieval.hybrid(ranked, terms, "doc_id", 10).select("doc_id", "rrf", "final_rank")


@query("SELECT doc_id, n FROM (SELECT doc_id, length(text)::BIGINT AS n, sum(length(text)) OVER (PARTITION BY lang ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING) AS s FROM documents) WHERE s <= 12000")
def context_budget(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return relational.budget(d, ["lang"], [F.col("n_chars"), F.col("doc_id")], "text", 12_000).select("doc_id", F.length("text").cast("long").alias("n"))


_ASKED = "text || CASE doc_id % 4 WHEN 0 THEN ' in the 10-K of ' || (1995 + doc_id % 20) || ', then 2031' WHEN 1 THEN ' 10-q x2024 and 20245' WHEN 2 THEN ' (2019) 10-Q/10-k' ELSE '' END"


@query(f"SELECT doc_id, nullif(regexp_extract(t, '\\b(20\\d{{2}})\\b', 1), '') AS year, CASE WHEN contains(upper(t), '10-K') THEN '10-K' WHEN contains(upper(t), '10-Q') THEN '10-Q' END AS form FROM (SELECT doc_id, {_ASKED} AS t FROM documents)")
def year_form_filter(spark, sf_dir):
    d = F.col("doc_id")
    said = F.when(d % 4 == 0, F.concat(F.lit(" in the 10-K of "), (1995 + d % 20).cast("string"), F.lit(", then 2031"))).when(d % 4 == 1, " 10-q x2024 and 20245").when(d % 4 == 2, " (2019) 10-Q/10-k").otherwise("")
    year, form = retrieval.question_filter(F.concat("text", said))
    return table(spark, sf_dir, "documents").select("doc_id", year.cast("string").alias("year"), form.alias("form"))


# -- text --------------------------------------------------------------------------------------

_WS = "trim(regexp_replace(replace(text, chr(160), ' '), '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({_WS}) AS h, CASE WHEN {_WS} = '' THEN 0 ELSE len(string_split({_WS}, ' ')) END::BIGINT AS n_words FROM documents")
def normalize_ws(spark, sf_dir):
    t = text.normalize_whitespace("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t.cast("binary")).alias("h"), text.word_count("text").alias("n_words"))


@query("SELECT lang, sum(len(t))::BIGINT AS n_tokens, sum(len(list_distinct(t)))::BIGINT AS n_distinct FROM (SELECT lang, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS t FROM documents) GROUP BY lang")
def tokenize_stats(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("lang", text.tokens("text").alias("t"))
    return t.groupBy("lang").agg(F.sum(F.size("t")).cast("long").alias("n_tokens"), F.sum(F.size(F.array_distinct("t"))).cast("long").alias("n_distinct"))


@query(f"""WITH w AS (SELECT doc_id, string_split({_WS}, ' ') AS w FROM documents WHERE {_WS} <> ''),
s AS (SELECT doc_id, w, unnest(CASE WHEN len(w) <= 450 THEN [0] ELSE range(0, (ceil((len(w) - 450) / 370.0)::BIGINT + 1) * 370, 370) END) AS start FROM w)
SELECT doc_id, start // 370 AS idx, start, len(w[start + 1 : start + 450])::BIGINT AS n_words, md5(array_to_string(w[start + 1 : start + 450], ' ')) AS h FROM s""", bench=True)
def word_window_chunks(spark, sf_dir):
    c = chunking.word_windows(table(spark, sf_dir, "documents"), ["doc_id"])
    return c.select("doc_id", "idx", "start", "n_words", F.md5(F.col("chunk").cast("binary")).alias("h"))


@query("""WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS ps FROM documents),
r(doc_id, ps, i, part, n, out, idx) AS (
  SELECT doc_id, ps, 1, ps[1], length(ps[1]), NULL::VARCHAR, 0 FROM p WHERE len(ps) > 0
  UNION ALL
  SELECT doc_id, ps, i + 1,
    CASE WHEN i >= len(ps) THEN NULL WHEN n + length(ps[i + 1]) + 1 > 1600 THEN right(part, 200) || chr(10) || ps[i + 1] ELSE part || chr(10) || ps[i + 1] END,
    CASE WHEN i >= len(ps) THEN 0 WHEN n + length(ps[i + 1]) + 1 > 1600 THEN least(200, length(part)) + length(ps[i + 1]) + 1 ELSE n + length(ps[i + 1]) + 1 END,
    CASE WHEN i >= len(ps) OR n + length(ps[i + 1]) + 1 > 1600 THEN part END,
    CASE WHEN i >= len(ps) OR n + length(ps[i + 1]) + 1 > 1600 THEN idx + 1 ELSE idx END
  FROM r WHERE part IS NOT NULL)
SELECT doc_id, (idx - 1)::BIGINT AS idx, md5(out) AS h, length(out)::BIGINT AS n FROM r WHERE out IS NOT NULL""")
def paragraph_pack(spark, sf_dir):
    c = chunking.packed_paragraphs(table(spark, sf_dir, "documents"), ["doc_id"], sep="\n")
    return c.select("doc_id", "idx", F.md5(F.col("chunk").cast("binary")).alias("h"), F.length("chunk").cast("long").alias("n"))


@query(f"""SELECT doc_id, n >= 40 AS long_enough, n >= 150 AS enough_prose, regexp_matches(t, '^\\d{{1,3}}$') AS page_number,
regexp_matches(t, '(?i)^(part\\s+[ivxlc]+\\b.*|item\\s+\\d+(\\.\\d+)?[a-z]?\\.?\\s*.*|[a-z][a-z0-9,''&/() \\-]{{3,80}})$') AS heading FROM (SELECT doc_id, {_WS} AS t, CASE WHEN {_WS} = '' THEN 0 ELSE len(string_split({_WS}, ' ')) END AS n FROM documents)""")
def low_value_filter(spark, sf_dir):
    words = text.word_count("text")
    plain = text.any_match(text.normalize_whitespace("text"), (r"^PART\s+[IVXLC]+\b.*$", text.fixed.ITEM_HEADING, text.fixed.SECTION_HEADINGS[3]))
    return table(spark, sf_dir, "documents").select("doc_id", (words >= 40).alias("long_enough"), (words >= chunking.MIN_WORDS).alias("enough_prose"), text.is_page_number("text").alias("page_number"), plain.alias("heading"))


@query("""WITH l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
h AS (SELECT *, length(line) < 30 AND NOT regexp_matches(line, '[.,;:!?]$') AS h FROM l),
b AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS block FROM h),
g AS (SELECT doc_id, block, string_agg(line, ' ' ORDER BY i) AS body FROM b WHERE NOT h GROUP BY ALL),
w AS (SELECT doc_id, block, body, trim(regexp_replace(body, '\\s+', ' ', 'g')) AS t FROM g)
SELECT doc_id, block::BIGINT AS block, md5(body) AS h, len(string_split(t, ' '))::BIGINT AS n_words FROM w WHERE t <> '' AND len(string_split(t, ' ')) >= 20""", bench=True)
def heading_blocks(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    heading = (F.length("line") < 30) & ~F.col("line").rlike("[.,;:!?]$")
    b = chunking.blocks(lines, ["doc_id"], "i", "line", heading)
    return b.select("doc_id", "block", F.md5(F.col("body").cast("binary")).alias("h"), "n_words")


@query("""WITH l AS (SELECT doc_id, unnest(range(0, len(ls))) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
v AS (SELECT *, CASE WHEN i % 7 = 0 THEN i END AS a, CASE WHEN i % 3 = 1 THEN i END AS b FROM l),
c AS (SELECT *, last_value(a IGNORE NULLS) OVER w AS la, last_value(b IGNORE NULLS) OVER w AS lb FROM v WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING))
SELECT doc_id, i::BIGINT AS i, la::BIGINT AS part, CASE WHEN lb >= la THEN lb END::BIGINT AS item FROM c""")
def carried_headings(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("i", F.col("i").cast("long"))
    levels = [("part", F.when(F.col("i") % 7 == 0, F.col("i"))), ("item", F.when(F.col("i") % 3 == 1, F.col("i")))]
    return relational.carried(lines, ["doc_id"], "i", levels).select("doc_id", "i", "part", "item")


@query("""SELECT doc_id, coalesce(list_sum(n), 0)::DOUBLE AS total, len(n)::BIGINT AS found FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '(?i)\\$?\\s*(\\d[\\d,]*\\.?\\d*)\\s*(?:billion|trillion|million|B|T|M)?', 1), lambda x: try_cast(replace(x, ',', '') AS DOUBLE)), lambda x: x IS NOT NULL AND NOT (x = floor(x) AND x BETWEEN 1900 AND 2100)) AS n FROM documents)""")
def extracted_numbers(spark, sf_dir):
    n = text.numbers("text")
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n")).select("doc_id", F.aggregate("n", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size("n").cast("long").alias("found"))


_PLAIN = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\\b.*?</(script|style)>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?i)<!doctype[^>]*>', '', 'g')"
_LINES = f"regexp_replace(regexp_replace({_PLAIN}, '(?i)</?(p|div|br|li|h1|ul|title|article|footer|nav|a|b)(\\s[^>]*)?>', chr(10), 'g'), '<[^>]*>', '', 'g')"
_DECODED = f"replace(replace(replace(replace({_LINES}, '&copy;', chr(169)), '&middot;', chr(183)), '&quot;', '\"'), '&amp;', '&')"


@query(f"""SELECT page_id, nullif(trim(regexp_replace(array_to_string(list_transform(string_split({_DECODED}, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)), '') AS text FROM pages""")
def html_text(spark, sf_dir):
    return html_source.html_text(table(spark, sf_dir, "pages"), ["page_id"])


@query("""SELECT page_id, (unnest(range(0, len(l))))::BIGINT AS pos, unnest(l) AS link FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages)""")
def html_links(spark, sf_dir):
    return html_source.links(table(spark, sf_dir, "pages"), ["page_id"])


@query("SELECT event_id, (props ->> '$.k') AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


# -- relational core ---------------------------------------------------------------------------


@query("SELECT CASE p_type WHEN 'PROMO' THEN 'STANDARD' WHEN 'ECONOMY' THEN 'BASIC' ELSE p_type END AS p_type, count(*) AS n, round(sum(p_retailprice), 2) AS total FROM part GROUP BY 1")
def tag_normalize(spark, sf_dir):
    p = relational.replace_values(table(spark, sf_dir, "part"), "p_type", {"PROMO": "STANDARD", "ECONOMY": "BASIC"})
    return p.groupBy("p_type").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("total"))


@query("SELECT count(*) FILTER (p_size IN (1, 2, 3)) AS mapped, count(*) FILTER (p_size NOT IN (1, 2, 3)) AS unmapped FROM part")
def mapped_tags(spark, sf_dir):
    return relational.mapped_counts(table(spark, sf_dir, "part").withColumn("s", F.col("p_size").cast("string")), "s", {"1": "a", "2": "b", "3": "b"})


@query("SELECT o_orderkey, year(o_orderdate)::INTEGER AS year, max(l_extendedprice) AS top_price, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL", bench=True)
def fact_filing_join(spark, sf_dir):
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    # facts of an order are summed up before they meet it: fewer rows travel
    facts = li.groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("top_price"), F.count("*").alias("n"))
    head = o.groupBy("o_orderkey", F.year("o_orderdate").alias("year")).agg(F.count("*").alias("c"))
    return facts.join(head, facts["l_orderkey"] == head["o_orderkey"]).select("o_orderkey", "year", "top_price", (F.col("n") * F.col("c")).alias("n"))


@query("SELECT * FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def semi_filter(spark, sf_dir):
    return relational.semi(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey").select(*table(spark, sf_dir, "orders").columns)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def anti_upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return relational.new_rows(o, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


_LI = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@query(f"SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LI}) AS rn FROM lineitem) WHERE rn = 1", bench=True)
def keep_first(spark, sf_dir):
    return relational.keep_first(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], _LI.split(", "))


@query(f"SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, {', '.join(c + ' DESC' for c in _LI.split(', '))}) AS rn FROM lineitem) WHERE rn = 1", bench=True)
def upsert_latest(spark, sf_dir):
    return relational.keep_last(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate", *_LI.split(", ")])


@query("SELECT l_suppkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS l_returnflag_set FROM lineitem GROUP BY 1")
def sorted_set_agg(spark, sf_dir):
    return relational.sorted_set(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_returnflag")


@query("SELECT lang, arg_min(source, CASE WHEN source <> 'src0' THEN doc_id END) AS source, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY lang")
def first_filled(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("source", F.when(F.col("source") != "src0", F.col("source")))
    return relational.first_filled(d, ["lang"], ["source", "n_chars"], "doc_id")


_DAYS = "date_diff('day', o_orderdate::DATE, l_shipdate::DATE)"


@query(f"""SELECT period_type, period_label, CASE WHEN period_label LIKE 'Q%' THEN period_label END AS fiscal_quarter, count(*) AS n FROM (SELECT CASE WHEN d <= 110 THEN 'quarterly' WHEN d <= 200 THEN 'semiannual' WHEN d <= 400 THEN 'annual' ELSE 'other' END AS period_type,
CASE WHEN d <= 110 THEN 'Q' || quarter(e) WHEN d <= 200 THEN CASE WHEN month(e) <= 6 THEN 'H1' ELSE 'H2' END WHEN d <= 400 THEN 'FY' ELSE 'TTM' END AS period_label FROM (SELECT {_DAYS} AS d, l_shipdate AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey)) GROUP BY ALL""")
def period_info(spark, sf_dir):
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.expr("l_orderkey = o_orderkey"))
    s, e = F.col("o_orderdate"), F.col("l_shipdate")
    label = numeric.period_label(s, e)
    return j.select(numeric.period_type(s, e).alias("period_type"), label.alias("period_label"), numeric.fiscal_quarter(label).alias("fiscal_quarter")).groupBy("period_type", "period_label", "fiscal_quarter").agg(F.count("*").alias("n"))


@query("""SELECT y::INTEGER AS y, q, CASE q WHEN 'Q1' THEN make_date(y, 1, 1) WHEN 'Q2' THEN make_date(y, 4, 1) WHEN 'Q3' THEN make_date(y, 7, 1) WHEN 'Q4' THEN make_date(y, 7, 1) END AS first_day,
CASE q WHEN 'Q1' THEN make_date(y, 3, 31) WHEN 'Q2' THEN make_date(y, 6, 30) WHEN 'Q3' THEN make_date(y, 9, 30) WHEN 'Q4' THEN make_date(y + 1, 1, 31) END AS last_day, count(*) AS n FROM (SELECT year(o_orderdate) AS y, 'Q' || quarter(o_orderdate) AS q FROM orders) GROUP BY ALL""")
def quarter_ranges(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y"), F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string")).alias("q")).agg(F.count("*").alias("n"))
    first, last = numeric.quarter_range(F.col("y"), F.col("q"))
    return o.select("y", "q", first.alias("first_day"), last.alias("last_day"), "n")


@query("SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3", bench=True)
def top_per_group(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return relational.top_per(o, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)


@query("SELECT o_orderkey AS k, 'order' AS via FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT DISTINCT l_orderkey, 'line' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def fallback_union(spark, sf_dir):
    a = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), F.lit("order").alias("via"))
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.lit("line").alias("via")).distinct()
    return relational.primary_or(a, b, ["k"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def uniqueness_check(spark, sf_dir):
    return relational.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def integrity_check(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    return relational.orphans(table(spark, sf_dir, "lineitem"), "l_orderkey", o, "o_orderkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%00001%' AND c_acctbal BETWEEN 0 AND 5000")
def substring_filter(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(F.col("c_name").ilike("%00001%") & F.col("c_acctbal").between(0, 5000)).select("c_custkey", "c_name")


@query("SELECT o_orderkey, list_contains(p, '1-URGENT') AS one, list_has_any(p, ['2-HIGH', '5-LOW']) AS some FROM (SELECT o_orderkey, [o_orderpriority, o_orderstatus] AS p FROM orders)")
def array_membership(spark, sf_dir):
    p = F.array("o_orderpriority", "o_orderstatus")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_contains(p, "1-URGENT").alias("one"), F.arrays_overlap(p, F.array(F.lit("2-HIGH"), F.lit("5-LOW"))).alias("some"))


@query("SELECT l_returnflag, o.p AS priority, count(*) AS n FROM lineitem JOIN (SELECT o_orderkey, string_agg(o_orderpriority, '') AS p FROM orders GROUP BY 1) o ON l_orderkey = o.o_orderkey GROUP BY ALL")
def lookup_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("priority"))
    return relational.lookup(table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("c")), o, "l_orderkey").where("priority is not null").groupBy("l_returnflag", "priority").agg(F.sum("c").alias("n"))


# -- graph and trees ---------------------------------------------------------------------------


@query("""WITH p AS (SELECT o_custkey, year(o_orderdate) AS y, o_orderpriority AS t, o_orderkey AS pos FROM orders),
m AS (SELECT o_custkey, string_agg(DISTINCT y::VARCHAR, ',' ORDER BY y::VARCHAR) AS years, max(y) AS latest, arg_max(t, struct_pack(y := y, n := length(t), p := -pos)) AS title FROM p GROUP BY 1)
SELECT o_custkey, years, latest::INTEGER AS latest, title, latest = (SELECT max(y) FROM p) AS is_current FROM m""", bench=True)
def entity_history(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    people = o.select(F.lit("T").alias("ticker"), F.year("o_orderdate").alias("year"), F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("name"), F.col("o_orderpriority").alias("title"), F.col("o_orderkey").alias("pos"))
    b = graph.board_members(people)
    return b.select(F.substring_index("name", " ", -1).cast("long").alias("o_custkey"), F.array_join("years_present", ",").alias("years"), F.col("latest_year").alias("latest"), "title", "is_current")


@query("""SELECT p_partkey, prefix AS cpc_prefix, CASE prefix WHEN 'G06' THEN 'Computing & Data Processing' ELSE 'Other (' || prefix || ')' END AS label FROM (SELECT p_partkey, unnest(list_distinct([substr(p_brand, 1, 3), substr(p_type, 1, 3)])) AS prefix FROM part)""")
def domain_edges(spark, sf_dir):
    return graph.domain_edges(table(spark, sf_dir, "part"), "p_partkey", F.array("p_brand", "p_type"))


@query("SELECT DISTINCT n_name, c_custkey, o_orderpriority FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE r_name = 'ASIA' AND year(o_orderdate) = 1996")
def graph_2hop(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    nation = t("region").where("r_name = 'ASIA'").join(t("nation"), F.expr("n_regionkey = r_regionkey")).select(F.col("n_nationkey").alias("src"), "n_name")
    people = graph.hop(nation, t("customer").select(F.col("c_nationkey").alias("src"), F.col("c_custkey").alias("dst")), t("customer").select(F.col("c_custkey").alias("dst"), "c_custkey")).select(F.col("dst").alias("src"), "n_name", "c_custkey")
    orders = t("orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), F.year("o_orderdate").alias("year"))
    props = t("orders").select(F.col("o_orderkey").alias("dst"), "o_orderpriority")
    return graph.hop(people, orders, props, F.col("year") == 1996).select("n_name", "c_custkey", "o_orderpriority").distinct()


@query("""SELECT DISTINCT s_suppkey, n_name, o_orderpriority, p_brand FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
WHERE s_acctbal > 9000 AND year(o_orderdate) = 1996 AND c_acctbal < 500 AND p_size <= 3""")
def graph_pattern(spark, sf_dir):
    """A pattern over six tables, reduced by semi-joins before any join."""
    t = lambda n: table(spark, sf_dir, n)
    tables = {
        "nation": t("nation").select("n_nationkey", "n_name"), "supplier": t("supplier").where("s_acctbal > 9000").select("s_suppkey", "s_nationkey"), "customer": t("customer").where("c_acctbal < 500").select("c_custkey", "c_nationkey"),
        "orders": t("orders").where("year(o_orderdate) = 1996").select("o_orderkey", "o_custkey", "o_orderpriority"), "lineitem": t("lineitem").select("l_orderkey", "l_partkey"), "part": t("part").where("p_size <= 3").select("p_partkey", "p_brand"),
    }
    links = [("nation", "n_nationkey", "supplier", "s_nationkey"), ("nation", "n_nationkey", "customer", "c_nationkey"), ("customer", "c_custkey", "orders", "o_custkey"), ("orders", "o_orderkey", "lineitem", "l_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey")]
    return graph.matched(tables, links, ["s_suppkey", "n_name", "o_orderpriority", "p_brand"], distinct=True)


@query("""SELECT n_nationkey, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers, coalesce(o.n, 0) AS orders FROM nation
LEFT JOIN (SELECT c_nationkey, count(DISTINCT c_custkey) AS n FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey
LEFT JOIN (SELECT s_nationkey, count(DISTINCT s_suppkey) AS n FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey
LEFT JOIN (SELECT c_nationkey AS k, count(DISTINCT o_orderkey) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1) o ON o.k = n_nationkey""", bench=True)
def graph_optional_counts(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    placed = t("orders").join(t("customer").select("c_custkey", "c_nationkey"), F.expr("o_custkey = c_custkey"))
    return graph.summary(
        t("nation"), "n_nationkey",
        customers=(t("customer").select(F.col("c_nationkey").alias("src"), "c_custkey"), "c_custkey"),
        suppliers=(t("supplier").select(F.col("s_nationkey").alias("src"), "s_suppkey"), "s_suppkey"),
        orders=(placed.select(F.col("c_nationkey").alias("src"), "o_orderkey"), "o_orderkey"),
    )


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a tree over vectors: leaves v, labels l, groups of labels g, one root."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    up = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    leaf = e.select(up("v", F.col("vec_id")).alias("id"), up("l", F.col("label")).alias("parent"), F.lit("leaf").alias("node_type"))
    low = e.select("label").distinct().select(up("l", F.col("label")).alias("id"), up("g", F.col("label") % 3).alias("parent"), F.lit("summary").alias("node_type"))
    high = low.select(F.col("parent").alias("id"), F.lit("root").alias("parent"), F.lit("summary").alias("node_type")).distinct()
    root = spark.range(1).select(F.lit("root").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit("summary").alias("node_type"))
    nodes = leaf.unionByName(low).unionByName(high).unionByName(root)
    return nodes.select("id", "node_type"), nodes.where("parent is not null").select(F.col("parent").alias("parent_id"), F.col("id").alias("child_id"), F.lit(0).alias("pos"))


@query("SELECT 'v' || vec_id AS id, CASE WHEN vec_id < 5 THEN 0.9 WHEN label = 4 THEN 0.76 ELSE 0.475 END::DOUBLE AS final_score, CASE WHEN vec_id >= 5 THEN 'l' || label END AS via FROM embeddings WHERE vec_id < 5 OR label = 4 OR label % 3 = 2")
def tree_expand(spark, sf_dir):
    nodes, edges = _tree(spark, sf_dir)
    direct = nodes.where("id in ('v0', 'v1', 'v2', 'v3', 'v4')").select("id", F.lit(0.9).alias("score"), "node_type")
    hits = direct.unionByName(nodes.where("id in ('l4', 'g2')").select("id", F.expr("case id when 'l4' then 0.8D else 0.5D end").alias("score"), "node_type"))
    return retrieval.merged_hits(retrieval.expand(hits, edges, nodes)).select("id", F.round("final_score", 6).alias("final_score"), "via")


@query("""SELECT 'missing_child' AS issue, 'x' || vec_id AS id FROM embeddings WHERE vec_id % 50 = 11 UNION ALL SELECT 'bad_parent', 'v' || vec_id FROM embeddings WHERE vec_id % 50 = 7 UNION ALL SELECT DISTINCT 'empty_summary', 'l' || label FROM embeddings WHERE label % 4 = 1
UNION ALL SELECT 'leaf_with_children', 'v' || vec_id FROM embeddings WHERE vec_id % 50 = 11 UNION ALL SELECT DISTINCT 'cycle', 'g' || label % 3 || '>root' FROM embeddings""")
def tree_verify(spark, sf_dir):
    """What is wrong with a tree over all vectors, in which every kind of defect is seeded."""
    nodes, edges = _tree(spark, sf_dir)
    kids = edges.groupBy("parent_id").agg(F.array_sort(F.collect_list("child_id")).alias("child_ids"))
    parents = edges.select(F.col("child_id").alias("id"), F.col("parent_id"))
    t = nodes.join(kids, nodes["id"] == kids["parent_id"], "left").drop("parent_id").join(parents, "id", "left").withColumn("text", F.col("id"))
    # seeded defects: children that are not there under leaves, wrong parents, empty summaries, a ring through each group
    n = F.expr("try_cast(substr(id, 2) as long)")
    leaf = F.col("node_type") == "leaf"
    t = t.withColumn("text", F.when(F.col("id").startswith("l") & (n % 4 == 1), " ").otherwise(F.col("text")))
    t = t.withColumn("child_ids", F.when(leaf & (n % 50 == 11), F.array(F.concat(F.lit("x"), n.cast("string")))).when(F.col("id").startswith("g"), F.concat("child_ids", F.array(F.lit("root")))).otherwise(F.col("child_ids")))
    return tree.issues(t.withColumn("parent_id", F.when(leaf & (n % 50 == 7), F.lit("root")).otherwise(F.col("parent_id"))))


@query("""WITH x AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
c AS (SELECT label, i, avg(v) AS m FROM x GROUP BY ALL), n AS (SELECT label, round(sqrt(sum(m * m)), 6) AS norm FROM c GROUP BY label)
SELECT label, n, children, norm FROM (SELECT label, count(*) AS n, string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) AS children FROM embeddings GROUP BY label) JOIN n USING (label)""")
def cluster_summary(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    mean = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m")).groupBy("label").agg(F.round(F.sqrt(F.sum(F.col("m") * F.col("m"))), 6).alias("norm"))
    kids = e.groupBy("label").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("vec_id")), lambda x: x.cast("string")), ",").alias("children"))
    return kids.join(mean, "label")


# -- cache, planning ---------------------------------------------------------------------------


@query("""SELECT probe_id, -b.o AS entry_id, b.s AS similarity FROM (SELECT p.vec_id AS probe_id, max(struct_pack(s := round(list_cosine_similarity(p.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6), o := -c.vec_id)) AS b
FROM embeddings p JOIN embeddings c ON nullif(p.label, 3) IS NOT DISTINCT FROM nullif(c.label, 3) WHERE p.vec_id % 100 = 0 AND c.vec_id % 100 <> 0 AND round(list_cosine_similarity(p.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) >= 0.1 GROUP BY 1)""", bench=True)
def semantic_cache_lookup(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.expr("nullif(label, 3)").alias("source_filter"), "embedding")
    entries, probes = e.where("vec_id % 100 <> 0").withColumnRenamed("vec_id", "entry_id"), e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "probe_id")
    return cache.similar(entries, probes, 0.1)


@query("SELECT doc_id, first < doc_id AS hit, CASE WHEN first < doc_id THEN first END AS answer FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents)")
def exact_cache_lookup(spark, sf_dir):
    """Every document asks; the first of each text has been answered before the others."""
    d = table(spark, sf_dir, "documents").select("doc_id", text.query_hash(F.col("text"), F.lit("en")).alias("key"))
    entries = d.groupBy("key").agg(F.min("doc_id").alias("answer"), F.count("*").alias("n")).where("n > 1")
    got = cache.exact(entries, d)
    known = F.coalesce(F.col("answer") < F.col("doc_id"), F.lit(False))
    return got.select("doc_id", known.alias("hit"), F.when(known, F.col("answer")).alias("answer"))


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS content_hash FROM documents GROUP BY text", bench=True)
def doc_hash_dedupe(spark, sf_dir):
    return cache.distinct_documents(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT CASE WHEN event_type IN ('view', 'click') THEN 'exact' ELSE 'similar' END AS tier, count(*) AS entries, sum(user_id)::BIGINT AS hits FROM events GROUP BY 1")
def cache_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return cache.stats(e.select(F.when(F.col("event_type").isin("view", "click"), "exact").otherwise("similar").alias("tier"), F.col("user_id").alias("hit_count")))


_ROUTE = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(text), {w!r})' for w in MARKERS[r])} THEN '{r}'" for r in ("graph", "sql", "filings", "transcripts", "patents", "litigation")) + " ELSE 'llm_direct' END"


@query(f"SELECT doc_id, {_ROUTE} AS route, CASE {_ROUTE} WHEN 'llm_direct' THEN 'tier_0' ELSE 'tier_1' END AS tier FROM documents", bench=True)
def route_hint(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", planner.route_hint(F.col("text"), MARKERS).alias("route"))
    return d.withColumn("tier", numeric.tier(F.lit("single"), F.col("route")))


@query(f"SELECT {_ROUTE} AS route, count(*) AS n FROM documents GROUP BY 1")
def route_distribution(spark, sf_dir):
    return route_hint(spark, sf_dir).groupBy("route").agg(F.count("*").alias("n"))


_STOP = ", ".join(f"'{w}'" for w in text.fixed.STOPWORDS)
_SET = f"list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda x: x NOT IN ({_STOP}))"


@query(f"""WITH t AS (SELECT conv_id, turn, {_SET} AS s FROM conversations), p AS (SELECT a.conv_id, a.turn AS i, b.turn AS j, a.s AS x, b.s AS y FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn < b.turn WHERE len(a.s) > 0 AND len(b.s) > 0)
SELECT conv_id, i, j FROM p WHERE len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) >= 0.2""")
def jaccard_pairs(spark, sf_dir):
    """Turns of one conversation that say much the same."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", planner.meaning(F.col("text")).alias("s"))
    return relational.similar_pairs(c, "conv_id", "turn", "s", 0.2)


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role || (length(text) % 3) ORDER BY turn) AS rn FROM conversations) WHERE rn = 1")
def citation_dedupe(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return relational.ordered_distinct(c, ["conv_id"], [F.concat("role", (F.length("text") % 3).cast("string"))], "turn").select("conv_id", "turn", "role")


# -- contradiction, evaluation, audit ------------------------------------------------------------

_GAP = "abs(figure - statement) / greatest(abs(figure), abs(statement))"


@query(f"""WITH f AS (SELECT l_orderkey AS k, round(sum(l_extendedprice * (1 - l_discount)), 2) AS figure FROM lineitem GROUP BY 1), s AS (SELECT o_orderkey AS k, max(o_totalprice) AS statement FROM orders GROUP BY 1),
g AS (SELECT k, CASE WHEN figure IS NULL OR statement IS NULL THEN 0 ELSE least(10, floor(round({_GAP} * 10, 6))) END::INTEGER AS score FROM f FULL JOIN s USING (k))
SELECT k, score, CASE WHEN score <= 2 THEN 'low' WHEN score <= 5 THEN 'medium' WHEN score <= 8 THEN 'high' ELSE 'critical' END AS severity, score >= 3 AS detected, score >= 6 AS high_or_above FROM g""", bench=True)
def contradiction_sweep(spark, sf_dir):
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    figures = li.groupBy(F.col("l_orderkey").alias("k")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("figure"))
    said = o.groupBy(F.col("o_orderkey").alias("k")).agg(F.max("o_totalprice").alias("statement"))
    return contradiction.sweep(figures, said, ["k"]).select("k", "score", "severity", "detected", "high_or_above")


_JUDGED = "SELECT lang || source AS qid, quality = 0 AS relevant, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS rank FROM documents JOIN labels USING (doc_id)"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.concat("lang", "source").alias("qid"), (F.col("quality") == 0).alias("relevant"), "n_chars", "doc_id")


@query(f"SELECT qid, round(coalesce(1.0 / min(CASE WHEN relevant THEN rank END), 0), 6) AS mrr FROM ({_JUDGED}) GROUP BY qid")
def eval_mrr(spark, sf_dir):
    return evaluation.mrr_of_order(_judged(spark, sf_dir), [-F.col("n_chars"), F.col("doc_id")])


@query(f"""WITH t AS (SELECT * FROM ({_JUDGED}) WHERE rank <= 5), i AS (SELECT *, relevant::INT AS rel, row_number() OVER (PARTITION BY qid ORDER BY relevant DESC, rank) AS ideal FROM t)
SELECT qid, round(CASE WHEN max(rel) = 0 THEN 0.0 WHEN count(*) < 2 THEN max(rel)::DOUBLE ELSE sum(rel / log2(rank + 1)) / sum(rel / log2(ideal + 1)) END, 6) AS ndcg FROM i GROUP BY qid""")
def eval_ndcg(spark, sf_dir):
    return evaluation.ndcg(relational.top_per(_judged(spark, sf_dir), ["qid"], [F.desc("n_chars"), F.col("doc_id")], 5))


_SHINGLES = "unnest(list_distinct(list_transform(range(1, greatest(len(t) - 3, 1)), lambda i: array_to_string(t[i:i + 4], ' '))))"
_BAG = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')"


@query(f"""WITH b AS (SELECT item_id, {_BAG} AS t FROM benchmark), d AS (SELECT doc_id, {_BAG} AS t FROM documents),
p AS (SELECT DISTINCT item_id, doc_id FROM (SELECT item_id, {_SHINGLES} AS g FROM b) JOIN (SELECT doc_id, {_SHINGLES} AS g FROM d) USING (g))
SELECT item_id, doc_id, round(len(list_intersect(list_distinct(d.t), list_distinct(b.t)))::DOUBLE / len(list_distinct(b.t)), 6) AS overlap FROM p JOIN b USING (item_id) JOIN d USING (doc_id)""")
def eval_overlap(spark, sf_dir):
    """Documents and benchmark items that share five words in a row, found by an inverted join, with the share of the
    item's words that the document holds."""
    bag = lambda n, key: table(spark, sf_dir, n).select(key, text.tokens("text").alias(f"t_{key}"))
    items, docs = bag("benchmark", "item_id"), bag("documents", "doc_id")
    grams = lambda df, key: df.where(F.size(f"t_{key}") >= 5).select(key, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(f"t_{key}") - 4), lambda i: F.xxhash64(F.array_join(F.slice(f"t_{key}", i, 5), " "))))).alias("g"))
    met = grams(items, "item_id").join(grams(docs, "doc_id"), "g").select("item_id", "doc_id").distinct()
    pairs = met.join(items, "item_id").join(docs, "doc_id")
    return pairs.select("item_id", "doc_id", F.round(evaluation.citation_overlap(F.col("t_doc_id"), F.col("t_item_id")), 6).alias("overlap"))


@query("""WITH e AS (SELECT o_orderkey, [o_totalprice, o_totalprice * 2] AS want, 'total ' || printf('%.2f', o_totalprice * (1 + (o_orderkey % 5) * 0.004)) || ' in 1996' AS answer FROM orders),
n AS (SELECT o_orderkey, want, list_transform(regexp_extract_all(answer, '\\$?\\s*(\\d[\\d,]*\\.?\\d*)', 1), lambda x: x::DOUBLE) AS got FROM e)
SELECT o_orderkey, (len(list_filter(want, lambda w: len(list_filter(got, lambda x: NOT (x = floor(x) AND x BETWEEN 1900 AND 2100) AND abs(x - w) / abs(w) <= 0.01)) > 0)) / 2.0)::DOUBLE AS accuracy FROM n""")
def eval_numeric(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    answer = F.concat(F.lit("total "), F.format_string("%.2f", F.col("o_totalprice") * (1 + (F.col("o_orderkey") % 5) * 0.004)), F.lit(" in 1996"))
    return o.select("o_orderkey", evaluation.numerical_accuracy(answer, F.array("o_totalprice", F.col("o_totalprice") * 2)).alias("accuracy"))


_SCORES = "SELECT c AS config, lang AS tier, 'brevity' AS metric, 1.0 / (1 + n_chars * f) AS value FROM documents, (VALUES ('naive_rag', 0.01), ('plus_router', 0.02), ('plus_reranker', 0.03), ('full_system', 0.05)) v(c, f)"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    configs = F.array(*(F.struct(F.lit(c).alias("c"), F.lit(f).alias("f")) for c, f in (("naive_rag", 0.01), ("plus_router", 0.02), ("plus_reranker", 0.03), ("full_system", 0.05))))
    d = table(spark, sf_dir, "documents").select("lang", "n_chars", F.explode(configs).alias("v"))
    return d.select(F.col("v.c").alias("config"), F.col("lang").alias("tier"), F.lit("brevity").alias("metric"), (1.0 / (1 + F.col("n_chars") * F.col("v.f"))).alias("value"))


@query(f"WITH m AS (SELECT config, tier, metric, round(avg(value), 4) AS mean FROM ({_SCORES}) GROUP BY ALL) SELECT a.config, a.tier, a.metric, round(a.mean - coalesce(b.mean, 0), 4) AS delta FROM m a LEFT JOIN m b ON b.config = 'naive_rag' AND a.tier = b.tier AND a.metric = b.metric WHERE a.config <> 'naive_rag'")
def ablation_delta(spark, sf_dir):
    return evaluation.deltas(evaluation.tier_means(_scores(spark, sf_dir)))


@query(f"SELECT config, metric, round(avg(mean), 4) AS mean FROM (SELECT config, tier, metric, round(avg(value), 4) AS mean FROM ({_SCORES}) GROUP BY ALL) GROUP BY ALL")
def ablation_overall(spark, sf_dir):
    return evaluation.overall(evaluation.tier_means(_scores(spark, sf_dir)))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("route"), F.col("value").alias("latency_ms"), (F.col("user_id") % 5).cast("string").alias("tenant_id"), (F.col("event_type") == "view").alias("cache_hit"), F.col("ts").alias("timestamp"))


@query("SELECT event_type AS route, count(*) AS n, round(avg(value), 4) AS avg_latency FROM events GROUP BY 1", bench=True)
def audit_routes(spark, sf_dir):
    return audit.by_route(_log(spark, sf_dir))


@query("SELECT (user_id % 5)::VARCHAR AS tenant_id, count(*) AS n, count(*) FILTER (event_type = 'view') AS hits, round(100.0 * count(*) FILTER (event_type = 'view') / count(*), 4) AS hit_rate FROM events GROUP BY 1")
def audit_hit_rate(spark, sf_dir):
    return audit.hit_rate(_log(spark, sf_dir))


@query("SELECT (user_id % 5)::VARCHAR AS tenant_id, count(*) AS n, round(avg(value), 4) AS avg_latency FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1")
def audit_recent(spark, sf_dir):
    log = _log(spark, sf_dir)
    last = log.agg((F.max("timestamp") - F.expr("INTERVAL 7 DAYS")).alias("since"))  # one row
    return audit.recent(log.crossJoin(F.broadcast(last)), F.col("since"))


# -- extensions --------------------------------------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, grouping(l_returnflag, l_linestatus)::BIGINT AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_extension(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.grouping_id().alias("level"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_extension(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return e.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), "n")


@query(f"SELECT 'vectors' AS route, vec_id::VARCHAR AS content, score FROM ({ORACLE_SQL['dense_topk']}) UNION ALL SELECT 'filings', doc_id::VARCHAR, rrf FROM ({_HYBRID_SQL})")
def evidence_routes(spark, sf_dir):
    """Two routes' results as uniform evidence."""
    dense = dense_topk(spark, sf_dir).select(F.col("vec_id").cast("string").alias("content"), "score")
    lexical = hybrid_rrf(spark, sf_dir).select(F.col("doc_id").cast("string").alias("content"), F.col("rrf").alias("score"))
    return retrieval.evidence(vectors=dense, filings=lexical)
