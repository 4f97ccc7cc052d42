"""Registered queries over whole web pages and scanned lines: labelled blocks, grids and texts of tables, broken words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import repair
from ..sources import blocks
from ..sources.tables import spread, table
from . import evidence
from .catalog import query

_PLAIN = "regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!doctype[^>]*>', '', 'g')"
_TEXT = "trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace({0}, '(?i)<br[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g'), '&copy;', chr(169)), '&middot;', chr(183)), '&quot;', '\"'), '&amp;', '&'), chr(160), ' '), '\\s+', ' ', 'g'))"


def _segments(pattern: str, group: int = 1) -> str:
    return f"list_filter(list_transform(regexp_extract_all(p, '{pattern}', {group}), lambda x: {_TEXT.format('x')}), lambda x: x <> '')"


@query(f"""WITH c AS (SELECT page_id, {_PLAIN} AS p FROM pages),
s AS (SELECT page_id, {_segments('(?is)<h1[^>]*>(.*?)</h1>')} AS heads, {_segments('(?is)<li[^>]*>(.*?)</li>')} AS items, list_filter(list_transform(regexp_split_to_array(p, '(?i)</?(p|div|h1|li|ul|nav|article|footer|title|body|html)(\\s[^>]*)?>'), lambda x: {_TEXT.format('x')}), lambda x: x <> '') AS every FROM c),
n AS (SELECT page_id, unnest(['section_header', 'list_item', 'text']) AS label, unnest([len(heads), len(items), len(every) - len(heads) - len(items)])::BIGINT AS n, md5(array_to_string(every, chr(10))) AS h FROM s)
SELECT page_id, label, n, h FROM n WHERE n > 0""")
def page_blocks(spark, sf_dir):
    """how many blocks of each label every page has, and a hash of its blocks in order."""
    found = blocks.located(table(spark, sf_dir, "pages"), ["page_id"])
    b = blocks.blocks(found, ["page_id"])
    order = b.groupBy("page_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "\n").cast("binary")).alias("h"))
    return b.groupBy("page_id", "label").agg(F.count("*").alias("n")).join(order, "page_id")


@query("""SELECT page_id, 0 AS grid, 'Structured Financial Table ' || page_id || chr(10) || 'Caption: Table ' || page_id || ' of ' || coalesce(url, '') || chr(10) || 'Headers: Region, Year, Year' || chr(10) || 'Dimensions: rows=' || (2 + page_id % 3) || ', cols=3' || chr(10) || 'Rows:' || chr(10)
|| 'Region: Region; Year: ' || 2000 + page_id % 25 || '; Year: ' || 2001 + page_id % 25 || chr(10) || array_to_string(list_transform(range(0, page_id % 3), lambda i: 'Region: R' || i || '; Year: ' || page_id * i || '; Year: ' || page_id * i) || ['Region: Total; Year: Total; Year: ' || page_id], chr(10)) AS text FROM pages""")
def page_tables(spark, sf_dir):
    """a table with a caption and cells over rows and columns in every page, as text."""
    i = F.col("page_id")
    s = lambda c: c.cast("string")
    body = F.when(i % 3 > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), i % 3 - 1)), lambda n: F.concat(F.lit("<tr><td>R"), s(n), F.lit("<td colspan=2>"), s(i * n)))).otherwise(F.array().cast("array<string>"))
    grid = F.concat(F.lit("<table class=t><caption>Table "), s(i), F.lit(" of <i>"), F.coalesce("url", F.lit("")), F.lit("</i></caption><thead><tr><th rowspan='2'>Region<th colspan=\"2\">Year</th></tr><tr><th>"), s(2000 + i % 25), F.lit("</th><th>"), s(2001 + i % 25), F.lit("</th></thead><tbody>"), F.array_join(body, ""), F.lit("<tr><td colspan=2>Total</td><td>"), s(i), F.lit("</td></tr></table>"))
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.coalesce("html", F.lit("")), grid).alias("html"))
    t = blocks.tables(blocks.located(pages, ["page_id"]), ["page_id"])
    return t.select("page_id", "grid", evidence.table_text(F.col("page_id"), F.col("caption"), F.col("headers"), F.col("n_rows"), F.col("n_cols"), F.col("rows")).alias("text"))


_NORMAL = "trim(regexp_replace(replace({0}, chr(160), ' '), '\\s+', ' ', 'g'))"
_CORE = "regexp_replace(lower({0}), '[.,;:!?]+$', '')"
_COST = "round(1000 * ln((total + 1) / ({0} + 0.5)))::BIGINT"


@query(f"""WITH RECURSIVE w AS MATERIALIZED (SELECT {_CORE.format('t')} AS word, count(*) AS n FROM (SELECT unnest(string_split({_NORMAL.format('text')}, ' ')) AS t FROM documents) GROUP BY 1 HAVING word <> ''), total AS (SELECT sum(n)::DOUBLE AS total FROM w),
l AS (SELECT conv_id, turn, unnest(range(0, len(ls))) AS line, unnest(ls) AS x FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS ls FROM conversations)),
b AS (SELECT conv_id, turn, line, {_NORMAL.format("array_to_string(list_transform(string_split(x, ' '), lambda y, i: CASE WHEN i % 5 = 3 AND length(y) >= 6 THEN left(y, 3) || ' ' || substr(y, 4) ELSE y END), ' ')")} AS x FROM l),
t AS MATERIALIZED (SELECT conv_id, turn, line, pos, tok, {_CORE.format('tok')} AS core, coalesce(n, 0) AS n FROM (SELECT conv_id, turn, line, unnest(range(1, len(ts) + 1)) AS pos, unnest(ts) AS tok FROM (SELECT *, string_split(x, ' ') AS ts FROM b)) LEFT JOIN w ON word = {_CORE.format('tok')}),
c2 AS MATERIALIZED (SELECT y.conv_id, y.turn, y.line, y.pos, {_COST.format('w.n')} AS c FROM t x JOIN t y ON x.conv_id = y.conv_id AND x.turn = y.turn AND x.line = y.line AND y.pos = x.pos + 1 JOIN w ON word = x.core || y.core, total
  WHERE w.n >= 3 AND w.n > least(x.n, y.n) AND regexp_matches(x.tok, '^\\p{{L}}+$') AND regexp_matches(y.tok, '^\\p{{L}}+[.,;:!?]*$')),
c3 AS MATERIALIZED (SELECT z.conv_id, z.turn, z.line, z.pos, {_COST.format('w.n')} AS c FROM t x JOIN t y ON x.conv_id = y.conv_id AND x.turn = y.turn AND x.line = y.line AND y.pos = x.pos + 1 JOIN t z ON x.conv_id = z.conv_id AND x.turn = z.turn AND x.line = z.line AND z.pos = x.pos + 2 JOIN w ON word = x.core || y.core || z.core, total
  WHERE w.n >= 3 AND w.n > least(x.n, y.n, z.n) AND regexp_matches(x.tok, '^\\p{{L}}+$') AND regexp_matches(y.tok, '^\\p{{L}}+$') AND regexp_matches(z.tok, '^\\p{{L}}+[.,;:!?]*$')),
m AS MATERIALIZED (SELECT t.conv_id, t.turn, t.line, t.pos, t.tok, {_COST.format('t.n')} AS c1, c2.c AS c2, c3.c AS c3 FROM t LEFT JOIN c2 USING (conv_id, turn, line, pos) LEFT JOIN c3 USING (conv_id, turn, line, pos), total),
r AS (SELECT conv_id, turn, line, 0::BIGINT AS pos, 0::BIGINT AS b1, NULL::BIGINT AS b2, NULL::BIGINT AS b3, '' AS s1, NULL::VARCHAR AS s2, NULL::VARCHAR AS s3, '' AS p1, '' AS p2 FROM b
  UNION ALL SELECT conv_id, turn, line, pos, best.b, b1, b2, best.s, s1, s2, tok, p1 FROM (SELECT m.conv_id, m.turn, m.line, m.pos, m.tok, b1, b2, s1, s2, p1,
    list_min(list_filter([{{'b': b1 + c1, 'g': 1, 's': s1 || CASE WHEN s1 = '' THEN '' ELSE ' ' END || tok}}, {{'b': b2 + c2, 'g': 2, 's': s2 || CASE WHEN s2 = '' THEN '' ELSE ' ' END || p1 || tok}}, {{'b': b3 + c3, 'g': 3, 's': s3 || CASE WHEN s3 = '' THEN '' ELSE ' ' END || p2 || p1 || tok}}], lambda z: z.b IS NOT NULL)) AS best
    FROM r JOIN m ON m.conv_id = r.conv_id AND m.turn = r.turn AND m.line = r.line AND m.pos = r.pos + 1))
SELECT conv_id, turn, line, s1 AS text FROM r QUALIFY row_number() OVER (PARTITION BY conv_id, turn, line ORDER BY pos DESC) = 1""")
def repaired_lines(spark, sf_dir):
    """lines of all turns with words torn apart, put together by what the documents' words tell."""
    lines = spread(table(spark, sf_dir, "conversations")).select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line", "x"))
    torn = F.array_join(F.transform(F.split("x", " "), lambda y, i: F.when((i % 5 == 2) & (F.length(y) >= 6), F.concat(F.left(y, F.lit(3)), F.lit(" "), F.substring(y, 4, 1 << 30))).otherwise(y)), " ")
    words = repair.word_counts(table(spark, sf_dir, "documents"))
    return repair.repaired(lines.select("conv_id", "turn", F.col("line").cast("long").alias("line"), torn.alias("text")), words, ["conv_id", "turn", "line"])
