"""Registered queries over steps that models take, with deterministic models in their place, on every turn of the
conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..sources.tables import table
from . import evidence, models, planner, styles
from .boundary import _Q, _clean, _meaning, _routes, contains_any, pick, picked, questions_of, quoted
from .catalog import ORACLE_SQL, query


def _letters(texts):
    """Stands for an embedding service: what it gives tells how many texts it was asked for at a time."""
    return [[float(len(t)), float(t.count("e")), float(1 <= len(texts) <= models.EMBED_BATCH)] for t in texts]


@query("SELECT conv_id, turn, length(text)::DOUBLE AS length, (length(text) - length(replace(text, 'e', '')))::DOUBLE AS es, true AS in_batches FROM conversations")
def embedded_turns(spark, sf_dir):
    """LM01, LM02: texts embedded by a service, at most 96 a call."""
    c = models.batched(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text", _letters, "v", "array<double>")
    return c.select("conv_id", "turn", F.get("v", F.lit(0)).alias("length"), F.get("v", F.lit(1)).alias("es"), (F.get("v", F.lit(2)) == 1).alias("in_batches"))


def _no_answer(texts):
    raise ConnectionError("no answer")


def _shouted(texts):
    return [t.upper()[::-1] for t in texts]


@query("SELECT conv_id, turn, md5(reverse(upper(text))) AS h FROM conversations WHERE regexp_matches(text, '^[ -~\\n]*$')")
def retried_models(spark, sf_dir):
    """LM03, LM12: the first model does not answer, after its tries the second does."""
    plain = table(spark, sf_dir, "conversations").where(F.col("text").rlike("^[ -~\\n]*$"))  # letters of other scripts have several capitals
    call = models.with_retries([_no_answer, _shouted], tries=2, sleep=_no_wait)
    c = models.batched(plain.select("conv_id", "turn", "text"), "text", call, "said", "string")
    return c.select("conv_id", "turn", F.md5(F.col("said").cast("binary")).alias("h"))


def _no_wait(seconds):
    return None


_BAG = "list_distinct(regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+'))"


@query(f"""WITH t AS (SELECT conv_id, turn, string_split(text, chr(10)) AS ls, {_BAG.format('text')} AS q FROM conversations), l AS (SELECT conv_id, turn, q, unnest(range(0, len(ls))) AS i, unnest(ls) AS c FROM t),
s AS (SELECT conv_id, turn, i, c, CASE WHEN len(q) = 0 THEN 0.0 ELSE len(list_intersect(q, {_BAG.format('c')}))::DOUBLE / len(q) END AS s FROM l)
SELECT conv_id, turn, arg_max(c, struct_pack(s := s, o := -i)) AS answer, count(*) FILTER (s >= 0.2) AS graded FROM s GROUP BY ALL""")
def extracted_answers(spark, sf_dir):
    """LM07, LM11, Q07, Q08: the line that says most of a turn stands for its answer; lines are graded against the turn."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.split("text", "\n").alias("lines"))
    m = models.Models()
    each = c.select("conv_id", "turn", m.generate(F.col("text"), F.col("lines")).alias("answer"), "text", F.explode("lines").alias("line"))
    return each.groupBy("conv_id", "turn", "answer").agg(F.count_if(m.grade(F.col("text"), F.col("line"))).alias("graded"))


_LOW = "trim(lower(q))"
_STYLE = "CASE turn % 3 WHEN 0 THEN 'answer' WHEN 1 THEN 'direct' ELSE 'merged' END"


@query(f"""WITH {_Q}, s AS (SELECT conv_id, turn, {_STYLE} AS kind, {' OR '.join(f"starts_with({_LOW}, {quoted(x)})" for x in fixed.YES_NO)} AS yes_no, {contains_any(_LOW, fixed.SEVERAL)} AS several, {contains_any(_LOW, fixed.SEVERAL_MERGED)} AS merged FROM w)
SELECT conv_id, turn, kind, yes_no, CASE kind WHEN 'answer' THEN several::INT * 4 WHEN 'merged' THEN merged::INT * 4 ELSE 0 END AS bullets, CASE kind WHEN 'answer' THEN 140 WHEN 'direct' THEN 90 ELSE 160 END AS most_words FROM s""")
def answer_styles(spark, sf_dir):
    """LM07, LM09: how the answer to every turn is to look, alone, without documents, and merged."""
    t = F.col("turn") % 3
    kind = F.when(t == 0, "answer").when(t == 1, "direct").otherwise("merged")
    return questions_of(spark, sf_dir).select("conv_id", "turn", kind.alias("kind"), styles.style(F.col("q"), kind).alias("s")).select("conv_id", "turn", "kind", "s.*")


@query("""SELECT conv_id, turn, 'Question: ' || text || chr(10) || 'Searched for: ' || CASE WHEN turn % 2 = 0 THEN role ELSE text END || chr(10) || 'Found in vain:' || chr(10) || CASE WHEN turn % 3 = 0 THEN 'No documents were retrieved.'
ELSE array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: '[' || i || '] Title: ' || CASE WHEN turn % 3 = 1 THEN role WHEN i % 2 = 1 THEN 'f' || i ELSE 'unknown' END || chr(10) || 'Preview: ' || replace(left(x || chr(10) || text, 250), chr(10), ' ')), chr(10) || chr(10)) END AS request FROM conversations""")
def rewrite_requests(spark, sf_dir):
    """LM08: what a rewriter is asked for every turn: the question, the last search, and the beginnings of what it found."""
    t = F.col("turn")
    none = F.lit(None).cast("string")
    found = F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.when(t % 3 == 1, F.col("role")).otherwise("").alias("title"), F.when(i % 2 == 0, F.concat(F.lit("f"), (i + 1).cast("string"))).alias("file_name"), none.alias("source"), F.concat(x, F.lit("\n"), F.col("text")).alias("content")))
    contexts = F.when(t % 3 == 0, F.slice(found, 1, 0)).otherwise(found)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", styles.rewrite_request(F.col("text"), F.when(t % 2 == 0, F.col("role")), contexts).alias("request"))


SUBS = ("What is the net income?", "Which patents exist", "  ", "what is the net income of it", "Is there a lawsuit in court?!", "WHICH PATENTS EXIST", "List the board members")
_SUB = picked(SUBS, "conv_id * 2 + turn + pos * 3")
_PLANS = ORACLE_SQL["question_plans"]
_CTES = _PLANS[: _PLANS.index("\nSELECT conv_id, turn, pos::BIGINT AS pos, sub AS subquestion")]


@query(f"""{_CTES},
told AS (SELECT conv_id, turn, pos, {_clean(_SUB)} AS sub, CASE WHEN pos % 2 = 0 THEN 'sql' END AS mr FROM conversations, range(0, 3) AS r(pos) WHERE {_clean(_SUB)} <> ''),
once AS (SELECT *, lower(sub) AS lx, {_meaning('sub')} AS m FROM told QUALIFY row_number() OVER (PARTITION BY conv_id, turn, lower(sub) ORDER BY pos) = 1),
near AS (SELECT DISTINCT a.conv_id, a.turn FROM once a JOIN once b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.pos < b.pos WHERE len(a.m) > 0 AND len(b.m) > 0 AND len(list_intersect(a.m, b.m))::DOUBLE / len(list_distinct(list_concat(a.m, b.m))) >= 0.6),
good AS (SELECT conv_id, turn FROM once SEMI JOIN (SELECT conv_id, turn FROM d WHERE multi) USING (conv_id, turn) ANTI JOIN near USING (conv_id, turn) GROUP BY ALL HAVING count(*) >= 2)
SELECT conv_id, turn, pos::BIGINT AS pos, sub AS subquestion, coalesce(mr, {_routes('lx', 'cx')}) AS route, 'multi' AS plan FROM (SELECT *, {"regexp_matches(sub, " + quoted('(?i)' + '|'.join(f'(?:{p})' for p in fixed.COMPARISONS)) + ")"} AS cx FROM once) SEMI JOIN good USING (conv_id, turn)
UNION ALL SELECT conv_id, turn, pos, subquestion, route, plan FROM ({_PLANS}) ANTI JOIN good USING (conv_id, turn)""")
def planned_questions(spark, sf_dir):
    """J13, LM06, Q04: a model's plans for every turn, taken where they hold, else the rules' own."""
    c = table(spark, sf_dir, "conversations")
    qid = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("qid")
    asked = questions_of(spark, sf_dir).select(qid, F.col("q").alias("question"))
    pos = F.col("pos")
    told = c.select("conv_id", "turn", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("pos")).select(qid, "pos", pick(SUBS, F.col("conv_id") * 2 + F.col("turn") + pos * 3).alias("subquestion"), F.when(pos % 2 == 0, "sql").alias("route"))
    key = lambda i: F.split_part("qid", F.lit("/"), F.lit(i)).cast("long")
    return planner.planned(asked, told).select(key(1).alias("conv_id"), key(2).alias("turn"), "pos", "subquestion", "route", "plan")


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'multi' ELSE 'single' END AS plan_type, CASE WHEN turn % 2 = 0 THEN 'tier_2' WHEN turn % 5 = 1 THEN 'tier_0' ELSE 'tier_1' END AS tier, CASE WHEN role = 'user' THEN 2 ELSE 1 END::BIGINT AS retrieved_context_count, 'hierarchical' AS chunking_strategy FROM conversations""")
def finalized_results(spark, sf_dir):
    """Results with their tier and distinct contexts: the same page under two numbers counts once."""
    t, r = F.col("turn"), F.col("role")
    page = lambda n, url: F.concat(F.lit(f"[Document {n}] a\nURL: http://x/"), url, F.lit(" z"))
    contexts = F.array(page(1, F.lit("p")), page(2, F.when(r == "user", F.lit("q")).otherwise("p")), page(3, F.lit("p")))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(t % 2 == 0, "multi").alias("plan_type"), F.when(t % 5 == 1, "llm_direct").otherwise("sql").alias("final_route"), contexts.alias("contexts"))
    return evidence.finalized(c, True, True).select("conv_id", "turn", "plan_type", "tier", "retrieved_context_count", "chunking_strategy")
