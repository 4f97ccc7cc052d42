"""Secret scan with a random forest that removes false positives.

Candidates are runs of 16 or more key characters with a digit among them; a name and ``=`` that lead the run
(``api_key=...``) are not part of the value, but a neighbouring word of it. Features: length, character
transitions, how much of it dictionary words cover, character classes, path signs of the value and of the word
around it, and the neighbouring words. The dictionary is the corpus's own: the ``DICTIONARY`` words that stand in
most documents (counted over all of them; a stated bound, so it may be broadcast), and a few that fill names.
A random forest (MLlib) trained from labelled findings tells secrets from commit ids, checksums, numbers, paths
and the like. Only DataFrame functions and MLlib run, all on the JVM. ``kept`` trains once and stores forest and
dictionary, for scans of later arrivals.

Labelled findings: a table (value, before2, before, after, label), or, by default, ``labelled_findings``:
``LABELLED`` generated examples, a documented bound that does not grow with the corpus.

Edges: null or empty text has no candidates; any length works; every candidate of a word is told by its
place (word, and place within the word); repeated rows give repeated findings; an empty table gives none.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.workspace import filesystem
from .common import settle, text_or_empty

LABELLED = 6000
TREES, DEPTH, SEED = 24, 7, 17
KEY = "A-Za-z0-9+/_=\\\\-"
_HAS = f"(?<![{KEY}])(?=[A-Za-z+/_=\\\\-]*+[0-9])[{KEY}]{{16,}}"
# what names the value in a run: all up to the last = that eight characters or more follow, with a digit
_NAMED = "^.*=(?=[^=0-9]*[0-9])(?=[^=]{8,}=*$)"
DICTIONARY, LEAST_DOCS = 20_000, 3
# Words that speak for and against a secret beside a value, and words that fill names.
SECRET_WORDS = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "key", "auth", "bearer", "credential", "private", "access")
PLAIN_WORDS = ("commit", "sha", "sha1", "sha256", "md5", "hash", "checksum", "digest", "uuid", "guid", "id", "isbn", "version", "rev", "revision", "file", "path", "url", "http", "https", "see", "order", "card", "number", "phone", "page")
NAME_WORDS = ("test", "example", "sample", "data", "file", "image", "model", "train", "value", "user", "name", "index", "table", "config", "module", "class", "version", "project", "report", "final", "draft", "page", "article", "the", "and", "for", "with", "from", "this", "that")
FEATURES = ("length", "transitions", "dictionary", "digits", "capitals", "distinct", "hex", "slashes", "path", "joints", "assigned", "quoted", "said_secret", "said_plain")


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, word_at, nth, value, word, before2, before, after: one row per candidate."""
    t = docs.select("doc_id", text_or_empty().alias("body")).where(F.expr(f"body rlike '{_HAS}'"))
    t = t.select("doc_id", F.split("body", r"[\x20\x09-\x0D]+").alias("words"))
    near = "struct(i as word_at, w as word, coalesce(get(words, i - 2), '') as before2, coalesce(get(words, i - 1), '') as before, coalesce(get(words, i + 1), '') as after)"
    t = t.select("doc_id", F.explode(F.expr(f"filter(transform(words, (w, i) -> if(w rlike '{_HAS}', {near}, null)), x -> x is not null)")).alias("x")).select("doc_id", "x.*")
    return t.select("doc_id", "word_at", F.posexplode(F.expr(f"transform(regexp_extract_all(word, '({_HAS})', 1), x -> regexp_replace(x, '{_NAMED}', ''))")).alias("nth", "value"), "word", "before2", "before", "after")


def _any(words: tuple[str, ...]) -> str:
    return "(^|[^a-z0-9])(" + "|".join(words) + ")([^a-z0-9]|$)"


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> DataFrame:
    """word: the words (letters alone, three or more) that stand in most documents, at least LEAST_DOCS, and NAME_WORDS."""
    words = F.filter(F.split(F.lower(text_or_empty()), r"[\x20\x09-\x0D]+"), lambda w: w.rlike(r"^\p{Punct}*\p{L}{3,16}\p{Punct}*$"))
    each = docs.select(F.explode(F.array_distinct(F.transform(words, lambda w: F.regexp_replace(w, r"\p{Punct}+", "")))).alias("word"))
    most = each.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_DOCS).orderBy(F.desc("n"), "word").limit(size).select("word")
    return most.union(docs.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, NAME_WORDS))))).distinct()


def _covered(c: DataFrame, words: DataFrame) -> DataFrame:
    """Adds ``dictionary``: the share of the value's characters in runs of letters that are words (a capital begins one)."""
    spaced = F.lower(F.regexp_replace(F.regexp_replace("value", r"(?<=[a-z])(?=[A-Z])", " "), r"[^A-Za-z]+", " "))
    runs = F.filter(F.split(spaced, " "), lambda x: F.length(x) >= 3)
    rows = c.withColumn("_row", F.monotonically_increasing_id())
    hits = rows.select("*", F.explode_outer(runs).alias("_run")).join(F.broadcast(words.withColumnRenamed("word", "_run").withColumn("_in", F.lit(1))), "_run", "left")
    share = F.coalesce(F.sum(F.when(F.col("_in") == 1, F.length("_run"))), F.lit(0)) / F.length(F.first("value"))
    others = [x for x in c.columns]
    return hits.groupBy("_row").agg(*(F.first(x).alias(x) for x in others), share.alias("dictionary")).drop("_row")


def with_features(c: DataFrame, words: DataFrame) -> DataFrame:
    """Adds FEATURES; needs value, word, before2, before, after."""
    c = _covered(c, words)
    n = F.length("value").cast("double")
    near = F.lower(F.concat_ws(" ", "before2", "before", F.expr("left(word, greatest(0, locate(value, word) - 1))")))
    kinds = F.expr("regexp_replace(regexp_replace(regexp_replace(regexp_replace(value, '[a-z]+', 'l'), '[A-Z]+', 'U'), '[0-9]+', '9'), '[^lU9]+', '.')")
    count = lambda p: F.expr(f"regexp_count(value, '{p}')") / n
    lead = F.expr("concat(before, ' ', left(word, greatest(0, locate(value, word) - 1)))")
    return c.withColumns({
        "length": n,
        "transitions": (F.length(kinds) - 1) / n,
        "digits": count("[0-9]"),
        "capitals": count("[A-Z]"),
        "distinct": F.size(F.array_distinct(F.split("value", ""))) / n,
        "hex": F.col("value").rlike("^[0-9a-fA-F]+$").cast("double"),
        "slashes": count("/"),
        "path": F.expr("regexp_count(word, '[/\\\\\\\\]')") / F.length("word") + F.col("word").rlike(r"[A-Za-z0-9_-]\.[a-z]{2,4}\W*$").cast("double"),
        "joints": count("[_\\\\-]"),
        "assigned": lead.rlike("[=:]\\s*[\"']?\\s*$").cast("double"),
        "quoted": F.col("word").rlike("[\"'`]").cast("double"),
        "said_secret": near.rlike(_any(SECRET_WORDS)).cast("double"),
        "said_plain": near.rlike(_any(PLAIN_WORDS)).cast("double"),
    })


def labelled_findings(spark: SparkSession, first: int = 0, n: int = LABELLED) -> DataFrame:
    """Generated examples (half of them secrets), the same for the same ids. Neither a secret word nor an
    assignment tells the label alone: secrets stand bare in prose, behind a word, or as ``name=value``, and what
    is none stands behind secret words and in assignments too."""
    pick = lambda words, salt: f"element_at(array({', '.join(repr(w) for w in words)}), 1 + cast(pmod(xxhash64(id, {salt}), {len(words)}) as int))"
    hexes = "sha2(cast(id * 7919 + 13 as string), 256)"
    b64 = f"base64(unhex({hexes}))"
    num = "lpad(cast(pmod(xxhash64(id, 5), 10000000000000000) as string), 16, '4')"
    letters = f"translate({hexes}, '0123456789', 'ghijklmnop')"
    prose = ("the", "of", "and", "was", "thing", "over", "le", "der", "los", "with", "from,", "et", "to")
    positive = f"""case kind % 7
        when 0 then left({hexes}, 40) when 1 then left({hexes}, 32) when 2 then left(translate({b64}, '=', 'x'), 40)
        when 3 then concat('AKIA', upper(left({hexes}, 16))) when 4 then concat('ghp_', left(translate({b64}, '+/=', 'abc'), 36))
        when 5 then concat('sk-', left(translate({b64}, '+/=', 'xyz'), 32)) else concat(left({letters}, 6), pmod(id, 97), substring({letters}, 9, 5 + pmod(id, 5)), pmod(id, 89)) end"""
    negative = f"""case kind % 8
        when 0 then left({hexes}, 40) when 1 then {hexes} when 2 then {num}
        when 3 then regexp_replace(left({hexes}, 32), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})', '$1-$2-$3-$4-')
        when 4 then concat({pick(NAME_WORDS, 2)}, '_', {pick(NAME_WORDS, 3)}, '_', {pick(NAME_WORDS, 4)}, '_v', pmod(id, 90))
        when 5 then concat({pick(NAME_WORDS, 2)}, '/', {pick(NAME_WORDS, 3)}, '/', {pick(NAME_WORDS, 4)}, '/', pmod(id, 999))
        when 6 then concat(repeat(cast(pmod(id, 10) as string), 16), pmod(id, 7)) else concat({pick(NAME_WORDS, 2)}, '-', {pick(NAME_WORDS, 3)}, '-', {pick(NAME_WORDS, 4)}, '-20', lpad(pmod(id, 30), 2, '0')) end"""
    cased = "case pmod(xxhash64(id, 17), 6) when 0 then upper(value) when 1 then replace(initcap(translate(value, '_-', '  ')), ' ', '') else value end"
    secret, plain, sign = pick(SECRET_WORDS, 6), pick(PLAIN_WORDS, 8), pick(("=", "=", ":"), 18)
    quote = "if(pmod(xxhash64(id, 9), 3) = 0, '', '\"')"
    t = spark.range(first, first + n).selectExpr("id", "cast(pmod(id, 2) as double) as label", "cast(pmod(xxhash64(id, 1), 56) as int) as kind", "cast(pmod(xxhash64(id, 15), 5) as int) as form")
    t = t.selectExpr("*", f"if(label = 1, {positive}, {negative}) as value").withColumn("value", F.expr(f"if(label = 1, value, {cased})"))
    # secrets, form 0 to 2: word and sign before; 3: name=value; 4: bare, of a shape that shows it, or else behind a word
    # others, form 0 and 1: in prose or behind a plain word; 2 and 3: a secret word is near; 4: name=value
    named = f"if(label = 0 and kind % 8 not in (4, 5, 7), {plain}, {secret})"
    return t.selectExpr(
        "label", "value",
        f"""case when form = if(label = 1, 3, 4) then concat({named}, {sign}, value) when label = 1 and form = 4 then value
            when label = 1 then concat({quote}, value, {quote}) else if(pmod(xxhash64(id, 10), 3) = 0, concat({quote}, value, {quote}), value) end as word""",
        f"if(if(label = 1, form < 3, form in (2, 3)), {secret}, {pick(prose, 6)}) as before2",
        f"""case when form = if(label = 1, 3, 4) then {pick(prose, 13)}
            when label = 1 and form < 3 then {pick(('=', ':', '=', ':='), 7)} when label = 1 then if(kind % 7 in (0, 1, 6), {secret}, {pick(prose, 13)})
            when form in (2, 3) or pmod(xxhash64(id, 11), 2) = 0 then concat({plain}, {pick(('', ':', ''), 12)}) else {pick(prose, 13)} end as before""",
        f"{pick(prose, 14)} as after",
    )


def train(labelled: DataFrame, words: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> RandomForestClassificationModel:
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep").transform(with_features(labelled, words)).select("features", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows)


def score(found: DataFrame, model: RandomForestClassificationModel, words: DataFrame) -> DataFrame:
    """Adds p_secret and is_secret to candidates."""
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep").transform(with_features(found, words))
    p = F.round(vector_to_array("probability")[1], 6)
    return model.transform(rows).withColumn("p_secret", p).withColumn("is_secret", F.col("p_secret") >= 0.5).select(*found.columns, *FEATURES, "p_secret", "is_secret")


def trained(docs: DataFrame, labelled: DataFrame | None = None) -> tuple[RandomForestClassificationModel, DataFrame]:
    """The forest, and the dictionary that its features are taken with."""
    words = settle(dictionary(docs), "dictionary", 1)
    return train(labelled_findings(docs.sparkSession) if labelled is None else labelled, words), words


def kept(docs: DataFrame, path: str, labelled: DataFrame | None = None) -> tuple[RandomForestClassificationModel, DataFrame]:
    """As ``trained``, but stored below ``path``: what an earlier call has stored there is read and nothing is trained.
    The forest is written last, so one that is there is whole and has its dictionary."""
    spark = docs.sparkSession
    fs, make = filesystem(spark, path)
    forest, words = f"{path}/forest", f"{path}/dictionary"
    if not fs.exists(make(f"{forest}/treesMetadata/_SUCCESS")):
        model, known = trained(docs, labelled)
        known.coalesce(1).write.mode("overwrite").parquet(words)
        model.write().overwrite().save(forest)
    return RandomForestClassificationModel.load(forest), spark.read.schema("word string").parquet(words)


def scan(docs: DataFrame, labelled: DataFrame | None = None, fitted: tuple[RandomForestClassificationModel, DataFrame] | None = None) -> DataFrame:
    """doc_id, word_at, nth, value_sha256, n_chars, p_secret, is_secret of every candidate of every text. fitted: what
    ``trained`` or ``kept`` gave; by default a forest is trained here."""
    model, words = fitted or trained(docs, labelled)
    got = score(candidates(docs), model, words)
    return got.select("doc_id", F.col("word_at").cast("long").alias("word_at"), F.col("nth").cast("long").alias("nth"), F.sha2("value", 256).alias("value_sha256"), F.length("value").cast("long").alias("n_chars"), "p_secret", "is_secret")
