"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from .common import documents, scratch


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies; SILTSTONE_TOKENIZERS names another folder."""
    folder = os.environ.get("SILTSTONE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def _compacted(spark: SparkSession, sf_dir: str):
    from .shards import ShardTable

    shards = ShardTable(spark, scratch(spark, "sharded"))
    shards.append(documents(spark, sf_dir))
    shards.compact()
    shards.vacuum(stale_s=0)  # no other writer knows this table
    return shards


def op1_size_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row as the committed manifest's shards hold it."""
    from pyspark.sql import functions as F

    rows = _compacted(spark, sf_dir).read()
    return rows.select("doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def shard_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the committed manifest says: rows in all, whether its shards' rows are those that are read, and whether no tier
    is left to merge that becomes fewer files."""
    from pyspark.sql import functions as F

    table = _compacted(spark, sf_dir)
    version, shards, _ = table.manifest()
    said = spark.createDataFrame([(s.path.rsplit("/", 1)[1], s.rows) for s in shards], "file string, rows long")
    read = table.read().groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("found"))
    both = read.join(said, "file", "full").agg(F.sum("rows").alias("n_rows"), F.coalesce(F.bool_and(F.col("rows").eqNullSafe(F.col("found"))), F.lit(True)).alias("rows_match"))
    return both.withColumn("compacted", F.lit(table.compact() == version))


def op2_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_ledger import apply_policy, ledger

    return apply_policy(ledger(documents(spark, sf_dir)))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_ledger import ablations, ledger

    return ablations(ledger(documents(spark, sf_dir)))


def op3_n_best_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .piece_lattice import encode

    return encode(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(documents(spark, sf_dir)).drop("row", "kept")


def op5_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ogg_media import media_column, media_digest

    return media_digest(media_column(documents(spark, sf_dir)))


def op6_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(documents(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken"))


def op7_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import identifier_digest

    return identifier_digest(documents(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_count import token_counts

    return token_counts(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op9_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan

    return scan(documents(spark, sf_dir))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(documents(spark, sf_dir))


def op11_block_anchor_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .block_anchors import remove_passages

    return remove_passages(documents(spark, sf_dir))


def op12_annular_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import coded

    return coded(table(spark, sf_dir, "embeddings"))


def op13_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sort_means import clustered

    return clustered(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_size_tiered_shards, shard_manifest, op2_quality_ledger, quality_ablations, op3_n_best_pieces, op4_jaccard_join, op5_ogg_media, op6_sum_of_squares_packing, op7_contextual_pii, op8_token_counts, op9_secret_forest, op10_suffix_array_dedup, op11_block_anchor_passages, op12_annular_vector_codes, op13_sort_means)}

_LEDGER = r"""
w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
      list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, i, list_slice(words, i, i + 4) AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
      coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines, length(regexp_replace(text, '[^\p{Lu}]', '', 'g'))::BIGINT AS n_upper,
      len(regexp_extract_all(text, '!!'))::BIGINT AS n_shouts, length(regexp_replace(text, '[^\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]', '', 'g'))::BIGINT AS n_unspaced,
      len(list_filter(lines, lambda l: regexp_matches(l, '^[\x20\x09-\x0D]*[-*\x{2022}]')))::BIGINT AS n_bullets, len(list_filter(lines, lambda l: regexp_matches(l, '(\.\.\.|\x{2026})[\x20\x09-\x0D]*$')))::BIGINT AS n_ellipses FROM w LEFT JOIN cover USING (doc_id)),
led AS (SELECT *, ((n_words < 10)::BIGINT + (100 * n_repeat_words > 20 * n_words)::BIGINT * 2 + (10 * n_symbols > n_words)::BIGINT * 4
      + (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines)::BIGINT * 8 + (100 * n_upper > 40 * word_chars)::BIGINT * 16
      + (10 * n_shouts > n_words)::BIGINT * 32 + (word_chars > 15 * n_words AND 4 * n_unspaced < word_chars)::BIGINT * 64
      + (word_chars < 2 * n_words)::BIGINT * 128 + (n_lines >= 3 AND 10 * n_bullets > 9 * n_lines)::BIGINT * 256 + (n_lines >= 3 AND 10 * n_ellipses > 3 * n_lines)::BIGINT * 512) AS fail_bits FROM m)"""

#: The squared distance of two lists of integers, and the floor of a quotient.
_SQUARED = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: ({0}[i] - {1}[i]) * ({0}[i] - {1}[i])))::BIGINT"
_FLOOR = "((sum({0}) - ((sum({0}) % {1}) + {1}) % {1}) // {1})::BIGINT"


def _codes_sql(scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    steps = [f"""k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
f"p AS MATERIALIZED (SELECT vec_id, m, list_slice(v, m * (len(v) // {parts}) + 1, (m + 1) * (len(v) // {parts})) AS x FROM k, range({parts}) AS t(m))",
f"b0 AS MATERIALIZED (SELECT m, row_number() OVER (PARTITION BY m ORDER BY vec_id) - 1 AS e, x AS c FROM p QUALIFY e < {entries})"]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, m, any_value(x) AS x, min({_SQUARED.format('x', 'c')} * {entries} + e) AS de FROM p JOIN b{r} USING (m) GROUP BY vec_id, m)")
        if r < rounds:
            steps.append(f"s{r} AS MATERIALIZED (SELECT m, e, list(y ORDER BY i) AS c FROM (SELECT m, de % {entries} AS e, i, {_FLOOR.format('x[i]', 'count(*)')} AS y FROM a{r}, range(1, len(x) + 1) AS t(i) GROUP BY ALL) GROUP BY m, e)")
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT b.m, b.e, coalesce(s.c, b.c) AS c FROM b{r} AS b LEFT JOIN s{r} AS s ON s.m = b.m AND s.e = b.e)")
    steps.append(f"f AS (SELECT vec_id, string_agg(printf('%02x', de % {entries}), '' ORDER BY m) AS code, sum(de // {entries})::BIGINT AS error FROM a{rounds} GROUP BY vec_id)")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY m, e)) FROM b{rounds}) AS codebooks_sha256 FROM f JOIN k USING (vec_id)"""


def _means_sql(scale: int = 256, dimensions: int = 64, centroids: int = 40, rounds: int = 5, seed: str = "2:") -> str:
    steps = [f"""k AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}' || vec_id)) - 1 AS e, x AS c FROM k QUALIFY e < {centroids})"]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(x) AS x, min({_SQUARED.format('x', 'c')} * {centroids} + e) AS de FROM k, c{r} GROUP BY vec_id)")
        if r < rounds:
            steps.append(f"s{r} AS MATERIALIZED (SELECT e, list(y ORDER BY i) AS c FROM (SELECT de % {centroids} AS e, i, {_FLOOR.format('x[i]', 'count(*)')} AS y FROM a{r}, range(1, {dimensions + 1}) AS t(i) GROUP BY ALL) GROUP BY e)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT b.e, coalesce(s.c, b.c) AS c FROM c{r} AS b LEFT JOIN s{r} AS s ON s.e = b.e)")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, (de % {centroids})::INTEGER AS cluster, (de // {centroids})::BIGINT AS distance, (sum(de // {centroids}) OVER (PARTITION BY de % {centroids}))::BIGINT AS cluster_inertia,
       (sum(de // {centroids}) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON e = de % {centroids}"""


ORACLE_SQL: dict[str, str] = {
    "op11_block_anchor_passages": r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 19), ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w)),
again AS (SELECT doc_id, i FROM g QUALIFY row_number() OVER (PARTITION BY gram ORDER BY doc_id, i) > 1),
gone AS (SELECT doc_id, list(DISTINCT i + k) AS places FROM again, range(20) AS t(k) GROUP BY doc_id),
kept AS (SELECT doc_id, words, list_filter(words, lambda x, i: places IS NULL OR NOT list_contains(places, i)) AS stay FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - len(stay))::BIGINT AS n_removed, sha256(array_to_string(stay, ' ')) AS kept_sha256 FROM kept""",
    "op12_annular_vector_codes": _codes_sql(),
    "op13_sort_means": _means_sql(),
    "op1_size_tiered_shards": "SELECT doc_id, lang, source, n_chars, strlen(text)::BIGINT AS n_bytes, sha256(text) AS text_sha256 FROM documents",
    "shard_manifest": "SELECT count(*) AS n_rows, true AS rows_match, true AS compacted FROM documents",
    "op2_quality_ledger": f"""WITH {_LEDGER}
SELECT *, (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 1023) = 0 AS kept, 4::INTEGER AS policy_version,
       (CASE WHEN bit_count(fail_bits) = 1 THEN fail_bits ELSE 0 END)::BIGINT AS decisive_bits FROM led""",
    "quality_ablations": f"""WITH {_LEDGER},
p(policy_version, mask) AS (VALUES (1, 3), (2, 7), (3, 127), (4, 1023)),
r(rule, bit) AS (VALUES ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('repeated_lines', 8), ('capitals', 16), ('shouts', 32), ('long_words', 64), ('short_words', 128), ('bullets', 256), ('ellipses', 512))
SELECT policy_version, rule, count(fail_bits)::BIGINT AS n_docs, count(*) FILTER ((fail_bits & mask) = 0)::BIGINT AS n_kept,
       count(*) FILTER ((fail_bits & bit) <> 0)::BIGINT AS n_failing, count(*) FILTER ((fail_bits & mask & ~bit) = 0)::BIGINT AS n_kept_without
FROM p JOIN r ON (mask & bit) <> 0 LEFT JOIN led ON true GROUP BY ALL""",
}
