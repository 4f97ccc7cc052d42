"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once and stores, per document, the measurements and one failure bit per
rule. Policies are versioned bit masks applied to the ledger afterwards: changing a threshold's place in
a policy never rereads a text. Ablations (what would be kept without a rule) are bitwise aggregations.

Everything is DataFrame functions on the JVM and one narrow pass; nothing is shuffled but the few rows
of an ablation report.

Edges: null text has no words (all measurements 0, fails ``few_words``); a null doc_id stays null;
repeated rows give repeated rows; windows are compared by 64-bit hashes of their five words, within one
document only; other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_shouts", "n_unspaced", "n_bullets", "n_ellipses")


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: str  # SQL over the measurements


RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "n_dup_lines >= 3 and 100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "capitals", "100 * n_upper > 40 * word_chars"),
    Rule(5, "shouts", "10 * n_shouts > n_words"),
    Rule(6, "long_words", "word_chars > 15 * n_words and 4 * n_unspaced < word_chars"),
    Rule(7, "short_words", "word_chars < 2 * n_words"),
    Rule(8, "bullets", "n_lines >= 3 and 10 * n_bullets > 9 * n_lines"),
    Rule(9, "ellipses", "n_lines >= 3 and 10 * n_ellipses > 3 * n_lines"),
)
BASE = 0b0000011
#: Versioned policies: a document is kept if none of its failure bits is in the mask.
POLICIES = {1: BASE, 2: BASE | 0b0000100, 3: 0b1111111, 4: 0b1111111111}
CURRENT = 4


def measure(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, MEASURES, and the columns ``carry`` as one struct ``carried``, of every row."""
    carried = [F.struct(*carry).alias("carried")] if carry else []
    t = docs.select("doc_id", text_or_empty().alias("text"), *carried)
    carried = ["carried"] if carry else []
    t = t.withColumn("trimmed", F.expr(r"btrim(text, ' \t\n\u000b\u000c\r')"))
    t = t.select(
        "doc_id",
        F.expr(r"if(trimmed = '', array(), split(trimmed, '[\\x20\\x09-\\x0D]+'))").alias("words"),
        F.expr(r"filter(split(text, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')").alias("lines"),
        F.expr("regexp_count(text, '[#*$%&|<>]')").cast("long").alias("n_symbols"),
        F.expr(r"regexp_count(text, '\\p{Lu}')").cast("long").alias("n_upper"),
        F.expr("regexp_count(text, '!!')").cast("long").alias("n_shouts"),
        F.expr(r"regexp_count(text, '[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsThai}\\p{IsLao}\\p{IsKhmer}\\p{IsMyanmar}]')").cast("long").alias("n_unspaced"),
        *carried,
    )
    hashed = ", ".join(f"words[i + {k}]" for k in range(WINDOW))
    t = t.withColumn("windows", F.expr(f"if(size(words) < {WINDOW}, cast(array() as array<bigint>), transform(sequence(0, size(words) - {WINDOW}), i -> xxhash64({hashed})))"))
    # most texts repeat no window: only the others are sorted
    t = t.withColumn("in_order", F.expr("if(size(array_distinct(windows)) = size(windows), null, sort_array(transform(windows, (h, i) -> struct(h as h, i as i))))"))
    t = t.withColumn("found_again", F.expr("sort_array(transform(filter(in_order, (x, k) -> x.h <=> get(in_order, k - 1).h or x.h <=> get(in_order, k + 1).h), x -> x.i))"))
    covered = F.expr(f"aggregate(found_again, struct(-{WINDOW} as last, 0L as n), (a, p) -> struct(p as last, a.n + least({WINDOW}, p - a.last) as n), a -> a.n)")
    return t.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.expr("cast(size(lines) - size(array_distinct(lines)) as long)").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        "n_upper",
        "n_shouts",
        "n_unspaced",
        F.expr(r"cast(size(filter(lines, l -> l rlike '^[\\x20\\x09-\\x0D]*[-*\u2022]')) as long)").alias("n_bullets"),
        F.expr(r"cast(size(filter(lines, l -> l rlike '(\\.\\.\\.|\u2026)[\\x20\\x09-\\x0D]*$')) as long)").alias("n_ellipses"),
        *carried,
    )


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, carry: tuple[str, ...] = ()) -> DataFrame:
    """Measurements and ``fail_bits`` (bit r set: rule r failed)."""
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, carry).withColumn("fail_bits", bits)


def kept(mask: int) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")) == 0


def apply_policy(led: DataFrame, version: int = CURRENT, policies: dict[int, int] = POLICIES) -> DataFrame:
    """Adds base_failed, kept, policy_version, and ``decisive_bits``: the rule without which the policy
    would keep the document (0: it is kept anyway, or two rules reject it)."""
    mask = policies[version]
    failing = F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long"))
    return (
        led.withColumn("base_failed", ~kept(BASE))
        .withColumn("kept", ~F.col("base_failed") & kept(mask))
        .withColumn("policy_version", F.lit(version))
        .withColumn("decisive_bits", F.when(F.bit_count(failing) == 1, failing).otherwise(F.lit(0)).cast("long"))
    )


def keep_good(docs: DataFrame, version: int = CURRENT) -> DataFrame:
    """The rows of ``docs`` that the policy keeps."""
    judged = apply_policy(ledger(docs, carry=tuple(docs.columns)), version)
    # A filter above plain projections would be pushed down through them, with every measurement written out
    # again wherever it is used, many times over; it does not pass a projection that numbers rows.
    numbered = judged.select("carried", "kept", F.monotonically_increasing_id().alias("nth"))
    return numbered.where("kept and nth >= 0").select("carried.*")


def ablations(led: DataFrame, policies: dict[int, int] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per policy and rule: documents, kept by the policy, failing the rule, and kept once the
    rule is left out. The ledger is first reduced to its distinct bit patterns (at most 2**len(rules))."""
    patterns = led.groupBy("fail_bits").agg(F.count("*").alias("n"))
    spark = led.sparkSession
    rows = ", ".join(f"({v}, {m}L, '{r.name}', {1 << r.bit}L)" for v, m in sorted(policies.items()) for r in rules if m >> r.bit & 1)
    grid = spark.sql(f"SELECT * FROM VALUES {rows} AS t(policy_version, mask, rule, bit)")
    hit = F.expr("fail_bits & mask")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return (
        F.broadcast(grid).join(patterns, F.lit(True), "left")  # both sides are bounded by the rules, not by the data
        .groupBy("policy_version", "rule")
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_docs"),
            total(hit == 0).alias("n_kept"),
            total(F.expr("fail_bits & bit") != 0).alias("n_failing"),
            total(F.expr("fail_bits & mask & ~bit") == 0).alias("n_kept_without"),
        )
    )
