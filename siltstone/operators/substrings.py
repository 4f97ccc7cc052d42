"""Which texts contain which others, by an inverted index of trigrams.

Every text is broken up into its distinct runs of three characters. A text that contains a pattern has all the pattern's
trigrams, so it is enough to look under one of them: the rarest, by counts over the texts of the trigrams that some pattern
asks for. What is found there is verified. A pattern of one or two characters is looked up under itself among the texts'
runs of that length, and needs no verification. Only trigrams and keys travel to find candidates; no side is compared with
all of the other.

Null and empty patterns are in no text, null texts contain nothing; equal patterns are looked up once; comparison is by
code points, so a caller lowers letters first if they are not to matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import settled

GRAM = 3


def grams(text: Column, length: Column | int = GRAM) -> Column:
    """The distinct runs of ``length`` characters; a run per place, each read in constant time from the characters."""
    n = F.lit(length) if isinstance(length, int) else length
    chars = F.split(text, "")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(chars) - n + 1)), lambda i: F.array_join(F.slice(chars, i, n), ""))
    return F.when(F.length(text) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def containing(patterns: DataFrame, texts: DataFrame, pattern: str, text: str) -> DataFrame:  # J09, P05
    """pattern, text: every distinct pattern with every distinct text that contains it."""
    asked = settled(patterns.select(F.col(pattern).cast("string").alias("pattern")).where("pattern <> ''").distinct(), "patterns")
    known = settled(texts.select(F.col(text).cast("string").alias("text")).where("text <> ''").distinct(), "texts")
    size = F.least(F.length("pattern"), F.lit(GRAM))
    wanted = settled(asked.select("pattern", F.explode(grams(F.col("pattern"), size)).alias("gram")), "pattern-grams")
    sizes = [r[0] for r in wanted.select(F.length("gram")).distinct().collect()]  # at most 1, 2 and 3
    runs = F.array_distinct(F.flatten(F.array(*(grams(F.col("text"), n) for n in sorted(sizes))))) if sizes else F.array().cast("array<string>")
    # postings of the asked trigrams alone
    postings = settled(known.select("text", F.explode(runs).alias("gram")).join(wanted.select("gram").distinct(), "gram", "left_semi"), "trigrams")
    counts = postings.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = wanted.join(counts, "gram", "left").groupBy("pattern").agg(F.min_by(F.struct("gram", "n"), F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("best"))
    rarest = rarest.where("best.n is not null").select("pattern", F.col("best.gram").alias("gram"))  # a trigram that no text has ends it
    return rarest.join(postings, "gram").where((F.length("pattern") < GRAM) | F.col("text").contains(F.col("pattern"))).select("pattern", "text")
