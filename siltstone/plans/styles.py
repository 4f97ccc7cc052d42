"""What models are told besides their task: the style of an answer, and what a search has found in vain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import any_in


def style(question: Column, kind: Column) -> Column:  # LM07, LM09
    """yes_no, bullets (at most; 0: prose), most_words of a question's answer. kind: answer, direct (no documents) or merged."""
    low = F.trim(F.lower(question))
    yes_no = F.lit(False)
    for start in fixed.YES_NO:
        yes_no = yes_no | low.startswith(start)
    several = F.when(kind == "merged", any_in(low, fixed.SEVERAL_MERGED)).when(kind == "direct", False).otherwise(any_in(low, fixed.SEVERAL))
    words = F.lit(fixed.MOST_WORDS["answer"])
    for k in ("direct", "merged"):
        words = F.when(kind == k, fixed.MOST_WORDS[k]).otherwise(words)
    return F.struct(yes_no.alias("yes_no"), F.when(several, fixed.MOST_BULLETS).otherwise(0).alias("bullets"), words.alias("most_words"))


def instructions(s: Column) -> Column:
    """A style as lines of a prompt."""
    return F.concat_ws(
        "\n",
        F.lit("Answer at once, without headings, and do not say the question again."),
        F.when(s["yes_no"], "Begin with Yes. or No. if the evidence allows it."),
        F.concat(F.lit("At most "), s["most_words"].cast("string"), F.lit(" words.")),
        F.when(s["bullets"] > 0, F.concat(F.lit("One sentence, then at most "), s["bullets"].cast("string"), F.lit(" bullets."))).otherwise("Prose in one paragraph."),
    )


def failed_contexts(contexts: Column) -> Column:  # LM08
    """What was found in vain, as a rewriter sees it: a number, the first name there is, and the beginning of the text.
    contexts: arrays of (title, file_name, source, content)."""
    named = lambda x: F.coalesce(*(F.nullif(x[c], F.lit("")) for c in ("title", "file_name", "source")), F.lit("unknown"))
    one = lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] Title: "), named(x), F.lit("\nPreview: "), F.replace(F.left(F.coalesce(x["content"], F.lit("")), F.lit(fixed.PREVIEW)), F.lit("\n"), F.lit(" ")))
    return F.when(F.size(contexts) > 0, F.array_join(F.transform(contexts, one), "\n\n")).otherwise("No documents were retrieved.")


def rewrite_request(question: Column, previous: Column, contexts: Column) -> Column:  # LM08
    """What a model is asked that rewrites a question whose search failed."""
    return F.concat(F.lit("Question: "), question, F.lit("\nSearched for: "), F.coalesce(previous, question), F.lit("\nFound in vain:\n"), failed_contexts(contexts))
