"""Language-model steps are injected functions. The defaults here are deterministic, need no network, and make
no claim to give what a model would."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import lexical_overlap
from ..functions.text import normalize_whitespace, tokens

DIMENSIONS = 64
EMBED_BATCH = 96


def hashed_embedding(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """A signed bag of hashed words as an array of floats: built-in functions only."""
    words = tokens(text)
    zero = F.array_repeat(F.lit(0.0), dimensions)
    add = lambda v, w: F.transform(v, lambda x, i: x + F.when(F.pmod(F.xxhash64(w), F.lit(dimensions)) == i, F.when(F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0)).otherwise(0.0))
    return F.aggregate(words, zero, add).cast("array<float>")


def first_sentences(texts: Column, limit: int = 400) -> Column:
    """The first sentence of each text, joined and cut."""
    firsts = F.transform(texts, lambda t: F.regexp_extract(normalize_whitespace(t), r"^(.*?[.!?])(?:\s|$)|^(.*)$", 0))
    return F.left(F.array_join(firsts, " "), F.lit(limit))


def overlap_grade(question: Column, chunk: Column, least: float = 0.2) -> Column:
    return lexical_overlap(tokens(question), tokens(chunk)) >= least


def extractive_answer(question: Column, contexts: Column) -> Column:
    """The context that shares most words with the question, whose words are taken once."""
    scored = lambda q: F.transform(contexts, lambda c, i: F.named_struct(F.lit("s"), lexical_overlap(q, tokens(c)), F.lit("o"), -i, F.lit("c"), c))
    best = F.transform(F.array(F.array_distinct(tokens(question))), lambda q: F.array_max(scored(q))["c"])
    return F.coalesce(F.get(best, F.lit(0)), F.lit(""))


def batched(df: DataFrame, column: str, call: Callable[[list[str]], list], out: str, kind: str, batch: int = EMBED_BATCH) -> DataFrame:  # LM01, LM12
    """A remote model over a column, at most ``batch`` texts a call, inside Arrow batches on the executors."""
    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts, got = f[column].tolist(), []
            for i in range(0, len(texts), batch):
                got.extend(call(texts[i : i + batch]))
            f[out] = got
            yield f

    return df.mapInPandas(run, ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes), f"{out} {kind}"]))


def with_retries(models: list[Callable], tries: int = 3, cool_down: float = 0.0, sleep: Callable[[float], None] | None = None) -> Callable:  # LM03
    """The first model that answers; each is tried with waits of 2, 4, 8 seconds at most before the next."""
    import time

    wait = sleep or time.sleep

    def call(*args):
        last: Exception | None = None
        for model in models:
            for n in range(1, tries + 1):
                try:
                    out = model(*args)
                    if cool_down:
                        wait(cool_down)
                    return out
                except Exception as e:  # noqa: BLE001 - any failure of a remote model leads to the next try
                    last = e
                    if n < tries:
                        wait(min(2**n, 8))
        raise RuntimeError("no model answered") from last

    return call


def no_web(question: str) -> list[str]:  # LM10
    return []


@dataclass(frozen=True)
class Models:
    """What an engine asks of models; each is replaceable."""

    embed: Callable[[Column], Column] = hashed_embedding  # LM01, LM02
    summarize: Callable[[Column], Column] = first_sentences  # LM03
    grade: Callable[[Column, Column], Column] = overlap_grade  # Q07, Q08
    generate: Callable[[Column, Column], Column] = extractive_answer  # LM07, LM09, LM11
    rewrite: Callable[[Column], Column] = normalize_whitespace  # LM08
    nl2sql: Callable[[str], str] | None = None  # LM04
    web: Callable[[str], list[str]] = no_web
    judge: Callable[[str], dict] | None = None  # E06, E07
    extra: dict = field(default_factory=dict)
