"""Personal data: fixed patterns, and identifiers found by bootstrapped contextual extraction.

The fixed patterns give seed entities. The words to the left and right of a seed, wherever it stands, induce
lexical patterns: one word before, two words before, one word after, one on each side, each with the signs
between it and the value. Places that could hold an identifier (a digit or an ``@``) are recorded with their
contexts in the first pass; a second pass over all texts counts what else stands in the induced patterns.
Patterns and values form a bipartite graph, scored by Spark in turns: a pattern by the share of its distinct
values that are believed, a value by the patterns that hold it. Values in a pattern of high confidence become
spans of the pattern's kind, although no fixed pattern knows them; they are believed from then on and induce
patterns of their own, until a turn brings no new value. A place has a reading for each class of kinds: without
spaces, and for cards and phones with the spaces, dots, hyphens and parentheses between groups of digits.

Edges: null text has no spans; any length works (all scanners take linear time); a null doc_id stays null;
repeated rows give repeated rows; an empty table gives an empty result; other columns are carried only
if asked for.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BITS, files_for, in_blocks, row_numbers, settle

KINDS = ("email", "ip", "card", "phone")
LEAST_SEEDS, SMOOTHING, BELIEVED = 3, 2.0, 0.5
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# possessive: what a run has taken is not tried again from its middle, with the same matches
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_CUE = re.compile(r"(?<![^\W\d_])([^\W\d_]{2,32})\x20{0,2}([:=])\x20{0,2}")
_RUN = re.compile(r"(?<![^\s\"'<>()])[^\s\"'<>()0-9@]*+[0-9@][^\s\"'<>()]*+")
_EDGES = re.compile(r"(\W*)(?:.*\w)?(\W*)", re.S)
_FIRST = re.compile(r"\+?[0-9]+")
_EXTENSION = re.compile(r"\x20?(?:x|ext\.?)\x20?[0-9]{1,6}(?!\w)", re.I)
# how groups of digits go on, and how many digits at most: cards, phones
_GROUPS = ((re.compile(r"[\x20-][0-9]+"), 19), (re.compile(r"[\x20().\-/]{1,3}[0-9]+"), 15))
CLASSES = (0, 0, 1, 2)  # of each kind: a run without spaces, a card, a phone
WORD, WINDOW = 32, 160  # characters of a context's word at most, and around a value where it is looked for


def emails(text: str) -> list[tuple[int, int]]:
    """As the leftmost matches of the address pattern: each ``@`` takes the run of local characters before
    it, as far as the last address allows."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        i = at
        while i > end and text[i - 1] in _LOCAL:
            i -= 1
        if i < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((i, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end), in order."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() < 14:
                continue
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def plain_words(text: str) -> list[str]:
    """Words as contexts know them: small letters, each run of digits as 0, a cue apart from its value."""
    if ":" in text or "=" in text:
        text = _CUE.sub(r"\1\2 ", text)
    return re.sub("[0-9]+", "0", text.lower()).split()


def keys(two: str | None, one: str | None, lead: str, tail: str, after: str | None) -> list[str]:
    """The patterns of a place: the words before it, the signs that touch it, the word after it."""
    out = []
    if one is not None:
        out.append(f"<1 {one} {lead}")
        if two is not None:
            out.append(f"<2 {two} {one} {lead}")
    if after is not None:
        out.append(f">1 {tail} {after}")
        if one is not None:
            out.append(f"<> {one} {lead} {tail} {after}")
    return out


def contexts(text: str, start: int, end: int) -> list[str]:
    """The patterns in which text[start:end] stands. A value that touches letters has none on that side."""
    left, right = text[max(0, start - WINDOW):start], text[end:end + WINDOW]
    if start > WINDOW:
        left = re.sub(r"^\S+", "", left)
    if len(text) > end + WINDOW:
        right = re.sub(r"(?<!\S)\S+$", "", right)
    words = plain_words(left + "\0")
    lead, words = words[-1][:-1], [w if len(w) <= WORD else None for w in words[:-1]]
    if re.search(r"\w", lead):
        lead, words = "", []
    then = plain_words("\0" + right)
    tail, after = then[0][1:], then[1] if len(then) > 1 and len(then[1]) <= WORD else None
    if re.search(r"\w", tail):
        after = None
    one = words[-1] if words else None
    return keys(words[-2] if len(words) > 1 else None, one, lead, tail, after)


def reach(text: str, at: int, stop: int, of: int) -> int:
    """Where groups of digits that begin at ``at`` end, as a card (of = 1) or a phone (2); ``at`` if none does."""
    joint, most = _GROUPS[of - 1]
    m, digits, good = _FIRST.match(text, at, stop), 0, at
    while m:
        digits += sum(c in "0123456789" for c in m[0])
        if digits > most:
            break
        end = m.end()
        if not re.match(r"[\w@]", text[end:end + 1]):
            good = end
        if of == 2 and (x := _EXTENSION.match(text, end, stop)):
            return x.end()
        m = joint.match(text, end, stop)
    return good


def readings(text: str, start: int, end: int, stop: int) -> dict[tuple[int, int], int]:
    """(start, end) of each way to read the place, with a bit for each of CLASSES that reads it so."""
    out = {(start, end): 1}
    for of in (1, 2):
        a, b = start, reach(text, start, stop, of)
        if of == 2 and start and text[start - 1] == "(" and ")" in text[start:b]:
            a -= 1
        at = (a, b) if b > end or (a < start and b >= end) else (start, end)
        out[at] = out.get(at, 0) | 1 << of
    return out


def slots(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int | None, int]]:
    """Places that could hold an identifier: (start, end, kind of the seed or None, bits of the classes that read
    it so), seeds first."""
    out: list[tuple[int, int, int | None, int]] = [(a, b, k, 7) for a, k, b in base]
    over = 0
    taken: list[tuple[int, int]] = []
    for a, _, b in base:
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    for m in _RUN.finditer(text):
        cues = list(_CUE.finditer(m[0])) if ":" in m[0] or "=" in m[0] else []
        for c, st in enumerate([0, *(x.end() for x in cues)]):
            value = m[0][st:cues[c].start() if c < len(cues) else None].rstrip(".,;:!?*$%#&")
            at = m.start() + st
            end = at + len(value)
            if not ("@" in value or _DIGIT.search(value)) or (i := free(taken, at, end)) < 0:
                continue
            if end <= over:  # a later group of a number
                out.append((at, end, None, 1))
                continue
            for (a, b), bits in readings(text, at, end, taken[i][0] if i < len(taken) else len(text)).items():
                out.append((a, b, None, bits))
                over = max(over, b)
    return out


def free(taken: list[tuple[int, int]], start: int, end: int) -> int:
    """Which of the spans (in order, apart from each other) comes next; -1 if start:end meets one."""
    i = bisect_right(taken, (start, 1 << 60))
    return -1 if i and taken[i - 1][1] > start or i < len(taken) and taken[i][0] < end else i


def identifies(value: str) -> bool:
    """Whether an unseen value may be an identifier at all: six characters or more, a digit or an @."""
    return len(value) >= 6 and ("@" in value or _DIGIT.search(value) is not None)


_SPAN = "array<struct<start:int,kind:int,end:int>>"
_SLOT = "array<struct<patterns:array<string>,value:string,start:int,end:int,kind:int,bits:int,fits:boolean>>"


def _scan(docs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """row, doc_id, base (spans), slots, and carried columns."""
    plain = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"), *carry)
    begin = row_numbers(plain)
    kinds = dict(plain.dtypes)
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    slot = pa.list_(pa.struct([("patterns", pa.list_(pa.string())), ("value", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("bits", pa.int32()), ("fits", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = begin()
        for b in batches:
            bases, found = [], []
            for text in b.column(1).to_pylist():
                base = base_spans(text)
                bases.append([{"start": a, "kind": k, "end": e} for a, k, e in base])
                found.append([{"patterns": contexts(text, a, e), "value": text[a:e], "start": a, "end": e, "kind": k, "bits": bits, "fits": k is None and identifies(text[a:e])} for a, e, k, bits in slots(text, base)])
            yield pa.RecordBatch.from_arrays([number(b.column(1)), b.column(0), pa.array(bases, span), pa.array(found, slot), *(b.column(2 + i) for i in range(len(carry)))], names=["row", "doc_id", "base", "slots", *carry])

    return plain.mapInArrow(run, ", ".join(["row long", f"doc_id {kinds['doc_id']}", f"base {_SPAN}", f"slots {_SLOT}", *(f"`{c}` {kinds[c]}" for c in carry)]))


def other_words(texts: Iterator[str], limits: dict[str, int]) -> Iterator[tuple[str, str | None]]:
    """Distinct (pattern, word) of words without a digit or ``@`` that stand in the patterns of ``limits``. A
    pattern with more of them than its limit gives one null instead: it is known to be untrustworthy."""
    live = {p: set() for p in limits}
    before, behind = Counter(), Counter()  # how many live patterns need this word on that side

    def words(p: str) -> tuple[Counter, str]:
        return (behind, p.rsplit(" ", 1)[1]) if p[:2] == ">1" else (before, p.split(" ")[2 if p[:2] == "<2" else 1])

    for p in limits:
        side, w = words(p)
        side[w] += 1
    for text in texts:
        if not live:
            break
        toks = plain_words(text)
        last = len(toks) - 1
        for i, t in enumerate(toks):
            one, after = toks[i - 1] if i else None, toks[i + 1] if i < last else None
            if not (one in before or after in behind) or "0" in t or "@" in t:
                continue
            lead, tail = _EDGES.fullmatch(t).groups()
            for p in keys(toks[i - 2] if i > 1 else None, one, lead, tail, after):
                if (had := live.get(p)) is not None:
                    had.add(t[len(lead):len(t) - len(tail)] or t)
                    if len(had) > limits[p]:
                        del live[p]
                        side, w = words(p)
                        side[w] -= 1
                        if not side[w]:
                            del side[w]
                        yield p, None
    for p, had in live.items():
        yield from ((p, w) for w in had)


def count_others(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """patterns: pattern, n (its distinct values with a digit or @). Returns pattern, others: how many distinct
    other words stand in it in all texts, null where more than n do. Only the patterns go to the workers; each has
    LEAST_SEEDS believed values or more, and a value's place is in four patterns."""
    limits = {r.pattern: r.n for r in patterns.collect()}
    kind = "pattern string, word string"
    if not limits:
        return patterns.select("pattern", F.lit(0).cast("long").alias("others"))
    sent = docs.sparkSession.sparkContext.broadcast(limits)
    schema = pa.schema([("pattern", pa.string()), ("word", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[tuple[str, str | None]] = []
        for pair in other_words((t for b in batches for t in b.column(0).to_pylist() if t), sent.value):
            got.append(pair)
            if len(got) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*got)], schema=schema)
                got = []
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*got)], schema=schema)

    pairs = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, kind).distinct()
    counted = pairs.groupBy("pattern").agg(F.count("word").alias("c"), F.max(F.col("word").isNull()).alias("over"))
    return patterns.join(counted, "pattern", "left").select("pattern", F.when(F.coalesce("over", F.lit(False)), None).otherwise(F.coalesce("c", F.lit(0))).alias("others"))


def _reads(kind: str) -> Column:
    """Whether ``bits`` has the class of the kind."""
    return F.expr(f"(bits & shiftleft(1, element_at(array{CLASSES}, {kind} + 1))) <> 0")


def score_patterns(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """edges: pattern, value, seed (kind or null), bits, fits, one row each. Returns the trusted patterns (pattern,
    kind, confidence): LEAST_SEEDS believed values and BELIEVED of all its values and other words, SMOOTHING added.

    Beliefs are whole hundredths and never fall, so the turns end: when one neither brings a new value nor
    strengthens one."""
    spark = edges.sparkSession
    edges = settle(edges, "pii-graph")
    few = files_for(spark, edges.count())
    sizes = settle(edges.groupBy("pattern").agg(F.count("*").alias("n"), *(F.count_if(F.expr(f"(bits & {1 << c}) <> 0")).alias(f"n{c}") for c in range(3))), "pii-sizes", few)
    believed = settle(edges.where("seed is not null").groupBy("value").agg(F.max("seed").alias("kind"), F.lit(100).alias("belief")), "pii-beliefs", few)
    seeds, strength = believed.select("value"), 0
    counted = spark.createDataFrame([], "pattern string, others long")
    while True:
        hits = edges.join(believed, "value").groupBy("pattern", "kind").agg(F.count("*").alias("c"), *(F.sum(F.expr(f"if((bits & {1 << c}) <> 0, belief, 0)")).alias(f"s{c}") for c in range(3)))
        hits = hits.groupBy("pattern").agg(F.sum("c").alias("c"), F.max_by("kind", F.struct("c", -F.col("kind"))).alias("kind"), *(F.sum(f"s{c}").alias(f"s{c}") for c in range(3)))
        of = [F.expr(f"element_at(array({x}0, {x}1, {x}2), 1 + element_at(array{CLASSES}, kind + 1))").alias(a) for x, a in (("n", "size"), ("s", "sum"))]
        able = hits.where(F.col("c") >= LEAST_SEEDS).join(sizes, "pattern").select("pattern", "kind", "n", *of)
        able = settle(able.where(F.col("sum") >= 100 * BELIEVED * (F.col("size") + SMOOTHING)), "pii-induced", few)
        others = settle(count_others(docs, able.join(counted, "pattern", "left_anti").select("pattern", "n")), "pii-others", few)
        counted = counted.unionByName(others)
        scored = able.join(counted.where("others is not null"), "pattern").withColumn("confidence", F.col("sum") / 100 / (F.col("size") + F.col("others") + SMOOTHING))
        trusted = settle(scored.where(F.col("confidence") >= BELIEVED).select("pattern", "kind", "confidence"), "pii-scores", few)
        # patterns that share their nearest word speak once
        told = edges.where("fits").join(trusted, "pattern").where(_reads("kind")).join(seeds, "value", "left_anti")
        told = told.withColumn("near", F.expr("case left(pattern, 2) when '<2' then split_part(pattern, ' ', 3) when '>1' then pattern else split_part(pattern, ' ', 2) end"))
        told = told.groupBy("value", "near").agg(F.max(F.struct("confidence", -F.col("kind"))).alias("best"))
        belief = F.floor(F.round(100 - 100 * F.exp(F.sum(F.log(1 - F.col("best.confidence")))), 4)).cast("int")
        new = told.groupBy("value").agg((-F.max("best")["col2"]).cast("int").alias("kind"), belief.alias("belief"))
        both = believed.unionByName(new).groupBy("value").agg(F.max_by("kind", F.struct("belief", -F.col("kind"))).alias("kind"), F.max("belief").alias("belief"))
        believed = settle(both, "pii-beliefs", few)
        was, strength = strength, believed.agg(F.coalesce(F.sum("belief"), F.lit(0))).first()[0]
        if new.isEmpty() or strength == was:
            return trusted


def find_identifiers(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """row, doc_id, base and all spans (arrays of start, kind, end in order), and carried columns."""
    found = in_blocks(_scan(docs, carry), "pii-scan")
    slot = found.where("size(slots) > 0").select("row", F.explode("slots").alias("s")).select("row", "s.*")
    slot = slot.select("row", F.explode("patterns").alias("pattern"), F.sha2(F.lower("value"), 256).alias("value"), "start", "end", "kind", "bits", "fits")
    sure = score_patterns(slot.groupBy("pattern", "value").agg(F.max("kind").alias("seed"), F.bit_or("bits").alias("bits"), F.max("fits").alias("fits")), docs)
    new = slot.where("fits").join(sure.withColumnRenamed("kind", "as_kind"), "pattern").where(_reads("as_kind"))
    new = new.groupBy("row", "start", "end").agg(F.max_by("as_kind", F.struct("confidence", "pattern")).alias("kind")).groupBy(F.shiftright("row", BLOCK_BITS).alias("block"), "row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    # by block alone, as the scan is bucketed: what the few rows of a block gained comes as one array
    new = new.groupBy("block").agg(F.collect_list(F.struct("row", "more")).alias("gained"))
    own = F.flatten(F.transform(F.filter("gained", lambda x: x["row"] == F.col("row")), lambda x: x["more"]))
    return found.join(new, "block", "left").select("row", "doc_id", "base", F.array_sort(F.concat("base", F.coalesce(own, F.array().cast(_SPAN)))).alias("spans"), *carry)


def told(spans: str):
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, x -> concat(element_at(array({names}), x.kind + 1), ':', x.start, ':', x.end)), ',')")


def identifier_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_<kind> of the fixed patterns, base_sha256, spans, n_found (spans that only contexts give)."""
    found = find_identifiers(docs)
    count = [F.expr(f"cast(size(filter(base, x -> x.kind = {i})) as long)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *count, F.sha2(told("base"), 256).alias("base_sha256"), told("spans").alias("spans"), F.expr("cast(size(spans) - size(base) as long)").alias("n_found"))


def redact(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``columns`` of docs with every span of ``text`` replaced by its kind in angle brackets; overlapping
    spans become one, named after the first."""
    found = find_identifiers(docs, carry=tuple(c for c in columns if c != "doc_id"))
    pieces = """aggregate(spans, struct(0 as at, cast('' as string) as done),
        (a, x) -> if(x.start < a.at, struct(greatest(a.at, x.end) as at, a.done as done),
                     struct(x.end as at, concat(a.done, substring(text, a.at + 1, x.start - a.at), '<', element_at(array({}), x.kind + 1), '>') as done)),
        a -> concat(a.done, substring(text, a.at + 1)))""".format(", ".join(f"'{k}'" for k in KINDS))
    return found.withColumn("text", F.when(F.size("spans") > 0, F.expr(pieces)).otherwise(F.col("text"))).select(*columns)
