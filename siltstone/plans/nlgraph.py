"""Questions to graph patterns: one read-only MATCH ... RETURN statement becomes a chain of joins.

The statements are a small part of Cypher: MATCH and OPTIONAL MATCH paths of any length, properties in braces, WHERE
comparisons joined by AND (=, <>, <, <=, >, >=, CONTAINS, IN a list property), RETURN [DISTINCT] with aliases,
ORDER BY and LIMIT. At most ten rows come back."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import graph

ROWS = 10


class NotReadOnly(ValueError):
    pass


class BadPattern(ValueError):
    pass


def extract_pattern(answer: str) -> str:  # F28
    t = re.sub(r"(?i)^```(?:cypher)?\s*", "", answer.strip())
    return re.sub(r"\s*```$", "", t).strip()


def checked(pattern: str) -> str:  # P17
    """``pattern`` if it is one statement that matches and returns, and has no word that writes."""
    if ";" in pattern or not re.search(r"(?i)MATCH", pattern) or not re.search(r"(?i)RETURN", pattern):
        raise NotReadOnly("one MATCH ... RETURN statement")
    if re.search(r"(?i)\b(?:" + "|".join(fixed.WRITE_WORDS) + r")\b", pattern):
        raise NotReadOnly("only reading statements")
    return pattern


def prompt(question: str, nodes: Mapping[str, DataFrame], edges: Mapping[str, tuple[str, str, DataFrame]], ticker: str | None = None, name: str | None = None) -> str:  # LM05
    """What a model is told: the question, the hints on the company, and the schema."""
    lines = [f"Question: {question}", f"Ticker: {ticker.upper()}" if ticker else "No ticker is known", f"Stored name: {name}" if name else "No stored name is known", "Nodes:"]
    lines += [f"  {label}({', '.join(df.columns)})" for label, df in nodes.items()]
    lines += ["Edges:", *(f"  ({a})-[:{kind} {{{', '.join(c for c in df.columns if c not in ('src', 'dst'))}}}]->({b})" for kind, (a, b, df) in edges.items())]
    return "\n".join([*lines, f"Write one read-only MATCH ... RETURN statement of at most {ROWS} rows."])


_NODE = re.compile(r"\(\s*(\w*)\s*(?::\s*(\w+))?\s*(?:\{([^}]*)\})?\s*\)")
_EDGE = re.compile(r"(<)?-\[\s*(\w*)\s*:\s*(\w+)\s*(?:\{([^}]*)\})?\s*\]-(>)?")
_CLAUSE = re.compile(r"(?is)\b(OPTIONAL\s+MATCH|MATCH|WHERE|RETURN|ORDER\s+BY|LIMIT)\b")
_TEST = re.compile(r"(?is)^\s*(.+?)\s*(<>|<=|>=|=|<|>|\bCONTAINS\b|\bIN\b)\s*(.+?)\s*$")


def _split(text: str, sep: str) -> list[str]:
    """Parts between separators that stand outside of quotes."""
    out, at, quote = [], 0, ""
    for m in re.finditer(rf"[\"']|{sep}", text):
        if m[0] in "\"'":
            quote = "" if quote == m[0] else quote or m[0]
        elif not quote:
            out.append(text[at : m.start()])
            at = m.end()
    return [p.strip() for p in [*out, text[at:]] if p.strip()]


def _value(text: str) -> Column:
    t = text.strip()
    if re.fullmatch(r"'[^']*'|\"[^\"]*\"", t):
        return F.lit(t[1:-1])
    if re.fullmatch(r"-?\d+", t):
        return F.lit(int(t))
    if re.fullmatch(r"-?\d+\.\d+", t):
        return F.lit(float(t))
    if t.lower() in ("true", "false"):
        return F.lit(t.lower() == "true")
    if re.fullmatch(r"\w+\.\w+", t):
        return F.col(t.replace(".", "__"))
    raise BadPattern(f"no value: {t}")


def _test(text: str) -> Column:
    m = _TEST.match(text)
    if not m:
        raise BadPattern(f"no comparison: {text}")
    a, op, b = _value(m[1]), m[2].upper(), _value(m[3])
    if op == "CONTAINS":
        return F.contains(a, b)
    if op == "IN":
        return F.array_contains(b, a)
    return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def _named(df: DataFrame, var: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{var}__{c}") for c in df.columns))


def _props(var: str, text: str | None) -> list[str]:
    return [f"{var}.{k.strip()} = {v.strip()}" for k, v in (p.split(":", 1) for p in _split(text or "", ","))]


def run(pattern: str, nodes: Mapping[str, DataFrame], edges: Mapping[str, tuple[str, str, DataFrame]], limit: int = ROWS) -> DataFrame:  # G06, J10, O04
    """Rows of a statement. nodes: label to a table with ``id``; edges: kind to (label, label, table with src and dst)."""
    text = checked(extract_pattern(pattern))
    pieces = _CLAUSE.split(text)
    clauses = [(re.sub(r"\s+", " ", k).upper(), v.strip()) for k, v in zip(pieces[1::2], pieces[2::2])]
    rows: DataFrame | None = None
    for i, (kind, body) in enumerate(clauses):
        if kind not in ("MATCH", "OPTIONAL MATCH"):
            continue
        where = clauses[i + 1][1] if i + 1 < len(clauses) and clauses[i + 1][0] == "WHERE" else ""
        tests = _split(where, r"(?i:\bAND\b)")
        for path in _split(body, r",(?=\s*\()"):
            found, tests = _path(path, nodes, edges, i, tests)
            if rows is None:
                rows = found
                continue
            common = [c for c in found.columns if c in rows.columns]
            keys = [c for c in common if c.endswith("__id")]
            if not keys:
                raise BadPattern("paths of one statement share a node")
            rows = rows.join(found.drop(*(c for c in common if c not in keys)), keys, "left" if kind.startswith("OPTIONAL") else "inner")
        for t in tests:
            rows = rows.where(_test(t))
    said = dict(clauses)
    if rows is None or "RETURN" not in said:
        raise BadPattern("one MATCH ... RETURN statement")
    wanted = re.sub(r"(?i)^DISTINCT\b", "", said["RETURN"]).strip()
    out = rows.select(*(_value(x[0]).alias(x[1] if len(x) > 1 else x[0].split(".")[1]) for x in (re.split(r"(?i)\s+AS\s+", p) for p in _split(wanted, ","))))
    if wanted != said["RETURN"]:
        out = out.distinct()
    if "ORDER BY" in said:
        keys = [re.split(r"\s+", p) for p in _split(said["ORDER BY"], ",")]
        out = out.orderBy(*((F.desc if len(k) > 1 and k[1].upper() == "DESC" else F.asc)(k[0].split(".")[-1]) for k in keys))
    return out.limit(min(limit, int(said["LIMIT"])) if "LIMIT" in said else limit)


def _variables(test: str) -> set[str]:
    return set(re.findall(r"\b([A-Za-z_]\w*)\.\w+", re.sub(r"'[^']*'|\"[^\"]*\"", "", test)))


def _path(path: str, nodes: Mapping[str, DataFrame], edges: Mapping[str, tuple[str, str, DataFrame]], n: int, tests: list[str]) -> tuple[DataFrame, list[str]]:
    """A path's rows, and the tests that name other variables. Tests of one variable stand before the joins; the path's tables
    are reduced by semi-joins before they are joined."""
    at, own, tables, links, before = 0, [], {}, [], ""
    while at < len(path):
        m = _NODE.match(path, at)
        if not m or (m[2] or "") not in nodes:
            raise BadPattern(f"no known node at: {path[at:at + 30]}")
        var = m[1] or f"_n{n}_{at}"
        if var in tables:
            raise BadPattern(f"a path meets {var} twice")
        tables[var] = _named(nodes[m[2]], var)
        own += _props(var, m[3])
        if before:
            links.append((before, f"{before}__next", var, f"{var}__id"))
        before, at = var, m.end()
        rest = path[at:].lstrip()
        if not rest:
            break
        at = len(path) - len(rest)
        e = _EDGE.match(path, at)
        if not e or e[3] not in edges or bool(e[1]) == bool(e[5]):
            raise BadPattern(f"no known edge at: {path[at:at + 30]}")
        kind, back = e[2] or f"_e{n}_{at}", bool(e[1])
        if kind in tables:
            raise BadPattern(f"a path meets {kind} twice")
        table = edges[e[3]][2]
        near, far = ("dst", "src") if back else ("src", "dst")
        tables[kind] = table.select(F.col(near).alias(f"{kind}__own"), F.col(far).alias(f"{kind}__next"), *(F.col(c).alias(f"{kind}__{c}") for c in table.columns if c not in ("src", "dst")))
        links.append((before, f"{before}__id", kind, f"{kind}__own"))
        own += _props(kind, e[4])
        before, at = kind, e.end()
        at += len(path[at:]) - len(path[at:].lstrip())
    usable = [t for t in tests if _variables(t) <= set(tables)]
    late = []
    for t in [*own, *usable]:
        of = _variables(t)
        if len(of) == 1:
            var = next(iter(of))
            tables[var] = tables[var].where(_test(t))
        else:
            late.append(t)
    hidden = [c for var in tables for c in (f"{var}__own", f"{var}__next")]
    rows = graph.matched(tables, links).drop(*hidden)
    for t in late:
        rows = rows.where(_test(t))
    return rows, [t for t in tests if t not in usable]


def ask(question: str, nodes: Mapping[str, DataFrame], edges: Mapping[str, tuple[str, str, DataFrame]], nl2graph: Callable[[str], str], **hints: str | None) -> tuple[str, DataFrame]:  # LM05
    """The statement that a model gives for a question, and its rows."""
    pattern = checked(extract_pattern(nl2graph(prompt(question, nodes, edges, **hints))))
    return pattern, run(pattern, nodes, edges)
