"""The company graph as node and edge tables; a pattern query is a chain of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..sources.workspace import settled
from . import relational

NODES = ("Company", "Filing", "Section", "Subsidiary", "BoardMember", "Patent", "TechnologyDomain")
#: edge: from node, to node, properties
EDGES = {"HAS_FILING": ("Company", "Filing", ()), "HAS_SECTION": ("Filing", "Section", ()), "HAS_SUBSIDIARY": ("Company", "Subsidiary", ("year", "source_form_type")), "HAS_BOARD_MEMBER": ("Company", "BoardMember", ("is_current",)), "HAS_PATENT": ("Company", "Patent", ()), "BELONGS_TO_DOMAIN": ("Patent", "TechnologyDomain", ("cpc_prefix",))}


def subsidiary_edges(payload: DataFrame) -> DataFrame:  # G04
    """One edge per subsidiary and year; nameless ones fall away."""
    years = payload.select(F.upper("ticker").alias("ticker"), "form_type", F.explode("subsidiaries_by_year").alias("y"))
    names = years.select("ticker", F.col("y.year").alias("year"), F.col("form_type").alias("source_form_type"), F.explode("y.subsidiaries").alias("name"))
    names = names.withColumn("name", text.normalize_whitespace("name")).where("name <> ''")
    return names.withColumn("subsidiary_id", text.subsidiary_id(F.col("ticker"), F.col("name"))).distinct()


def board_members(records: DataFrame) -> DataFrame:  # A05, A06
    """records: ticker, year, name, title, pos. One row per person: years, the latest year's longest title
    (the first of equal length), and whether the latest year is the ticker's latest."""
    named = records.where(F.col("year").isNotNull()).withColumn("name", text.board_name("name")).where("name <> ''").withColumn("title", text.normalize_whitespace("title"))
    people = named.groupBy("ticker", "name").agg(
        F.array_sort(F.collect_set("year")).alias("years_present"), F.max("year").alias("latest_year"), F.max_by("title", F.struct("year", F.length("title"), -F.col("pos"))).alias("title"))
    last = people.groupBy("ticker").agg(F.max("latest_year").alias("_last"))
    return people.join(last, "ticker").select(text.person_id(F.col("ticker"), F.col("name")).alias("id"), "ticker", "name", "title", "years_present", "latest_year", (F.col("latest_year") == F.col("_last")).alias("is_current"))


def domain_edges(patents: DataFrame, key: str, codes: Column) -> DataFrame:  # G05, F24
    """One edge per patent and distinct class prefix, with the class's label."""
    out = patents.select(F.col(key), F.explode(text.cpc_prefixes(codes)).alias("cpc_prefix"))
    return out.withColumn("label", text.cpc_label(F.col("cpc_prefix")))


def patents_in_scope(patents: DataFrame, assignee: str | None, first: int = 2021, last: int = 2025) -> DataFrame:  # P15
    """An assignee's patents (or those without one) granted from ``first`` to ``last``; malformed dates go."""
    year = F.regexp_extract(F.trim(F.coalesce("grant_date", F.lit(""))), r"^(\d{4})", 1).try_cast("int")
    who = F.lower(F.trim(F.coalesce("assignee_organization", F.lit(""))))
    return patents.where(year.between(first, last) & ((who == "") | (who == (assignee or "").strip().lower()) if assignee else F.lit(True)))


def hop(left: DataFrame, edges: DataFrame, nodes: DataFrame, where: Column | None = None, optional: bool = False) -> DataFrame:  # J10, G06
    """Follows edges (src, dst, properties) to nodes (dst as their key); a predicate on the edge or node is
    part of the pattern. optional: rows without a match stay."""
    far = edges.join(nodes, "dst")
    far = far if where is None else far.where(where)
    return left.join(far, "src", "left" if optional else "inner")


def _tree_of(tables: dict[str, DataFrame], links: list[tuple[str, str, str, str]]) -> list[tuple[str, str, str, str]]:
    """The links (parent, its column, child, its column) of an acyclic pattern, parents before children."""
    if not tables:
        raise ValueError("a pattern needs a table")
    order, placed, rest = [], {next(iter(tables))}, list(links)
    while rest:
        at = next((l for l in rest if (l[0] in placed) != (l[2] in placed)), None)
        if at is None:
            raise ValueError("the links of a pattern form one tree over its tables")
        rest.remove(at)
        order.append(at if at[0] in placed else (at[2], at[3], at[0], at[1]))
        placed.add(order[-1][2])
    if placed != set(tables):
        raise ValueError("the links of a pattern form one tree over its tables")
    return order


def reduced(tables: dict[str, DataFrame], links: list[tuple[str, str, str, str]]) -> dict[str, DataFrame]:
    """Every table of an acyclic pattern without the rows that are in no match: semi-joins from the leaves of the pattern up
    to its root, then down again."""
    out, order = dict(tables), _tree_of(tables, links)

    def kept(a: str, of_a: str, b: str, of_b: str) -> DataFrame:
        keys = out[b].select(F.col(of_b).alias(of_a))
        return out[a].join(keys, of_a, "left_semi").select(*out[a].columns)

    for parent, up, child, down in reversed(order):
        out[parent] = kept(parent, up, child, down)
    for parent, up, child, down in order:
        out[child] = kept(child, down, parent, up)
    return out


def matched(tables: dict[str, DataFrame], links: list[tuple[str, str, str, str]], wanted: list[str] | None = None, distinct: bool = False) -> DataFrame:  # G06, J10
    """Matches of an acyclic pattern: tables by name, whose columns have names of their own, and links (table, column,
    table, column). Tables are reduced first, then joined from the leaves up. wanted: the columns that matter; with
    ``distinct``, what hangs below a link comes down to its distinct wanted columns before it is joined, so two branches of
    a table meet with no more rows than they add to the result, however many rows of theirs match."""
    order, small = _tree_of(tables, links), reduced(tables, links)

    def cut(rows: DataFrame, *needed: str) -> DataFrame:
        if wanted is None:
            return rows
        rows = rows.select(*(c for c in rows.columns if c in wanted or c in needed))
        return rows.distinct() if distinct else rows

    def below(name: str, *link: str) -> DataFrame:
        rest = [(up, child, down) for parent, up, child, down in order if parent == name]
        rows = cut(small[name], *link, *(up for up, _, _ in rest))
        for i, (up, child, down) in enumerate(rest):
            copy = f"_{down}"
            far = below(child, down).withColumn(copy, F.col(down))
            rows = cut(rows.join(far, F.col(up) == F.col(copy)).drop(copy), *link, *(u for u, _, _ in rest[i + 1 :]))
        return rows

    rows = below(next(iter(tables)))
    return rows if wanted is None else rows.select(*wanted)


def summary(companies: DataFrame, key: str, **branches: tuple[DataFrame, str]) -> DataFrame:  # G07, A09
    """Distinct counts per branch, each aggregated before it is joined, so that branches do not multiply."""
    out = companies.select(key)
    for name, (edges, dst) in branches.items():
        out = out.join(edges.groupBy(F.col("src").alias(key)).agg(F.count_distinct(dst).alias(name)), key, "left")
    return out.na.fill(0, list(branches))


def on_topic(question: Column) -> Column:  # G08
    return text.any_in(F.lower(question), fixed.MARKERS["graph"])


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges whose ends both have edges in and out, until none is left to go: a tree ends here."""
    n = -1
    while (left := edges.count()) != n:
        n = left
        heads, tails = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        edges = settled(edges.join(heads, "src", "left_semi").join(tails, "dst", "left_semi").select("src", "dst"), "ring-edges")
    return edges


def strong_components(edges: DataFrame) -> DataFrame:  # G09
    """node, root (its smallest node) of every strongly connected component of two nodes or more. edges: src, dst.

    Labels go forwards until every node has the smallest node that reaches it; a label's own node, and what reaches that
    node through nodes of the same label (labels go backwards), is one component. What is left of each label is done again.
    Rounds are as many as the longest way is long; each is a join and an aggregation over the edges that are left."""
    edges = settled(edges.select("src", "dst").where("src <> dst").distinct(), "ring-edges")
    found = edges.select(F.col("src").alias("node"), F.col("src").alias("root")).limit(0)
    while not (edges := _trimmed(edges)).isEmpty():
        label = edges.select(F.col("src").alias("node"), F.col("src").alias("label")).distinct()
        while True:
            into = edges.join(label, edges["src"] == label["node"]).groupBy("dst").agg(F.min("label").alias("near")).withColumnRenamed("dst", "node")
            moved = settled(label.withColumnRenamed("label", "was").join(into, "node", "left").select("node", "was", F.least("was", "near").alias("label")), "ring-labels")
            label = moved.select("node", "label")
            if moved.where("was <> label").isEmpty():
                break
        same = settled(edges.join(label.withColumnsRenamed({"node": "src"}), "src").join(label.select(F.col("node").alias("dst"), F.col("label").alias("_l")), "dst").where(F.col("label") == F.col("_l")).select("src", "dst", "label"), "ring-edges")
        front = label.where("node = label").select("node")
        part = front
        while not front.isEmpty():
            new = same.join(front.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
            front = settled(new.join(part, "node", "left_anti"), "ring-front")
            part = settled(part.unionByName(front), "ring-part")
        found = found.unionByName(label.join(part, "node", "left_semi").select("node", F.col("label").alias("root")))
        edges = same.select("src", "dst").join(part.withColumnRenamed("node", "src"), "src", "left_anti").join(part.withColumnRenamed("node", "dst"), "dst", "left_anti")
    counts = settled(found, "strong-components")
    return counts.join(counts.groupBy("root").agg(F.count("*").alias("_n")).where("_n > 1").select("root"), "root", "left_semi").select("node", "root")


def cycles(edges: DataFrame) -> DataFrame:  # G09
    """Rings as paths (arrays of node ids from their smallest node on): one for each edge that closes a ring. edges: src, dst.

    Every strongly connected component is walked from its smallest node, level by level, each node keeping its smallest
    parent. An edge to a node that lies on the way to its own start closes a ring: the way between them. So each
    component has a ring at least, and there are never more rings than edges, also in a dense core that has any number."""
    known = settled(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "ring-edges")
    loops = known.where("src = dst").select(F.array("src").alias("path"))
    of = strong_components(known)
    inner = known.where("src <> dst").join(of.withColumnRenamed("node", "src"), "src").join(of.select(F.col("node").alias("dst"), F.col("root").alias("_r")), "dst").where(F.col("root") == F.col("_r")).select("src", "dst")
    inner = settled(inner, "ring-edges")
    front = of.where("node = root").select("node", F.lit(None).cast(of.schema["node"].dataType).alias("parent"), F.lit(0).alias("level"))
    walked = front
    while not front.isEmpty():
        step = inner.join(front.select(F.col("node").alias("src"), "level"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"), (F.max("level") + 1).alias("level"))
        front = settled(step.join(walked, "node", "left_anti"), "ring-front")
        walked = settled(walked.unionByName(front), "ring-walk")
    level = lambda c: walked.select(F.col("node").alias(c), F.col("level").alias(f"_{c}"))
    # an edge can only close a ring if it does not lead further down
    going = settled(inner.join(level("src"), "src").join(level("dst"), "dst").where("_dst <= _src").select("dst", F.col("src").alias("at"), F.col("_src").alias("level"), F.col("_dst").alias("top"), F.array("src").alias("path")), "ring-paths")
    found = going.where("at = dst").select("path")
    going = going.where("level > top")
    while not going.isEmpty():
        up = walked.select(F.col("node").alias("at"), "parent")
        going = settled(going.join(up, "at").select("dst", F.col("parent").alias("at"), (F.col("level") - 1).alias("level"), "top", F.concat(F.array("parent"), "path").alias("path")), "ring-paths")
        found = found.unionByName(going.where("at = dst").select("path"))
        going = going.where("level > top")
    first = F.array_position("path", F.array_min("path")).cast("int")
    turned = found.select(F.concat(F.slice("path", first, F.size("path")), F.slice("path", F.lit(1), first - 1)).alias("path"))
    return loops.unionByName(turned).distinct()


def is_read_only(query: Column) -> Column:  # P17
    """A graph query that matches and returns, without a semicolon or a writing statement."""
    q = F.regexp_replace(text.strip_fence(query), r"^\s+|\s+$", "")
    words = "|".join(fixed.WRITE_WORDS)
    return ~q.contains(";") & q.rlike(r"(?i)\bMATCH\b") & q.rlike(r"(?i)\bRETURN\b") & ~q.rlike(rf"(?i)\b(?:{words})\b")


def merged(df: DataFrame, key: list[str], order: str) -> DataFrame:  # K12
    """Nodes or edges once per key, with the properties written last."""
    return relational.keep_last(df, key, [order, *(c for c in df.columns if c not in key and c != order)])


def company_exists(companies: DataFrame, ticker: str) -> None:  # G10
    if not companies.where(F.col("ticker") == ticker.upper()).limit(1).count():
        raise LookupError(f"company {ticker} is not in the graph")
