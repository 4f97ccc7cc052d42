"""Relational operators whose result does not depend on how rows are dealt out: every order is total."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import replace_by
from ..sources.workspace import settled


def semi(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:  # J04, P01
    return df.join(keys, on, "left_semi")


def new_rows(df: DataFrame, existing: DataFrame, key: str | list[str]) -> DataFrame:  # K02, J05
    """Rows of ``df`` whose key is not there yet, one per key: insert-if-absent."""
    keys = [key] if isinstance(key, str) else list(key)
    return keep_first(df.join(existing.select(*keys), keys, "left_anti"), keys, df.columns)


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:  # A02, A03
    """The first row of each key. An aggregation, not a window: partial minima travel, not rows, and a hot
    key is no more than one row per task."""
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    names = df.columns
    first = df.groupBy(*key).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("_row"))
    return first.select("_row.*")


def keep_last(df: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:  # K08
    """The last row of each key: last write wins."""
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    return df.groupBy(*key).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_row")).select("_row.*")


def upsert(existing: DataFrame, arriving: DataFrame, key: Sequence[str]) -> DataFrame:  # K08, K10, K12
    """Existing rows without the arriving keys, and the arriving rows."""
    return existing.join(arriving.select(*key).distinct(), list(key), "left_anti").unionByName(arriving)


def replace_values(df: DataFrame, column: str, names: Mapping[str, str]) -> DataFrame:  # J07
    return df.withColumn(column, replace_by(column, names))


def lookup(df: DataFrame, table: DataFrame, on: str | list[str]) -> DataFrame:  # J03, J06
    return df.join(table, on, "left")


def sorted_set(df: DataFrame, key: Sequence[str], value: str, sep: str = ",") -> DataFrame:  # A01, A06
    """Sorted distinct values of each key, nulls dropped, joined."""
    distinct = df.where(F.col(value).isNotNull()).select(*key, value).distinct()
    return distinct.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list(F.col(value).cast("string"))), sep).alias(f"{value}_set"))


def first_filled(df: DataFrame, key: Sequence[str], columns: Sequence[str], position: str) -> DataFrame:  # A04
    """The first non-empty value of each column by position, per key."""
    filled = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    return df.groupBy(*key).agg(*(F.min_by(F.col(c), F.when(filled(c).isNotNull(), F.col(position))).alias(c) for c in columns))


def ordered_distinct(df: DataFrame, key: Sequence[str], identity: Sequence[str | Column], position: str) -> DataFrame:  # A14
    """The first occurrence of each identity within a key."""
    named = {f"_id{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(identity)}
    return keep_first(df.withColumns(named), [*key, *named], [position, *df.columns]).select(*df.columns)


def primary_or(primary: DataFrame, secondary: DataFrame, key: Sequence[str]) -> DataFrame:  # U05
    """Rows of ``primary``; for keys that it lacks, those of ``secondary``."""
    return primary.unionByName(secondary.join(primary.select(*key).distinct(), list(key), "left_anti"))


def mapped_counts(df: DataFrame, column: str, names: Mapping[str, str]) -> DataFrame:  # A17
    known = F.col(column).isin(*names)
    return df.agg(F.count_if(known).alias("mapped"), F.count_if(~known).alias("unmapped"))


def duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:  # K13
    """Keys that occur more than once: empty if the key is unique."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:  # V06
    """Rows of the child whose reference leads nowhere: empty if integrity holds."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(parent_column).alias(column)), column, "left_anti")


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:  # V04
    return [c for c in required if c not in df.columns]


def budget(df: DataFrame, group: Sequence[str], order: Sequence[Column], text: str, limit: int) -> DataFrame:  # W02
    """Rows in order while their lengths add up to at most ``limit``; the first overflow ends the list, and a missing
    text adds nothing. A group's rows are first cut share by share, each after its own first overflow: the list and the
    overflow that ends it pass all these cuts, so one task meets no more than a few rows of each share."""
    size = F.coalesce(F.length(text), F.lit(0))

    def so_far(*keys: str) -> Column:
        return F.sum(size).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))

    shares = df.withColumn("_share", F.spark_partition_id())
    cut = shares.withColumn("_sum", so_far(*group, "_share") - size).where(F.col("_sum") <= limit).drop("_share")
    return cut.withColumn("_sum", so_far(*group)).where(F.col("_sum") <= limit).drop("_sum")


#: Items of a group that are held against each other at a time.
TILE = 256


def similar_pairs(df: DataFrame, group: str, item: str, words: str, least: float, tile: int = TILE) -> DataFrame:  # U02
    """group, i, j (i < j): items of a group whose sets of words have a Jaccard similarity of ``least`` or more, which
    lies above 0; an empty set is like nothing. Items meet as tiles: a group of more than ``tile`` of them is dealt into
    blocks of about that many, and every two of its blocks are a key of their own. So a set travels once, or as often as
    its group has blocks, whatever words it shares, and a group's size makes no hot key."""
    sets = df.select(group, F.col(item).alias("i"), F.array_distinct(F.col(words)).alias("x")).where(F.size("x") > 0)
    large = settled(df.groupBy(group).agg(F.ceil(F.count("*") / tile).cast("int").alias("_blocks")).where("_blocks > 1"), "large-groups")
    blocks = F.coalesce("_blocks", F.lit(1))
    dealt = sets.join(large, group, "left").withColumn("_own", F.pmod(F.xxhash64("i"), blocks).cast("int"))
    dealt = dealt.select(group, "i", "x", "_own", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_with"))
    dealt = dealt.select(group, F.least("_own", "_with").alias("_a"), F.greatest("_own", "_with").alias("_b"), "_own", "i", "x")
    both = dealt.join(dealt.withColumnsRenamed({"i": "j", "x": "y", "_own": "_other"}), [group, "_a", "_b"])
    both = both.where((F.col("i") < F.col("j")) & ((F.col("_own") != F.col("_other")) | (F.col("_a") == F.col("_b"))))
    m, n = F.size("x"), F.size("y")
    alike = F.forall(F.array(F.size(F.array_intersect("x", "y"))), lambda shared: shared / (m + n - shared) >= least)  # looked up once
    return both.where((F.least(m, n) >= F.greatest(m, n) * least - 1e-9) & alike).select(group, "i", "j")


def top_per(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:  # O01, W01
    """The first k rows of each group with their rank. Rows beyond k leave each task before the shuffle
    (Spark's group limit), so a hot group sends k rows per task."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("long")).where(F.col(rank) <= k)


def running(df: DataFrame, group: Sequence[str], order: Sequence[Column], value: str, name: str) -> DataFrame:
    """What the rows of a group before each row add up to."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))


def ranked(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """The place of every row in one total order, without a window over the whole table: rows are dealt out by range
    and sorted where they are; what a partition adds is the number of rows in those before it."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    fixed = settled(dealt, "ranked").withColumn("_part", F.shiftright("_at", 33))
    sizes = fixed.groupBy("_part").agg(F.count("*").alias("_n"))  # a row per partition
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return fixed.join(F.broadcast(offsets), "_part").withColumn(name, place.cast("long")).drop("_at", "_part", "_before")


def islands(df: DataFrame, group: Sequence[str], order: str, starts: Column, name: str = "island") -> DataFrame:  # W04
    """Numbers runs of rows: each row for which ``starts`` holds begins the next run."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(w).cast("long"))


def carried(df: DataFrame, group: Sequence[str], order: str, levels: Sequence[tuple[str, Column]]) -> DataFrame:  # W03
    """Carries each level's last value forward; a new value of a higher level clears the lower ones.
    levels: (name, value or null), highest first."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    resets: list[Column] = []
    for name, value in levels:
        df = df.withColumn(f"_v_{name}", value)
        resets.append(F.col(f"_v_{name}").isNotNull())
    for i, (name, _) in enumerate(levels):
        own = F.last(F.when(resets[i], F.struct(F.col(order).alias("at"), F.col(f"_v_{name}").alias("v"))), ignorenulls=True).over(w)
        if i:
            higher = resets[0]
            for r in resets[1:i]:
                higher = higher | r
            cleared = F.last(F.when(higher, F.col(order)), ignorenulls=True).over(w)
            df = df.withColumn(name, F.when(cleared.isNull() | (own["at"] >= cleared), own["v"]))
        else:
            df = df.withColumn(name, own["v"])
    return df.drop(*(f"_v_{n}" for n, _ in levels))
