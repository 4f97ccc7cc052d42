import pytest

from siltstone.llm.common import scratch
from siltstone.llm.shards import Conflict, SchemaClash, Shard, ShardTable


def rows(a, b):
    return [(i, None if i % 7 == 0 else f"text {i} " * 20, i % 3) for i in range(a, b)]


SCHEMA = "doc_id long, text string, version int"


def test_append_compact_and_time_travel(spark):
    t = ShardTable(spark, scratch(spark, "shards"), target=1 << 20, small=1 << 10)
    v = [t.append(spark.createDataFrame(rows(100 * k, 100 * k + 100), SCHEMA).repartition(4), rows_per_shard=20) for k in range(3)]
    assert v == [1, 2, 3]
    before = t.manifest()[1]
    version = t.compact()
    after = t.manifest()[1]
    assert version == 4 and len(after) < len(before) // 4 and sum(s.rows for s in after) == 300
    assert sorted(map(tuple, t.read().collect()), key=str) == sorted(rows(0, 300), key=str)
    assert t.read(1).count() == 100
    assert t.vacuum() == len(before) and t.read().count() == 300 and t.vacuum() == 0


def test_tiers_merge_only_similar_sizes(spark):
    t = ShardTable(spark, scratch(spark, "shards"), target=1000, small=10)
    shards = [Shard(f"s{i}", b, 1) for i, b in enumerate([12, 13, 14, 15, 300, 320, 999, 600])]
    assert [[s.bytes for s in run] for run in t.plan(shards)] == [[15, 14, 13, 12]]


def test_a_lost_race_commits_nothing(spark):
    t = ShardTable(spark, scratch(spark, "shards"))
    t.append(spark.createDataFrame(rows(0, 5), SCHEMA))
    with pytest.raises(Conflict):
        t._commit(1, [], "{}")
    assert t.read().count() == 5


def test_empty_arrival_and_repeated_rows(spark):
    t = ShardTable(spark, scratch(spark, "shards"))
    t.append(spark.createDataFrame([], SCHEMA))
    assert t.read().count() == 0 and t.compact() == 1
    t.append(spark.createDataFrame(rows(1, 3) + rows(1, 3), SCHEMA))
    assert sorted(map(tuple, t.read().collect())) == sorted(rows(1, 3) * 2)


def test_an_added_column_is_kept_through_a_merge(spark):
    t = ShardTable(spark, scratch(spark, "shards"), target=1 << 20, small=1 << 10)
    t.append(spark.createDataFrame([(i, "a") for i in range(8)], "doc_id long, text string").repartition(4))
    t.append(spark.createDataFrame([(8, "b", 1.5)], "doc_id long, text string, weight double"))
    t.append(spark.createDataFrame([(9, 2.5)], "doc_id long, weight double"))
    want = [(i, "a", None) for i in range(8)] + [(8, "b", 1.5), (9, None, 2.5)]
    assert sorted(map(tuple, t.read().collect())) == want and t.read(1).columns == ["doc_id", "text"]
    t.compact()
    t.vacuum()
    assert len(t.manifest()[1]) < 4 and sorted(map(tuple, t.read().collect())) == want


@pytest.mark.parametrize("schema", ["doc_id string, text string", "doc_id long, Text string"])
def test_a_clashing_column_is_refused_before_anything_is_written(spark, schema):
    t = ShardTable(spark, scratch(spark, "shards"))
    t.append(spark.createDataFrame([(1, "a")], "doc_id long, text string").coalesce(1))
    with pytest.raises(SchemaClash):
        t.append(spark.createDataFrame([], schema))
    assert t.manifest()[0] == 1 and t.read().count() == 1 and t.vacuum() == 0


def test_vacuum_spares_another_writers_arrival(spark):
    root = scratch(spark, "shards")
    a, b = ShardTable(spark, root), ShardTable(spark, root)
    a.append(spark.createDataFrame(rows(0, 5), SCHEMA))
    commit, removed = a._commit, []
    a._commit = lambda *x: (removed.append(b.vacuum()), commit(*x))[1]
    a.append(spark.createDataFrame(rows(5, 10), SCHEMA))
    assert removed == [0] and b.read().count() == 10
    folder = a._folder("arrival")  # a writer that dies now leaves its intent and files
    spark.createDataFrame(rows(0, 1), SCHEMA).coalesce(1).write.parquet(f"{root}/{folder}")
    assert b.vacuum() == 0 and b.vacuum(stale_s=0) == 1 and b.read().count() == 10


def test_two_writers_commit_both(spark):
    from concurrent.futures import ThreadPoolExecutor

    root = scratch(spark, "shards")
    writers = [ShardTable(spark, root, target=1 << 20, small=1 << 10) for _ in range(4)]
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(lambda k: writers[k].append(spark.createDataFrame(rows(10 * k, 10 * k + 10), SCHEMA)), range(4)))
    assert sorted(versions) == [1, 2, 3, 4] and writers[0].read().count() == 40
    with ThreadPoolExecutor(4) as pool:
        wins = list(pool.map(lambda w: _wins(w, 5), writers))
    assert sum(wins) == 1


def _wins(table, version):
    try:
        table._commit(version, *table.manifest()[1:])
        return True
    except Conflict:
        return False


def test_a_compaction_that_was_overtaken_plans_anew(spark):
    root = scratch(spark, "shards")
    a, b = (ShardTable(spark, root, target=1 << 20, small=1 << 10) for _ in range(2))
    for k in range(5):
        a.append(spark.createDataFrame(rows(10 * k, 10 * k + 10), SCHEMA).coalesce(1))
    merge, once = a._merge, []

    def overtaken(*x):
        if not once:
            once.append(b.compact())
        return merge(*x)

    a._merge = overtaken
    a.compact()
    assert sorted(r.doc_id for r in a.read().collect()) == list(range(50))
    assert {s.path.split("/")[1] for s in a.manifest()[1]} >= {s.path.split("/")[1] for s in b.manifest()[1]}
    live = {s.path for s in a.manifest()[1]}
    a.vacuum()
    assert {s.path for s in a.manifest()[1]} == live and a.read().count() == 50
