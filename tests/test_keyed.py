"""Tables by key: several writers, failures on the way, nulls, versions."""

import threading

import pytest
from pyspark.sql import functions as F

from siltstone.sources import keyed
from siltstone.sources.keyed import KeyedTable

ROW = "k long, v string"


def rows(df):
    return sorted(((r.k, r.v) for r in df.collect()), key=str)


def test_writers_at_once_lose_nothing_and_store_a_key_once(spark, tmp_path):
    root, errors = str(tmp_path / "t"), []

    def write(name):
        try:
            for n in range(3):
                KeyedTable(spark, root, ["k"], 4).insert_absent(spark.createDataFrame([(0, name), (n, name), (100 * (name == "b") + 10 + n, name)], ROW))
        except Exception as e:
            errors.append(e)

    writers = [threading.Thread(target=write, args=(n,)) for n in "ab"]
    [w.start() for w in writers]
    [w.join() for w in writers]
    table = KeyedTable(spark, root, ["k"])
    got = rows(table.read())
    assert not errors and table.versions()[-1] == 6
    assert sorted(k for k, _ in got) == [0, 1, 2, 10, 11, 12, 110, 111, 112]


def test_a_commit_that_comes_second_merges_again(spark, tmp_path, monkeypatch):
    root, place, done = str(tmp_path / "t"), keyed.place_once, []
    table = KeyedTable(spark, root, ["k"], 1)
    table.upsert(spark.createDataFrame([(1, "old"), (2, "old")], ROW))

    def late(fs, draft, final):
        if not done:
            done.append(1)
            KeyedTable(spark, root, ["k"]).upsert(spark.createDataFrame([(1, "other"), (3, "other")], ROW))
        return place(fs, draft, final)

    monkeypatch.setattr(keyed, "place_once", late)
    back = table.insert_absent(spark.createDataFrame([(3, "mine"), (4, "mine"), (4, "mine too")], ROW), ["v"])
    assert rows(back) == [(3, "other"), (4, "mine")]  # what the other writer stored meanwhile stays
    assert rows(table.read()) == [(1, "other"), (2, "old"), (3, "other"), (4, "mine")] and table.versions() == [1, 2, 3]
    assert rows(table.read(1)) == [(1, "old"), (2, "old")]


def test_untouched_buckets_stay_where_they_are(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], 16)
    table.upsert(spark.range(200).select(F.col("id").alias("k"), F.lit("x").alias("v")))
    before = table.state()[1]["parts"]
    table.upsert(spark.createDataFrame([(5, "y")], ROW))
    after = table.state()[1]["parts"]
    assert len(before) == 16 and sum(before[b] != after[b] for b in before) == 1
    assert table.read().count() == 200 and rows(table.read().where("k = 5")) == [(5, "y")]
    assert table.vacuum(keep=1) == 1 and table.read().count() == 200 and table.versions() == [2]


def test_failures_and_edges(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], 4)
    with pytest.raises(LookupError):
        table.read()
    table.insert_absent(spark.createDataFrame([(None, "a"), (None, "b"), (1, None)], ROW))
    assert rows(table.insert_absent(spark.createDataFrame([(None, "c")], ROW))) in ([(None, "a")], [(None, "b")])
    assert [k for k, _ in rows(table.read())].count(None) == 1 and table.read().count() == 2
    with pytest.raises(ValueError, match="differ"):
        table.upsert(spark.createDataFrame([(1, "x", 2)], "k long, v string, extra int"))
    version = table.versions()[-1]
    monkeypatch.setattr(keyed, "place_once", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        table.upsert(spark.createDataFrame([(1, "z")], ROW))
    monkeypatch.undo()
    assert table.versions()[-1] == version and rows(table.read().where("k = 1")) == [(1, None)]
    assert table.insert_absent(spark.createDataFrame([], ROW)).collect() == [] and table.read().count() == 2
    ordered = spark.createDataFrame([(9, "b"), (9, "c"), (9, "a")], ROW)
    table.upsert(ordered, [F.col("v") != "c", "v"])
    assert rows(table.read().where("k = 9")) == [(9, "c")]
