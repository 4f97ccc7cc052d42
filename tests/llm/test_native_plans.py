"""The operators that are to run on DataFrame functions alone have no Python in their plans."""

import re

import pytest

from siltstone.llm import queries

DATA = "/root/testdata/sf0.001"
OF_VECTORS = ("op12_annular_vector_codes", "op13_sort_means")


@pytest.mark.parametrize("name", ["op1_size_tiered_shards", "op2_quality_ledger", "quality_ablations", "op9_secret_forest"])
def test_native(spark, name):
    p = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Python|Pandas|ArrowEval|MapInArrow|CartesianProduct", p)


def test_texts_are_not_shuffled_for_the_ledger(spark):
    from siltstone.llm.quality_ledger import apply_policy, ledger

    assert "Exchange" not in apply_policy(ledger(spark.read.parquet(f"{DATA}/documents.parquet")))._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_every_query_runs(spark, name):
    rows = queries.QUERIES[name](spark, DATA)
    assert rows.count() > 0
    if name.startswith("op") and name != "op9_secret_forest":
        assert ("vec_id" if name in OF_VECTORS else "doc_id") in rows.columns


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_sql_gives_the_same(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, DATA)
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    at = [want.columns.index(c) for c in order]
    plain = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert plain([[r[c] for c in order] for r in got.collect()]) == plain([[r[i] for i in at] for r in want.fetchall()])
