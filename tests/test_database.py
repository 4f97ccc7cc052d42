"""The database source: ranges, pushed filters, nulls, and the join of claims with their patents."""

import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from siltstone.sources import database, filings

CLAIMS = "claim_id long, patent_id string, claim_number long, claim_text string"


@pytest.fixture
def base(spark, tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, known])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    path = str(tmp_path / "base.db")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE claims (claim_id INTEGER, patent_id TEXT, claim_number INTEGER, claim_text TEXT)")
    con.executemany("INSERT INTO claims VALUES (?, ?, ?, ?)", [(i, f"p{i % 20}", i // 20, f"Claim {i} 100% a_b" if i % 3 else None) for i in range(-50, 350)] + [(None, "p1", 99, "no key")])
    con.execute("CREATE TABLE patents (n INTEGER, patent_id TEXT, grant_date TEXT, assignee_organization TEXT)")
    con.executemany("INSERT INTO patents VALUES (?, ?, ?, ?)", [(i, f"p{i}", f"20{10 + i % 9}-01-0{1 + i % 5}" if i % 4 else None, "Apple Inc" if i % 2 else "Other") for i in range(20)])
    con.execute("CREATE TABLE empty_one (n INTEGER)")
    con.commit()
    con.close()
    yield lambda: sqlite3.connect(path)
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_scan_and_pushed_filters(spark, base):
    claims = database.scan(spark, base, CLAIMS, "claims", "claim_id", 6)
    assert claims.rdd.getNumPartitions() == 6 and claims.count() == 401
    want = [r for r in claims.collect()]
    tests = {
        "claim_id = 7": lambda r: r.claim_id == 7, "claim_number >= 3 and claim_number < 5": lambda r: 3 <= r.claim_number < 5, "patent_id in ('p1', 'p3')": lambda r: r.patent_id in ("p1", "p3"),
        "claim_text is null": lambda r: r.claim_text is None, "contains(claim_text, '0%')": lambda r: "0%" in (r.claim_text or ""), "startswith(claim_text, 'claim')": lambda r: False,
        "endswith(claim_text, 'a_b') and not claim_number = 2": lambda r: (r.claim_text or "").endswith("a_b") and r.claim_number != 2, "claim_id <=> null": lambda r: r.claim_id is None,
        "length(patent_id) = 2 and claim_id > 300": lambda r: len(r.patent_id) == 2 and (r.claim_id or 0) > 300,
    }
    for said, test in tests.items():
        assert sorted(map(str, claims.where(said).collect())) == sorted(map(str, filter(test, want))), said
    plan = claims.where("claim_number >= 3 and length(patent_id) = 2")._jdf.queryExecution().executedPlan().toString()
    kept = next(line for line in plan.splitlines() if "Filter" in line)  # what the database says is not asked again
    assert "BatchScan siltstone_claims" in plan and "length(patent_id" in kept and "claim_number" not in kept
    assert database.scan(spark, base, "n long", "empty_one", "n").count() == 0


def test_claims_with_their_patents_in_order(spark, base):
    claims = database.scan(spark, base, CLAIMS, "claims", "claim_id", 3)
    patents = database.scan(spark, base, "n long, patent_id string, grant_date string, assignee_organization string", "patents", "n", 2)
    got = [(r.grant_date, r.patent_id, r.claim_number) for r in filings.joined_claims(patents, claims.where(F.col("claim_text").isNotNull()), "APPLE").collect()]
    con = base()
    want = con.execute("SELECT p.grant_date, p.patent_id, c.claim_number FROM claims c JOIN patents p ON p.patent_id = c.patent_id WHERE lower(assignee_organization) LIKE '%apple%' AND claim_text IS NOT NULL ORDER BY p.grant_date IS NOT NULL, p.grant_date DESC, p.patent_id, c.claim_number").fetchall()
    assert got == want and len(want) > 50
