"""The driver's contract: every query that has SQL agrees with it."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tracemill import catalog, mined_queries
from tracemill.functions import text as tx
from tracemill.operators import routes
from tracemill.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    out = duckdb.connect()
    for name in TABLES:
        out.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return out


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    rows = sorted(tuple(str(r[c]) for c in sorted(got.columns)) for r in got.collect())
    assert rows or name in SQL  # the smallest tables may hold nothing to propose
    if name in SQL:
        found = db.execute(SQL[name])
        names = [c[0] for c in found.description]
        want = sorted(tuple(str(v) for _, v in sorted(zip(names, row, strict=True))) for row in found.fetchall())
        assert sorted(names) == sorted(got.columns) and rows == want


def test_entry(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())


def agrees(spark, db, sf_dir, name) -> bool:
    got = QUERIES[name](spark, sf_dir)
    found = db.execute(SQL[name])
    names = [c[0] for c in found.description]
    want = sorted(tuple(str(v) for _, v in sorted(zip(names, row, strict=True))) for row in found.fetchall())
    return sorted(tuple(str(r[c]) for c in sorted(got.columns)) for r in got.collect()) == want


def test_a_broken_operator_shows(spark, db, sf_dir, monkeypatch):
    """The queries run the engine itself: what is broken there makes them disagree with their SQL."""
    assert agrees(spark, db, sf_dir, "tool_friction") and agrees(spark, db, sf_dir, "project_corrections") and agrees(spark, db, sf_dir, "history_last10")
    with monkeypatch.context() as broken:
        broken.setattr(routes, "retries", lambda cli, settings: cli.groupBy("entity").agg(F.lit(0).alias("retries")))
        assert not agrees(spark, db, sf_dir, "tool_friction")
    with monkeypatch.context() as broken:
        broken.setattr(catalog, "CORRECTIONS_A_SESSION", 1)
        broken.setattr(routes, "ORDER", ["session_ord", "line"])
        broken.setattr(routes, "references", lambda evidence: F.transform(evidence, lambda e: e["path"]))
        assert not agrees(spark, db, sf_dir, "project_corrections")
    with monkeypatch.context() as broken:
        broken.setattr(mined_queries, "_made", {})
        broken.setattr(tx, "is_pasted", lambda text: F.lit(False))
        assert not agrees(spark, db, sf_dir, "mined_evidence")
    assert agrees(spark, db, sf_dir, "mined_evidence")
