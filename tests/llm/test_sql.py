"""Queries that SQL can express agree with it, on the smallest tables."""

import duckdb
import pytest

from tracemill.llm.entry import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for table in ("clicks", "documents", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    found = db.execute(oracle_sql()[name])
    names = [c[0] for c in found.description]
    want = sorted(tuple(str(v) for _, v in sorted(zip(names, row, strict=True))) for row in found.fetchall())
    got = queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(names) and want
    assert sorted(tuple(str(r[c]) for c in sorted(got.columns)) for r in got.collect()) == want
