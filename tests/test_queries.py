"""Every registered query with SQL gives the SQL's rows on the smallest tables."""

import os

import duckdb
import pytest

from tracewell import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, duck, name, tmp_path):
    registry.QUERIES[name](spark, SF).write.parquet(str(tmp_path / "out"))
    rel = duck.sql(registry.ORACLE_SQL[name])
    cols = ", ".join(f'"{c}"' for c in sorted(rel.columns))
    got = duck.sql(f"select {cols} from '{tmp_path}/out/*.parquet'").fetchall()
    want = duck.sql(f"select {cols} from ({registry.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert want, "the query says nothing on these tables"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
