"""Each registered query of the engine against its oracle in DuckDB, on the smallest tables."""

import os

import pytest

from larkspur.plans.catalogue import ORACLES, QUERIES, TABLES

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plain(rows):
    return sorted(tuple("\0" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_oracle(spark, db, name):
    df = QUERIES[name](spark, SF)
    found = db.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert plain(df.select(*[f"`{n}`" for n in names]).collect()) == plain(found.fetchall())
