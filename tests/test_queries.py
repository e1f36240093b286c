"""Every registered query of the engine against its SQL, on the smallest sample."""

import math
import os

import duckdb
import pytest

from penumbra.plans import registry, reports, walking  # noqa: F401

SF = os.environ.get("PENUMBRA_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    if name not in registry.ORACLES:
        assert mine
        return
    sql = registry.ORACLES[name]
    assert sorted(con.sql(sql).columns) == columns
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    assert mine == sorted((tuple(plain(v) for v in r) for r in want), key=repr)
