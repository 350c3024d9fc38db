"""Every registered query with a twin against DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from tracklens.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    cell = lambda x: "null" if x is None or (isinstance(x, float) and math.isnan(x)) else f"{x:.5f}" if isinstance(x, float) else str(x)
    return sorted("|".join(cell(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_twin(spark, db, name):
    df = registry.QUERIES[name](spark, DATA)
    found = plain([tuple(r) for r in df.collect()], df.columns)
    twin = db.sql(registry.ORACLE[name])
    wanted = plain(twin.fetchall(), twin.columns)
    assert sorted(df.columns) == sorted(twin.columns)
    assert found == wanted
