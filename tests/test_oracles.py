"""Every query with oracle SQL, against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from chronocite.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return (0, "")
    if not isinstance(v, bool) and (isinstance(v, (int, float)) or type(v).__name__ == "Decimal"):
        return (1, f"{float(v):.9g}") if not math.isnan(v) else (2, "")
    return (1, str(v))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    answer = duck.execute(registry.ORACLES[name])
    names = [c[0] for c in answer.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in answer.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_others_run(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 1
