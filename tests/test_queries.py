"""Every registered query against its SQL; the others must return rows."""

import duckdb
import pytest

from spanveil.plans import registry
from tests import more_literal_cases  # noqa: F401  registers its cases
from tests.case_sql import CASE_SQL
from tests.literal_cases import CASES, EXPECTED

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    return "null" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x).lower()


def test_case_sql_works_out_the_stated_rows(con):
    for name, sql in CASE_SQL.items():
        columns, rows = EXPECTED[name]
        found = con.sql(sql).project(", ".join(f'"{c}"' for c in columns)).fetchall()
        assert sorted(tuple(map(plain, r)) for r in found) == sorted(tuple(map(plain, r)) for r in rows), name


@pytest.mark.parametrize("name", sorted(CASES))
def test_literal_case(spark, name):
    columns, rows = EXPECTED[name]
    found = CASES[name](spark).select(*columns).collect()
    assert sorted(tuple(map(plain, r)) for r in found) == sorted(tuple(map(plain, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(x) for x in r) for r in df.select(*cols).collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    want = sorted(tuple(plain(x) for x in r) for r in rel.project(", ".join(f'"{c}"' for c in cols)).fetchall())
    assert got == want
