"""shipping_union against its SQL on quantities with a fraction, times before 1970 and missing values."""

import duckdb

from spanveil.plans import registry

ROWS = """(1, 19.6, '1995-01-01'), (1, 5, '1995-01-03'), (2, NULL, '1995-01-01'), (2, 5, NULL), (2, 15, NULL), (3, 5, '1965-01-01 12:00'), (3, -15, '1995-01-01'), (NULL, 5, '1995-01-01'),
  (NULL, 5, '1995-01-05'), (4, 25, '1995-01-01'), (4, NULL, '1995-01-02'), (4, 10, '1995-01-04'), (5, 5, '1995-01-01'), (5, 5, '1995-01-01'), (6, 35, '1995-01-01'), (6, 5, NULL), (6, NULL, NULL)"""


def test_odd_spans_are_those_of_the_sql(spark, tmp_path):
    con = duckdb.connect()
    con.sql("SET threads = 1")  # with more, rows that its ORDER BY ties may come in another order in each of its windows
    con.sql(f"CREATE TABLE lineitem AS SELECT CAST(k AS BIGINT) AS l_suppkey, CAST(q AS DOUBLE) AS l_quantity, CAST(d AS TIMESTAMP) AS l_shipdate FROM (VALUES {ROWS}) t(k, q, d)")
    con.sql(f"COPY lineitem TO '{tmp_path}/lineitem.parquet'")
    got = [tuple(r) for r in registry.queries()["shipping_union"](spark, str(tmp_path)).select("l_suppkey", "lo", "hi").collect()]
    want = con.sql(registry.oracle_sql()["shipping_union"]).fetchall()
    assert want and sorted(map(str, got)) == sorted(map(str, want))


def test_equal_spans_open_one_run(spark, tmp_path):
    """Two equal spans that touch nothing before them are a run of their own, and don't lengthen the one before."""
    spark.sql("SELECT CAST(1 AS BIGINT) AS l_suppkey, CAST(q AS DOUBLE) AS l_quantity, CAST(d AS TIMESTAMP) AS l_shipdate FROM VALUES (0, '1970-01-02'), (10, '1970-01-05'), (10, '1970-01-05') t(q, d)").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sorted(map(tuple, registry.queries()["shipping_union"](spark, str(tmp_path)).collect())) == [(1, 1, 1), (1, 4, 5)]
