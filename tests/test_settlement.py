"""Sums that don't depend on the order of rows."""

from spanveil.plans import registry


def test_settlement_is_exact(spark, tmp_path):
    """Doubles that lose a large sum's small terms: 2^53 and thrice 1."""
    spark.sql("SELECT 'A' AS l_returnflag, 'F' AS l_linestatus, CAST(x AS DOUBLE) AS l_extendedprice FROM VALUES (9007199254740992), (1), (1), (1), (0.25) t(x)").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [tuple(r) for r in registry.queries()["fee_settlement"](spark, str(tmp_path)).collect()] == [("A", 9007199254740995, 0)]
