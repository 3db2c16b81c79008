"""Check characters worked out instead of tried."""

from pyspark.sql import functions as F

from spanveil.functions import validators as v
from spanveil.plans import registry


def test_check_character_is_the_one_that_passes(spark):
    body = F.concat(F.lit("91"), F.lpad((F.col("id") % 25).cast("string"), 6, "0"), F.lpad(F.col("id").cast("string"), 9, "A"))
    own = spark.range(2000).select("id", body.alias("body"))
    tried = own.select("id", "body", F.explode(F.array(*[F.lit(c) for c in v.USCC_ALPHABET])).alias("c")).where(v.uscc_ok(F.concat("body", "c")))
    assert tried.count() == 2000 == tried.where(F.col("c") == v.uscc_check_character(F.col("body"))).count()


def test_one_row_a_customer_whatever_its_keys(spark, tmp_path):
    spark.sql("SELECT * FROM VALUES (1L, 3), (1234567890L, 3), (7L, NULL) t(c_custkey, c_nationkey)").write.parquet(f"{tmp_path}/customer.parquet")
    df = registry.queries()["company_codes"](spark, str(tmp_path))
    assert {r["c_custkey"]: r["code"] and len(r["code"]) for r in df.collect()} == {1: 18, 1234567890: 18, 7: None}
    assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()
