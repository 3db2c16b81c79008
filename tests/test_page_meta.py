"""page_meta counts the hits of all twelve rules, as its SQL states them."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from spanveil.operators import rules
from spanveil.plans import registry, rule_sql
from tests.literal_cases import RULE_HITS, RULE_LINES

#: Where a rule looks around its match, where rules overlap, and where one match only begins behind another.
EDGES = [
    "5+8613800138000", "++86 138-0013-8000x", "1380013800013800138000", "13800138000+8613800138001", "_11010519491231002X_", "x11010519491231002X", "11010519491231002x", "11010519490230002X",
    "a91350100M000100Y43b 91350100M000100Y43", "0539-8591248转123456", "0539-8591248 分机 7774", "-0539-8591248", "0539-85912481", "电话手机0522.3964869电话0522.3964868", "电话0522.3964869.", "电话12345 0522.3964869",
    "1 4111 1111 1111 1111", "4111-1111-1111-1111-1", "4111 1111 1111 1111 11111", "证件号码：E12345678 证件E12345678x", "😀京E·31979挂 京E\x0b31979", "\x01a@b.co\x02c@d.org", "到北京协和医院东院区", "本人在某某有限公司银行卡", "大河银行账 大河银行",
    "4111111111111111@example.com 13800138000@example.com", "110105194912310021@example.com 110101199003070142", None, "",
]


@pytest.fixture(scope="module")
def edges():
    con = duckdb.connect()
    con.execute("CREATE TABLE ln (doc_id BIGINT, page INTEGER, line INTEGER, text VARCHAR)")
    con.executemany("INSERT INTO ln VALUES (?, 0, 0, ?)", [*enumerate(EDGES), *[(100 + i, t) for i, t in RULE_LINES]])
    return con


def test_page_meta_counts_all_rules(spark, tmp_path):
    spark.createDataFrame(RULE_LINES, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(str, ((r["doc_id"], r["page"], r["n"]) for r in registry.queries()["page_meta"](spark, str(tmp_path)).collect())))
    per_doc = Counter(i for i, *_ in RULE_HITS)
    assert got == sorted(map(str, [(None, None, len(RULE_HITS)), *[(i, None, n) for i, n in per_doc.items()], *[(i, 1, n) for i, n in per_doc.items()]]))
    want = duckdb.connect()
    want.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(map(str, want.sql(registry.oracle_sql()["page_meta"]).fetchall()))


def test_sql_states_all_rules(spark, edges):
    df = spark.createDataFrame([tuple(r) for r in edges.sql("SELECT doc_id, text FROM ln").fetchall()], "doc_id bigint, text string")
    hits = df.select("doc_id", F.explode(rules.find(F.col("text"))).alias("h")).select("doc_id", "h.prio", "h.start", "h.end")
    want = sorted(map(tuple, hits.collect()))
    assert {p for _, p, *_ in want} == set(range(1, 13))
    assert sorted(edges.sql(f"WITH one AS (SELECT 1), {rule_sql.ALL_HITS} SELECT doc_id, prio, s, e FROM all_hits").fetchall()) == want
