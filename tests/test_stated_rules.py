"""Queries over the hits, against their SQL, on texts that hold more than the SQL states."""

import duckdb
import pytest

from spanveil.plans import registry

#: Phones, numbers of persons and companies, grouped cards and organisations beside, inside and across what the SQL finds.
TEXTS = [
    "call 18945874088 now", "a13800138000@example.com", "4111111111111111 13800138000", "4111 1111 1111 1111 b@c.de", "11010519491231002X\n91350100M000100Y43",
    "4111111111111111@example.com", "110105194912310021@example.com 110101199003070142", "北京协和医院 d@e.fr\n0539-8591248转7774", "nothing", "", None,
]


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    at, con = tmp_path_factory.mktemp("stated"), duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars INTEGER)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, 'web', 1)", [(i, t, "de" if i % 2 else "en") for i, t in enumerate(TEXTS)])
    con.execute("CREATE TABLE conversations AS SELECT doc_id AS conv_id, CAST(0 AS INTEGER) AS turn, 'user' AS role, text FROM documents")
    con.execute("CREATE TABLE pages AS SELECT doc_id AS page_id, 'http://a.b/' AS url, text AS html FROM documents")
    for t in ("documents", "conversations", "pages"):
        con.execute(f"COPY {t} TO '{at}/{t}.parquet'")
    return str(at), con


def equals_sql(spark, small, name):
    at, con = small
    df = registry.queries()[name](spark, at)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    want = con.sql(registry.oracle_sql()[name]).project(", ".join(f'"{c}"' for c in cols)).fetchall()
    assert want and sorted(map(str, got)) == sorted(map(str, want))


HITS = "alias_map_counts aliases counts_by_lang entity_counts entity_counts_rollup line_tags page_meta prose_scores report_items resolved_hits seeds sql_entities tagged_round_trip".split()


@pytest.mark.parametrize("name", [*HITS, "detect_bank_card", "detect_bank_pages", "detect_email", "detect_email_conv"])
def test_hits_are_those_of_the_sql(spark, small, name):
    equals_sql(spark, small, name)


def test_observed_hits_are_those_of_the_sql(spark, small):
    equals_sql(spark, small, "observed_counts")


@pytest.mark.parametrize("name", ["redact_black", "redact_label", "residual_check"])
def test_redaction_is_that_of_the_sql(spark, small, name):
    equals_sql(spark, small, name)
