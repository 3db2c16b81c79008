"""similar_pairs takes every vector as a query, over several blocks, against its SQL."""

import duckdb
import numpy as np

from spanveil.operators import regions
from spanveil.plans import registry


def test_all_vectors_are_queries(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(7 * i + 1, v) for i, v in enumerate((rng.integers(-4, 5, (1300, 8)) / 10.0).astype("float32").tolist())]  # many products of about 0.4
    rows += [(None, [1.0] * 8), (3, None), (8, [1.0] * 8), (8, [0.5] * 8), (11, [float("nan")] * 8), (12, [float("inf")] + [0.0] * 7), (13, [0.0] * 8), (14, [1e30] * 8)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = sorted(tuple(r) for r in registry.queries()["similar_pairs"](spark, str(tmp_path)).collect())
    assert got == sorted(con.sql(registry.oracle_sql()["similar_pairs"]).fetchall())
    assert {q for q, _ in got if q % 20} and {(v, q) for q, v in got} == set(got)


def test_blocks_keep_to_their_size(spark, monkeypatch):
    """As many blocks as the values ask for, each pair of blocks a task."""
    vectors = spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(90)], "vec_id bigint, embedding array<float>")
    monkeypatch.setattr(regions, "BLOCK", 20)
    out = regions.similar_pairs(vectors, 1.0)
    assert out.rdd.getNumPartitions() == 9 * 10 // 2 and out.count() == 90 * 89
