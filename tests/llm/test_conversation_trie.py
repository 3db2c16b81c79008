import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from spanveil.llm import conversation_trie as t
from tests.llm.cases import with_clashes

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Rows of the query by building every prefix."""
    digest = lambda r, x: hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest()
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), digest(role, text), (role, text)))
    own = {c: [x for _, _, x in sorted(v)] for c, v in own.items()}
    nodes = defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        turns = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append((c, d == len(turns)))
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(members) - 1) * (len(p[-1][1]) if p else 0)
    return sorted(
        (m[0][0], len(p), nodes[p[:-1]][0][0] if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c, e in m if e).encode()).hexdigest())
        for p, m in nodes.items()
    )


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def some_rows(seed, convs=180, ids=420):
    rng = random.Random(seed)
    words = ["hello", "yes", "no", "a longer answer é", "", None]
    rows = []
    for c in rng.sample(range(-ids // 3, ids), convs):
        rows += [(c, k if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(words)) for k in range(rng.choice([0, 1, 2, 3, 5, 8, 13, 21]))]
    rows += [(5, 3, "user", "tie"), (5, 3, "user", "tie"), (5, 3, "user", "other"), (None, 1, "user", "lost"), (9, 0, "user", "x" * 100_000)]
    return rows


def test_equals_all_prefixes(spark):
    for seed in (1, 2):
        rows = some_rows(seed)
        df = spark.createDataFrame(rows, SCHEMA)
        assert found(t.prefix_trie(with_clashes(df))) == brute(rows)
    # Parts of few nodes, heavy families and hot parents give the same.
    assert found(t.prefix_trie(df, heavy=30, nodes=5, hot=3)) == brute(rows)
    assert found(t.prefix_trie(df, nodes=1, hot=2)) == brute(rows)


def test_deep_copies_across_families(spark):
    long = [(k, "user" if k % 2 else "assistant", f"turn {k}") for k in range(40)]
    rows = [(c, *x) for c in (100, 201, 302, 1200, 1201) for x in long] + [(c, *x) for c in (403, 404) for x in long[:25]]
    assert found(t.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_no_conversations(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert found(t.prefix_trie(empty)) == []
    assert found(t.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA))) == []


def test_last_turns_of_nodes(spark):
    df = spark.createDataFrame(some_rows(3, 60), SCHEMA)
    nodes = t.with_turns(t.prefix_trie(df), df)
    rows = nodes.select("k1", "depth", "text", "n_convs").collect()
    assert len(rows) == len(brute(some_rows(3, 60))) and all((r["text"] is None) == (r["depth"] == 0) for r in rows)


def test_sql_agrees(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = sorted(con.sql(t.ORACLE).project(", ".join(COLUMNS)).fetchall())
    assert found(t.op11_conversation_trie(spark, sf)) == want


def test_base_turns_are_few(spark):
    rows = [(0, k, "user", str(k)) for k in range(5000)]
    assert t.family_parts(spark.createDataFrame(rows, SCHEMA)).agg(F.max("depth")).first()[0] == 5000
