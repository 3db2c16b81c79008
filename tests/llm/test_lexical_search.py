import math
import random
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from spanveil.llm import lexical_search as s
from tests.llm.cases import documents, with_clashes

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10, multiplicity=False):
    """Rows (item_id, rank, doc_id, score) with every document against every item."""
    counts = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, total = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    own = {}
    for i, t in items:
        own.setdefault(i, Counter()).update(terms(t))
    for i, q in own.items():
        scored = []
        for d, c in counts:
            m = 10 + 90 * sum(c.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) * (times if multiplicity else 1) for t, times in q.items() if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def made(seed, n=120):
    rng = random.Random(seed)
    words = [rng.choice(["é", "", "x"]) + "".join(rng.choice("abc1") for _ in range(rng.randrange(1, 4))) for _ in range(60)] + ["The"] * 20
    text = lambda m: " ".join(rng.choice(words) + rng.choice(["", ".", "-", " "]) for _ in range(m))
    docs = [(k, text(rng.choice([0, 1, 3, 10, 60]))) for k in range(n)]
    docs += [(k + 500, docs[5][1] + " copy") for k in range(40)] + [(7, docs[7][1]), (None, docs[9][1]), (900, None), (901, "THE the The")]
    items = [(k, text(rng.choice([0, 1, 4, 12]))) for k in range(12)] + [(3, "again abc"), (50, None), (51, "zzz unknown"), (None, "the copy")]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = made(1)
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    assert found(s.search(with_clashes(d), with_clashes(i))) == brute(docs, items)
    assert found(s.search(d, i, k=3, multiplicity=True)) == brute(docs, items, 3, True)
    # Items in several groups give the same.
    assert found(s.search(d, i, group_terms=12)) == brute(docs, items)


def test_string_ids_and_empty_tables(spark):
    docs, items = made(2, 30)
    d = spark.createDataFrame([(None if a is None else f"d{a:04d}", t) for a, t in docs], "doc_id string, text string")
    i = spark.createDataFrame([(f"i{a}", t) for a, t in items], "item_id string, text string")
    want = sorted(((f"i{a}", r, None if x is None else f"d{x:04d}", y) for a, r, x, y in brute(docs, items)), key=str)
    assert found(s.search(d, i)) == want
    assert found(s.search(d.where(F.lit(False)), i)) == [] and found(s.search(d, i.where(F.lit(False)))) == []
    assert s.search(documents(spark), i).count() >= 0


def test_sql_agrees(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = sorted(con.sql(s.ORACLE).project("item_id, rank, doc_id, score").fetchall(), key=str)
    got = found(s.op12_lexical_search(spark, sf))
    assert got == want and len({(i, r) for i, r, _, _ in got}) == len(got)
