import random

import numpy as np
from pyspark.sql import functions as F

from spanveil.llm import decontaminate as c
from spanveil.llm.fm_index import FMIndex, suffix_array
from tests.llm.cases import documents, with_clashes


def test_suffix_array_and_search():
    rng = np.random.default_rng(4)
    text = rng.integers(1, 4, 400)
    order = suffix_array(np.append(text, 0))
    full = np.append(text, 0).tolist()
    assert order.tolist() == sorted(range(401), key=lambda i: full[i:])
    index = FMIndex(text, 4)
    phrases = np.zeros((60, 5), np.int32)
    lengths = rng.integers(1, 6, 60)
    for k, n in enumerate(lengths.tolist()):
        phrases[k, :n] = rng.integers(1, 4, n)
    found, low, high = index.search(phrases, lengths)
    got = {int(k): sorted(index.locate(np.arange(a, b)).tolist()) for k, a, b in zip(found, low, high)}
    for k, n in enumerate(lengths.tolist()):
        want = [i for i in range(400 - n + 1) if text[i : i + n].tolist() == phrases[k, :n].tolist()]
        assert got.get(k, []) == want


def random_case(seed, docs=40):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["É", "don't"]
    items = [(str(i), " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 13, 14, 30])))) for i in range(8)] + [("9", None)]
    texts = []
    for _ in range(docs):
        t = [rng.choice(words + ["zzz", "Q?"]) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            t[rng.randint(0, len(t)) : 0] = (rng.choice(items)[1] or "").upper().split()
        texts.append(" ".join(t))
    return items, [*texts, None, ""]


def test_shards_equal_brute_force():
    for seed in range(6):
        items, texts = random_case(seed)
        p = c.Phrases([(i, c.words(t)) for i, t in items])
        for t, (n, own, hit) in zip(texts, c.search_shard(texts, p)):
            want = c.brute_force(t, items)
            assert (n, len(hit), len(own)) == want[:3]


def test_blocks_of_the_benchmark_give_the_same(spark):
    items, texts = random_case(11, 30)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(int(i), t) for i, t in items], "item_id bigint, text string")
    for block in (1_000_000, 20):
        found = c.annotate(docs, bench, block_words=block)
        for r in found.collect():
            own = r["contamination"]
            want = c.brute_force(texts[r["doc_id"]], items)
            assert (own["n_words"], own["n_hit"], len(own["items"])) == want[:3], block


def test_spans_are_code_points(spark):
    passage = " ".join(f"p{i}" for i in range(13))
    docs = spark.createDataFrame([(1, f"é {passage}, tail")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, passage)], "item_id bigint, text string")
    r = c.annotate(docs, bench).select("contamination.spans", c.without_spans("text", "contamination.spans").alias("rest")).first()
    assert [(x["start"], x["end"]) for x in r["spans"]] == [(2, 2 + len(passage))] and r["rest"] == "é , tail"


def test_stage_keeps_clean_rows_and_columns(spark):
    docs = with_clashes(documents(spark))
    bench = spark.createDataFrame([(1, "nothing like it"), (2, None)], "item_id bigint, text string")
    out = c.decontaminate(docs, bench)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert c.decontaminate(docs, bench.where(F.lit(False))).count() == docs.count()
    assert c.decontaminate(docs.where(F.lit(False)), bench).count() == 0
