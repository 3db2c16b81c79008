import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spanveil.llm import simhash_dedup as d
from tests.llm.cases import PROSE, documents, with_clashes


def slow_fingerprint(text):
    ws = text.encode().lower().split() if text else []
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(ws[k : k + 3]), 42) for k in range(max(1, len(ws) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprint_by_bits(spark):
    texts = ["", None, "one", "Two words", "a b c", PROSE, "É É é x\x0by\tz" * 5, PROSE * 20, "a\u00a0b c d"]
    assert [d.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]
    # The engine's own hash agrees with the library's.
    row = spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("h")).first()
    assert row["h"] % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


def near_values(rng, centres, n, flips=2):
    c = rng.integers(0, 2**64, centres, dtype=np.uint64)
    x = c[rng.integers(0, centres, n)]
    for _ in range(flips):
        x = x ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    return np.unique(x)


def gray(x):
    for k in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(k))
    return x


@pytest.mark.parametrize("n", [2, 15, 17, 300, 2000])
def test_index_finds_every_link(n):
    f = near_values(np.random.default_rng(n), max(1, n // 60), n)
    f = f[np.argsort(gray(f))]
    i, j = d.node_links(f)
    a, b = np.where(np.triu(np.bitwise_count(f[:, None] ^ f[None, :]) <= 3, 1))
    assert set(zip(i.tolist(), j.tolist())) == set(zip(a.tolist(), b.tolist()))


def test_paths_share_bits_by_the_pigeonhole_principle():
    two, five = d.masks(2), d.masks(d.DEPTH)
    assert len(two) == 16 and all(m.bit_count() == 28 for m, _ in two.values())
    assert len(five) == 4**5 and max(len(left) for _, left in five.values()) <= 16
    rng = np.random.default_rng(1)
    for _ in range(200):
        diff = 0
        for b in rng.integers(0, 64, 3).tolist():
            diff |= 1 << b
        assert any(diff & m == 0 for m, _ in two.values())


@pytest.mark.parametrize("node", [1024, 8])
def test_components_equal_brute_force(spark, node):
    f = near_values(np.random.default_rng(9), 12, 1500)
    ids = np.random.default_rng(2).permutation(len(f)) + 10
    values = spark.createDataFrame([(int(x), int(i)) for x, i in zip(f.view(np.int64), ids)], "fp bigint, id bigint")
    root = {r["a"]: r["b"] for r in d.components(d.link_edges(values, node)).collect()}
    i, j = np.where(np.triu(np.bitwise_count(f[:, None] ^ f[None, :]) <= 3, 1))
    want = d.least_reachable(ids.astype(np.int64), i, j)
    assert [root.get(int(x), int(x)) for x in ids] == want.tolist()


def test_long_chains_end(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(300)] + [(1000, 999)], "a bigint, b bigint")
    root = {r["a"]: r["b"] for r in d.components(edges).collect()}
    assert all(root[i] == 0 for i in range(1, 301)) and root[1000] == 999


def test_documents_with_nulls_and_copies(spark):
    groups = {(r["doc_id"], r["component_id"]) for r in d.near_groups(with_clashes(documents(spark))).collect()}
    assert {(1, 1), (2, 1), (3, 3), (4, 3), (6, 3), (7, 7)} <= groups
    kept = sorted(r["doc_id"] for r in d.drop_near_duplicates(documents(spark)).collect() if r["doc_id"] is not None)
    assert kept.count(1) == 1 and 2 not in kept and 3 in kept and 4 not in kept


def test_ids_of_any_type(spark):
    """Text ids give the groups of numbers that sort alike; so do small integers."""
    docs = documents(spark, [(20 + k, PROSE * 3 + (" x" if k % 2 else ""), "en", "a", None) for k in range(6)])
    want = {(r["doc_id"], r["component_id"]) for r in d.near_groups(docs).collect()}
    kept = sorted(str(r["doc_id"]) for r in d.drop_near_duplicates(docs).collect())
    name = lambda x: None if x is None else f"id-{x:05d}"
    texts = docs.withColumn("doc_id", F.when(F.col("doc_id").isNotNull(), F.concat(F.lit("id-"), F.lpad(F.col("doc_id").cast("string"), 5, "0"))))
    assert {(r["doc_id"], r["component_id"]) for r in d.near_groups(texts).collect()} == {(name(a), name(b)) for a, b in want}
    assert sorted(str(r["doc_id"]) for r in d.drop_near_duplicates(texts).collect()) == sorted(str(name(int(x))) if x != "None" else "None" for x in kept)
    ints = docs.withColumn("doc_id", F.col("doc_id").cast("int"))
    assert {(r["doc_id"], r["component_id"]) for r in d.near_groups(ints).collect()} == want


def near_pairs(docs):
    """Pairs of different texts with 0.8 or more of their five-word shingles in common, one row a text, by all shared shingles."""
    texts = {}
    for i, t in sorted(docs):
        if t:
            texts.setdefault(" ".join(t.lower().split()), i)
    shingles = {i: {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} for t, i in texts.items() for ws in [t.split()] if len(ws) >= 5}
    where, shared = {}, {}
    for i, own in shingles.items():
        for x in own:
            for j in where.setdefault(x, []):
                shared[j, i] = shared.get((j, i), 0) + 1
            where[x].append(i)
    return [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(shingles[a]) + len(shingles[b]) - n)]


def test_lone_edited_copies_have_links_of_their_own():
    """Direct links of the table's pairs, and of texts with one to three words in a hundred changed, without any copy between."""
    import duckdb

    caught = []
    for sf in ("sf0.01", "sf0.1"):
        docs = duckdb.sql(f"SELECT doc_id, text FROM '/root/testdata/{sf}/documents.parquet' WHERE text IS NOT NULL").fetchall()
        text = dict(docs)
        pairs = near_pairs(docs)
        linked = [any((x ^ y).bit_count() <= d.RADIUS for x, y in zip(d.word_prints(text[a]), d.word_prints(text[b]))) for a, b in pairs]
        print(sf, "pairs with a link of their own:", sum(linked), "of", len(linked))
        caught += linked
    assert sum(caught) >= 0.9 * len(caught)
    rng = np.random.default_rng(3)
    words = ["".join(chr(97 + k) for k in rng.integers(0, 26, 6)) for _ in range(4000)]
    hits = []
    for _ in range(200):
        own = [words[k] for k in rng.integers(0, 4000, int(rng.integers(60, 400)))]
        copy = list(own)
        for k in rng.choice(len(own), max(1, int(len(own) * rng.uniform(0.01, 0.02))), replace=False).tolist():
            copy[k] = words[int(rng.integers(0, 4000))]
        hits.append(any((x ^ y).bit_count() <= d.RADIUS for x, y in zip(d.word_prints(" ".join(own)), d.word_prints(" ".join(copy)))))
    print("edited copies with a link of their own:", sum(hits) / len(hits))
    assert sum(hits) >= 0.9 * len(hits)


def test_empty_table(spark):
    empty = documents(spark).where(F.lit(False))
    assert d.near_groups(empty).count() == 0 and d.drop_near_duplicates(empty).count() == 0


def slow_groups(docs):
    """Components by all pairs of documents, for any of the fingerprints."""
    prints = {i: d.word_prints(t) for i, t in docs}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in prints:
        for j in prints:
            if i < j and any((a ^ b).bit_count() <= d.RADIUS for a, b in zip(prints[i], prints[j])):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in prints}


def test_copies_by_distinct_words(spark):
    rng = np.random.default_rng(12)
    words = ["".join(chr(97 + k) for k in rng.integers(0, 26, int(rng.integers(2, 9)))) for _ in range(3000)]
    rows, originals = [], []
    for i in range(60):
        text = [words[k] for k in rng.integers(0, 3000, int(rng.integers(60, 300)))]
        originals.append(len(rows))
        rows.append((len(rows), " ".join(text)))
        for _ in range(2):  # near copies: one word in fifty replaced, which leaves 0.8 of the five-word shingles
            copy = list(text)
            for k in rng.choice(len(text), max(1, len(text) // 50), replace=False).tolist():
                copy[k] = words[int(rng.integers(0, 3000))]
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame([*rows, (1000, rows[0][1]), (1001, ""), (1002, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in d.copy_groups(docs).collect()}
    assert got == slow_groups([(r["doc_id"], r["text"]) for r in docs.collect()])
    caught = sum(got[i] == i // 3 * 3 for i, _ in rows if i % 3)
    assert got[1000] == 0 and got[1002] == 1001 and caught >= 0.9 * 120 and all(got[i] == i for i in originals)
    kept = {r["doc_id"] for r in d.drop_near_duplicates(docs).collect()}
    assert kept == set(got.values())


def test_long_texts_of_one_language_are_not_copies():
    rng = np.random.default_rng(4)
    words, share = [f"w{k}" for k in range(30000)], 1 / np.arange(1, 30001)
    texts = [" ".join(rng.choice(words, 8000, p=share / share.sum())) for _ in range(12)]
    prints = [d.word_prints(t) for t in texts]
    assert min((a ^ b).bit_count() for i, p in enumerate(prints) for q in prints[:i] for a, b in zip(p, q)) > d.RADIUS
