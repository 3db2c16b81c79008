import struct
import zlib

import duckdb
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from spanveil.llm import decontaminate, language_id, secret_scan, simhash_dedup
from spanveil.llm.queries import ORACLE_SQL
from spanveil.session import table

SF = "/root/testdata/sf0.001"


def test_stages_and_what_they_drop(spark):
    assert [n for n, _ in pipeline.STAGES] == ["language", "near_dups", "contamination", "secrets", "packing"]
    docs = table(spark, SF, "documents")
    before = docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        n = out.count()
        assert n <= before and (n == before or name != "secrets")
        docs, before = out, n
    pieces = pipeline.run(spark, SF)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def slow_kept(docs, crf, items):
    """ids that the first three stages keep, by looking at every text and every pair of texts."""
    found = language_id.detect_all([t for _, t in docs], crf)
    docs = [d for d, f in zip(docs, found) if f["lang"] != "und" and f["score"] >= 0.4]
    prints = [simhash_dedup.word_prints(t) for _, t in docs]
    root = {i: i for i, _ in docs}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, _) in enumerate(docs):
        for b in range(a):
            if any((x ^ y).bit_count() <= simhash_dedup.RADIUS for x, y in zip(prints[a], prints[b])):
                x, y = sorted((top(i), top(docs[b][0])))
                root[y] = x
    docs = [(i, t) for i, t in docs if top(i) == i]
    windows = {tuple(ws[k : k + 13]) for t in items for ws in [decontaminate.words(t)] for k in range(max(1, len(ws) - 12) if ws else 0)}
    sizes, kept = {len(w) for w in windows}, []
    for i, t in docs:
        ws = decontaminate.words(t)
        hit = {k + j for n in sizes for k in range(len(ws) - n + 1) if tuple(ws[k : k + n]) in windows for j in range(n)}
        if not hit or 20 * len(hit) < len(ws):
            kept.append(i)
    return kept


def test_pipeline_equals_a_slow_one(spark):
    docs = table(spark, SF, "documents")
    crf = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    kept = slow_kept(rows, crf, [r["text"] for r in table(spark, SF, "benchmark").collect()])
    pieces = pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in pieces} == set(kept) and 0 < len(kept) < len(rows)
    tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    masked = {r["doc_id"]: r["text"] for r in secret_scan.mask(docs.where(F.col("doc_id").isin(kept))).collect()}
    ids = {i: [*tokenizer.encode(masked[i] or "", add_special_tokens=False).ids, 1] for i in kept}
    by_doc, places = {}, {}
    for r in pieces:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, parts in by_doc.items():  # each id lies in one piece
        assert sum(n for _, n in parts) == len(ids[i]) and all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:]))
    for parts in places.values():  # gapless from 0, at most 2048
        assert sorted(parts)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:])) and sum(n for _, n in parts) <= 2048


def test_all_operators_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    cols = sorted(want.columns)
    rows = sorted(tuple(map(str, r)) for r in con.sql(ORACLE_SQL[name]).project(", ".join(f'"{c}"' for c in cols)).fetchall())
    got = sorted(tuple(map(str, r)) for r in entry.queries()[name](spark, "/root/testdata/sf0.01").select(*cols).collect())
    assert [tuple(x.lower() for x in r) for r in got] == [tuple(x.lower() for x in r) for r in rows]
