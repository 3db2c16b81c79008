import zlib

import numpy as np
from pyspark.sql import functions as F

from spanveil.llm import language_id as l
from spanveil.session import table
from tests.llm.cases import documents, with_clashes


def slow_marginals(e, t):
    n, k = e.shape
    alpha, v = [], np.full(k, 1 / k)
    for i in range(n):
        v = (v @ t) * e[i]
        v /= v.sum()
        alpha.append(v)
    b, out = np.ones(k), np.zeros_like(e)
    for i in range(n - 1, -1, -1):
        out[i] = alpha[i] * b / (alpha[i] * b).sum()
        b = t @ (e[i] * b)
        b /= b.sum()
    return out


def test_chunked_recursions_equal_plain_ones():
    rng = np.random.default_rng(1)
    sizes = np.array([1, 5, 32, 33, 100, 64, 700, 7])
    e, t = rng.random((sizes.sum(), 3)) + 1e-3, rng.random((3, 3)) + 0.1
    got, at = l.forward_backward(e, sizes, t), 0
    for n in sizes.tolist():
        assert np.abs(got[at : at + n] - slow_marginals(e[at : at + n], t)).max() < 1e-9
        at += n


SNIPPETS = [("en", "the house and the river are old while they were walking through".split()), ("de", "das haus und der fluss sind schön während sie durch gehen".split()), ("fr", "la maison et le fleuve sont très vieux pendant qu ils marchaient".split())] * 12


def test_code_switched_words():
    crf = l.fit(SNIPPETS)
    ws = "the house and the river das haus und der fluss".split()
    p = crf.marginals(ws, np.array([len(ws)]))
    assert [crf.langs[i] for i in p.argmax(1)] == ["en"] * 5 + ["de"] * 5
    assert np.abs(p.sum(1) - 1).max() < 1e-9


def test_defined_cases(spark):
    crf = l.fit(SNIPPETS)
    texts = [None, "", "123 !!", "the house " * 30000, "das haus"]
    got = l.detect_all(texts, crf)
    assert [g["lang"] for g in got] == ["und", "und", "und", "en", "de"] and got[0]["score"] == 0.0
    assert all(g["lang"] == "und" for g in l.detect_all(texts, l.fit([])))
    docs = with_clashes(documents(spark)).drop("language")
    rows = l.annotate(docs, crf).collect()
    assert len(rows) == docs.count() and {r["language"]["lang"] for r in rows if r["doc_id"] in (3, 4, 6)} == {"und"}
    kept = l.keep_identified(docs, crf)
    assert kept.columns == docs.columns and kept.where("doc_id = 1").count() == 1 and kept.where("doc_id = 4").count() == 0
    assert l.annotate(docs.where(F.lit(False)), crf).count() == 0
    assert l.train(docs.where(F.lit(False))).langs == []


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    found = l.op5_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").toPandas()
    assert len(found) > 200 and (found["lang"] == found["lang_pred"]).mean() > 0.98
    assert found["score"].between(0, 1).all()


def test_long_runs_are_scored_to_their_end():
    run = "abcdefghij" * 5
    assert l.words(run + " Xy") == [run[:40], run[40:], "xy"] and l.words("漢" * 4000) == ["漢" * 40] * 100 and "".join(l.words(run * 9)) == run * 9
    word = "q" * 30 + "zx" + "q" * 8
    assert len(l.hashed(word)) > len(l.hashed("q" * 40)) and zlib.crc32(b"yv>") % l.FEATURES in l.hashed("q" * 38 + "yv")
    rng = np.random.default_rng(4)
    own = {"aa": list("abcdef"), "bb": list("uvwxyz")}
    text = lambda lang, n: "".join(rng.choice(own[lang], n))
    crf = l.fit([(lang, l.words(text(lang, 400))) for lang in own for _ in range(40)])
    ws = l.words(text("aa", 40) + text("bb", 800))
    p = crf.marginals(ws, np.array([len(ws)]))
    assert p.sum(0).argmax() == crf.langs.index("bb") and p[0].argmax() == crf.langs.index("aa")


def test_signs_that_are_no_letters():
    assert l.words("½ ² ① Ⅷ x²y ٣ 5") == ["x", "y"] and l.words("Straße ①été½") == ["straße", "été"]
    crf = l.fit(SNIPPETS)
    assert [g["lang"] for g in l.detect_all(["½ ² ①", "²", "①the②"], crf)] == ["und", "und", "en"]


def test_switched_text_word_by_word(spark):
    """Stretches of the held-out documents of a table, one after the other: each word's language against its source's."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").where("lang IS NOT NULL AND text IS NOT NULL")
    crf = l.train(docs.where(~l.held_out(F.col("doc_id"))))
    rng = np.random.default_rng(3)
    own = [(r["lang"], l.words(r["text"])) for r in docs.where(l.held_out(F.col("doc_id"))).orderBy("doc_id").collect()]
    own = [(lang, ws) for lang, ws in own if len(ws) >= 30]
    right = total = 0
    for _ in range(60):
        picks = [own[int(rng.integers(len(own)))] for _ in range(4)]
        parts = [(lang, ws[a : a + 15]) for lang, ws in picks for a in [int(rng.integers(len(ws) - 15))]]
        ws, want = [w for _, p in parts for w in p], [lang for lang, p in parts for _ in p]
        got = [crf.langs[k] for k in crf.marginals(ws, np.array([len(ws)])).argmax(1)]
        right, total = right + sum(a == b for a, b in zip(got, want)), total + len(ws)
    print("words of switched text labelled right:", right / total)
    assert right / total > 0.9
