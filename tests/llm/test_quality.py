import math
import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from spanveil.llm import quality_classifier as qc
from spanveil.llm import quality_rules as qr
from spanveil.session import table
from tests.llm.cases import PROSE, documents, with_clashes

SF = "/root/testdata/sf0.01"


def slow_counts(text):
    text = text or ""
    ws, seen = re.findall("[^\x20\x09-\x0d]+", text), {}
    for k in range(len(ws) - 7):
        seen.setdefault(tuple(ws[k : k + 8]), []).append(k)
    hit = {x + j for at in seen.values() if len(at) > 1 for x in at for j in range(8)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_counts_equal_brute_force(spark):
    texts = [None, "", "a b c d e f g h", "a b c d e f g h " * 2, "x " * 40, "a\x0bb\u00a0c\u2003d", "p\np\n\n \np", "# * | <> &", PROSE * 2, "a b c d e f g h i a b c d e f g h", "é É ü\r\nß"]
    rows = qr.measure(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")).collect()
    for r in rows:
        assert tuple(r[c] for c in COUNTS) == slow_counts(texts[r["doc_id"]]), texts[r["doc_id"]]
    docs = table(spark, SF, "documents").select("doc_id", "text")
    whole = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(tuple(r[c] for c in COUNTS) == slow_counts(whole[r["doc_id"]]) for r in qr.measure(docs).collect())


def test_counts_equal_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cols = ["doc_id", *COUNTS, "base_failed"]
    want = sorted(con.sql(qr.COUNTS_SQL).project(", ".join(cols)).fetchall())
    assert sorted(tuple(r) for r in qr.op8_quality_rules(spark, SF).select(*cols).collect()) == want


def slow_verdicts(rows, rounds=50):
    """Posterior of each row by EM over the rows themselves, one after the other."""
    k = len(qr.RULES)
    prior, acc, p = 0.7, [(0.8, 0.8)] * k, [0.1 if -1 in v else 0.95 for v in rows]
    for _ in range(rounds):
        prior = min(0.99, max(0.01, (0.7 + sum(p)) / (1 + len(rows))))
        acc = []
        for j in range(k):
            voted = [(v[j], x) for v, x in zip(rows, p) if v[j]]
            good = (1.6 + sum(x for v, x in voted if v > 0)) / (2 + sum(x for _, x in voted))
            bad = (1.6 + sum(1 - x for v, x in voted if v < 0)) / (2 + sum(1 - x for _, x in voted))
            acc.append(tuple(min(0.99, max(0.01, x)) for x in (good, bad)))
        p = []
        for v in rows:
            x = math.log(prior / (1 - prior))
            for (good, bad), vote in zip(acc, v):
                if vote and good + bad > 1:
                    x += math.log(good / (1 - bad)) if vote > 0 else math.log((1 - good) / bad)
            p.append(1 / (1 + math.exp(-x)))
    return p


def test_verdicts_equal_a_slow_fit(spark):
    measured = qr.measure(table(spark, SF, "documents").select("doc_id", "text"))
    votes = {r["doc_id"]: tuple(r[1:]) for r in measured.select("doc_id", *[qr.vote(x).alias("v_" + x) for x in qr.RULES]).collect()}
    want = dict(zip(votes, slow_verdicts(list(votes.values()))))
    for r in qr.op8_quality_rules(spark, SF).collect():
        assert abs(r["posterior"] - want[r["doc_id"]]) < 1e-4 and (r["base_failed"] or abs(want[r["doc_id"]] - 0.5) < 1e-4 or r["kept"] == (want[r["doc_id"]] > 0.5))


def test_votes_beat_all_must_pass(spark):
    found = qr.op8_quality_rules(spark, SF).join(table(spark, SF, "labels"), "doc_id").where("NOT base_failed").toPandas()
    good, bad = found[found["quality"] == 1], found[found["quality"] == 0]
    assert good["kept"].mean() > 0.97 and bad["kept"].mean() < 0.2


def test_em_recovers_planted_accuracies():
    rng = np.random.default_rng(2)
    k = len(qr.RULES)
    good = rng.random(20000) < 0.8
    votes = np.where(rng.random((20000, k)) < np.where(good[:, None], 0.95, 0.6), np.where(good[:, None], 1, -1), np.where(good[:, None], -1, 1))
    votes[rng.random(votes.shape) < 0.2] = 0
    table_ = {}
    for v in map(tuple, votes.tolist()):
        table_[v] = table_.get(v, 0) + 1
    prior, acc = qr.fit_votes(list(table_.items()))
    assert abs(prior - 0.8) < 0.05 and all(abs(a - 0.95) < 0.05 and abs(b - 0.6) < 0.1 for a, b in acc)
    assert qr.fit_votes([])[0] == 0.7


def test_rules_take_any_table(spark):
    docs = with_clashes(documents(spark))
    assert qr.judge(qr.measure(docs)).count() == docs.count()
    assert qr.judge(qr.measure(docs.where(F.lit(False)))).count() == 0


def test_native_plan_has_no_python(spark):
    plan = qr.measure(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_hinge_loss_reaches_its_optimum():
    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, 40, 6)) for _ in range(60)]
    y = np.where([r.min() < 4 for r in rows], 1.0, -1.0)
    ratio = np.zeros(qc.FEATURES)
    ratio[:40] = rng.normal(size=40)
    w, b = qc.fit_hinge(rows, y, ratio, epochs=3000)
    x = np.zeros((60, 41))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.sqrt((ratio[r] ** 2).sum())
    x[:, 40] = 1
    share = (y > 0).mean()
    cost = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    value = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - y * (x @ v))).sum()
    own = np.append(w[:40], b)
    assert all(value(own) <= value(own + rng.normal(size=41) * s) + 1e-6 for s in (1e-3, 1e-2, 1e-1) for _ in range(50))


def test_classifier_on_held_out_rows(spark):
    found = qc.op7_quality_classifier(spark, SF).join(table(spark, SF, "labels"), "doc_id").where("held_out").toPandas()
    assert (found["predicted"] == found["quality"]).mean() > 0.93 and found["score"].between(0, 1).all()


def test_classifier_defined_cases(spark):
    docs = with_clashes(documents(spark)).drop("score")
    labels = spark.createDataFrame([(1, 1), (5, 0), (7, None), (None, 1)], "doc_id bigint, quality int")
    model = spark.sparkContext.broadcast(qc.train(docs, labels))
    rows = docs.select("doc_id", qc.scorer(model)("text").alias("s")).collect()
    assert len(rows) == docs.count() and all(0 <= r["s"] <= 1 for r in rows)
    none = qc.train(docs, labels.where(F.lit(False)))
    assert none.score(qc.features("any", {})) == 0.5


def test_training_rows_are_bounded(spark):
    docs = spark.createDataFrame([(1, f"words number {i} here") for i in range(50)] + [(2, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    sizes = []
    fit, qc.fit = qc.fit, lambda rows, y: sizes.append(len(rows))
    try:
        qc.train(docs, labels, 10)
        qc.train(docs.where(F.lit(False)), labels, 10)
    finally:
        qc.fit = fit
    assert sizes == [10, 0]
    x = np.arange(0, 200_000, 3)
    assert len(qc.thinned(x)) == qc.ROW_FEATURES and len(qc.thinned(x[:50])) == 50 and (np.diff(qc.thinned(x)) > 0).all()
