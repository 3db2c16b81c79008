"""Dictionary scan, overlap joins, neighbours, quantiles and best-window similarity against brute force."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanveil.operators import dictionary as d
from spanveil.operators import intervals as iv
from spanveil.operators import quantiles as qt
from spanveil.operators import similarity as sim


def slow_words(text, words, overlaps):
    spans = [(k, k + len(w), w) for w in set(words) if w for k in range(len(text or "")) if text.startswith(w, k)]
    if overlaps == "all":
        return sorted(spans)
    out, reach = [], {}
    for a, b, w in sorted(spans, key=lambda s: (s[0], -s[1])):
        key = w if overlaps == "each" else ""
        if a >= reach.get(key, 0):
            out.append((a, b, w))
            reach[key] = b
    return sorted(out)


def made_texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé李") for _ in range(rng.randrange(1, 6)))
    words = [word() for _ in range(60)] + ["", None, "aaaa", "aa"]
    texts = ["".join(rng.choice("abé李x ") for _ in range(rng.choice([0, 3, 40, 3000]))) for _ in range(40)] + [None, "a" * 50, "\U0001f600a李"]
    return texts, words


@pytest.mark.parametrize("overlaps", d.OVERLAPS)
@pytest.mark.parametrize("cells", [d.CELLS, 60])
def test_dictionary_equals_a_search_word_by_word(spark, overlaps, cells):
    texts, words = made_texts(5)
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = d.find_words(rows, spark.createDataFrame([(w,) for w in words], "word string"), ["id"], overlaps, cells=cells).collect()
    got = {}
    for r in found:
        got.setdefault(r["id"], []).append((r["start"], r["end"], r["value"]))
    assert {i: sorted(v) for i, v in got.items()} == {i: w for i, t in enumerate(texts) if (w := slow_words(t, [x for x in words if x], overlaps))}


def test_no_words_and_no_texts(spark):
    texts = spark.createDataFrame([(1, "abc")], "id int, text string")
    none = spark.createDataFrame([], "word string")
    assert d.find_words(texts, none, ["id"]).count() == 0 and d.find_words(texts.where("false"), spark.createDataFrame([("a",)], "word string"), ["id"]).count() == 0
    with pytest.raises(ValueError):
        d.find_words(texts, none, ["id"], "some")


def test_cost_does_not_grow_with_the_words():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(9))
    text, spent = ["".join(rng.choice("abcdefghij ") for _ in range(400_000))], []
    for n in (100, 10_000):
        automaton = d.Automaton([word() for _ in range(n)])
        begun = time.process_time()
        automaton.scan(text)
        spent.append(time.process_time() - begun)
    assert spent[1] < 10 * spent[0] + 1, spent


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(7)
    lo = lambda: rng.choice([rng.uniform(0, 100), float(rng.randrange(100))])
    size = lambda: rng.choice([0.0, 0.5, 2.0, 3.0, 40.0, 300.0])
    make = lambda n: [(k, rng.choice(["x", "y", None]), a, a + size()) for k in range(n) for a in [lo()]] + [(n, "x", None, 3.0), (n + 1, "x", 5.0, 4.0)]
    a, b = make(150), make(170)
    schema = "id int, k string, lo double, hi double"
    x, y = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    ok = lambda r: r[1] is not None and r[2] is not None and r[2] <= r[3]
    for closed in (False, True):
        meet = lambda p, q: (p[2] <= q[3] and q[2] <= p[3]) if closed else (p[2] < q[3] and q[2] < p[3])  # noqa: B023, E731
        want = sorted((p[0], q[0]) for p in a for q in b if ok(p) and ok(q) and p[1] == q[1] and meet(p, q))
        for share, width in ((2000, None), (5, None), (2000, 0.3)):
            met = iv.overlap_join(x, y, ["k"], width, share, closed).select("a.id", F.col("b.id").alias("other"))
            assert sorted(tuple(r) for r in met.collect()) == want, (closed, share, width)


def test_next_rows_equal_a_search(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([1, 1, 1, 2, None]), float(rng.randrange(300)), rng.choice("abc")) for k in range(250)]
    df = spark.createDataFrame(rows, "id int, u int, at double, kind string")
    for width in (7.0, 1000.0):
        right = df.where("kind = 'a'").select("u", "at", F.struct("at", "id").alias("v"))
        got = {r["id"]: r["found"] for r in iv.next_of(df, right, ["u"], "at", "v", width).collect()}
        for i, u, at, _ in rows:
            want = min(((a, j) for j, v, a, kind in rows if kind == "a" and v == u and u is not None and a > at), default=None)
            if u is not None:
                assert (tuple(got[i]) if got[i] else None) == want
        starts = {r["id"] for r in iv.run_starts(df.where("u IS NOT NULL").withColumn("pos", F.col("at") + F.col("id") / 1000), ["u"], "pos", "kind", width).collect()}
        for u in (1, 2):
            own = sorted((a + i / 1000, kind, i) for i, v, a, kind in rows if v == u)
            assert {i for k, (_, kind, i) in enumerate(own) if not k or own[k - 1][1] != kind} == {i for i in starts if rows[i][1] == u}


def test_line_beside_a_label(spark):
    labels = spark.createDataFrame([(1, 0, 0, 100.0, 0.0, 20.0, 20.0), (1, 0, 1, 100.0, 50.0, 70.0, 20.0)], "doc_id int, page int, line int, x1 double, y0 double, y1 double, h double")
    lines = spark.createDataFrame([(1, 0, 2, 150.0, 0.0, 20.0), (1, 0, 3, 120.0, 2.0, 22.0), (1, 0, 4, 80.0, 0.0, 20.0), (1, 0, 5, 110.0, 30.0, 40.0), (1, 0, 6, 301.0, 50.0, 70.0), (1, 1, 7, 110.0, 0.0, 20.0), (1, 0, 1, 105.0, 50.0, 70.0)], "doc_id int, page int, line int, x0 double, y0 double, y1 double")
    assert {r["line"]: r["found"] for r in iv.right_neighbours(labels, lines).collect()} == {0: 3, 1: None}


def test_quantiles(spark):
    rng = np.random.default_rng(4)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 4, 4000), rng.choice([rng.normal(size=4000), rng.integers(0, 9, 4000)], axis=0))] + [(9, 1.5), (8, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r["g"]: r for r in qt.exact(df, ["g"], "v", {"p40": 0.4, "p80": 0.8, "p90": 0.9, "p100": 1.0}).collect()}
    for g in (0, 1, 2, 3, 9):
        own = sorted(v for h, v in rows if h == g)
        assert [got[g][f"p{p}"] for p in (40, 80, 90, 100)] == [own[min(int(p / 100 * len(own)), len(own) - 1)] for p in (40, 80, 90, 100)] and got[g]["n"] == len(own)
    assert 8 not in got and qt.exact(df, [], "v", {"p50": 0.5}).first()["p50"] == sorted(v for _, v in rows if v is not None)[2000]
    parts = qt.sketches(df.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(5))), ["g", "part"], "v")
    for r in qt.merged(parts, ["g"]).where("g < 4").select("g", qt.quantile(F.col("sketch"), 0.8).alias("q")).collect():
        own = sorted(v for h, v in rows if h == r["g"])
        low, high = np.searchsorted(own, r["q"], "left") / len(own), np.searchsorted(own, r["q"], "right") / len(own)
        assert low - qt.ERROR <= 0.8 <= high + qt.ERROR


def slow_ratio(a, b):
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0

    def common(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            last = 0
            for j, e in enumerate(y):
                last, row[j + 1] = row[j + 1], last + 1 if c == e else max(row[j + 1], row[j])
        return row[-1]

    windows = [b[k : k + len(a)] for k in range(len(b) - len(a) + 1)] + [w for n in range(1, len(a)) for w in (b[:n], b[len(b) - n :])]
    return max(200.0 * common(a, w) / (len(a) + len(w)) for w in windows)


def test_ratio_equals_all_windows():
    rng = random.Random(6)
    for _ in range(400):
        a, b = ("".join(rng.choice("abcé") for _ in range(rng.randrange(n))) for n in (9, 40))
        want = slow_ratio(a, b)
        assert abs(sim.partial_ratio(a, b) - want) < 1e-9 and abs(sim.partial_ratio(a, b, 75) - (want if want >= 75 else 0)) < 1e-9


def test_similar_windows_lose_no_pair(spark):
    rng = random.Random(8)
    names = ["".join(rng.choice("abcdefgh0") for _ in range(rng.randrange(1, 16))) for _ in range(40)] + ["Supplier#000000012", "", None, "aaaa"]
    lines = []
    for k in range(160):
        own = list(rng.choice(names) or "x")
        for _ in range(rng.randrange(4)):
            own[rng.randrange(len(own))] = rng.choice(["", "z", "a"])
        lines.append((k, "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(12))) + "".join(own) + "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(12)))))
    lines += [(500, None), (501, ""), (502, "a"), (503, "aaa")]
    n, t = spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame(lines, "id int, text string")
    for least in (80.0, 90.0):
        got = {(r["name"], r["id"]): r["ratio"] for r in sim.similar_windows(n, t, ["id"], least).collect()}
        want = {(a, i): r for a in names if a for i, b in lines if b and (r := slow_ratio(a, b)) >= least}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
