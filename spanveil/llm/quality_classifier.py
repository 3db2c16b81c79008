"""Quality by naive-Bayes features in a linear support vector machine.

A text's features are indicators of word and word-shape n-grams, hashed to FEATURES numbers. Each is scaled by its class
log-count ratio, rows get unit length, and a linear hinge-loss model is fitted by dual coordinate descent. A logistic
curve, fitted to margins on the fold that a model has not seen, turns margins into probabilities.

The model is fitted on at most SAMPLE labelled rows, those with the least hash of doc_id, and with at most ROW_FEATURES of the features of
each, those with the least scrambled number; only these numbers reach the driver. Scoring is narrow and covers every whole text with all
its features.

Defined cases: null and empty texts have no features and get the probability of a zero margin. Labels that are null are ignored; of several labels
of a document each counts. With no labels of one class every score is the smoothed share of label 1. Repeated rows get equal scores.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanveil.session import ship, table

FEATURES = 1 << 18
SAMPLE, ROW_FEATURES = 6000, 8192
COST, EPOCHS = 1.0, 12
THRESHOLD = 0.3
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_LETTERS = 8  # word shapes


def _shape(t: str) -> int:
    if not (t[0].isalnum() or t[0] == "_"):
        return 0 if len(t) == 1 else 1
    if t.islower():
        return 2 if len(t) < 12 else 3
    if t.isupper():
        return 4 if len(t) == 1 else 5
    return 6 if t[0].isalpha() else 7


def features(text: str | None, cache: dict[str, tuple[int, int]]) -> np.ndarray:
    """Distinct feature numbers of a text: word uni- and bigrams, repeats, and shape trigrams."""
    tokens = _TOKEN.findall(text) if text else []
    if not tokens:
        return np.zeros(0, np.int64)
    if len(cache) > 500_000:
        cache.clear()
    get = cache.get
    pairs = []
    for t in tokens:
        p = get(t)
        if p is None:
            p = cache[t] = (zlib.crc32(t.lower().encode("utf-8", "surrogatepass")), _shape(t))
        pairs.append(p)
    a = np.array(pairs, np.int64)
    h, s = a[:, 0], a[:, 1]
    two = (h[:-1] * 1_000_003 + h[1:]) ^ 0x5BD1E995
    three = s[:-2] * _LETTERS * _LETTERS + s[1:-1] * _LETTERS + s[2:]
    again = h[1:][h[1:] == h[:-1]]
    # The first numbers are the shapes' own; hashed words share the rest.
    own = _LETTERS**3 + 1
    hashed = np.concatenate((h, two)) % (FEATURES - own) + own
    return np.unique(np.concatenate((hashed, three, np.full(min(1, len(again)), _LETTERS**3))))


def thinned(x: np.ndarray, most: int = ROW_FEATURES) -> np.ndarray:
    """At most `most` of a row's features, in order; the same ones in every row that has them."""
    return x if len(x) <= most else np.sort(x[np.argsort(x * 0x9E3779B1 % (1 << 32), kind="stable")[:most]])


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def feature_numbers(texts: pa.Array) -> pa.Array:
    cache: dict[str, tuple[int, int]] = {}
    return pa.array([thinned(features(t.as_py(), cache)).astype(np.int32) for t in texts], type=pa.list_(pa.int32()))


class Model:
    """weights over features, and the logistic curve slope * margin + offset."""

    def __init__(self, weights: np.ndarray, bias: float, ratio: np.ndarray, slope: float, offset: float):
        self.weights, self.bias, self.ratio, self.slope, self.offset = weights, bias, ratio, slope, offset

    def margin(self, x: np.ndarray) -> float:
        r = self.ratio[x]
        norm = math.sqrt(float(r @ r))
        return self.bias + (float(self.weights[x] @ r) / norm if norm else 0.0)

    def score(self, x: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * self.margin(x) + self.offset))))


def log_ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Class log-count ratio of every feature, add-one smoothed."""
    count = [np.ones(FEATURES), np.ones(FEATURES)]
    for x, label in zip(rows, y):
        count[int(label > 0)][x] += 1
    return np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())


def fit_hinge(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """L2-regularised hinge loss by dual coordinate descent; the bias is one more constant feature of value 1."""
    w, bias = np.zeros(FEATURES), 0.0
    alpha = np.zeros(len(rows))
    values = []
    for x in rows:
        r = ratio[x]
        norm = math.sqrt(float(r @ r))
        values.append(r / norm if norm else r)
    diagonal = np.array([float(v @ v) + 1 for v in values])
    # The rarer class weighs more, so that its rows count as much in all.
    share = max(1e-9, float((y > 0).mean()))
    caps = np.where(y > 0, cost * 0.5 / share, cost * 0.5 / max(1e-9, 1 - share))
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)).tolist():
            x, v = rows[i], values[i]
            gradient = y[i] * (float(w[x] @ v) + bias) - 1
            new = min(max(alpha[i] - gradient / diagonal[i], 0.0), caps[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[x] += step * v
                bias += step
                alpha[i] = new
    return w, bias


def fit_curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve through (margin, label) by Newton steps, a little regularised."""
    a, b, t = 1.0, 0.0, (y > 0).astype(float)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - t) * margins).sum() + 1e-2 * (a - 1), (p - t).sum() + 1e-3 * b])
        v = p * (1 - p)
        h = np.array([[(v * margins**2).sum() + 1e-2, (v * margins).sum()], [(v * margins).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], labels: list[int]) -> Model:
    y = np.where(np.array(labels, dtype=int) == 1, 1.0, -1.0)
    zero = np.zeros(FEATURES)
    if not len(y) or abs(y.sum()) == len(y):
        p = ((y > 0).sum() + 1) / (len(y) + 2)
        return Model(zero, 0.0, zero, 1.0, math.log(p / (1 - p)))
    ratio = log_ratio(rows, y)
    fold = np.arange(len(rows)) % 2
    margins = np.zeros(len(rows))
    for k in (0, 1):
        own = [i for i in range(len(rows)) if fold[i] != k]
        if abs(y[own].sum()) == len(own):
            continue
        part = log_ratio([rows[i] for i in own], y[own])
        half = Model(*fit_hinge([rows[i] for i in own], y[own], part, epochs=EPOCHS // 2), part, 1.0, 0.0)
        for i in np.flatnonzero(fold == k).tolist():
            margins[i] = half.margin(rows[i])
    return Model(*fit_hinge(rows, y, ratio), ratio, *fit_curve(margins, y))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on the labelled rows (doc_id, quality) given, at most `sample` of them; labels are chosen before any text is read.

    Where a document's id is on several rows, or a label repeats, the rows with the least hash of their text count.
    """
    ship(docs.sparkSession)
    chosen = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # `chosen` has at most `sample` rows
    numbered = found.select(F.xxhash64("doc_id").alias("h"), "quality", F.xxhash64("text").alias("t"), feature_numbers("text").alias("x"))
    rows = numbered.orderBy("h", "quality", "t").limit(sample).toPandas()
    return fit([np.asarray(x, np.int64) for x in rows["x"]], rows["quality"].tolist())


def scorer(model):
    """Arrow function text -> score for a broadcast model."""

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        m, cache = model.value, {}
        return pa.array([m.score(features(t.as_py(), cache)) for t in texts], type=pa.float64())

    return score


def in_fold(doc_id, modulus: int, remainder: int):
    """crc32 of the id as text has this remainder."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Score of every document; trained outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~in_fold(F.col("doc_id"), 5, 0))
    model = spark.sparkContext.broadcast(train(docs, labels))
    score = F.col("score")
    return docs.select("doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), scorer(model)("text").alias("score")).select(
        "doc_id", "held_out", "score", F.when(score >= THRESHOLD, 1).otherwise(0).alias("predicted")
    )
