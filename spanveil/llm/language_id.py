"""Language identification of words in running text by a linear-chain conditional random field.

States are the learned languages. A word's emission scores come from its affixes, character n-grams, and membership in per-language
lexicons; transition scores are learned with them, on chains that join stretches of different languages, so the model labels
code-switched text word by word. Marginals come from the forward-backward recursions; a text gets the language with the greatest sum
of marginals and its share of the words as score.

Long texts cost no more per word than short ones: a chain is cut into chunks, all chunks of a batch advance together, and
chunk products of the step matrices carry the messages from chunk to chunk.

The model is fitted on at most SAMPLE documents, those with the least hash of doc_id, with SNIPPET consecutive words of each.
Scoring covers every word of every text, with all of its n-grams, and is narrow. Runs of more than PIECE letters, as in scripts without
spaces, are cut into consecutive pieces that are words of their own, in training as in scoring.

Defined cases: a text that is null or has no letter is `und` with score 0, as is every text if nothing was learned. Ties
go to the language first in alphabetical order. Repeated rows get equal results; other columns are never read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanveil.llm.fm_index import ranges
from spanveil.llm.memory import give_back
from spanveil.session import ship, table

UNKNOWN = "und"
SAMPLE, SNIPPET = 4000, 48
FEATURES = 1 << 16
LEXICON = 200
CHAIN, EPOCHS, RATE = 48, 40, 0.3
CHUNK = 32
BATCH_CHARS = 2_000_000
CACHE_WORDS = 400_000
#: Letters of a word: longer runs are cut into consecutive words of that many.
PIECE = 40
_WORD = re.compile(rf"[^\W\d_]{{1,{PIECE}}}")

RESULT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])
_ARROW = pa.struct([("lang", pa.string()), ("score", pa.float64())])


def words(text: str | None) -> list[str]:
    """Runs of letters, in lower case; a run of more than PIECE letters is so many words one after the other.

    The pattern also takes signs that are numbers without being digits; words are parted at those.
    """
    found = _WORD.findall(text.lower()) if text else []
    if not text or text.isascii() or all(map(str.isalpha, found)):
        return found
    return [x for w in found for x in ((w,) if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def hashed(word: str) -> list[int]:
    """Feature numbers of a word: the word, prefixes, suffixes, and character 2- and 3-grams."""
    w = f"<{word}>"
    grams = {"w" + word, *("p" + word[:k] for k in (1, 2, 3)), *("s" + word[-k:] for k in (1, 2, 3, 4))}
    grams |= {w[i : i + 2] for i in range(len(w) - 1)} | {w[i : i + 3] for i in range(len(w) - 2)}
    return sorted({zlib.crc32(g.encode("utf-8", "surrogatepass")) % FEATURES for g in grams})


class Crf:
    """Languages, feature weights, lexicons and transition scores; caches the emissions of words it has met."""

    def __init__(self, langs: list[str], weights: np.ndarray, lexicon: dict[str, int], lexicon_weights: np.ndarray, transitions: np.ndarray):
        self.langs, self.weights, self.lexicon, self.lexicon_weights, self.transitions = langs, weights, lexicon, lexicon_weights, transitions
        self.forget()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "table")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.langs)))

    def emissions(self, ws: list[str]) -> np.ndarray:
        """exp(score) of every word and language, at most 1."""
        if len(self.known) > CACHE_WORDS:
            self.forget()
        at = np.fromiter(map(self.known.get, ws, repeat(-1)), np.int64, len(ws))
        new = np.flatnonzero(at < 0).tolist()
        if new:
            fresh = list(dict.fromkeys(ws[k] for k in new))
            n = len(self.known)
            lists = [hashed(w) for w in fresh]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            sums = np.add.reduceat(self.weights[np.concatenate(lists)], np.cumsum(sizes) - sizes, axis=0) / np.sqrt(sizes)[:, None]
            lex = np.fromiter(map(self.lexicon.get, fresh, repeat(-1)), np.int64, len(fresh))
            sums[lex >= 0] += self.lexicon_weights[lex[lex >= 0]]
            while len(self.table) < n + len(fresh):
                self.table = np.concatenate((self.table, np.zeros_like(self.table)))
            self.table[n : n + len(fresh)] = np.exp(sums - sums.max(1, keepdims=True))
            self.known.update(zip(fresh, range(n, n + len(fresh))))
            at[new] = [self.known[ws[k]] for k in new]
        return self.table[at]

    def marginals(self, ws: list[str], sizes: np.ndarray) -> np.ndarray:
        """P(language) of every word; `sizes` are the words per text."""
        e, t = self.emissions(ws), np.exp(self.transitions)
        return forward_backward(e, sizes, t / t.sum(1, keepdims=True))


def forward_backward(e: np.ndarray, sizes: np.ndarray, t: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Marginals of chains laid end to end, e: (words, states) potentials, t: (states, states) potentials."""
    states = e.shape[1]
    pieces = -(-sizes // chunk)
    m = int(pieces.sum())
    first = np.cumsum(pieces) - pieces
    number = ranges(np.zeros(len(sizes), np.int64), pieces)  # of a chunk in its text
    text_start = np.cumsum(sizes) - sizes
    starts = np.repeat(text_start, pieces) + chunk * number
    lengths = np.minimum(chunk, np.repeat(text_start + sizes, pieces) - starts)
    # Longest chunks first: those that reach a step are then a leading slice.
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    rows_at = [int(np.searchsorted(-lengths, -k, "left")) for k in range(chunk)]  # chunks of more than k words

    def scaled(x):
        return x / np.maximum(x.max(axis=tuple(range(1, x.ndim)), keepdims=True), 1e-300)

    product = np.broadcast_to(np.eye(states), (m, states, states)).copy()
    for k in range(chunk):
        r = rows_at[k]
        if not r:
            break
        product[:r] = scaled((product[:r] @ t) * e[starts[:r] + k][:, None, :])
    place = np.empty(m, np.int64)
    place[order] = np.arange(m)
    alpha = np.full((m, states), 1.0 / states)
    beta = np.ones((m, states))
    texts = np.argsort(-pieces, kind="stable")
    for k in range(1, int(pieces.max(initial=0))):
        live = texts[: int(np.searchsorted(-pieces[texts], -k, "left"))]
        before, here = place[first[live] + k - 1], place[first[live] + k]
        alpha[here] = scaled(np.einsum("ij,ijk->ik", alpha[before], product[before]))
    for k in range(int(pieces.max(initial=0)) - 2, -1, -1):
        live = texts[: int(np.searchsorted(-pieces[texts], -(k + 1), "left"))]
        here, after = place[first[live] + k], place[first[live] + k + 1]
        beta[here] = scaled(np.einsum("ijk,ik->ij", product[after], beta[after]))
    out = np.zeros_like(e)
    for k in range(chunk):
        r = rows_at[k]
        if not r:
            break
        alpha[:r] = scaled((alpha[:r] @ t) * e[starts[:r] + k])
        out[starts[:r] + k] = alpha[:r]
    for k in range(chunk - 1, -1, -1):
        r = rows_at[k]
        if r:
            out[starts[:r] + k] *= beta[:r]
            beta[:r] = scaled((e[starts[:r] + k] * beta[:r]) @ t.T)
    return out / np.maximum(out.sum(1, keepdims=True), 1e-300)


def chains(snippets: list[tuple[str, list[str]]], langs: list[str], seed: int = 7) -> tuple[list[str], np.ndarray]:
    """Training chains of CHAIN words: stretches of shuffled snippets, so languages switch inside a chain; words and their languages."""
    rng = np.random.default_rng(seed)
    ws: list[str] = []
    ys: list[int] = []
    for i in rng.permutation(len(snippets)).tolist():
        lang, own = snippets[i]
        cut = int(rng.integers(len(own) // 3, len(own) + 1))
        ws += own[:cut]
        ys += [langs.index(lang)] * cut
    n = len(ws) // CHAIN * CHAIN
    if not n and ws:
        times = -(-CHAIN // len(ws))
        ws, ys, n = (ws * times)[:CHAIN], (ys * times)[:CHAIN], CHAIN
    return ws[:n], np.array(ys[:n], np.int64)


def fit(snippets: list[tuple[str, list[str]]], epochs: int = EPOCHS) -> Crf:
    """Maximum likelihood by Adagrad over all chains at once; snippets are (language, words)."""
    snippets = [(lang, ws) for lang, ws in snippets if ws]
    langs = sorted({lang for lang, _ in snippets})
    count: dict[str, dict[str, int]] = {lang: {} for lang in langs}
    for lang, ws in snippets:
        for w in ws:
            count[lang][w] = count[lang].get(w, 0) + 1
    lexicon: dict[str, int] = {}
    for lang in langs:
        for w, _ in sorted(count[lang].items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicon.setdefault(w, len(lexicon))
    k = len(langs)
    crf = Crf(langs, np.zeros((FEATURES, k)), lexicon, np.zeros((max(1, len(lexicon)), k)), np.zeros((k, k)))
    ws, y = chains(snippets, langs)
    if not len(ws):
        return crf
    unique = list(dict.fromkeys(ws))
    number = {w: i for i, w in enumerate(unique)}
    at = np.array([number[w] for w in ws]).reshape(-1, CHAIN)
    y = y.reshape(at.shape)
    lists = [hashed(w) for w in unique]
    sizes = np.array([len(x) for x in lists])
    flat, owner = np.concatenate(lists), np.repeat(np.arange(len(unique)), sizes)
    weight = 1 / np.sqrt(sizes)
    lex = np.array([lexicon.get(w, -1) for w in unique])
    squares = [np.full_like(x, 1e-3) for x in (crf.weights, crf.lexicon_weights, crf.transitions)]
    one = np.eye(k)[y]
    n = at.size
    for _ in range(epochs):
        score = np.add.reduceat(crf.weights[flat], np.cumsum(sizes) - sizes, axis=0) * weight[:, None]
        score[lex >= 0] += crf.lexicon_weights[lex[lex >= 0]]
        e = np.exp(score - score.max(1, keepdims=True))[at]
        t = np.exp(crf.transitions)
        t /= t.sum(1, keepdims=True)
        alpha, beta = np.zeros_like(e), np.ones_like(e)
        a = np.full((len(at), k), 1 / k)
        for j in range(CHAIN):
            a = (a @ t) * e[:, j]
            a /= a.sum(1, keepdims=True)
            alpha[:, j] = a
        for j in range(CHAIN - 2, -1, -1):
            b = (e[:, j + 1] * beta[:, j + 1]) @ t.T
            beta[:, j] = b / b.sum(1, keepdims=True)
        p = alpha * beta
        p /= p.sum(2, keepdims=True)
        pairs = alpha[:, :-1, :, None] * t * (e[:, 1:] * beta[:, 1:])[:, :, None, :]
        pairs /= pairs.sum((2, 3), keepdims=True)
        seen = np.einsum("cji,cjk->ik", one[:, :-1], one[:, 1:])
        expected = pairs.sum((0, 1))
        # Transitions are kept normalised by row, so their gradient is that of log-probabilities.
        g_t = (seen - expected - (seen - expected).sum(1, keepdims=True) * t) / n
        diff = (one - p).reshape(n, k)
        per_word = np.stack([np.bincount(at.ravel(), diff[:, c], len(unique)) for c in range(k)], 1) / n
        spread = (per_word * weight[:, None])[owner]
        g_w = np.stack([np.bincount(flat, spread[:, c], FEATURES) for c in range(k)], 1) - 1e-7 * crf.weights
        g_l = np.zeros_like(crf.lexicon_weights)
        g_l[lex[lex >= 0]] = per_word[lex >= 0]
        for x, g, s in zip((crf.weights, crf.lexicon_weights, crf.transitions), (g_w, g_l, g_t), squares):
            s += (g * 1e3) ** 2
            x += RATE * (g * 1e3) / np.sqrt(s)
    crf.forget()
    return crf


@F.arrow_udf(T.ArrayType(T.StringType()))
def snippet(texts: pa.Array) -> pa.Array:
    """SNIPPET words from the middle of each text."""
    out = []
    for t in texts:
        ws = words(t.as_py())
        a = max(0, (len(ws) - SNIPPET) // 2)
        out.append(ws[a : a + SNIPPET])
    return pa.array(out, type=pa.list_(pa.string()))


def train(labelled: DataFrame, sample: int = SAMPLE) -> Crf:
    """Fit on rows (doc_id, text, lang) with a language, at most `sample` of them."""
    ship(labelled.sparkSession)
    eligible = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select(F.xxhash64("doc_id").alias("h"), "doc_id", "lang", "text")
    # The ids are chosen first, without their texts; at most `sample` of them are broadcast.
    chosen = eligible.select("h", "doc_id").orderBy("h", "doc_id").limit(sample).distinct()
    rows = eligible.join(F.broadcast(chosen), ["h", "doc_id"]).select("h", "lang", snippet("text").alias("ws")).orderBy("h", "lang").limit(sample).collect()
    return fit([(r["lang"], list(r["ws"])) for r in rows])


def detect_all(texts: list[str | None], crf: Crf) -> list[dict]:
    """Language and score of each text."""
    lists = [words(t) for t in texts]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    out = [{"lang": UNKNOWN, "score": 0.0} for _ in texts]
    some = np.flatnonzero(sizes)
    if not len(some) or not crf.langs:
        return out
    p = crf.marginals([w for ws in lists for w in ws], sizes[some])
    sums = np.add.reduceat(p, np.cumsum(sizes[some]) - sizes[some], axis=0)
    best = sums.argmax(1)
    share = sums[np.arange(len(some)), best] / sizes[some]
    for i, b, s in zip(some.tolist(), best.tolist(), share.tolist()):
        out[i] = {"lang": crf.langs[b], "score": min(1.0, max(0.0, s))}
    return out


def detector(model):
    """Arrow function text -> struct<lang, score> for a broadcast model."""

    @F.arrow_udf(RESULT)
    def detect(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        crf = model.value
        for texts in batches:
            rows, part, size = [], [], 0
            for t in texts:
                s = t.as_py()
                part.append(s)
                size += len(s) if s else 0
                if size >= BATCH_CHARS:
                    rows += detect_all(part, crf)
                    part, size = [], 0
            out = pa.array(rows + detect_all(part, crf), type=_ARROW)
            del rows, part
            give_back()
            yield out
        crf.forget()
        give_back()

    return detect


def annotate(docs: DataFrame, crf: Crf, name: str = "language") -> DataFrame:
    """docs with one more column struct<lang, score>; one of the same name is replaced."""
    ship(docs.sparkSession)
    return docs.withColumn(name, detector(docs.sparkSession.sparkContext.broadcast(crf))("text"))


def keep_identified(docs: DataFrame, crf: Crf, least_score: float = 0.4) -> DataFrame:
    """docs without rows of unknown language, or whose best language holds less than `least_score` of the words."""
    name = "language"
    while name in docs.columns:
        name = "_" + name
    found = annotate(docs, crf, name)
    return found.where((F.col(name)["lang"] != UNKNOWN) & (F.col(name)["score"] >= least_score)).drop(name)


def held_out(doc_id):
    """crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document; trained outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    crf = train(docs.where(~held_out(F.col("doc_id"))))
    found = annotate(docs.select("doc_id", "text"), crf)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
