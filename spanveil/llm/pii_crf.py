"""Personal data by a skip-chain conditional random field over the tokens of a document.

Four patterns find e-mail addresses, IP addresses, card and phone numbers: the base spans. A document's candidates are its tokens with a digit or
an @, and tokens that equal the local part of one of its addresses. They are the nodes of a graph: neighbours in the text are linked as a chain, and
tokens that are the same or alike - one address or its local part, numbers with the same last SAME_DIGITS digits, dotted quads
by their parts - share a potential however far apart they stand. Occurrences of a key are linked to the one before and to the first,
so a group of any size has two links an occurrence. Loopy message passing over all links at once gives each token's
marginals; tokens of base spans are evidence, and a mention elsewhere in the document that lacks the form the patterns ask for gets
the same label. What is added are runs of tokens whose label reaches THRESHOLD and that overlap no base span.

The field is fitted on at most SAMPLE documents of at most SAMPLE_CHARS code points, by gradient steps with the expectations of the same message passing; labels come from
the patterns. Half of the sample's documents get a second mention of a value they hold, in another form, and all some numbers that are
none (dates, versions, amounts), so that shapes and links carry what the patterns' own signs do not. Scoring covers every text, whole.

Offsets are code points, ends exclusive. Defined cases: null and empty texts have no spans; white space is what Unicode calls so; base spans of
different kinds may overlap. Without any base span in the sample nothing is learned, and links to evidence alone decide. Repeated rows get equal
results. Extra columns are kept by `annotate` and not read; one of the result's name is replaced. The time is linear in the text.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanveil.llm.memory import give_back
from spanveil.session import ship, table

KINDS = ("email", "ip", "card", "phone")
STATES = 1 + 2 * len(KINDS)  # none; first token of a kind; further token of a kind
SAMPLE, SAMPLE_CHARS = 1500, 100_000
ROUNDS, DAMPING = 12, 0.3
EPOCHS, RATE = 40, 0.3
THRESHOLD = 0.6
SAME_DIGITS = 7
#: Code points of text whose tokens are one graph: whole texts, so the bound falls between documents.
GRAPH_CHARS = 1_000_000
EVIDENCE, NEVER = 12.0, -12.0

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]++@?")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_QUAD = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: A token with a digit or an @, from its beginning.
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
_WORD = re.compile(r"\S++")
_EDGE = "\"'`.,;:!?()[]{}<>|*#%$&=~_"

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _octet(s: str) -> bool:
    s = s.lstrip("0")
    return len(s) < 3 or len(s) == 3 and int(s) <= 255


def base_spans(text: str | None) -> list[Span]:
    """What the patterns find, by kind and start. Each is the leftmost match, found without trying a run of signs from every place."""
    if not text:
        return []
    out: list[Span] = []
    if "@" in text:
        done = 0
        for m in _LOCAL.finditer(text):
            start = max(m.start(), done)
            if text[m.end() - 1] == "@" and start < m.end() - 1 and (d := _DOMAIN.match(text, m.end())):
                out.append(("email", start, d.end()))
                done = d.end()
    for m in _DOTTED.finditer(text):
        if m[0].count(".") >= 3:
            parts, at = m[0].split("."), m.start()
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                size = sum(map(len, four)) + 3
                if all(map(_octet, four)):
                    out.append(("ip", at, at + size))
                at += size + 1
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


class Document:
    """The candidates of a text: their places, keys, features and labels by the base spans (0 where there is none)."""

    def __init__(self, text: str, base: list[Span]):
        places = [m.span() for m in _TOKEN.finditer(text)]
        locals_ = {text[a:b].partition("@")[0].lower() for kind, a, b in base if kind == "email"}
        named = {x for x in locals_ if len(x) >= 4 and any(c in "._+-" for c in x) and not any(c.isdigit() for c in x)}
        if named:
            seen = set(places)
            places = sorted([*places, *(m.span() for m in _WORD.finditer(text) if m.span() not in seen and m[0].strip(_EDGE).lower() in named)])
        self.text, self.n = text, len(places)
        self.cores: list[tuple[int, int]] = []
        for a, b in places:
            s = text[a:b]
            left = len(s) - len(s.lstrip(_EDGE))
            core = s.strip(_EDGE)
            self.cores.append((a + left, a + left + len(core)) if core else (a, b))
        self.near = [False] + [text[places[k - 1][1] : places[k][0]].isspace() for k in range(1, self.n)]
        self.places = places
        self.labels = [0] * self.n
        k = 0
        for kind, a, b in sorted(base, key=lambda x: (x[1], KINDS.index(x[0]))):
            while k < self.n and places[k][1] <= a:
                k += 1
            j, first = k, True
            while j < self.n and places[j][0] < b:
                if not self.labels[j]:
                    self.labels[j] = KINDS.index(kind) + (1 if first else 1 + len(KINDS))
                first = False
                j += 1

    def keys(self, k: int) -> list[str]:
        """What the token shares with others like it."""
        a, b = self.cores[k]
        s = self.text[a:b].lower()
        out = []
        local, at, _ = s.partition("@")
        if at and local:
            out.append("a" + s)
        if len(local) >= 4 and (any(c in "._+-" for c in local) or local.isalnum() and not local.isdigit()) and any(c.isalpha() for c in local):
            out.append("l" + local)
        digits = "".join(c for c in s if "0" <= c <= "9")
        if len(digits) >= SAME_DIGITS and not at and len(digits) * 2 >= len(s):
            out.append("n" + digits[-SAME_DIGITS:])
        parts = re.split("[^0-9]+", s)
        if len(parts) == 4 and all(p and len(p) <= 3 for p in parts):
            out.append("q" + ".".join(parts))
        return out

    def features(self, k: int) -> list[str]:
        a, b = self.cores[k]
        shape, own = self.shape(k), self.text[a:b]
        digits = "".join(c for c in own if "0" <= c <= "9")
        out = ["bias", "s=" + shape, f"d={min(len(digits), 20)}", f"p={self.text[self.places[k][0]]}" if not self.text[self.places[k][0]].isalnum() else "p=x"]
        if "@" in own:
            out.append("at")
        if any(c.isalpha() for c in own):
            out.append("letters")
        if 13 <= len(digits) <= 19:
            out.append("luhn" if luhn(digits) else "no luhn")
        if _QUAD.fullmatch(own) and all(map(_octet, own.split("."))):
            out.append("quad")
        before = self.shape(k - 1) if self.near[k] else "-"
        after = self.shape(k + 1) if k + 1 < self.n and self.near[k + 1] else "-"
        return [*out, "b=" + before, "f=" + after, f"bs={before}|{shape}", f"sf={shape}|{after}"]

    def shape(self, k: int) -> str:
        """Runs of digits by their length, runs of letters, other signs; tokens of many runs are one shape."""
        a, b = self.cores[k]
        if b - a > 60:
            return "long"
        lead = "(" if self.text[self.places[k][0] : a].endswith("(") else ""
        s = re.sub(r"[0-9]+", lambda m: f"<{len(m[0])}>", self.text[a:b])
        return lead + re.sub(r"[^\W\d_]+", "a", s)


def _grouped(docs: list[Document]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links of all documents' tokens, numbered one after the other: neighbours (a, b), tokens alike (a, b)."""
    chain: list[int] = []
    skip: list[tuple[int, int]] = []
    at = 0
    for d in docs:
        chain += [at + k for k in range(1, d.n) if d.near[k]]
        first: dict[str, int] = {}
        last: dict[str, int] = {}
        for k in range(d.n):
            mine: set[int] = set()
            for key in d.keys(k):
                if key in last:
                    mine |= {last[key], first[key]}
                first.setdefault(key, k)
                last[key] = k
            skip += [(at + j, at + k) for j in sorted(mine)]
        at += d.n
    b = np.array(chain, np.int64)
    pairs = np.array(skip, np.int64).reshape(-1, 2)
    return b - 1, b, pairs[:, 0], pairs[:, 1]


def _kind(state: np.ndarray) -> np.ndarray:
    return np.where(state > len(KINDS), state - len(KINDS), state)


class Field:
    """Feature weights, chain potentials, and potentials of links between tokens alike, by kind."""

    def __init__(self, vocabulary: dict[str, int]):
        k = 1 + len(KINDS)
        self.vocabulary = vocabulary
        self.weights = np.zeros((len(vocabulary) + 1, STATES))
        self.chain = np.zeros((STATES, STATES))
        self.alike = np.where(np.eye(k) > 0, 1.0, -1.0)

    def unary(self, docs: list[Document]) -> np.ndarray:
        flat, owner = self.numbered(docs)
        return self.scores(flat, owner, sum(d.n for d in docs))

    def numbered(self, docs: list[Document]) -> tuple[np.ndarray, np.ndarray]:
        """Known features of all documents' tokens, and the token of each."""
        lists = [[i for f in d.features(k) if (i := self.vocabulary.get(f)) is not None] for d in docs for k in range(d.n)]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter((i for x in lists for i in x), np.int64, int(sizes.sum())), np.repeat(np.arange(len(lists)), sizes)

    def scores(self, flat: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, STATES))
        for c in range(STATES):
            out[:, c] = np.bincount(owner, self.weights[flat, c], n)
        return out

    def matrices(self) -> tuple[np.ndarray, np.ndarray]:
        """exp of both potentials; a further token follows one of its kind only."""
        chain = self.chain.copy()
        kinds = _kind(np.arange(STATES))
        for s in range(1 + len(KINDS), STATES):
            chain[kinds != kinds[s], s] = NEVER
        return np.exp(chain), np.exp(self.alike[np.ix_(kinds, kinds)])


def messages(unary: np.ndarray, links: tuple[np.ndarray, ...], matrices: tuple[np.ndarray, np.ndarray], rounds: int = ROUNDS):
    """Loopy sum-product: log beliefs of the tokens and, for both kinds of links, what each end says to the other."""
    state = []
    n = len(unary)

    def gather() -> np.ndarray:
        belief = unary.copy()
        for a, b, to_b, to_a in state:
            for c in range(STATES):
                if len(a):
                    belief[:, c] += np.bincount(b, to_b[:, c], n) + np.bincount(a, to_a[:, c], n)
        return belief

    for a, b in (links[:2], links[2:]):
        state.append([a, b, np.zeros((len(a), STATES)), np.zeros((len(a), STATES))])
    damping = DAMPING if len(links[2]) else 0.0
    for _ in range(rounds if len(links[0]) or len(links[2]) else 0):
        belief = gather()
        for link, m in zip(state, matrices):
            a, b, to_b, to_a = link
            if len(a):
                link[2], link[3] = (damping * old + (1 - damping) * _said(source, m_) for old, source, m_ in ((to_b, belief[a] - to_a, m), (to_a, belief[b] - to_b, m.T)))
    return gather(), state


def _said(log_source: np.ndarray, m: np.ndarray) -> np.ndarray:
    p = np.exp(log_source - log_source.max(1, keepdims=True)) @ m
    out = np.log(np.maximum(p, 1e-30))
    return out - out.max(1, keepdims=True)


def normalised(log_belief: np.ndarray) -> np.ndarray:
    p = np.exp(log_belief - log_belief.max(1, keepdims=True)) if len(log_belief) else log_belief
    return p / p.sum(1, keepdims=True) if len(p) else p


def _starts(docs: list[Document], unary: np.ndarray) -> np.ndarray:
    """A token without a neighbour before it can't be a further one."""
    alone = ~np.array([x for d in docs for x in d.near], bool)
    unary[alone, 1 + len(KINDS) :] += NEVER
    return unary


def _other_form(rng: random.Random, kind: str, value: str) -> str | None:
    """A value as it may stand a second time: without the signs that its pattern asks for."""
    digits = "".join(c for c in value if c.isdigit())
    if kind == "phone" and len(digits) >= 10:
        area, rest = digits[-10:-7], digits[-7:]
        return rng.choice([f"{area}-{rest[:3]}-{rest[3:]}", f"({area}) {rest[:3]}-{rest[3:]}", f"{area}.{rest[:3]}.{rest[3:]}", f"{area} {rest[:3]}-{rest[3:]}", digits[-10:], f"{rest[:3]}-{rest[3:]}"])
    if kind == "email":
        local, _, host = value.partition("@")
        return rng.choice([local, f"{local}[at]{host}", f"{local}(at){host}"]) if any(c.isdigit() for c in local) else None
    if kind == "ip":
        return value.replace(".", rng.choice(["-", "_", ":"]))
    if kind == "card":
        return rng.choice([digits.replace(digits[-4:], "", 1) + "." + digits[-4:], "x" + digits, digits[:8] + "/" + digits[8:]])
    return None


def _no_data(rng: random.Random) -> str:
    """Numbers that are nobody's."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    return rng.choice([
        f"20{d(2)}-0{rng.randrange(1, 10)}-1{d(1)}", f"1{d(1)}:{rng.randrange(10, 60)}", f"{d(1)}.{d(2)}", f"v{d(1)}.{d(1)}.{d(1)}", f"${d(3)}.{d(2)}", d(2), d(4), f"{d(2)}%", f"no.{d(5)}", f"{d(3)},{d(3)}",
        f"{d(1)}1{d(1)}/{d(2)}", f"#{d(6)}", f"a{d(2)}", d(8), "1" + d(8), f"{d(3)}-{d(2)}", f"fig{d(1)}.{d(1)}",
    ])


def examples(texts: list[str], seed: int = 5) -> list[Document]:
    """Labelled documents: the texts, half of them with a value's second mention, all with some numbers that are none."""
    rng, out = random.Random(seed), []
    for text in texts:
        base = base_spans(text)
        extra: list[tuple[str, str | None]] = [(_no_data(rng), None) for _ in range(rng.randrange(3))]
        if base and rng.random() < 0.5:
            kind, a, b = rng.choice(base)
            form = _other_form(rng, kind, text[a:b])
            if form:
                extra.append((form, kind))
        rng.shuffle(extra)
        spans = list(base)
        for form, kind in extra:
            text += " " + rng.choice(["see", "und", "de", "or", "la", "."]) + " "
            if kind:
                spans.append((kind, len(text), len(text) + len(form)))
            text += form
        d = Document(text, spans)
        if d.n:
            out.append(d)
    return out


def fit(texts: list[str], epochs: int = EPOCHS) -> Field:
    """Gradient steps (Adagrad) on the labelled documents; expectations by message passing over the same graph."""
    docs = examples(texts)
    count: dict[str, int] = {}
    for d in docs:
        for k in range(d.n):
            for f in d.features(k):
                count[f] = count.get(f, 0) + 1
    field = Field({f: i for i, f in enumerate(sorted(f for f, n in count.items() if n >= 2))})
    y = np.array([x for d in docs for x in d.labels], np.int64)
    if not y.any():
        return field
    n, links, one = len(y), _grouped(docs), np.eye(STATES)[y]
    flat, owner = field.numbered(docs)
    kinds = _kind(np.arange(STATES))
    by_kind = np.eye(1 + len(KINDS))[kinds]
    seen = [one[a].T @ one[b] for a, b in (links[:2], links[2:])]
    squares = [np.full_like(x, 1e-2) for x in (field.weights, field.chain, field.alike)]
    for _ in range(epochs):
        matrices = field.matrices()
        belief, state = messages(_starts(docs, field.scores(flat, owner, n)), links, matrices)
        expected = []
        for (a, b, to_b, to_a), m in zip(state, matrices):
            pa_, pb = normalised(belief[a] - to_a), normalised(belief[b] - to_b)
            z = np.maximum(np.einsum("ij,jk,ik->i", pa_, m, pb), 1e-30) if len(a) else np.ones(0)
            expected.append(m * ((pa_ / z[:, None]).T @ pb))
        diff = one - normalised(belief)
        g_w = np.stack([np.bincount(flat, diff[owner, c], len(field.weights)) for c in range(STATES)], 1) - 0.02 * field.weights
        g_c = seen[0] - expected[0] - 0.02 * field.chain
        g_a = by_kind.T @ (seen[1] - expected[1]) @ by_kind
        g_a = (g_a + g_a.T) / 2 - 0.02 * field.alike
        for x, g, s in zip((field.weights, field.chain, field.alike), (g_w, g_c, g_a), squares):
            s += g * g
            x += RATE * g / np.sqrt(s)
    return field


def train(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """Fit on at most `sample` distinct texts of docs that have a digit or an @, those with the least hash."""
    some = docs.where(F.col("text").rlike("[0-9@]") & (F.length("text") <= SAMPLE_CHARS)).select(F.xxhash64("text").alias("h"), "text")
    chosen = some.select("h").distinct().orderBy("h").limit(sample)  # hashes first, without their texts
    rows = some.join(F.broadcast(chosen), "h").dropDuplicates(["h"]).limit(sample).collect()
    return fit([r["text"] for r in sorted(rows, key=lambda r: r["h"])])


def find(texts: list[str | None], field: Field) -> list[list[tuple[str, int, int, bool]]]:
    """All spans of each text, by kind and start."""
    bases = [base_spans(t) for t in texts]
    docs = [Document(t, b) if t else None for t, b in zip(texts, bases)]
    live = [d for d in docs if d is not None and d.n]
    p = np.zeros((0, STATES))
    if live:
        unary = _starts(live, field.unary(live))
        known = np.array([x for d in live for x in d.labels], np.int64)
        at = np.flatnonzero(known)
        unary[at] += NEVER
        unary[at, known[at]] += EVIDENCE - NEVER
        p = normalised(messages(unary, _grouped(live), field.matrices())[0])
    label = p.argmax(1) if len(p) else np.zeros(0, np.int64)
    sure = p.max(1) if len(p) else np.zeros(0)
    out, first = [], 0
    for d, base in zip(docs, bases):
        spans = [(k, a, b, True) for k, a, b in base]
        if d is not None and d.n:
            spans += [(*s, False) for s in _added(d, base, label[first : first + d.n], sure[first : first + d.n])]
            first += d.n
        out.append(sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))
    return out


def _added(d: Document, base: list[Span], label: np.ndarray, sure: np.ndarray) -> list[Span]:
    taken = sorted((a, b) for _, a, b in base)
    reach: list[int] = []  # the furthest end of the base spans up to each
    for _, b in taken:
        reach.append(max(b, reach[-1] if reach else 0))
    runs: list[list[int]] = []
    for k in np.flatnonzero(label).tolist():
        if label[k] > len(KINDS) and runs and runs[-1][1] == k - 1 and d.near[k] and _kind(label[k]) == runs[-1][2]:
            runs[-1][1] = k
        else:
            runs.append([k, k, int(_kind(label[k]))])
    out: list[Span] = []
    for i, j, kind in runs:
        a, b = d.cores[i][0], d.cores[j][1]
        before = bisect_left(taken, (b,))  # base spans that start before the end
        if sure[i] >= THRESHOLD and not (before and reach[before - 1] > a):
            out.append((KINDS[kind - 1], a, b))
    return out


def finder(model):
    """Arrow function text -> SPANS for a broadcast field."""

    @F.arrow_udf(SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        names = ("kind", "start", "end", "base")
        rows, part, size = [], [], 0
        for t in texts:
            part.append(t.as_py())
            size += len(part[-1] or "")
            if size >= GRAPH_CHARS:
                rows += find(part, model.value)
                part, size = [], 0
        rows += find(part, model.value)
        out = pa.array([[dict(zip(names, s)) for s in own] for own in rows], type=_ARROW)
        del rows, part
        give_back()
        return out

    return spans


def annotate(docs: DataFrame, field: Field, name: str = "pii_spans") -> DataFrame:
    """docs with one more column: array<struct<kind, start, end, base>>, by kind and start; no shuffle."""
    ship(docs.sparkSession)
    return docs.withColumn(name, finder(docs.sparkSession.sparkContext.broadcast(field))("text"))


def op13_pii(spark, sf_dir: str) -> DataFrame:
    """Counts and spans of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, s = annotate(docs, train(docs)), F.col("pii_spans")
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter(s, lambda x: x["base"])
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias("n_" + k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(s).alias("spans"),
        (F.size(s) - F.size(base)).cast("long").alias("n_added"),
    )


def base_digest(text: str | None) -> str:
    """base_sha256 of one text, for tests."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(text)).encode()).hexdigest()
