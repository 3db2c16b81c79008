"""Secrets in texts: three patterns, and strings that a battery of randomness tests tells from text.

The base patterns find assigned values, access keys and long hexadecimal runs. Beyond them, every run of
16 or more characters of the base64 alphabets is a candidate. A run that fits no encoding is split at its inner `=`. A part that
still fits none is read three ways, as pieces between all of its signs, between `_-` and between `+/`; of overlapping
pieces the one with most evidence stays, less READINGS for the choice. Parts have 16 characters at least. A candidate's encoding is inferred from its characters (hex, letters of
one case, base32, base36, base64) and three tests are made against what text-like strings would show:
  chi-squared   how uniform the encoding's alphabet is used (text is far from uniform);
  runs          how often neighbours differ in class - digit, lower, upper, other signs passed over; a capital and the small letter
                behind it count as one class, as words in names such as readNextLine begin so (text rarely changes);
  serial        lag-one correlation of the characters' ranks (sequences and patterns correlate).
Fisher's method combines the three p-values. As the tests depend on each other and text differs from corpus to corpus, a stratum's
p-values are calibrated on the corpus itself: the evidence that its least random BULK share shows gives the rate at which a text-like string's
evidence falls off (an empirical null), never taken as steeper than SHARPEST nor as flatter than Fisher's own. Length strata then get
their own Benjamini-Hochberg cut-off over all candidates of the corpus, so that the many short strings don't pay for the few
long ones, nor the reverse. The only corpus statistic is a histogram of at most strata * buckets rows. The query reads texts once: it writes the
candidates, which are narrow, and filters them; `annotate` and `mask`, which return the texts, scan twice instead of writing them.

Offsets are code points, end exclusive. Defined cases: null and empty texts have no spans; the base spans of a kind don't
overlap; base spans are cut out of a run and what is left on either side is tested. Repeated rows count as often as they occur. Extra
columns are kept by `annotate` and not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanveil.llm.memory import give_back
from spanveil.session import keep, ship, table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
KINDS = ("assign", "access", "hex", "random")
HINTS = ("passw", "secret", "token", "api")

LEAST = 16
#: Lower ends of the length strata.
STRATA = (16, 24, 32, 48, 64, 128)
#: Width of the histogram's buckets of -ln(p), and their number.
STEP, BUCKETS = 0.25, 400
FDR = 0.01
#: The empirical null: share of a stratum's candidates taken as text, fewest candidates to estimate from, and steepest fall-off.
BULK, ENOUGH, SHARPEST = 0.8, 50, 0.5
#: What text-like strings show: squared mass of letters, class changes per neighbouring pair, correlation of ranks.
TEXT_MASS, TEXT_CHANGES, STRUCTURE = 0.065, 0.2, 0.5

ENCODINGS = (
    ("hex", "0123456789abcdef", re.compile("[0-9a-f]+")),
    ("HEX", "0123456789ABCDEF", re.compile("[0-9A-F]+")),
    ("letters", "abcdefghijklmnopqrstuvwxyz", re.compile("[a-z]+")),
    ("LETTERS", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", re.compile("[A-Z]+")),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", re.compile("[A-Z2-7]+")),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz", re.compile("[0-9a-z]+")),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", re.compile("[A-Za-z0-9+/]+")),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", re.compile("[A-Za-z0-9_-]+")),
)
#: Parts between inner `=`, with the padding at their end; and the readings of a part that fits no encoding.
_BETWEEN = re.compile(r"[^=]+(?:=+\Z)?")
_READINGS = [re.compile(rf"{x}+(?:=+\Z)?") for x in ("[A-Za-z0-9]", "[A-Za-z0-9+/]", "[A-Za-z0-9_-]")]
READINGS, WIDER = math.log(len(_READINGS)), 4.0
_RANKS = {name: {c: i for i, c in enumerate(letters)} for name, letters, _ in ENCODINGS}

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), *(T.StructField(n, T.IntegerType()) for n in ("start", "end", "stratum", "bucket"))]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("stratum", pa.int32()), ("bucket", pa.int32())]))


def _normal_tail(z: float) -> float:
    """P(Z <= z)."""
    return 0.5 * math.erfc(-z / math.sqrt(2))


def encoding_of(s: str) -> str | None:
    """The narrowest alphabet that holds the string, padding aside; None for mixtures such as paths."""
    return next((name for name, _, fits in ENCODINGS if fits.fullmatch(s)), None)


def candidates(text: str, start: int, end: int) -> list[tuple[int, int, float]]:
    """Spans to test in a run and their evidence, in order; they don't overlap."""
    s = text[start:end]
    if encoding_of(s.rstrip("=")):
        return [(start, end, evidence(s))]
    out: list[tuple[int, int, float]] = []
    for m in _BETWEEN.finditer(text, start, end):
        a, b = m.span()
        if b - a < LEAST:
            continue
        if encoding_of(m[0].rstrip("=")):
            out.append((a, b, evidence(m[0])))
            continue
        pieces = {x.span(): k for k, reading in reversed([*enumerate(_READINGS)]) for x in reading.finditer(text, a, b) if len(x[0]) >= LEAST}
        # A wider piece has to say clearly more than the one between all signs: a directory before a value is no part of it.
        rated = sorted((-(e := evidence(text[x:y])) + (WIDER if k else 0), x, y, e) for (x, y), k in pieces.items())
        own: list[tuple[int, int, float]] = []  # in order and apart, so only neighbours can overlap
        for _, x, y, e in rated:
            k = bisect(own, (x,))
            if (k == len(own) or y <= own[k][0]) and (not k or own[k - 1][1] <= x):
                own.insert(k, (x, y, max(0.0, e - READINGS)))
        out += own
    return out


def evidence(s: str) -> float:
    """-ln of the combined p-value against the string being text-like; 0 if no encoding fits."""
    s = s.rstrip("=")
    name = encoding_of(s)
    n = len(s)
    if name is None or n < LEAST:
        return 0.0
    ranks = [_RANKS[name][c] for c in s]
    size = len(_RANKS[name])
    counts: dict[int, int] = {}
    for r in ranks:
        counts[r] = counts.get(r, 0) + 1
    x2 = size / n * sum(c * c for c in counts.values()) - n
    # Under a text-like source X2 is about a non-central chi-squared variable with this non-centrality.
    away = n * max(0.5, size * TEXT_MASS - 1)
    p_chi = _normal_tail((x2 - (size - 1 + away)) / math.sqrt(2 * (size - 1 + 2 * away)))
    kinds = [0 if c.isdigit() else 1 if c.islower() else 2 for c in s if c.isalnum()]
    changes = sum(a != b and (a, b) != (2, 1) for a, b in zip(kinds, kinds[1:]))
    mean, sd = (n - 1) * TEXT_CHANGES, math.sqrt((n - 1) * TEXT_CHANGES * (1 - TEXT_CHANGES))
    p_runs = _normal_tail(-(changes - 0.5 - mean) / sd)
    centre = sum(ranks) / n
    spread = sum((r - centre) ** 2 for r in ranks)
    corr = sum((a - centre) * (b - centre) for a, b in zip(ranks, ranks[1:])) / spread if spread else 1.0
    p_serial = _normal_tail((math.atanh(min(0.999, abs(corr))) - math.atanh(STRUCTURE)) * math.sqrt(n - 3))
    half = -sum(math.log(max(p, 1e-30)) for p in (p_chi, p_runs, p_serial))
    # Fisher: the chi-squared tail with six degrees of freedom at twice `half`.
    return half - math.log(1 + half + half * half / 2)


def scan(text: str | None) -> list[tuple[str, int, int, int, int]]:
    """(kind, start, end, stratum, bucket) of base matches and of candidates; base rows have stratum -1."""
    if not text:
        return []
    out: list[tuple[str, int, int, int, int]] = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [("assign", m.start(), m.end(), -1, 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), -1, 0) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    runs = [m.span() for m in CANDIDATE.finditer(text)]
    for a, b in runs:
        if b - a >= 32:
            out += [("hex", m.start(), m.end(), -1, 0) for m in HEX.finditer(text, a, b)]
    base = sorted((a, b) for _, a, b, _, _ in out)
    at = 0
    for start, end in runs:
        # What base spans leave of the run. They may overlap each other, but are few, and both lists ascend.
        while at < len(base) and base[at][1] <= start:
            at += 1
        parts, k = [], at
        while k < len(base) and base[k][0] < end:
            parts.append((start, start + len(text[start : base[k][0]].rstrip("="))))  # signs before a base span part it off
            start = max(start, base[k][1])
            k += 1
        for a, b in (*parts, (start, end)):
            if b - a >= LEAST:
                out += [("random", x, y, sum(y - x >= n for n in STRATA) - 1, min(BUCKETS - 1, int(e / STEP))) for x, y, e in candidates(text, a, b)]
    return out


@F.arrow_udf(SPANS)
def scan_spans(texts: pa.Array) -> pa.Array:
    names = ("kind", "start", "end", "stratum", "bucket")
    out = pa.array([[dict(zip(names, x)) for x in scan(t.as_py())] for t in texts], type=_ARROW)
    give_back()
    return out


def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(stratum, bucket, n) of a task's candidates, at most strata * buckets rows."""
    n: Counter[tuple[int, int]] = Counter()
    for batch in batches:
        for t in batch.column(0):
            n.update((stratum, bucket) for _, _, _, stratum, bucket in scan(t.as_py()) if stratum >= 0)
        give_back()
    keys = list(n)
    yield pa.record_batch([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([n[k] for k in keys], pa.int64())], names=["stratum", "bucket", "n"])


def fall_off(histogram: list[tuple[int, int]]) -> float:
    """Mean evidence of a text-like candidate by a stratum's (bucket, n), were it exponential: 1 where the tests are exact."""
    total, seen = sum(n for _, n in histogram), 0
    if total < ENOUGH:
        return 1.0
    for bucket, n in sorted(histogram):
        seen += n
        if seen >= BULK * total:
            return min(1.0, max(SHARPEST, (bucket + 1) * STEP / -math.log(1 - BULK)))
    return 1.0


def cut_offs(docs: DataFrame, fdr: float = FDR) -> list[int]:
    """For each length stratum the least bucket that Benjamini-Hochberg accepts, over all texts of docs."""
    ship(docs.sparkSession)
    counts = docs.select("text").mapInArrow(tally, "stratum int, bucket int, n long")
    rows = counts.groupBy("stratum", "bucket").agg(F.sum("n").alias("n")).collect()  # at most strata * buckets rows
    return [_cut([(r["bucket"], r["n"]) for r in rows if r["stratum"] == k], fdr) for k in range(len(STRATA))]


def _cut(histogram: list[tuple[int, int]], fdr: float) -> int:
    """The least bucket of a stratum that Benjamini-Hochberg accepts."""
    total, above, cut, mean = sum(n for _, n in histogram), 0, BUCKETS, fall_off(histogram)
    for bucket, n in sorted(histogram, reverse=True):
        above += n
        if total * math.exp(-bucket * STEP / mean) <= fdr * above:
            cut = bucket
    return cut


def accepted(candidates: DataFrame, fdr: float = FDR, name: str = "secret_spans") -> DataFrame:
    """A table whose column `name` holds what scan_spans found, with the accepted spans in its place: cut-offs come from the table itself, so texts
    are read once."""
    each = candidates.select(F.explode(F.filter(name, lambda s: s["stratum"] >= 0)).alias("s")).select("s.stratum", "s.bucket")
    rows = each.groupBy("stratum", "bucket").agg(F.count("*").alias("n")).collect()  # at most strata * buckets rows
    cuts = [_cut([(r["bucket"], r["n"]) for r in rows if r["stratum"] == k], fdr) for k in range(len(STRATA))]
    return candidates.withColumn(name, _kept(F.col(name), cuts))


def _kept(spans: Column, cuts: list[int]) -> Column:
    limits, order = F.array(*[F.lit(c) for c in cuts]), F.array(*[F.lit(k) for k in KINDS])
    kept = F.filter(spans, lambda s: (s["stratum"] < 0) | (s["bucket"] >= F.get(limits, s["stratum"])))
    keyed = F.sort_array(F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.transform(keyed, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def annotate(docs: DataFrame, fdr: float = FDR, name: str = "secret_spans") -> DataFrame:
    """docs with one more column of accepted spans, ordered by start and kind: array<struct<kind, start, end>>. It replaces a column of
    the same name.

    Two passes over the texts: the first fills the histogram, the second keeps what the cut-offs accept.
    """
    ship(docs.sparkSession)
    return docs.withColumn(name, _kept(scan_spans("text"), cut_offs(docs, fdr)))


def masker(cuts: list[int]):
    """Arrow function text -> text with accepted spans replaced; the spans never leave the worker."""

    @F.arrow_udf(T.StringType())
    def masked(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            s = t.as_py()
            found = sorted((a, b) for _, a, b, stratum, bucket in scan(s) if stratum < 0 or bucket >= cuts[stratum])
            if found:
                parts, at = [], 0
                for a, b in found:
                    if a >= at:
                        parts += [s[at:a], "[SECRET]"]
                    at = max(at, b)
                s = "".join(parts) + s[at:]
            out.append(s)
        result = pa.array(out, type=pa.string())
        give_back()
        return result

    return masked


def mask(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """docs with every secret in text replaced by [SECRET]; null texts stay null, n_chars follows where there is one."""
    ship(docs.sparkSession)
    cuts = cut_offs(docs, fdr)
    out = docs.withColumn("text", masker(cuts)("text")).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Counts and spans of every document."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    found = accepted(keep(docs.select("doc_id", scan_spans("text").alias("secret_spans")), "secrets"))
    s = F.col("secret_spans")
    text = lambda arr: F.array_join(F.transform(arr, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(text(F.filter(s, lambda x: x["kind"] != "random")), 256).alias("base_sha256"),
        text(s).alias("spans"),
        count("random").alias("n_random"),
    )


def base_digest(text: str | None) -> str:
    """base_sha256 of one text, for tests."""
    own = sorted((s, KINDS.index(k), e, k) for k, s, e, x, _ in scan(text) if x < 0)
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in own).encode()).hexdigest()
