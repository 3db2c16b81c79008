"""Weak supervision over quality rules (native DataFrame functions only).

Each rule votes good (+1), bad (-1) or abstains (0) on a text. Expectation-maximisation over the table of vote
patterns (at most 3 ** number of rules rows, whatever the corpus) estimates the share of good texts and each rule's
accuracy on good and on bad texts, under conditional independence. A text is kept when its posterior probability of being good reaches
`keep_at`; no single rule is decisive.

Defined cases: null text has no words. Rows are judged one by one, so repeated rows get equal results and other
columns are never read. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.session import keep, table

WINDOW = 8
#: rule: (value column, good when <= / bad when >=) or, with good > bad, good when >= / bad when <=.
RULES: dict[str, tuple[str, float, float]] = {
    "symbols": ("symbols_per_word", 0.05, 0.3),
    "repeats": ("repeat_share", 0.02, 0.2),
    "dup_lines": ("dup_line_share", 0.02, 0.25),
    "capitals": ("capital_share", 0.2, 0.5),
    "marks": ("mark_share", 0.02, 0.2),
    "word_size": ("mean_word", 9.5, 13.0),
    "variety": ("distinct_share", 0.4, 0.2),
    "tails": ("symbol_tail_share", 0.02, 0.2),
}
MOST_ACCURACY = 0.99


def words_of(text: Column) -> Column:
    """The runs of characters other than space and U+0009 to U+000D."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), "")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(hashes: Column, width: int = WINDOW) -> Column:
    """Number of words inside windows of `width` words that occur twice or more in the text; takes the words' hashes.

    Windows are compared by a 64-bit hash. Sorting (hash, position) puts equal windows side by side, so a text of n
    words takes O(n log n) and stays in its own row.
    """

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            n = F.size(s)
            twin = lambda x, k: (F.when(k > 0, F.get(s, k - 1)["h"] == x["h"]).otherwise(F.lit(False))) | (
                F.when(k < n - 1, F.get(s, k + 1)["h"] == x["h"]).otherwise(F.lit(False))
            )
            return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))

        def total(p: Column) -> Column:
            steps = F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(width)), F.lit(width)))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        return _let(pairs, lambda s: _let(starts(s), total))

    windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - width), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]))
    some = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long"))
    return F.when(F.size(hashes) > width, _let(windows, some)).otherwise(F.lit(0).cast("long"))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, the contract's counts, and the values that the rules vote on. Narrow: one pass, no shuffle."""
    text = F.col("text")
    with_word = F.filter(F.split(text, "\n"), lambda s: s.rlike("[^ \\t-\\r]"))
    hashed = F.transform(words_of(text), lambda x: F.xxhash64(x))
    counts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id",
        _let(hashed, lambda h: F.struct(F.size(h).alias("n"), F.size(F.array_distinct(h)).alias("distinct"), repeated_words(h).alias("repeated"))).alias("w"),
        _let(with_word, lambda s: F.struct(F.size(s).alias("n"), (F.size(s) - F.size(F.array_distinct(s))).alias("dup"))).alias("l"),
        (F.length(text) - F.regexp_count(text, F.lit("[ \\t-\\r]"))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).alias("n_capitals"),
        F.regexp_count(text, F.lit("[!|]")).alias("n_marks"),
        F.regexp_count(text, F.lit("[#*$%&|<>](?![^ \\t-\\r])")).alias("n_tails"),
    )
    counts = counts.select(
        "*", F.col("w.n").cast("long").alias("n_words"), F.col("w.repeated").alias("n_repeat_words"), F.col("l.dup").cast("long").alias("n_dup_lines"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    # Long texts reuse words by nature: variety is judged against the size expected of a text of that length.
    expected = F.least(F.col("n_words").cast("double"), F.lit(20) + F.pow(F.col("n_words").cast("double"), F.lit(0.8)))
    return counts.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("n_symbols", "n_words").alias("symbols_per_word"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_dup_lines", "l.n").alias("dup_line_share"),
        share("n_capitals", "word_chars").alias("capital_share"),
        share("n_marks", "n_words").alias("mark_share"),
        share("n_tails", "n_words").alias("symbol_tail_share"),
        share("word_chars", "n_words").alias("mean_word"),
        F.coalesce(F.try_divide(F.col("w.distinct").cast("double"), expected), F.lit(0.0)).alias("distinct_share"),
    )


def vote(rule: str) -> Column:
    """+1, -1 or 0 of one rule."""
    name, good, bad = RULES[rule]
    v = F.col(name)
    if good < bad:
        return F.when(v <= good, 1).when(v >= bad, -1).otherwise(0)
    return F.when(v >= good, 1).when(v <= bad, -1).otherwise(0)


def fit_votes(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[float, list[tuple[float, float]]]:
    """EM on (votes, count) rows: (share of good texts, per rule (P(+1 | good), P(-1 | bad)) among its votes).

    It starts from texts without a vote against them being good. Abstentions carry no evidence. A rule that turns out
    no better than chance weighs nothing. With no rows it returns the starting values; there are at most
    3 ** rules rows.
    """
    k = len(RULES)
    prior, acc = 0.7, [(0.8, 0.8)] * k
    p = {votes: 0.1 if -1 in votes else 0.95 for votes, _ in patterns}
    for _ in range(rounds if patterns else 0):
        good, total = 0.7, 1.0
        tally = [[1.6, 2.0, 1.6, 2.0] for _ in range(k)]  # two pseudo-votes of each class at an accuracy of 0.8
        for votes, n in patterns:
            good += n * p[votes]
            total += n
            for t, v in zip(tally, votes):
                if v:
                    t[1] += n * p[votes]
                    t[3] += n * (1 - p[votes])
                    t[0 if v > 0 else 2] += n * (p[votes] if v > 0 else 1 - p[votes])
        prior = min(0.99, max(0.01, good / total))
        acc = [tuple(min(MOST_ACCURACY, max(1 - MOST_ACCURACY, x)) for x in (t[0] / t[1], t[2] / t[3])) for t in tally]
        p = {votes: posterior(votes, prior, acc) for votes, _ in patterns}
    return prior, acc


def evidence(accuracy: tuple[float, float]) -> tuple[float, float]:
    """Log-odds of good that a vote of +1 and of -1 add."""
    good, bad = accuracy
    if good + bad <= 1:
        return 0.0, 0.0
    return math.log(good / (1 - bad)), math.log((1 - good) / bad)


def posterior(votes: tuple[int, ...], prior: float, acc: list[tuple[float, float]]) -> float:
    """P(good | votes)."""
    x = math.log(prior / (1 - prior)) + sum(evidence(a)[0 if v > 0 else 1] for v, a in zip(votes, acc) if v)
    return 1 / (1 + math.exp(-x))


def judge(measured: DataFrame, keep_at: float = 0.5) -> DataFrame:
    """measured with `posterior` and `kept_by_votes`; fits the rules' accuracies on all rows first."""
    names = [f"v_{r}" for r in RULES]
    rows = measured.select(*[vote(r).alias(n) for r, n in zip(RULES, names)]).groupBy(*names).count().collect()  # at most 3 ** rules rows
    prior, acc = fit_votes([(tuple(r[n] for n in names), r["count"]) for r in rows])
    x = F.lit(math.log(prior / (1 - prior)))
    for rule, a in zip(RULES, acc):
        up, down = evidence(a)
        x = x + F.when(vote(rule) > 0, up).when(vote(rule) < 0, down).otherwise(0.0)
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
    return measured.withColumns({"posterior": p, "kept_by_votes": x >= math.log(keep_at / (1 - keep_at))})


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The contract's counts and the verdict of every document."""
    measured = keep(measure(table(spark, sf_dir, "documents").select("doc_id", "text")), "op8")
    failed = (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))
    return judge(measured).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & F.col("kept_by_votes")).alias("kept"),
        F.round("posterior", 6).alias("posterior"),
    )


#: DuckDB SQL of the contract's counts; the fitted verdict is compared with a slow fit in tests instead.
COUNTS_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\f\r]')) AS ls FROM d),
g AS (SELECT rid, i, array_to_string(ws[i:i+7], ' ') AS win FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twin AS (SELECT rid, unnest(range(i, i + 8)) AS place FROM (SELECT *, count(*) OVER (PARTITION BY rid, win) AS n FROM g) WHERE n >= 2),
rep AS (SELECT rid, count(DISTINCT place) AS n FROM twin GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
       CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
       CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(ws) < 20 OR 100 * coalesce(rep.n, 0) > 30 * len(ws) AS base_failed
FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid)"""
