"""Queries of word tables, similar windows, overlapping spans, neighbours in time, decisions and quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.operators import dictionary, intervals, lines, quantiles, similarity
from spanveil.plans.registry import query
from spanveil.plans.tables import LINES_SQL
from spanveil.session import table
from spanveil.streaming import limits

_WORD = "[A-Za-zÀ-ÿ]{6,}"
_WORDS_SQL = f"ws AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{_WORD}')) AS w FROM benchmark)"


def _words(spark, sf_dir) -> DataFrame:
    """The longer words of the benchmark's items."""
    return table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(f"({_WORD})"))).alias("word")).distinct()


@query("dictionary_counts", f"""WITH {_WORDS_SQL}, n AS (SELECT doc_id, w AS value, (length(text) - length(replace(text, w, ''))) // length(w) AS n FROM documents, ws WHERE contains(text, w))
SELECT doc_id, value, CAST(sum(n) AS BIGINT) AS n FROM n GROUP BY ALL""")
def dictionary_counts(spark, sf_dir):
    """How often each word of a table stands in each document, inside longer words too."""
    docs = table(spark, sf_dir, "documents")
    return dictionary.find_words(docs, _words(spark, sf_dir), ["doc_id"], "each").groupBy("doc_id", "value").agg(F.count("*").alias("n"))


@query("dictionary_longest", f"""WITH {_WORDS_SQL}, p AS (SELECT string_agg(w, '|' ORDER BY length(w) DESC, w) AS pattern FROM ws),
m AS (SELECT doc_id, unnest(regexp_extract_all(text, pattern)) AS value FROM documents, p) SELECT doc_id, value, count(*) AS n FROM m GROUP BY ALL""")
def dictionary_longest(spark, sf_dir):
    """The same without overlaps: the leftmost, of these the longest word."""
    docs = table(spark, sf_dir, "documents")
    return dictionary.find_words(docs, _words(spark, sf_dir), ["doc_id"], "longest").groupBy("doc_id", "value").agg(F.count("*").alias("n"))


@query("dictionary_all", f"""WITH {_WORDS_SQL}, m AS (SELECT conv_id, turn, w, unnest(list_filter(range(1, length(text) - length(w) + 2), lambda i: text[i:i + length(w) - 1] = w)) AS i
FROM conversations, ws WHERE contains(text, w)) SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS "start", CAST(i - 1 + length(w) AS INTEGER) AS "end", w AS value FROM m""")
def dictionary_all(spark, sf_dir):
    """Every occurrence of the words in turns of conversations, with its place."""
    return dictionary.find_words(table(spark, sf_dir, "conversations"), _words(spark, sf_dir), ["conv_id", "turn"], "all")


@query("similar_words")
def similar_words(spark, sf_dir):
    """Lines of documents with a window that is 90 % or more like a word of eleven letters or more, other than the word itself."""
    names = _words(spark, sf_dir).where(F.length("word") >= 11).select(F.col("word").alias("name"))
    own = lines.text_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    found = similarity.similar_windows(names, own.select("doc_id", "line", "text"), ["doc_id", "line"], 90.0, q=3)
    return found.where("ratio < 100").select("name", "doc_id", "line", F.round("ratio", 6).alias("ratio"))


@query("shipping_overlaps", """WITH s AS (SELECT l_suppkey, epoch_us(l_shipdate) / 86400e6 AS lo, epoch_us(l_shipdate) / 86400e6 + l_quantity AS hi FROM lineitem)
SELECT a.l_suppkey, count(*) AS pairs, round(sum(least(a.hi, b.hi) - greatest(a.lo, b.lo)), 3) AS days FROM s a JOIN s b ON a.l_suppkey = b.l_suppkey AND a.lo < b.hi AND b.lo < a.hi GROUP BY 1""")
def shipping_overlaps(spark, sf_dir):
    """Pairs of a supplier's lines that are on their way at the same time, and for how many days; each with itself and in both orders."""
    days = F.unix_micros(F.col("l_shipdate").cast("timestamp")) / F.lit(86400e6)
    own = table(spark, sf_dir, "lineitem").select("l_suppkey", days.alias("lo"), (days + F.col("l_quantity")).alias("hi"))
    both = F.least("a.hi", "b.hi") - F.greatest("a.lo", "b.lo")
    return intervals.overlap_join(own, own, ["l_suppkey"]).groupBy("l_suppkey").agg(F.count("*").alias("pairs"), F.round(F.sum(both), 3).alias("days"))


@query("next_other_event", """WITH e AS (SELECT event_id, user_id, event_type, ts FROM events), k AS (SELECT DISTINCT event_type AS kind FROM events),
n AS (SELECT x.event_id, f.event_id AS next_id, f.ts AS tm FROM (SELECT e.*, kind FROM e, k WHERE kind <> event_type) x ASOF JOIN events f ON f.user_id = x.user_id AND f.event_type = x.kind AND f.ts > x.ts)
SELECT e.event_id, next_id FROM e LEFT JOIN (SELECT event_id, arg_min(next_id, tm) AS next_id FROM n GROUP BY 1) USING (event_id)""")
def next_other_event(spark, sf_dir):
    """For each event the next one of another type of the same user: the next beginning of a run of one type."""
    at = F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    own = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", at)
    day = 86_400_000_000.0
    starts = intervals.run_starts(own, ["user_id"], "at", "event_type", day).select("user_id", "at", F.struct("at", "event_id").alias("v"))
    return intervals.next_of(own, starts, ["user_id"], "at", "v", day).select("event_id", F.col("found.event_id").alias("next_id"))


_WEEK, _FEW = 604_800, 3


@query("limiter_decisions", f"""WITH RECURSIVE e AS (SELECT event_id, user_id, event_type <> 'error' AS ok, epoch_us(ts) AS tm, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
s AS (SELECT user_id, CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS times, CAST(NULL AS BIGINT) AS event_id, '' AS decision FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL SELECT user_id, r, CASE WHEN len(kept) < {_FEW} AND NOT ok THEN list_append(kept, tm) ELSE kept END, event_id, CASE WHEN len(kept) >= {_FEW} THEN 'limited' WHEN ok THEN 'accepted' ELSE 'rejected' END
  FROM (SELECT s.user_id, e.r, e.ok, e.tm, e.event_id, list_filter(s.times, lambda t: t > e.tm - {_WEEK}000000) AS kept FROM s JOIN e ON e.user_id = s.user_id AND e.r = s.r + 1))
SELECT event_id, decision FROM s WHERE r > 0""")
def limiter_decisions(spark, sf_dir):
    """Decisions of the failure limiter on all events of a table, errors being failures: refused ones are not counted."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    own = table(spark, sf_dir, "events").select(F.col("user_id").alias("client"), F.col("event_id").alias("seq"), at.alias("at"), (F.col("event_type") != "error").alias("ok"))
    return limits.decisions(own, _WEEK, _FEW).select(F.col("seq").alias("event_id"), "decision")


def _places_sql(group: str, value: str, source: str) -> str:
    at = lambda p: f"v[least(CAST(floor({p} * n) AS BIGINT), n - 1) + 1]"
    return f"SELECT {group}, n, {at(0.4)} AS p40, {at(0.8)} AS p80, {at(0.9)} AS p90 FROM (SELECT {group}, count(*) AS n, list({value} ORDER BY {value}) AS v FROM {source} GROUP BY ALL)"


_SHARES = {"p40": 0.4, "p80": 0.8, "p90": 0.9}


@query("line_quantiles", f"WITH {LINES_SQL}, l AS (SELECT lang, length(ln.text) AS size FROM ln JOIN documents USING (doc_id)) {_places_sql('lang', 'size', 'l WHERE lang IS NOT NULL')}")
def line_quantiles(spark, sf_dir):
    """Lengths of the lines of each language at shares of their ranks."""
    docs = table(spark, sf_dir, "documents").where("lang IS NOT NULL")
    own = docs.select("lang", F.explode(F.split("text", "\n")).alias("text")).select("lang", F.length("text").cast("long").alias("size"))
    return quantiles.exact(own, ["lang"], "size", _SHARES)


@query("price_quantiles", _places_sql("l_returnflag, l_linestatus", "l_extendedprice", "lineitem"))
def price_quantiles(spark, sf_dir):
    return quantiles.exact(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", _SHARES)


@query("price_sketches", "SELECT l_suppkey % 10 AS part, count(*) AS n, TRUE AS p40, TRUE AS p80, TRUE AS p90 FROM lineitem GROUP BY 1")
def price_sketches(spark, sf_dir):
    """Whether sketches, kept a supplier and merged, are within the stated rank error of each share, per tenth of the suppliers."""
    items = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("part"), "l_suppkey", "l_extendedprice")
    merged = quantiles.merged(quantiles.sketches(items, ["part", "l_suppkey"], "l_extendedprice"), ["part"])
    found = merged.select("part", *[quantiles.quantile(F.col("sketch"), p).alias(c) for c, p in _SHARES.items()])
    near = items.join(F.broadcast(found), "part")  # ten rows
    low = lambda c: F.count_if(F.col("l_extendedprice") < F.col(c)) / F.count("*")
    high = lambda c: F.count_if(F.col("l_extendedprice") <= F.col(c)) / F.count("*")
    ok = [((low(c) <= p + quantiles.ERROR) & (high(c) >= p - quantiles.ERROR)).alias(c) for c, p in _SHARES.items()]
    return near.groupBy("part").agg(F.count("*").alias("n"), *ok)
