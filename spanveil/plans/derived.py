"""Queries over numbers, keys, boxes and spans that are worked out from the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.functions import geometry as g
from spanveil.functions import validators as v
from spanveil.operators import jobs, metrics, ner, regions, review
from spanveil.plans.registry import query
from spanveil.plans.tables import HITS_SQL, LINES_SQL, doc_hits
from spanveil.session import table
from spanveil.sources import files

_BODY = "lpad(CAST(110000 + o_custkey % 1000 AS VARCHAR), 6, '0') || strftime(o_orderdate, '%Y%m%d') || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0')"
_WEIGHTS = "[" + ", ".join(map(str, v.ID_WEIGHTS)) + "]"


def _bodies(spark, sf_dir) -> DataFrame:
    """17 digits of a number of an order: customer, date, order."""
    body = F.concat(F.lpad((110000 + F.col("o_custkey") % 1000).cast("string"), 6, "0"), F.date_format("o_orderdate", "yyyyMMdd"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"))
    return table(spark, sf_dir, "orders").select("o_orderkey", body.alias("body"))


@query("id_numbers", f"""WITH b AS (SELECT o_orderkey, {_BODY} AS body FROM orders),
c AS (SELECT o_orderkey, body || '{v.ID_CHECK}'[CAST(list_sum(list_transform(range(1, 18), lambda i: CAST(body[i:i] AS INTEGER) * {_WEIGHTS}[i])) % 11 AS INTEGER) + 1:CAST(list_sum(list_transform(range(1, 18), lambda i: CAST(body[i:i] AS INTEGER) * {_WEIGHTS}[i])) % 11 AS INTEGER) + 1] AS number FROM b)
SELECT o_orderkey, number, TRUE AS ok, number[18:18] = '7' AS seven FROM c""")
def id_numbers(spark, sf_dir):
    """Numbers with their check character, whether they pass, and whether they pass with a 7 in its place."""
    own = _bodies(spark, sf_dir).withColumn("number", F.concat("body", v.id_check_character(F.col("body"))))
    return own.select("o_orderkey", "number", v.id_card_ok(F.col("number")).alias("ok"), v.id_card_ok(F.concat("body", F.lit("7"))).alias("seven"))


_PLACE = f"(strpos('{v.USCC_ALPHABET}', body[i:i]) - 1)"
_POWERS = "[" + ", ".join(str(pow(3, k, 31)) for k in range(17)) + "]"


@query("company_codes", f"""WITH b AS (SELECT c_custkey, '91' || lpad(CAST(c_nationkey AS VARCHAR), 6, '0') || lpad(CAST(c_custkey AS VARCHAR), 9, 'A') AS body FROM customer),
t AS (SELECT c_custkey, body, CAST((31 - list_sum(list_transform(range(1, 18), lambda i: {_PLACE} * {_POWERS}[i])) % 31) % 31 AS INTEGER) + 1 AS k FROM b)
SELECT c_custkey, body || '{v.USCC_ALPHABET}'[k:k] AS code FROM t""")
def company_codes(spark, sf_dir):
    """17 characters and the one behind them with which a company's code passes."""
    body = F.concat(F.lit("91"), F.lpad(F.col("c_nationkey").cast("string"), 6, "0"), F.lpad(F.col("c_custkey").cast("string"), 9, "A"))
    own = table(spark, sf_dir, "customer").select("c_custkey", body.alias("body"))
    return own.select("c_custkey", F.concat("body", v.uscc_check_character(F.col("body"))).alias("code"))


@query("card_digits", """WITH b AS (SELECT o_orderkey, '4' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS body FROM orders)
SELECT o_orderkey, body || CAST((10 - list_sum(list_transform(range(1, 16), lambda i: CASE WHEN (16 - i) % 2 = 1 THEN CASE WHEN CAST(body[i:i] AS INTEGER) > 4 THEN 2 * CAST(body[i:i] AS INTEGER) - 9 ELSE 2 * CAST(body[i:i] AS INTEGER) END
  ELSE CAST(body[i:i] AS INTEGER) END)) % 10) % 10 AS VARCHAR) AS card, TRUE AS ok FROM b""")
def card_digits(spark, sf_dir):
    """Card numbers with their last digit, and whether they pass."""
    body = F.concat(F.lit("4"), F.lpad(F.col("o_custkey").cast("string"), 6, "0"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"))
    own = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(body, v.luhn_digit(body)).alias("card"))
    return own.withColumn("ok", v.luhn_ok(F.col("card")))


@query("clean_names", r"""SELECT page_id, nullif(trim(left(trim(regexp_replace(list_last(string_split(replace(url, '\', '/'), '/')), '[\x00-\x1F\x7F]', '', 'g')), 200)), '') AS name FROM pages""")
def clean_names(spark, sf_dir):
    """The last segment of each page's address as a file's name."""
    return table(spark, sf_dir, "pages").select("page_id", v.clean_name(F.col("url")).alias("name"))


_BOX_SQL = "SELECT *, l_quantity AS x0, l_discount * 500 AS y0, l_quantity + 1 + l_tax * 300 AS x1, l_discount * 500 + l_linenumber AS y1, (l_linenumber % 4) * 90 AS turn FROM lineitem"


def _boxes(spark, sf_dir) -> DataFrame:
    """Boxes on pages of 100 by 60: place by quantity and discount, size by tax and line."""
    x0, y0 = F.col("l_quantity"), F.col("l_discount") * 500
    r = g.rect(x0, y0, x0 + 1 + F.col("l_tax") * 300, y0 + F.col("l_linenumber"))
    return table(spark, sf_dir, "lineitem").select("*", r.alias("r"), ((F.col("l_linenumber") % 4) * 90).alias("turn"))


def _sums(r, *names: str) -> list:
    return [F.round(F.sum(r[k]), 3).alias(n) for k, n in zip(g.KEYS, names)]


@query("unrotated_boxes", f"""WITH b AS ({_BOX_SQL}), t AS (SELECT turn, CASE turn WHEN 90 THEN y0 WHEN 180 THEN 99 - x1 WHEN 270 THEN 99 - y1 ELSE x0 END AS a, CASE turn WHEN 90 THEN 59 - x1 WHEN 180 THEN 59 - y1 WHEN 270 THEN x0 ELSE y0 END AS b,
  CASE turn WHEN 90 THEN y1 WHEN 180 THEN 99 - x0 WHEN 270 THEN 99 - y0 ELSE x1 END AS c, CASE turn WHEN 90 THEN 59 - x0 WHEN 180 THEN 59 - y0 WHEN 270 THEN x1 ELSE y1 END AS d FROM b)
SELECT turn, round(sum(a), 3) AS x0, round(sum(b), 3) AS y0, round(sum(c), 3) AS x1, round(sum(d), 3) AS y1 FROM t GROUP BY turn""")
def unrotated_boxes(spark, sf_dir):
    own = _boxes(spark, sf_dir).select("turn", g.unrotate(F.col("r"), F.col("turn"), F.lit(100.0), F.lit(60.0)).alias("r"))
    return own.groupBy("turn").agg(*_sums(F.col("r"), "x0", "y0", "x1", "y1"))


@query("padded_boxes", f"""WITH b AS ({_BOX_SQL}), t AS (SELECT l_returnflag, greatest(x0 - greatest((x1 - x0) * 0.08, 4), 0) AS a, greatest(y0 - greatest((y1 - y0) * 0.08, 4), 0) AS b, least(x1 + greatest((x1 - x0) * 0.08, 4), 100) AS c, least(y1 + greatest((y1 - y0) * 0.08, 4), 60) AS d,
  round(least(greatest(x0, 0), 100) / 100, 4) AS n FROM b) SELECT l_returnflag, round(sum(a), 3) AS x0, round(sum(b), 3) AS y0, round(sum(c), 3) AS x1, round(sum(d), 3) AS y1, round(sum(n), 2) AS share FROM t GROUP BY 1""")
def padded_boxes(spark, sf_dir):
    w, h = F.lit(100.0), F.lit(60.0)
    own = _boxes(spark, sf_dir).select("l_returnflag", g.padded(F.col("r"), w, h).alias("p"), g.normalised(F.col("r"), w, h)["x0"].alias("n"))
    return own.groupBy("l_returnflag").agg(*_sums(F.col("p"), "x0", "y0", "x1", "y1"), F.round(F.sum("n"), 2).alias("share"))


@query("box_checks", f"""WITH b AS ({_BOX_SQL}), t AS (SELECT l_shipdate, (x1 - x0) BETWEEN 0.6 * 10 / 2.54 AND 6 * 10 / 2.54 AND (y1 - y0) BETWEEN 0.6 * 10 / 2.54 AND 6 * 10 / 2.54 AND (x1 - x0) / (y1 - y0) BETWEEN 0.75 AND 1.33 AS code,
  (l_quantity * 7) % 180 BETWEEN 15 AND 75 OR (l_quantity * 7) % 180 BETWEEN 105 AND 165 AS slanted, x1 * 72.0 / CASE WHEN l_extendedprice / 10 BETWEEN 36 AND 2400 THEN l_extendedprice / 10 ELSE 200 END AS pt FROM b)
SELECT year(l_shipdate) AS y, count(*) FILTER (code) AS codes, count(*) FILTER (slanted) AS slanted, round(sum(pt), 2) AS points FROM t GROUP BY 1""")
def box_checks(spark, sf_dir):
    """Boxes of a code's size, slanted angles, and widths in points."""
    own = _boxes(spark, sf_dir)
    code, slant = g.plausible_code(F.col("r"), F.lit(10.0)), v.is_slanted(F.col("l_quantity") * 7)
    pt = g.points(F.col("r.x1"), F.col("l_extendedprice") / 10)
    return own.groupBy(F.year("l_shipdate").cast("long").alias("y")).agg(F.count_if(code).alias("codes"), F.count_if(slant).alias("slanted"), F.round(F.sum(pt), 2).alias("points"))


@query("shipping_union", """WITH s AS (SELECT l_suppkey, epoch_us(l_shipdate) // 86400000000 AS lo, epoch_us(l_shipdate) // 86400000000 + CAST(l_quantity AS BIGINT) // 10 AS hi FROM lineitem),
f AS (SELECT *, coalesce(lo > max(hi) OVER (PARTITION BY l_suppkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS fresh FROM s),
r AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY l_suppkey ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS run FROM f) SELECT l_suppkey, min(lo) AS lo, max(hi) AS hi FROM r GROUP BY l_suppkey, run""")
def shipping_union(spark, sf_dir):
    """Spans of days on which something of a supplier is on its way."""
    whole = lambda x, n: F.call_function("div", x, F.lit(n))  # noqa: E731  towards zero, as // in SQL
    day = whole(F.unix_micros(F.col("l_shipdate").cast("timestamp")), 86_400_000_000)
    own = table(spark, sf_dir, "lineitem").select("l_suppkey", day.alias("lo"), (day + whole(F.rint("l_quantity").cast("long"), 10)).alias("hi"))
    return regions.interval_union(own, ["l_suppkey"])


_ITEMS = "l_suppkey % 50 + 1 AS page, l_returnflag AS type, l_linestatus AS style, [l_quantity, l_discount] AS box"


@query("review_difference", f"""WITH a AS (SELECT {_ITEMS} FROM lineitem WHERE l_linenumber <= 4), b AS (SELECT {_ITEMS} FROM lineitem WHERE l_linenumber >= 2),
removed AS (SELECT * FROM a EXCEPT ALL SELECT * FROM b), added AS (SELECT * FROM b EXCEPT ALL SELECT * FROM a)
SELECT page, (SELECT count(*) FROM removed r WHERE r.page = p.page) AS removed, (SELECT count(*) FROM added d WHERE d.page = p.page) AS added FROM (SELECT page FROM removed UNION SELECT page FROM added) p""")
def review_difference(spark, sf_dir):
    """Items removed and added between two versions, as multisets, on each page that changed."""
    items = table(spark, sf_dir, "lineitem").select("l_linenumber", (F.col("l_suppkey") % 50 + 1).alias("page"), F.col("l_returnflag").alias("type"), F.col("l_linestatus").alias("style"), F.array("l_quantity", "l_discount").alias("box"))
    removed, added = review.difference(items.where("l_linenumber <= 4"), items.where("l_linenumber >= 2"))
    per = lambda df, n: df.groupBy("page").agg(F.count("*").alias(n))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return review.changed_pages(removed, added).join(per(removed, "removed"), "page", "left").join(per(added, "added"), "page", "left").select("page", zero("removed"), zero("added"))


@query("key_checks", """SELECT e.event_id AS request_id, s.s_suppkey AS key_id FROM events e LEFT JOIN supplier s ON s.s_acctbal >= 0 AND sha256('key_' || CAST(e.user_id AS VARCHAR)) = sha256('key_' || CAST(s.s_suppkey AS VARCHAR))""")
def key_checks(spark, sf_dir):
    """Which live key each request carries, by hashes; accounts in debt have lost theirs."""
    secret = lambda c: F.concat(F.lit("key_"), F.col(c).cast("string"))
    keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), jobs.hash_key(secret("s_suppkey")).alias("key_hash"), F.when(F.col("s_acctbal") < 0, 1.0).alias("revoked"))
    requests = table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), secret("user_id").alias("key"))
    return jobs.verify_keys(requests, keys)


@query("key_usage", "SELECT s_suppkey AS id, s_acctbal >= 0 AS active, count(l_suppkey) AS jobs FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL")
def key_usage(spark, sf_dir):
    keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_acctbal") < 0, 1.0).alias("revoked"))
    return jobs.usage(keys, table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("owner")))


@query("key_last_used", """WITH u AS (SELECT user_id, list(DISTINCT CAST(epoch_us(ts) AS DOUBLE) / 1e6 ORDER BY CAST(epoch_us(ts) AS DOUBLE) / 1e6) AS ats FROM events GROUP BY 1)
SELECT c_custkey AS id, round(list_reduce(ats, lambda last, x: CASE WHEN x - last > 86400 THEN x ELSE last END), 3) AS last_used FROM customer LEFT JOIN u ON user_id = c_custkey""")
def key_last_used(spark, sf_dir):
    """The last use that was written down, at most one a day."""
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit(None).cast("double").alias("last_used"))
    uses = table(spark, sf_dir, "events").select(F.col("user_id").alias("key_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return jobs.last_used(keys, uses, 86_400).select("id", F.round("last_used", 3).alias("last_used"))


@query("job_states", """SELECT o_custkey AS job_id, CASE arg_max(o_orderstatus, o_orderkey) WHEN 'F' THEN 'succeeded' ELSE 'failed' END AS status,
  CASE arg_max(o_orderstatus, o_orderkey) WHEN 'F' THEN NULL ELSE 'INTERRUPTED' END AS code FROM orders GROUP BY 1""")
def job_states(spark, sf_dir):
    """Last states of jobs by their log of events, behind a restart."""
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("succeeded")
    log = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("seq"), status.alias("status"), F.lit(None).cast("string").alias("code"))
    return jobs.interrupted(jobs.states(log)).select("job_id", "status", "code")


@query("model_windows", f"""SELECT doc_id, len(w) AS n, w[-1] AS last FROM (SELECT doc_id, range(0, CAST(greatest(length(text) - {ner.WINDOW - ner.STRIDE}, 1) AS BIGINT), {ner.STRIDE}) AS w FROM documents WHERE text IS NOT NULL)""")
def model_windows(spark, sf_dir):
    """How many windows a name model needs for each text, and where the last one starts."""
    w = ner.windows(F.length("text"))
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.size(w).cast("long").alias("n"), F.element_at(w, -1).cast("long").alias("last"))


@query("line_tags", f"""{HITS_SQL}, c AS (SELECT ln.doc_id, ln.line, text, unnest(range(0, length(text))) AS pos FROM ln WHERE EXISTS (SELECT 1 FROM hits h WHERE h.doc_id = ln.doc_id AND h.line = ln.line)),
t AS (SELECT c.doc_id, CASE WHEN type IS NULL THEN 'O' WHEN pos = "start" THEN 'B-' || type ELSE 'I-' || type END AS tag FROM c LEFT JOIN hits h ON h.doc_id = c.doc_id AND h.line = c.line AND pos >= "start" AND pos < "end")
SELECT doc_id, tag, count(*) AS n FROM t GROUP BY ALL""")
def line_tags(spark, sf_dir):
    """Tags of the characters of lines with hits, counted per document."""
    hits = doc_hits(spark, sf_dir)
    per = hits.groupBy("doc_id", "line").agg(F.collect_list(F.struct("start", "end", F.col("type").alias("label"))).alias("entities"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    sentences = docs.join(per, ["doc_id", "line"]).select(F.struct("doc_id", "line").alias("id"), "text", "entities")
    return files.bio_tags(sentences).groupBy(F.col("id.doc_id").alias("doc_id"), "tag").agg(F.count("*").alias("n"))


@query("prose_scores", f"""{HITS_SQL}, runs AS (SELECT doc_id, "start" + line * 100000 AS a, "end" + line * 100000 AS b FROM dg WHERE length(value) BETWEEN 16 AND 19),
n AS (SELECT h.doc_id, h.type = 'BANK_CARD' AS covered FROM hits h)
SELECT count(*) AS names, round(count(*) FILTER (covered) / greatest(count(*), 1), 4) AS recall, round(count(*) FILTER (covered) / greatest(count(*) FILTER (covered), 1), 4) AS type_accuracy FROM n""")
def prose_scores(spark, sf_dir):
    """How much of all hits a detector of digit runs would have covered, and whether it had named them rightly."""
    own = doc_hits(spark, sf_dir)
    at = lambda c: (F.col(c) + F.col("line") * 100_000).alias(c)
    names = own.select("doc_id", at("start"), at("end"), F.col("type").alias("role"))
    cards = own.where("type = 'BANK_CARD'").select("doc_id", at("start"), at("end"), "type")
    return metrics.prose_summary(metrics.score_prose(names, cards))


@query("manifest_states", """SELECT CAST(doc_id AS VARCHAR) AS name, CASE WHEN doc_id % 7 = 0 THEN 'unlisted' WHEN doc_id % 5 = 0 THEN 'mismatch' ELSE 'ok' END AS status FROM documents WHERE doc_id IS NOT NULL
UNION ALL SELECT 'gone/' || CAST(doc_id AS VARCHAR), 'missing' FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT '../' || CAST(doc_id AS VARCHAR), 'bad_name' FROM documents WHERE doc_id % 11 = 0""")
def manifest_states(spark, sf_dir):
    """Documents as files against a list of their hashes that lacks some, is wrong on some and names others."""
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    name, content = F.col("doc_id").cast("string"), F.coalesce(F.col("text"), F.lit("")).cast("binary")
    listed = docs.where("doc_id % 7 <> 0").select(name.alias("name"), F.upper(F.when(F.col("doc_id") % 5 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.sha2(content, 256))).alias("sha256"))
    odd = lambda rule, prefix: docs.where(rule).select(F.concat(F.lit(prefix), name).alias("name"), F.sha2(content, 256).alias("sha256"))
    manifest = listed.unionByName(odd("doc_id % 5 = 0", "gone/")).unionByName(odd("doc_id % 11 = 0", "../"))
    return files.verify_manifest(docs.select(name.alias("name"), content.alias("content")), manifest)


@query("compact_lines", rf"WITH {LINES_SQL} SELECT doc_id, line, regexp_replace(text, '[\s\x0B\x1C-\x1F\x85\xA0\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', '', 'g') AS text FROM ln")
def compact_lines(spark, sf_dir):
    """Lines without white space, as those read from scans are matched."""
    from spanveil.operators.lines import compact
    from spanveil.plans.tables import doc_lines

    return doc_lines(spark, sf_dir).select("doc_id", "line", compact(F.col("text")).alias("text"))
