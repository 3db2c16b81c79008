"""URL filtering by rules first, then by empirical-Bayes host reputation (DataFrame functions only).

Outcomes are labelled pages, bad or good. Every level of the name hierarchy shrinks towards the next:
a host's rate towards its registered domain's, a domain's towards its suffix's, a suffix's towards the overall rate, each
through a beta prior whose strength is estimated from the over-dispersion of that level's beta-binomial counts, and is never
more than the evidence behind the parent's rate. A page
is blocked when the lower bound of its host's posterior bad rate exceeds `block_above`.

Defined cases: a null url, or one without "://", has an empty host and path; all such pages share the empty host. A page_id that is null is one like any other. Hosts
without labelled pages take their domain's rate, and so on upwards; without any label the overall rate is one half and
nothing is blocked. Equally long rules: the greater string wins. Repeated rows each get a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.session import keep, table

RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]
#: More rules than this are joined by host suffix instead of being tested as one expression.
INLINE_RULES = 200
Z = 1.645
BLOCK_ABOVE = 0.5
STRENGTH = (1.0, 1000.0)
#: Second-level labels that belong to the suffix when the last label has two letters.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
#: Suffixes of several labels under which unrelated owners register, beyond the rule above. Deployments pass the whole public
#: list as `suffixes`.
SUFFIXES = tuple(
    "go.jp ne.jp or.jp tokyo.jp kyoto.jp osaka.jp hokkaido.jp me.uk ltd.uk plc.uk nhs.uk police.uk sch.uk gob.mx gob.ar gob.es gov.br nom.br gouv.fr asso.fr id.au asn.au govt.nz school.nz geek.nz gc.ca on.ca qc.ca "
    "k12.ma.us pvt.k12.ma.us k12.ca.us k12.ny.us k12.tx.us state.ma.us web.za school.za idv.tw game.tw or.kr re.kr go.kr ne.kr biz.pl info.pl waw.pl in.th go.th or.th "
    "github.io gitlab.io netlify.app vercel.app pages.dev workers.dev web.app firebaseapp.com herokuapp.com blogspot.com wordpress.com tumblr.com substack.com neocities.org readthedocs.io fly.dev onrender.com "
    "azurewebsites.net cloudfront.net s3.amazonaws.com appspot.com r.appspot.com myshopify.com weebly.com wixsite.com altervista.org dyndns.org duckdns.org".split()
)


def host_of(url: Column) -> Column:
    low = F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(low, F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def split_rule(rule: str) -> tuple[str, str]:
    """Host and path of a rule such as net/de/."""
    host, slash, rest = rule.partition("/")
    return host, slash + rest


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct<n, rule, verdict> of the longest rule that fits, else null."""
    fits = []
    for verdict, rule in rules:
        h, p = split_rule(rule)
        ok = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        fits.append(F.when(ok, F.struct(F.lit(len(rule)).alias("n"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fits))


def with_rules(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path and the winning rule with its verdict (both null if none fits)."""
    base = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not rules:
        return base.withColumns({"rule": F.lit(None).cast("string"), "listed": F.lit(None).cast("string")})
    if len(rules) <= INLINE_RULES:
        hit = base.withColumn("m", matched_rule(F.col("host"), F.col("path"), rules))
        return hit.select("page_id", "host", "path", F.col("m.rule").alias("rule"), F.col("m.verdict").alias("listed"))
    spark = pages.sparkSession
    known = spark.createDataFrame([(len(r), r, v, *split_rule(r)) for v, r in rules], "n int, rule string, verdict string, rule_host string, rule_path string")
    # One row for each distinct (host, path) meets the rules; pages get the answer back by a join that can split.
    labels = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    places = base.select("host", "path").distinct()
    found = (
        places.select("host", "path", F.explode(tails).alias("rule_host"))
        .join(known, "rule_host")
        .where(F.startswith("path", "rule_path"))
        .groupBy("host", "path")
        .agg(F.max(F.struct("n", "rule", "verdict")).alias("m"))
    )
    return base.join(found, ["host", "path"], "left").select("page_id", "host", "path", F.col("m.rule").alias("rule"), F.col("m.verdict").alias("listed"))


def _by_labels(suffixes: tuple[str, ...]) -> list[tuple[int, list[str]]]:
    """Suffixes by their number of labels, most first."""
    sizes = {x: x.count(".") + 1 for x in suffixes}
    return [(m, sorted(x for x, n in sizes.items() if n == m)) for m in sorted(set(sizes.values()), reverse=True)]


def suffix_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The longest listed suffix, else the last label, or two by the rule of SECOND_LEVEL."""
    two = F.substring_index(host, ".", -2)
    second, last = F.substring_index(two, ".", 1), F.substring_index(host, ".", -1)
    out = None
    for m, own in _by_labels(suffixes):
        tail = F.substring_index(host, ".", -m)
        out = F.when(tail.isin(*own), tail) if out is None else out.when(tail.isin(*own), tail)
    ruled = (F.length(last) == 2) & second.isin(*SECOND_LEVEL) & (two != last)
    return F.when(ruled, two).otherwise(last) if out is None else out.when(ruled, two).otherwise(last)


def domain_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The suffix and one more label, or the host itself if it has no more."""
    dots = F.size(F.split(suffix_of(host, suffixes), r"\."))
    return F.array_join(F.slice(F.reverse(F.slice(F.reverse(F.split(host, r"\.")), F.lit(1), dots + 1)), F.lit(1), dots + 1), ".")


def _strength(counts: DataFrame) -> float:
    """Prior strength of a level with columns bad, n and prior (the parent's rate), by moments; one row reaches the driver."""
    m = F.col("prior")
    r = counts.select(
        F.sum((F.col("bad") - F.col("n") * m) ** 2 - F.col("n") * m * (1 - m)).alias("over"),
        F.sum(F.col("n") * (F.col("n") - 1) * m * (1 - m)).alias("scale"),
    ).first()
    rho = (r["over"] or 0.0) / r["scale"] if r["scale"] else 0.0
    return STRENGTH[1] if rho <= 1 / (STRENGTH[1] + 1) else max(STRENGTH[0], 1 / rho - 1)


def host_posteriors(outcomes: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """outcomes: host, bad (null where unlabelled). Returns host, n, bad, rate, lower (bound of the bad rate)."""
    hosts = keep(
        outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad"))
        .withColumns({"domain": domain_of(F.col("host"), suffixes), "suffix": suffix_of(F.col("host"), suffixes)}),
        "hosts",
    )
    add = lambda df, key: df.groupBy(*key).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains, suffixes = add(hosts, ["domain", "suffix"]), add(hosts, ["suffix"])
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = ((total["bad"] or 0) + 1.0) / ((total["n"] or 0) + 2.0)

    def shrink(counts: DataFrame) -> DataFrame:
        s = F.least(F.lit(_strength(counts)), F.col("behind"))
        return counts.withColumns({"a": F.col("bad") + s * F.col("prior"), "total": F.col("n") + s}).withColumn("rate", F.col("a") / F.col("total"))

    suffixes = shrink(suffixes.withColumns({"prior": F.lit(overall), "behind": F.lit((total["n"] or 0) + 2.0)}))
    domains = shrink(domains.join(suffixes.select("suffix", F.col("rate").alias("prior"), F.col("total").alias("behind")), "suffix"))
    hosts = shrink(hosts.join(domains.select("domain", F.col("rate").alias("prior"), F.col("total").alias("behind")), "domain"))
    rate = F.col("rate")
    return hosts.select("host", "n", "bad", "rate", (rate - F.lit(Z) * F.sqrt(rate * (1 - rate) / (F.col("total") + 1))).alias("lower"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, block_above: float = BLOCK_ABOVE, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict. The pages that a rule decides are the labelled outcomes.

    They are a biased sample: rules name what their authors looked at, so rates tell about hosts like those, and the bound
    only about chance. With labels of judged pages `host_posteriors` takes these instead.
    """
    listed = with_rules(pages, rules)
    scores = host_posteriors(listed.select("host", F.when(F.col("listed").isNotNull(), F.col("listed") == "block").alias("bad")), suffixes)
    bad = scores.select("host", (F.col("lower") > block_above).alias("bad_host"))
    return listed.join(bad, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("listed", F.when(F.col("bad_host"), "block").otherwise("allow")).alias("verdict"),
    )


def op3_host_reputation(spark, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))


def oracle() -> str:
    """DuckDB SQL of op3_host_reputation."""
    rules = ",".join(f"({len(r)},'{r}','{v}','{split_rule(r)[0]}','{split_rule(r)[1]}')" for v, r in RULES)
    low, high = STRENGTH
    second = ",".join(f"'{x}'" for x in SECOND_LEVEL)
    listed = " ".join(f"WHEN len(labels) >= {m} AND array_to_string(labels[-{m}:], '.') IN ({','.join(repr(x) for x in own)}) THEN {m}" for m, own in _by_labels(SUFFIXES))

    def level(name: str, source: str) -> str:
        return f"""
{name}_s AS (SELECT CASE WHEN coalesce(sum(n*(n-1)*prior*(1-prior)),0)=0 THEN {high}
   WHEN sum((bad-n*prior)**2-n*prior*(1-prior))/sum(n*(n-1)*prior*(1-prior)) <= {1 / (high + 1)} THEN {high}
   ELSE greatest({low}, 1/(sum((bad-n*prior)**2-n*prior*(1-prior))/sum(n*(n-1)*prior*(1-prior)))-1) END AS s FROM {source}),
{name} AS (SELECT *, (bad+least(s,behind)*prior)/(n+least(s,behind)) AS rate, n+least(s,behind) AS total FROM {source}, {name}_s)"""

    return rf"""
WITH rules(len, rule, verdict, rhost, rpath) AS (VALUES {rules}),
p AS (SELECT row_number() OVER () AS rid, page_id,
  translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT rid, rule, verdict FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY len DESC, rule DESC) = 1),
l AS (SELECT p.*, m.rule, m.verdict AS listed FROM p LEFT JOIN m USING (rid)),
h0 AS (SELECT host, count(listed) AS n, count(*) FILTER (listed = 'block') AS bad, string_split(host, '.') AS labels FROM l GROUP BY host),
h1 AS (SELECT *, CASE {listed} WHEN len(labels) > 1 AND length(labels[-1]) = 2 AND labels[-2] IN ({second}) THEN 2 ELSE 1 END AS k FROM h0),
h2 AS (SELECT host, n, bad, array_to_string(labels[-k:], '.') AS suffix, array_to_string(labels[greatest(len(labels) - k, 1):], '.') AS domain FROM h1),
tot AS (SELECT (coalesce(sum(bad),0)+1.0)/(coalesce(sum(n),0)+2.0) AS prior, coalesce(sum(n),0)+2.0 AS behind FROM h2),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(prior) AS prior, any_value(behind) AS behind FROM h2, tot GROUP BY suffix),{level("s1", "s0")},
d0 AS (SELECT domain, h2.suffix, sum(h2.n) AS n, sum(h2.bad) AS bad, any_value(rate) AS prior, any_value(total) AS behind FROM h2 JOIN s1 ON h2.suffix = s1.suffix GROUP BY ALL),{level("d1", "d0")},
q0 AS (SELECT host, h2.n, h2.bad, rate AS prior, total AS behind FROM h2 JOIN d1 ON h2.domain = d1.domain),{level("q1", "q0")},
v AS (SELECT host, rate - {Z} * sqrt(rate*(1-rate)/(total+1)) > {BLOCK_ABOVE} AS bad_host FROM q1)
SELECT page_id, l.host, path, rule, coalesce(listed, CASE WHEN bad_host THEN 'block' ELSE 'allow' END) AS verdict
FROM l LEFT JOIN v ON l.host = v.host"""
