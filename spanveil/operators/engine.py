"""Hits on lines, seeds of a document, propagation of seeds through it, and aliases.

Order is carried in columns: `ord` is a struct that sorts a document's hits by (page, line, source rank, priority, start), so that no step
has to sort a document to number its rows. Where numbers are wanted, of seeds and aliases, `numbered` ranks block by block, and
a document of any size is spread over tasks. Rows with a null doc_id belong to no document and meet nothing; give them ids first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil import lexicon
from spanveil.catalog import label_of
from spanveil.functions.text import MARK, first_come, hamming, occurrences, places, quoted
from spanveil.functions.validators import surname_start
from spanveil.operators import rules
from spanveil.operators.dictionary import find_words

KEY = ["doc_id", "page", "line"]
SOURCES = {"rule": 0, "custom": 1, "anchor": 2, "template": 3, "ner": 4, "propagate": 5}
SEED_TYPES = ["PERSON", "STAFF", "ORG", "ADDRESS", "ID_CARD", "PHONE", "BANK_CARD", "USCC", "MEDICAL_ID", "CUSTOM"]


def order_of(source: Column, prio: Column, start: Column) -> Column:
    """A struct that sorts hits of a document as the detectors deliver them."""
    rank = F.try_element_at(F.create_map(*[F.lit(x) for kv in SOURCES.items() for x in kv]), source)
    return F.struct(F.col("page").alias("page"), F.col("line").alias("line"), rank.alias("rank"), prio.alias("prio"), start.alias("start"))


def rule_hits(lines: DataFrame, enabled: list[str] | None = None, only: frozenset[int] | None = None) -> DataFrame:
    """doc_id, page, line, type, source, prio, start, end, value. Types outside `enabled` still claim their spans; rules outside `only` (priorities) don't run."""
    found = lines.select(*KEY, F.explode(rules.find(F.col("text"), only)).alias("h")).select(
        *KEY, F.col("h.type").alias("type"), F.lit("rule").alias("source"), F.col("h.prio").alias("prio"),
        F.col("h.start").alias("start"), F.col("h.end").alias("end"), F.col("h.value").alias("value"),
    )
    return found.where(F.col("type").isin(*enabled)) if enabled is not None else found


def _word_hits(pairs: DataFrame) -> DataFrame:
    """Hits of `word` on the lines (KEY, text, word): its occurrences, per word non-overlapping."""
    fenced = F.regexp_replace(F.translate("text", MARK, " "), quoted(F.col("word")), F.lit(MARK + "$0"))
    at = pairs.select(*KEY, "word", F.explode(places(fenced)).alias("start"))
    return at.select(
        *KEY, F.lit("CUSTOM").alias("type"), F.lit("custom").alias("source"), F.lit(0).alias("prio"), "start",
        (F.col("start") + F.length("word")).alias("end"), F.col("word").alias("value"),
    )


def custom_hits(lines: DataFrame, words: DataFrame) -> DataFrame:
    """Literal occurrences of words (doc_id, word): each document has its own list.

    Words travel in a table, never in the plan's literals. Words of fewer than two characters don't count.
    """
    kept = words.where(F.length("word") >= 2).select("doc_id", "word").distinct()
    return _word_hits(lines.join(kept, "doc_id").where(F.contains("text", "word")).select(*KEY, "text", "word"))


def listed_hits(lines: DataFrame, words: DataFrame) -> DataFrame:
    """Literal occurrences of the words (word) of one list for all documents, of any length, found by one automaton in one pass; per word
    non-overlapping. Words of fewer than two characters don't count."""
    found = find_words(lines, words.where(F.length("word") >= 2), KEY, "each")
    return found.select(*KEY, F.lit("CUSTOM").alias("type"), F.lit("custom").alias("source"), F.lit(0).alias("prio"), "start", "end", "value")


def without_overlaps(hits: DataFrame, taken: DataFrame) -> DataFrame:
    """Hits that overlap no span of `taken` on their line."""
    t = taken.select(*KEY, F.col("start").alias("t_start"), F.col("end").alias("t_end"))
    return hits.join(t, _same(hits, t) & (hits["start"] < t["t_end"]) & (t["t_start"] < hits["end"]), "left_anti")


def _same(a: DataFrame, b: DataFrame) -> Column:
    out = a[KEY[0]] == b[KEY[0]]
    for k in KEY[1:]:
        out = out & (a[k] == b[k])
    return out


def page_hits(first: DataFrame, *later: DataFrame) -> DataFrame:
    """Hits of several detectors; each later source is kept only where it overlaps nothing before it."""
    out = first
    for hits in later:
        out = out.unionByName(without_overlaps(hits, out), allowMissingColumns=True)
    return out


def ranked(hits: DataFrame) -> DataFrame:
    """hits with `ord`, which sorts them inside their document."""
    key = order_of(F.col("source"), F.col("prio"), F.col("start"))
    return hits.withColumn("ord", F.struct(key["page"].alias("page"), key["line"].alias("line"), key["rank"].alias("rank"), key["prio"].alias("prio"), key["start"].alias("start"), F.col("type").alias("type"), F.col("end").alias("end")))


#: Lines, or numbers, that are ranked in one task at most.
BLOCK = 1024


def _block(df: DataFrame, ord_: str = "ord") -> Column:
    """The block of an order: page and lines of a struct, a range of a number."""
    o = F.col(ord_)
    nested = df.schema[ord_].dataType.typeName() == "struct"
    return F.struct(o["page"].alias("page"), F.floor(o["line"] / BLOCK).alias("block")) if nested else F.struct(F.floor(o / BLOCK).alias("block"))


def numbered(df: DataFrame, keys: list[str], order: str, block: Column, name: str) -> DataFrame:
    """df with `name`, the rank of each row among those of its keys from 1. `block` must not decrease along `order`: rows are ranked inside
    their block, and a window over the blocks' sizes, one row each, tells how many come before."""
    local = df.withColumn("__block", block)
    local = local.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys, "__block").orderBy(order)))
    sizes = local.groupBy(*keys, "__block").agg(F.max("__rank").alias("__size"))
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*keys, "__block", F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__before"))
    return local.join(before, [*keys, "__block"]).withColumn(name, (F.col("__rank") + F.col("__before")).cast("long")).drop("__block", "__rank", "__before")


def collect_seeds(hits: DataFrame, lines: DataFrame | None = None, custom: DataFrame | None = None, enabled: list[str] | None = None, surnames: list[str] | None = None) -> DataFrame:
    """doc_id, value, type, ord: values worth following through their document, numbered from 1.

    hits: KEY, type, source, seed, start, value, ord. Of a value's types the first wins, except that a person's or staff
    member's type overwrites, the last one winning, while the place in the order stays that of the first. Model-found names count when they stand
    on two lines, or alone on two lines. Custom words fill in last. Pre-aggregated: one row per document and value.
    """
    v, n = F.col("value"), F.length("value")
    people = F.col("type").isin("PERSON", "STAFF")
    common = v.isin(*lexicon.stop_words()) | F.rlike(v, F.lit(r"\A(?:" + "|".join(lexicon.NOT_NAME_START) + ")"))
    person_ok = F.rlike(v, F.lit(r"\A[一-龥·•]{2,}\z")) & ~common & F.col("source").isin("anchor", "custom")
    ok = F.when(people, person_ok).otherwise(n >= F.when(F.col("type") == "ORG", 4).when(F.col("type") == "ADDRESS", 8).otherwise(5))
    strong = hits.where(F.col("seed") & F.col("type").isin(*SEED_TYPES) & ok & (F.col("source") != "ner"))
    found = strong.groupBy("doc_id", "value").agg(
        F.min_by("type", "ord").alias("first"), F.max_by(F.when(people, F.col("type")), F.when(people, F.col("ord"))).alias("person"), F.min("ord").alias("ord"),
    ).select("doc_id", "value", F.coalesce("person", "first").alias("type"), "ord", F.lit(0).alias("tier"))
    ner = hits.where((F.col("source") == "ner") & people & F.rlike(v, F.lit(r"\A[一-龥·•]{2,4}\z")) & surname_start(v, surnames) & ~common)
    names = ner.groupBy("doc_id", "value").agg(F.count_distinct("page", "line").alias("places"), F.min_by("type", "ord").alias("type"), F.min("ord").alias("ord"))
    if lines is not None:
        alone = lines.where(F.length("text").between(2, 4)).groupBy("doc_id", F.col("text").alias("value")).agg(F.count("*").alias("alone"))
        names = names.join(alone, ["doc_id", "value"], "left")
        names = names.where((F.col("places") >= 2) | (F.coalesce("alone", F.lit(0)) >= 2))
    else:
        names = names.where("places >= 2")
    both = found.unionByName(names.select("doc_id", "value", "type", "ord", F.lit(1).alias("tier")))
    if custom is not None:
        none = F.lit(None).cast(hits.schema["ord"].dataType)
        words = custom.where(F.length("word") >= 2).select("doc_id", F.col("word").alias("value")).distinct()
        both = both.unionByName(words.select("doc_id", "value", F.lit("CUSTOM").alias("type"), none.alias("ord"), F.lit(2).alias("tier")))
    one = both.groupBy("doc_id", "value").agg(F.min_by("type", F.struct("tier", "ord")).alias("type"), F.min(F.struct("tier", "ord", "value")).alias("o"))
    own = one.select("doc_id", "value", "type", "o", F.col("o.ord").alias("at"))
    out = numbered(own, ["doc_id"], "o", F.struct(F.col("o.tier").alias("tier"), _block(own, "at").alias("in")), "ord").select("doc_id", "value", "type", "ord")
    return out.where(F.col("type").isin(*enabled)) if enabled is not None else out


CLAIM = "array<struct<ord:int,tier:int,start:int,end:int,type:string,value:string,fresh:boolean>>"
#: Seeds of a document that meet a line together.
CHUNK = 256


def _islands(covered: Column) -> Column:
    """Covered spans in order of their starts, overlapping ones joined."""

    def step(acc: Column, c: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        grown = c.withField("start", last["start"]).withField("end", F.greatest(last["end"], c["end"]))
        return F.when((F.size(acc) > 0) & (c["start"] < last["end"]), F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), grown)).otherwise(F.array_append(acc, c))

    by_start = F.array_sort(F.transform(covered, lambda c: F.struct(c["start"].alias("s"), c.alias("c"))))
    return F.aggregate(F.transform(by_start, lambda x: x["c"]), F.array().cast(CLAIM), step)


def _seed_chunks(seeds: DataFrame, fuzzy: bool) -> DataFrame:
    """doc_id, ss: at most CHUNK seeds a row. Those that may occur with k differences carry k + 1 parts, one of which any such occurrence
    holds unchanged (the pigeonhole principle)."""
    v, n = F.col("value"), F.length("value")
    person, org = F.col("type").isin("PERSON", "STAFF") & (n >= 3), (F.col("type") == "ORG") & (n >= 6)
    k = F.when(person, 1).when(org, F.greatest(F.lit(1), (n / 6).cast("int"))) if fuzzy else F.lit(None).cast("int")
    edge = lambda j: (j * n / (k + 1)).cast("int")
    part = lambda j: F.struct(edge(j).alias("off"), F.substring(v, edge(j) + 1, edge(j + 1) - edge(j)).alias("p"))
    parts = F.when(k.isNotNull(), F.transform(F.sequence(F.lit(0), k), part))
    seed = F.struct(F.col("ord").cast("int").alias("o"), v.alias("v"), F.col("type").alias("t"), k.alias("k"), parts.alias("parts"))
    return seeds.groupBy("doc_id", F.floor(F.col("ord") / CHUNK).alias("chunk")).agg(F.collect_list(seed).alias("ss")).drop("chunk")


def propagate(lines: DataFrame, seeds: DataFrame, covered: DataFrame | None = None, fuzzy: bool = True) -> DataFrame:
    """Further occurrences of a document's seeds: doc_id, page, line, type, source, prio, start, end, value (the seed's).

    Seeds claim in their order, exact occurrences before near ones: names of three or more characters that differ in one after
    the first, organisations of six or more with the same last character and at most max(1, n // 6) differences. Nothing
    overlaps a span that was covered or claimed before. `ord` numbers a document's seeds. Lines meet chunks of bounded size of their document's seeds
    by an equi-join on doc_id, and go on only with the seeds, or parts of them, that they hold; what is grouped by line is offsets, not text.
    """
    text = F.col("text")
    holds = lambda x: F.contains(text, x["v"]) | F.coalesce(F.exists(x["parts"], lambda p: F.contains(text, p["p"])), F.lit(False))
    met = lines.join(_seed_chunks(seeds, fuzzy), "doc_id").select(*KEY, "text", F.filter("ss", holds).alias("ss")).where(F.size("ss") > 0)
    pairs = met.select(*KEY, "text", F.explode("ss").alias("s")).select(*KEY, "text", "s.*")
    v, n = F.col("v"), F.length("v")
    exact = F.transform(occurrences(text, v), lambda p: F.struct(p.alias("start"), F.lit(0).alias("tier")))
    spans = exact
    if fuzzy:
        starts = F.array_distinct(F.flatten(F.transform("parts", lambda p: F.transform(occurrences(text, p["p"]), lambda i: i - p["off"]))))
        windows = F.transform(F.filter(starts, lambda i: (i >= 0) & (i + n <= F.length(text))), lambda i: F.struct(i.alias("start"), F.substring(text, i + 1, n).alias("w")))
        near = lambda x: F.when(
            F.col("t") == "ORG", (F.substring(x["w"], -1, 1) == F.substring(v, -1, 1)) & hamming(x["w"], v).between(1, F.col("k"))
        ).otherwise((F.substring(x["w"], 1, 1) == F.substring(v, 1, 1)) & F.rlike(x["w"], F.lit(r"\A[一-龥·•]+\z")) & (hamming(x["w"], v) == 1))
        close = F.transform(F.array_sort(F.filter(windows, near)), lambda x: F.struct(x["start"].alias("start"), F.lit(1).alias("tier")))
        spans = F.concat(exact, F.coalesce(close, F.array().cast("array<struct<start:int,tier:int>>")))
    at = pairs.select(*KEY, "v", "t", "o", F.explode(spans).alias("p"))
    claims = at.select(
        *KEY, F.col("o").alias("ord"), F.col("p.tier").alias("tier"), F.col("p.start").alias("start"), (F.col("p.start") + n).cast("int").alias("end"),
        F.col("t").alias("type"), F.col("v").alias("value"), F.lit(True).alias("fresh"),
    )
    if covered is not None:
        claims = claims.unionByName(covered.select(
            *KEY, F.lit(-1).alias("ord"), F.lit(0).alias("tier"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "type", "value", F.lit(False).alias("fresh"),
        ))
    fields = ["ord", "tier", "start", "end", "type", "value", "fresh"]
    per_line = claims.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("cs")).where(F.exists("cs", lambda c: c["fresh"]))
    taken = F.concat(_islands(F.filter("cs", lambda c: ~c["fresh"])), F.filter("cs", lambda c: c["fresh"]))
    won = per_line.select(*KEY, F.explode(F.filter(first_come(taken, CLAIM), lambda c: c["fresh"])).alias("c"))
    return won.select(
        *KEY, F.col("c.type").alias("type"), F.lit("propagate").alias("source"), F.col("c.ord").alias("prio"),
        F.col("c.start").alias("start"), F.col("c.end").alias("end"), F.col("c.value").alias("value"),
    )


def override_types(ner: DataFrame, anchors: DataFrame, enabled: list[str] | None = None) -> DataFrame:
    """Model-found names take the type of the last anchored hit with the same value in their document."""
    known = anchors.where(F.col("type").isin("PERSON", "STAFF") & F.col("seed")).groupBy("doc_id", "value").agg(F.max_by("type", "ord").alias("known"))
    if enabled is not None:
        known = known.where(F.col("known").isin(*enabled))
    return ner.join(known, ["doc_id", "value"], "left").withColumn("type", F.coalesce("known", "type")).drop("known")


def aliases(hits: DataFrame) -> DataFrame:
    """doc_id, type, value, alias: the type's label and a running number by first appearance; empty values get none."""
    first = hits.where(F.coalesce("value", F.lit("")) != "").groupBy("doc_id", "type", "value").agg(F.min("ord").alias("ord"))
    ranks = numbered(first, ["doc_id", "type"], "ord", _block(first), "n")
    return ranks.select("doc_id", "type", "value", F.concat(label_of(F.col("type")), F.col("n").cast("string")).alias("alias"))


def standalone(lines: DataFrame) -> DataFrame:
    """doc_id, text, n: lines of two to four characters and how often each stands."""
    return lines.where(F.length("text").between(2, 4)).groupBy("doc_id", "text").agg(F.count("*").alias("n"))
