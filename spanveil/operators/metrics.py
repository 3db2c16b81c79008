"""Scoring of redaction against truth: coverage by cells, statuses, recall tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FULL, PARTIAL, OVER, EXTRA, GROW = 0.8, 0.3, 0.15, 0.2, 0.006
LONG_SIDE = 1000
BOX = "array<double>"


def _cells(box: Column, w: Column, h: Column) -> Column:
    """Half-open ranges of grid cells that a box of page shares touches, clamped to the grid."""
    lo = lambda v, n: F.greatest(F.floor(v * n), F.lit(0)).cast("int")
    hi = lambda v, n: F.least(F.ceil(v * n), n).cast("int")
    return F.struct(lo(box[0], w).alias("x0"), lo(box[1], h).alias("y0"), hi(box[2], w).alias("x1"), hi(box[3], h).alias("y1"))


def _grid(aspect: Column) -> tuple[Column, Column]:
    """Cells across and down; the aspect is width over height."""
    a = F.coalesce(aspect, F.lit(1 / 1.414))
    long = F.lit(LONG_SIDE)
    return F.when(a >= 1, long).otherwise(F.round(long * a)).cast("int"), F.when(a >= 1, F.round(long / a)).otherwise(long).cast("int")


def coverage(box: Column, others: Column, aspect: Column | None = None) -> Column:
    """Share of the box's cells that the union of `others` (array of boxes) covers; 0 for a box without cells.

    Column by column of cells, the covered rows are counted over the union of the boxes that reach that column.
    """
    w, h = _grid(aspect if aspect is not None else F.lit(None).cast("double"))
    own = _cells(box, w, h)
    cover = F.transform(others, lambda o: _cells(o, w, h))

    def in_column(x: Column) -> Column:
        here = F.filter(cover, lambda c: (c["x0"] <= x) & (x < c["x1"]))
        spans = F.array_sort(F.transform(here, lambda c: F.struct(F.greatest(c["y0"], own["y0"]).alias("a"), F.least(c["y1"], own["y1"]).alias("b"))))
        start = F.struct(F.lit(0).alias("n"), own["y0"].alias("upto"))
        step = lambda s, p: F.struct(
            (s["n"] + F.greatest(p["b"] - F.greatest(p["a"], s["upto"]), F.lit(0))).alias("n"), F.greatest(s["upto"], p["b"]).alias("upto")
        )
        return F.aggregate(spans, start, step, lambda s: s["n"])

    columns = F.when(own["x1"] > own["x0"], F.sequence(own["x0"], own["x1"] - 1))
    hit = F.aggregate(columns, F.lit(0), lambda n, x: n + in_column(x))
    return F.coalesce(F.try_divide(hit.cast("double"), (own["x1"] - own["x0"]) * (own["y1"] - own["y0"])), F.lit(0.0))


def score(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """truth (doc_id, item, page, type, role, form, box) with `cover` and `status`: full, partial, miss; over, ok.

    predicted: doc_id, page, source, box. Watermark boxes cover what must go, not what must stay.
    """
    p = predicted.groupBy("doc_id", "page").agg(F.collect_list(F.struct("source", "box")).alias("ps"))
    joined = truth.join(p, ["doc_id", "page"], "left")
    boxes = lambda a: F.transform(a, lambda x: x["box"])
    all_boxes = boxes(F.coalesce("ps", F.array().cast(f"array<struct<source:string,box:{BOX}>>")))
    solid = boxes(F.filter(F.coalesce("ps", F.array().cast(f"array<struct<source:string,box:{BOX}>>")), lambda x: x["source"] != "watermark"))
    redact = F.col("role") == "redact"
    cover = coverage(F.col("box"), F.when(redact, all_boxes).otherwise(solid))
    status = F.when(redact, F.when(F.col("cover") >= FULL, "full").when(F.col("cover") >= PARTIAL, "partial").otherwise("miss")).otherwise(
        F.when(F.col("cover") > OVER, "over").otherwise("ok")
    )
    return joined.withColumn("cover", cover).withColumn("status", status).drop("ps")


def extras(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Predicted boxes, watermarks aside, that hardly touch any truth item grown by GROW."""
    grown = F.array(F.col("box")[0] - GROW, F.col("box")[1] - GROW, F.col("box")[2] + GROW, F.col("box")[3] + GROW)
    t = truth.groupBy("doc_id", "page").agg(F.collect_list(grown).alias("ts"))
    own = predicted.where("source <> 'watermark'").join(t, ["doc_id", "page"], "left")
    return own.where(coverage(F.col("box"), F.coalesce("ts", F.array().cast(f"array<{BOX}>"))) < EXTRA).drop("ts")


def _counts() -> list[Column]:
    redact, status = F.col("role") == "redact", F.col("status")
    n = F.count_if(redact)
    return [
        n.alias("redact"),
        F.count_if(redact & (status == "full")).alias("full"), F.count_if(redact & (status == "partial")).alias("partial"), F.count_if(redact & (status == "miss")).alias("miss"),
        F.count_if(~redact).alias("keep"), F.count_if(status == "over").alias("over"),
        F.round(F.try_divide(F.count_if(redact & (status == "full")), n), 3).alias("recall"),
    ]


def summarise(scored: DataFrame, *keys: str) -> DataFrame:
    """Counts and recall per key; recall is null where nothing had to go."""
    return scored.groupBy(*keys).agg(*_counts())


def summarise_sets(scored: DataFrame, sets: list[list[str]]) -> DataFrame:
    """The same for several groupings in one pass, absent keys null."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    return scored.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(*_counts())


def variant_costs(docs: DataFrame) -> DataFrame:
    """variant, extras, sec_per_page of documents (doc_id, variant, pages, elapsed, extras): what is painted too much, and time."""
    per = F.sum("elapsed") / F.greatest(F.sum("pages"), F.lit(1))
    return docs.groupBy("variant").agg(F.sum("extras").alias("extras"), F.round(per, 1).alias("sec_per_page"))


def score_prose(names: DataFrame, hits: DataFrame) -> DataFrame:
    """names (doc_id, start, end, role) with `covered` and `got`: whether the union of hits holds every character of a name, and the
    type found at its first. hits: doc_id, start, end, type.

    Overlapping or touching hits are joined to islands first, so a name is covered if one island holds it.
    """
    by = Window.partitionBy("doc_id").orderBy("start", "end")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    runs = hits.withColumn("run", F.sum(F.coalesce((F.col("start") > before).cast("int"), F.lit(1))).over(by))
    islands = runs.groupBy("doc_id", "run").agg(F.min("start").alias("lo"), F.max("end").alias("hi"))
    n = names.alias("n")
    whole = n.join(islands.alias("i"), (F.col("n.doc_id") == F.col("i.doc_id")) & (F.col("lo") <= F.col("n.start")) & (F.col("hi") >= F.col("n.end")), "left_semi")
    first = hits.select("doc_id", F.col("start").alias("a"), F.col("end").alias("b"), "type").alias("h")
    typed = n.join(first, (F.col("n.doc_id") == F.col("h.doc_id")) & (F.col("a") <= F.col("n.start")) & (F.col("b") > F.col("n.start")))
    got = typed.groupBy(*[F.col("n." + c).alias(c) for c in ("doc_id", "start")]).agg(F.max_by("type", F.col("a")).alias("got"))
    flagged = names.join(whole.select("doc_id", "start", F.lit(True).alias("covered")), ["doc_id", "start"], "left").join(got, ["doc_id", "start"], "left")
    return flagged.withColumn("covered", F.coalesce("covered", F.lit(False)))


def prose_summary(scored: DataFrame) -> DataFrame:
    """names, recall and the share of covered names whose type is right."""
    covered = F.count_if("covered")
    return scored.agg(
        F.count("*").alias("names"), F.round(covered / F.greatest(F.count("*"), F.lit(1)), 4).alias("recall"),
        F.round(F.count_if(F.col("covered") & (F.col("got") == F.col("role"))) / F.greatest(covered, F.lit(1)), 4).alias("type_accuracy"),
    )


def confusion(scored: DataFrame) -> DataFrame:
    return scored.where("covered").groupBy("role", "got").agg(F.count("*").alias("n"))


def false_runs(chars: DataFrame, top: int = 12) -> DataFrame:
    """The most frequent runs of characters that were hit and must not have been. chars: doc_id, pos, ch, hit, allowed."""
    wrong = chars.where(F.col("hit") & ~F.col("allowed") & (F.col("ch") != "\n"))
    by = Window.partitionBy("doc_id").orderBy("pos")
    runs = wrong.withColumn("run", F.sum(F.coalesce((F.col("pos") != F.lag("pos").over(by) + 1).cast("int"), F.lit(1))).over(by))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "ch"))), lambda x: x["ch"]), "")
    return runs.groupBy("doc_id", "run").agg(text.alias("text")).groupBy("text").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "text").limit(top)
