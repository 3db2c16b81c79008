"""From documents, conversations and pages to lines; from characters with boxes to lines in reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.functions.text import upper_median


def text_lines(df: DataFrame, doc_id: str, page=None, text: str = "text") -> DataFrame:
    """doc_id, page, line, text: one row per line, numbered from 0. A null text has no lines. Narrow."""
    return df.select(
        F.col(doc_id).alias("doc_id"),
        (F.lit(0) if page is None else F.col(page)).cast("int").alias("page"),
        F.posexplode(F.split(text, "\n")).alias("line", "text"),
    )


def compact(text: Column) -> Column:
    """Without white space, as lines read from scans are matched."""
    return F.regexp_replace(text, r"(?U)\s+", "")


def tight_boxes(raw: DataFrame) -> DataFrame:
    """raw: doc_id, page, ord, ch, tight box x0..y1, loose ly0, ly1, angle, page_height. Characters of a text layer.

    Blanks and fillers go, as do empty boxes and characters at a slant; a box much flatter than its loose box
    takes that one's vertical extent; y turns from bottom-up to top-down.
    """
    flat = (F.col("y1") - F.col("y0")) < 0.3 * (F.col("ly1") - F.col("ly0"))
    low, high = F.when(flat, F.col("ly0")).otherwise(F.col("y0")), F.when(flat, F.col("ly1")).otherwise(F.col("y1"))
    turn = F.pmod(F.col("angle"), F.lit(90.0))
    kept = raw.where(~F.rlike("ch", F.lit(r"(?U)\A[\s￾￿]*\z")) & ~((turn > 8) & (turn < 82)))
    return kept.select(
        "doc_id", "page", "ord", "ch", "x0", (F.col("page_height") - high).alias("y0"), "x1", (F.col("page_height") - low).alias("y1")
    ).where("x1 > x0 AND y1 > y0")


def order_runs(chars: DataFrame, line: list[str]) -> DataFrame:
    """Characters of a line in reading order: runs that follow each other in writing order with x not falling stay
    together, and runs are sorted by where they begin. Adds `place`, from 0."""
    by = Window.partitionBy(*line)
    writing = by.orderBy("ord")
    breaks = ((F.col("ord") != F.lag("ord").over(writing) + 1) | (F.col("x0") < F.lag("x0").over(writing))).cast("int")
    runs = chars.withColumn("run", F.sum(F.coalesce(breaks, F.lit(0))).over(writing))
    first = runs.withColumn("run_x", F.min("x0").over(Window.partitionBy(*line, "run")))
    return first.withColumn("place", F.row_number().over(by.orderBy("run_x", "run", "ord")) - 1).drop("run", "run_x")


def group_lines(chars: DataFrame) -> DataFrame:
    """doc_id, page, ord, x0, y0, x1, y1 -> with `line`.

    Characters in order of vertical centre and x join the line before them if their centre is within half a height of its
    mean; else they open a line. The fold runs inside a page's own row of sorted characters.
    """
    entry = F.struct(((F.col("y0") + F.col("y1")) / 2).alias("cy"), "x0", (F.col("y1") - F.col("y0")).alias("h"), "ord")
    pages = chars.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(entry)).alias("cs"))
    kind = "struct<line:int,sum:double,hs:array<double>,acc:array<struct<ord:bigint,line:int>>>"
    start = F.struct(F.lit(-1).alias("line"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("hs"), F.array().cast("array<struct<ord:bigint,line:int>>").alias("acc")).cast(kind)

    def step(s: Column, c: Column) -> Column:
        near = (s["line"] >= 0) & (F.abs(c["cy"] - s["sum"] / F.greatest(F.size(s["hs"]), F.lit(1))) < 0.5 * F.greatest(c["h"], F.coalesce(upper_median(s["hs"]), F.lit(0.0))))
        line = F.when(near, s["line"]).otherwise(s["line"] + 1)
        return F.struct(
            line.alias("line"),
            F.when(near, s["sum"] + c["cy"]).otherwise(c["cy"]).alias("sum"),
            F.when(near, F.array_append(s["hs"], c["h"])).otherwise(F.array(c["h"])).alias("hs"),
            F.array_append(s["acc"], F.struct(c["ord"].cast("bigint").alias("ord"), line.alias("line"))).alias("acc"),
        ).cast(kind)

    numbered = pages.select("doc_id", "page", F.explode(F.aggregate("cs", start, step, lambda s: s["acc"])).alias("n"))
    lines = numbered.select("doc_id", "page", F.col("n.ord").alias("ord"), F.col("n.line").alias("line"))
    return chars.join(lines, ["doc_id", "page", "ord"])


def slanted_runs(chars: DataFrame) -> DataFrame:
    """doc_id, page, ord, ch, box, angle -> one row per run of slanted characters at most two places apart, with its box."""
    turn = F.pmod(F.col("angle"), F.lit(90.0))
    by = Window.partitionBy("doc_id", "page").orderBy("ord")
    slanted = chars.where((turn > 8) & (turn < 82))
    fresh = F.coalesce((F.col("ord") > F.lag("ord").over(by) + 2).cast("int"), F.lit(0))
    return (
        slanted.withColumn("run", F.sum(fresh).over(by))
        .groupBy("doc_id", "page", "run")
        .agg(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "ch"))), lambda c: c["ch"]), "").alias("text"),
            F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        )
    )


def orientation(boxes: DataFrame) -> DataFrame:
    """doc_id, page, w, h of detected boxes -> tall, wide, sideways: eight tall boxes or more and twice as many as wide ones."""
    tall, wide = F.count_if(F.col("h") > 1.5 * F.col("w")), F.count_if(F.col("w") > 1.5 * F.col("h"))
    return (
        boxes.groupBy("doc_id", "page").agg(F.count("*").alias("n"), tall.alias("tall"), wide.alias("wide"))
        .withColumn("sideways", (F.col("n") >= 5) & (F.col("tall") >= 8) & (F.col("tall") >= 2 * F.col("wide")))
    )


def synthetic_box(line: Column, k: Column, n: Column) -> Column:
    """Box of characters k to k + n of a line of plain text: 20 by 30 pixels a character cell."""
    x, y = F.lit(40.0) + 20 * k, F.lit(40.0) + 30 * line
    return F.struct(x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + 20 * n - 2).cast("double").alias("x1"), (y + 18).cast("double").alias("y1"))
