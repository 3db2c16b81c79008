"""Fill-in areas and photos against what is read on the page: which areas hold printed matter, which photos are documents.

Lines: KEY, text, source (text or ocr), x0s, x1s, y0, y1, and scores where known. Areas: doc_id, page, id, rect. All joins are by page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions.geometry import area, rect
from spanveil.functions.text import find_all
from spanveil.functions.validators import is_slanted, looks_printed, names_only
from spanveil.operators import rules
from spanveil.operators.anchors import ANY_STOP, complete
from spanveil.operators.engine import KEY
from spanveil.operators.regions import PAGE


def characters(lines: DataFrame) -> DataFrame:
    """KEY, place, ch, box, source of every character; `box` has the line's vertical extent."""
    at = F.sequence(F.lit(0), F.length("text") - 1)
    one = lambda i: F.struct(i.cast("int").alias("place"), F.substring("text", i + 1, F.lit(1)).alias("ch"), rect(F.get("x0s", i), F.col("y0"), F.get("x1s", i), F.col("y1")).alias("box"))
    return lines.where(F.length("text") > 0).select(*KEY, "source", F.explode(F.transform(at, one)).alias("c")).select(*KEY, "source", "c.*")


def _centre_inside(c: Column, r: Column) -> Column:
    return ((c["x0"] + c["x1"]) / 2).between(r["x0"], r["x1"]) & ((c["y0"] + c["y1"]) / 2).between(r["y0"], r["y1"])


def images_to_read(images: DataFrame, pages: DataFrame, least: float = 0.12) -> DataFrame:
    """Images (doc_id, page, rect, digest, repeated) on pages with a text layer (doc_id, page, width, height, text_source) that are large enough to hold
    text of their own and are no graphics that recur."""
    own = images.join(pages.where("text_source = 'text'"), PAGE)
    return own.where((area(F.col("rect")) / (F.col("width") * F.col("height")) >= least) & ~F.col("repeated")).select(*images.columns)


def upright(lines: DataFrame) -> DataFrame:
    """Lines that are not at a slant: what is left of a watermark is no text of the page."""
    return lines.where(~is_slanted(F.col("angle")))


def new_lines(photo: DataFrame, known: DataFrame) -> DataFrame:
    """Lines read in a photo whose centre lies in no line that is known already."""
    box = lambda df, p: df.select(*PAGE, F.array_min("x0s").alias(p + "x0"), F.array_max("x1s").alias(p + "x1"), F.col("y0").alias(p + "y0"), F.col("y1").alias(p + "y1"))
    k = box(known, "k_")
    mid = (F.array_min("x0s") + F.array_max("x1s")) / 2
    inside = (photo["doc_id"] == k["doc_id"]) & (photo["page"] == k["page"]) & mid.between(F.col("k_x0"), F.col("k_x1")) & ((photo["y0"] + photo["y1"]) / 2).between(F.col("k_y0"), F.col("k_y1"))
    return photo.join(k, inside, "left_anti")


def identity_photos(photo_lines: DataFrame, most: int = 20) -> DataFrame:
    """doc_id, page, photo of photos (lines with `photo`) that hold an identity number and at most `most` lines: they go as a whole."""
    card = F.exists(rules.find(F.col("text")), lambda h: h["type"] == "ID_CARD")
    return photo_lines.groupBy(*PAGE, "photo").agg(F.count("*").alias("n"), F.max(card).alias("card")).where(F.col("card") & (F.col("n") <= most)).select(*PAGE, "photo")


def removed_slanted(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc_id, page, text, rect, type of the slanted runs that cleaning took away: those with an organisation's name are that, others watermarks."""
    same = [*PAGE, "text", *[F.round(F.col("rect")[k]).alias("r" + k) for k in ("x0", "y0", "x1", "y1")]]
    key = [*PAGE, "text", "rx0", "ry0", "rx1", "ry1"]
    gone = before.select(*same, "rect").join(after.select(*same).distinct(), key, "left_anti")
    org = F.exists(rules.find(F.col("text")), lambda h: h["type"] == "ORG")
    return gone.select(*PAGE, "text", "rect", F.when(org, "ORG").otherwise("WATERMARK").alias("type"))


def distinct_profiles(profiles: DataFrame) -> DataFrame:
    """doc_id, ord, angle, color: each document's watermark profiles, in order, without those alike to an earlier one kept - angles within five
    degrees, colours (red, green, blue) within 20. A document has few."""
    entry = F.struct("ord", F.col("angle").cast("double").alias("angle"), F.col("color").cast("array<double>").alias("color"))
    own = profiles.groupBy("doc_id").agg(F.sort_array(F.collect_list(entry)).alias("ps"))
    away = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    alike = lambda a, b: (F.abs(a["angle"] - b["angle"]) < 5) & (away(a["color"], b["color"]) < 20)
    none = F.slice("ps", F.lit(1), F.lit(0))
    kept = F.aggregate("ps", none, lambda acc, p: F.when(F.exists(acc, lambda q: alike(q, p)), acc).otherwise(F.array_append(acc, p)))
    return own.select("doc_id", F.explode(kept).alias("p")).select("doc_id", "p.*")


def printed_boxes(areas: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, page, id, box: characters that an area's test for ink leaves out - a text layer's, and those of printed lines that begin in the area or right
    of its edge; lines of names only may be handwriting."""
    lines = complete(lines)
    sure = looks_printed(F.col("text"), F.col("scores")) & ~names_only(F.col("text"))
    kept = lines.where((F.col("source") == "text") | sure).withColumn("begin", F.get("x0s", F.lit(0)))
    chars = characters(kept.where(F.length("text") > 0)).join(kept.select(*KEY, "begin"), KEY)
    return areas.join(chars, PAGE).where((F.col("source") == "text") | (F.col("begin") >= F.col("rect.x0"))).select(*PAGE, "id", "box")


def outside(areas: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, page, id, box: characters with their centre outside an area, which strokes that grow out of it must not take in."""
    return areas.join(characters(lines), PAGE).where(~_centre_inside(F.col("box"), F.col("rect"))).select(*PAGE, "id", "box")


def has_printed_digits(areas: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, page, id of areas that hold a date or a number: two characters or more wholly inside, digits among them, and half digits or a date's signs."""
    b, r = F.col("box"), F.col("rect")
    inside = (b["x0"] >= r["x0"]) & (b["x1"] <= r["x1"]) & (b["y0"] >= r["y0"]) & (b["y1"] <= r["y1"])
    own = areas.join(characters(lines), PAGE).where(inside)
    digits, signs = F.count_if(F.rlike("ch", F.lit(r"\p{Nd}"))), F.count_if(F.rlike("ch", F.lit("[-/:年月日时分]")))
    counts = own.groupBy(*PAGE, "id").agg(F.count("*").alias("n"), digits.alias("d"), signs.alias("s"))
    return counts.where((F.col("n") >= 2) & (F.col("d") > 0) & (F.col("d") + F.col("s") >= 0.5 * F.col("n"))).select(*PAGE, "id")


def has_printed_labels(areas: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, page, id of areas that reach into other fields: characters of one line with their centre inside make up a stop word."""
    own = areas.join(characters(lines), PAGE).where(_centre_inside(F.col("box"), F.col("rect")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "ch"))), lambda c: c["ch"]), "")
    return own.groupBy(*PAGE, "id", "line").agg(text.alias("t")).where(F.rlike("t", F.lit(ANY_STOP))).select(*PAGE, "id").distinct()


def usable(areas: DataFrame, lines: DataFrame) -> DataFrame:
    """Areas to check for ink: those without a printed number and without a label of another field."""
    key = [*PAGE, "id"]
    return areas.join(has_printed_digits(areas, lines), key, "left_anti").join(has_printed_labels(areas, lines), key, "left_anti")


def after_printed_date(areas: DataFrame, lines: DataFrame) -> DataFrame:
    """Areas whose beginning a printed date takes up begin behind it; those that it takes up to their end go. Dates are never painted over."""
    dates = lines.select(*PAGE, "x0s", "x1s", "y0", "y1", F.explode(find_all(F.col("text"), rules.DATE)).alias("d"))
    d = dates.select(*PAGE, F.get("x0s", F.col("d.start")).alias("d0"), F.get("x1s", F.col("d.end") - 1).alias("d1"), ((F.col("y0") + F.col("y1")) / 2).alias("dy"), F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0)).alias("dh"))
    r = F.col("rect")
    at = areas.join(d, PAGE).where(F.col("dy").between(r["y0"], r["y1"]) & (F.col("d0") >= r["x0"] - 2) & (F.col("d0") < r["x0"] + 0.5 * (r["x1"] - r["x0"])) & (F.col("d1") > r["x0"]))
    first = at.groupBy(*PAGE, "id").agg(F.min_by(F.struct("d1", "dh"), F.struct("dy", "d0")).alias("m"))
    moved = areas.join(first, [*PAGE, "id"], "left")
    begin = F.col("m.d1") + 0.3 * F.col("m.dh")
    fresh = F.when(F.col("m").isNull(), r).when(begin < r["x1"] + 6 * F.col("m.dh"), rect(begin, r["y0"], F.greatest(r["x1"], begin + 6 * F.col("m.dh")), r["y1"]))
    return moved.withColumn("rect", fresh).where("rect IS NOT NULL").drop("m")
