"""Review of reports: validation of edited items, differences between versions, export, and what changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil import catalog

KEY = ["page", "type", "box", "style"]


def check_items(items: DataFrame, pages: Column) -> DataFrame:
    """items (page, type, box, style, sources, alias) with a clamped `box` and `problem`, null for a good item.

    pages is the number of pages. Boxes are clamped to the page and need sides of 0.002; styles must be known unless the item is a
    watermark; at most 8 sources of 32 characters are kept, an alias keeps 64.
    """
    b = F.transform("box", lambda v: F.round(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)), 4))
    problem = (
        F.when(~F.coalesce(F.col("page").between(1, pages), F.lit(False)), "page")
        .when(~F.coalesce(F.col("type").isin(*catalog.CODES), F.lit(False)), "type")
        .when(F.coalesce(F.size("box"), F.lit(0)) != 4, "box")
        .when((b[2] - b[0] < 0.002) | (b[3] - b[1] < 0.002), "size")
        .when((F.col("type") != "WATERMARK") & ~F.coalesce(F.col("style").isin(*catalog.STYLES), F.lit(False)), "style")
    )
    return items.withColumns({
        "problem": problem, "box": b, "alias": F.substring("alias", 1, 64),
        "sources": F.transform(F.slice("sources", 1, 8), lambda s: F.substring(s, 1, 32)),
    })


def difference(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(removed, added) as multisets of page, type, box and style; sources and aliases don't count."""
    a, b = old.select(*KEY), new.select(*KEY)
    return a.exceptAll(b), b.exceptAll(a)


def too_many_items(items: DataFrame, pages: int) -> Column:
    """Whether a review holds more items than 50 a page and 1000; a scalar."""
    return (items.agg(F.count("*").alias("n")).scalar() > 50 * pages + 1000).alias("too_many")


def applied(reports: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """New versions of reports (job_id, editable, edits, counts, evidence) for the items (job_id and KEY) that a review leaves.

    `code` is NOT_EDITABLE, and nothing else changes, where items are gone or altered but the originals were not kept. Else edits grow by what was removed and
    added, counts follow, and evidence of an earlier check is stale as soon as anything changed.
    """
    key = ["job_id", *KEY]
    a, b = old.select(*key), new.select(*key)
    n = lambda df, name: df.groupBy("job_id").agg(F.count("*").alias(name))
    removed, added = n(a.exceptAll(b), "removed"), n(b.exceptAll(a), "added")
    per_type = new.groupBy("job_id", "type").agg(F.count("*").alias("n"))
    totals = per_type.groupBy("job_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("fresh"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    joined = reports.join(removed, "job_id", "left").join(added, "job_id", "left").join(totals, "job_id", "left").withColumns({"removed": zero("removed"), "added": zero("added")})
    refused, changed = ~F.col("editable") & (F.col("removed") > 0), (F.col("removed") + F.col("added")) > 0
    return joined.select(
        "job_id", "editable", F.when(refused, "NOT_EDITABLE").alias("code"), (zero("edits") + F.when(refused, 0).otherwise(F.col("removed") + F.col("added"))).alias("edits"),
        F.when(refused, F.col("counts")).otherwise(F.coalesce("fresh", F.create_map().cast("map<string,bigint>"))).alias("counts"),
        F.when(changed & ~refused, "stale").otherwise(F.col("evidence")).alias("evidence"),
    )


def to_paint(reports: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """job_id and KEY of the items to paint on changed pages: all of them on the originals where these were kept, else what was added, on the
    output; counted as multisets."""
    key = ["job_id", *KEY]
    a, b = old.select(*key), new.select(*key)
    removed, added = a.exceptAll(b), b.exceptAll(a)
    pages = removed.select("job_id", "page").union(added.select("job_id", "page")).distinct()
    kept = reports.where("editable").select("job_id")
    whole = b.join(pages, ["job_id", "page"], "left_semi").join(kept, "job_id", "left_semi").select(*key)
    return whole.unionByName(added.join(kept, "job_id", "left_anti").select(*key))


def finished(reports: DataFrame) -> DataFrame:
    """Reports whose review is done: their originals go, so they are not editable any more."""
    return reports.withColumns({"editable": F.lit(False), "finished": F.lit(True)})


def changed_pages(removed: DataFrame, added: DataFrame) -> DataFrame:
    return removed.select("page").union(added.select("page")).distinct()


def coco(items: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, categories) of a document: pixel boxes [x, y, w, h] rounded to 0.1, categories are all codes in order."""
    kept = items.where("type <> 'WATERMARK'")
    number = {code: k + 1 for k, code in enumerate(sorted(catalog.CODES))}
    n = items.sparkSession.createDataFrame([*number.items()], "type string, category_id int")
    box = lambda x: F.round(x, 1)
    b = F.col("box")
    w, h = F.col("width"), F.col("height")
    notes = kept.join(pages, "page").join(F.broadcast(n), "type").select(
        F.col("page").alias("image_id"), "category_id", F.array(box(b[0] * w), box(b[1] * h), box((b[2] - b[0]) * w), box((b[3] - b[1]) * h)).alias("bbox"),
    )
    return pages.select(F.col("page").alias("image_id"), "width", "height"), notes, n.select("category_id", F.col("type").alias("name"))


def truth_coco(truth: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same for a detector's training: signatures and seals that must go, on scanned pages (page, width, height, text_source) only."""
    scanned = pages.where("text_source <> 'text'").drop("text_source")
    return coco(truth.where("role = 'redact' AND type IN ('SIGNATURE', 'SEAL')"), scanned)


def load_coco(images: DataFrame, annotations: DataFrame, categories: DataFrame, classes: list[str]) -> DataFrame:
    """image_id, labels: [(class, cx, cy, w, h)] as page shares; images without wanted classes stay, with none."""
    number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("name")).cast("int") - 1
    a = annotations.join(categories.where(F.col("name").isin(*classes)), "category_id")
    b, w, h = F.col("bbox"), F.col("width"), F.col("height")
    label = F.when(F.col("name").isNotNull(), F.struct(number.alias("cls"), ((b[0] + b[2] / 2) / w).alias("cx"), ((b[1] + b[3] / 2) / h).alias("cy"), (b[2] / w).alias("w"), (b[3] / h).alias("h")))
    return images.join(a, "image_id", "left").groupBy("image_id").agg(F.sort_array(F.collect_list(label)).alias("labels"))
