"""Form templates: known layouts of labels, fitted to pages to recover labels that could not be read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanveil import lexicon
from spanveil.functions.geometry import rect
from spanveil.functions.text import bind
from spanveil.functions.validators import valid
from spanveil.operators.anchors import OTHER_WIDTH, SIGN_WIDTH
from spanveil.operators.engine import KEY, without_overlaps

PAGE = ["doc_id", "page"]


def build(labels: DataFrame) -> DataFrame:
    """name, text, type, box: labels (name, text, type, rect, width, height) as page shares rounded to five places."""
    r = F.col("rect")
    share = lambda v, n: F.round(v / n, 5)
    w, h = F.col("width"), F.col("height")
    return labels.select("name", "text", "type", F.array(share(r["x0"], w), share(r["y0"], h), share(r["x1"], w), share(r["y1"], h)).alias("box"))


def fit(seen: DataFrame, templates: DataFrame) -> DataFrame:
    """doc_id, page, name, slopes and offsets of the template that fits each page.

    seen: doc_id, page, text, rect, width, height. A fit needs pairs for 40 % of the template's labels, at least three, and a median
    residual within 0.8 of the median label height; most pairs win, then the name. Axes are fitted by least squares; an axis on
    which all labels agree keeps its scale and is shifted.
    """
    r, b = F.col("rect"), F.col("box")
    sized = templates.withColumn("labels", F.count("*").over(Window.partitionBy("name")))
    pairs = seen.join(sized, "text").select(
        *PAGE, "name", "labels", ((b[0] + b[2]) / 2 * F.col("width")).alias("tx"), ((b[1] + b[3]) / 2 * F.col("height")).alias("ty"),
        ((r["x0"] + r["x1"]) / 2).alias("px"), ((r["y0"] + r["y1"]) / 2).alias("py"), (r["y1"] - r["y0"]).alias("h"),
    )
    slope = lambda y, x: F.coalesce(F.regr_slope(y, x), F.lit(1.0))
    fits = pairs.groupBy(*PAGE, "name", "labels").agg(
        F.count("*").alias("n"), F.median("h").alias("mh"), slope("px", "tx").alias("ax"), slope("py", "ty").alias("ay"),
        F.avg("px").alias("mpx"), F.avg("tx").alias("mtx"), F.avg("py").alias("mpy"), F.avg("ty").alias("mty"),
    ).withColumns({"bx": F.col("mpx") - F.col("ax") * F.col("mtx"), "by": F.col("mpy") - F.col("ay") * F.col("mty")})
    off = lambda p, a, t, b: F.abs(F.col(p) - F.col(a) * F.col(t) - F.col(b))
    resid = pairs.join(fits.select(*PAGE, "name", "ax", "ay", "bx", "by"), [*PAGE, "name"]).groupBy(*PAGE, "name").agg(
        F.median(off("px", "ax", "tx", "bx")).alias("rx"), F.median(off("py", "ay", "ty", "by")).alias("ry")
    )
    good = fits.join(resid, [*PAGE, "name"]).where((F.col("n") >= F.greatest(F.lit(3), 0.4 * F.col("labels"))) & (F.greatest("rx", "ry") <= 0.8 * F.col("mh")))
    best = F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.desc("n"), "name"))
    return good.withColumn("rank", best).where("rank = 1").select(*PAGE, "name", "n", "ax", "bx", "ay", "by")


def _placed(seen: DataFrame, templates: DataFrame) -> DataFrame:
    """doc_id, page, name, text, type, rect: all labels of the templates that fit, where they must be."""
    sizes = seen.groupBy(*PAGE).agg(F.first("width").alias("width"), F.first("height").alias("height"))
    placed = fit(seen, templates).join(sizes, PAGE).join(templates, "name")
    b = F.col("box")
    x = lambda k: F.col("ax") * b[k] * F.col("width") + F.col("bx")
    y = lambda k: F.col("ay") * b[k] * F.col("height") + F.col("by")
    return placed.select(*PAGE, "name", "text", "type", F.struct(x(0).alias("x0"), y(1).alias("y0"), x(2).alias("x1"), y(3).alias("y1")).alias("rect"))


def recover(seen: DataFrame, templates: DataFrame) -> DataFrame:
    """doc_id, page, name, text, type, rect: where the labels that a fitted template has and the page lacks there must be."""
    placed, r, o = _placed(seen, templates), F.col("rect"), F.col("o_rect")
    there = seen.select(*PAGE, F.col("text").alias("o_text"), F.col("rect").alias("o_rect"))
    h = r["y1"] - r["y0"]
    same = (placed["doc_id"] == there["doc_id"]) & (placed["page"] == there["page"]) & (F.col("text") == F.col("o_text"))
    near = (F.abs((r["x0"] + r["x1"] - o["x0"] - o["x1"]) / 2) < 2 * h) & (F.abs((r["y0"] + r["y1"] - o["y0"] - o["y1"]) / 2) < h)
    return placed.join(there, same & near, "left_anti")


def recover_values(seen: DataFrame, templates: DataFrame, lines: DataFrame, enabled: list[str], existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, fields) of the labels that could not be read. lines: KEY, text, x0s, x1s, y0, y1; existing: hits that new ones must not overlap.

    A field's area lies right of where its label must be, to the next label of the template on its row. What is read in it, and goes on
    behind it without a blank, is a hit if it is valid for the type; hits are no seeds. All areas are to be checked for ink.
    """
    missing = recover(seen, templates)
    r, sig = F.col("rect"), F.contains("text", F.lit("签"))
    missing = missing.where(F.col("type").isin(*enabled) | (sig & F.lit("SIGNATURE" in enabled))).withColumn("h", F.greatest(r["y1"] - r["y0"], F.lit(4.0)))
    o = _placed(seen, templates).select(*PAGE, F.col("text").alias("o_text"), F.col("rect").alias("o")).alias("o")
    m = missing.alias("m")
    on_row = (F.col("m.doc_id") == F.col("o.doc_id")) & (F.col("m.page") == F.col("o.page")) & (F.col("o.x0") > F.col("m.rect.x1")) & (F.abs((F.col("o.y0") + F.col("o.y1") - F.col("m.rect.y0") - F.col("m.rect.y1")) / 2) < 0.6 * F.col("m.h"))
    keys = [F.col("m." + c).alias(c) for c in (*PAGE, "name", "text", "type", "rect", "h")]
    stopped = m.join(o, on_row, "left").groupBy(*keys).agg(F.min(F.col("o.x0")).alias("stop")).withColumn("stop", F.coalesce(F.col("stop") - 0.25 * F.col("h"), F.lit(1e9)))
    h = F.col("h")
    width = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in lexicon.FIELD_WIDTH.items() for x in (k, float(v))]), F.col("type")), F.lit(OTHER_WIDTH))
    right = F.least(r["x1"] + F.when(sig, SIGN_WIDTH).otherwise(width) * h, F.col("stop"))
    areas = stopped.withColumn("area", rect(r["x1"] + 0.15 * h, r["y0"] - 0.3 * h, right, r["y1"] + 0.3 * h)).where(F.col("area.x1") - F.col("area.x0") >= 1.2 * h)
    fields = areas.select(*PAGE, F.when(sig, "SIGNATURE").otherwise("HANDWRITTEN_FIELD").alias("type"), F.col("text").alias("label"), "area")
    on_line = areas.withColumnRenamed("text", "label").join(lines.select(*KEY, "text", "x0s", "x1s", "y0", "y1"), PAGE)
    on_line = on_line.where(((F.col("y0") + F.col("y1")) / 2).between(F.col("area.y0"), F.col("area.y1")))
    n, mid = F.length("text"), lambda k: (F.get("x0s", k) + F.get("x1s", k)) / 2
    inside = F.filter(F.sequence(F.lit(0), n - 1), lambda k: mid(k).between(F.col("area.x0"), F.col("area.x1")))
    on_line = bind(on_line.where("text <> ''"), "ks", inside).where("size(ks) > 0").withColumns({"a": F.array_min("ks"), "b": F.array_max("ks") + 1})
    breaks = F.filter(F.when(F.col("b") < n, F.sequence(F.col("b"), n - 1)), lambda k: ~((F.get("x0s", k) - F.get("x1s", k - 1) <= F.col("h")) & (mid(k) < F.col("stop"))))
    on_line = on_line.withColumn("b", F.coalesce(F.array_min(breaks), n))
    value = F.trim(F.substring("text", F.col("a") + 1, F.col("b") - F.col("a")), F.lit("：: "))
    good = bind(on_line, "value", value).where(F.col("type").isin(*enabled) & valid(F.col("type"), F.col("value")))
    hits = good.select(
        *KEY, "type", F.lit("template").alias("source"), F.lit(0).alias("prio"), F.col("a").cast("int").alias("start"), F.col("b").cast("int").alias("end"), "value", F.lit(False).alias("seed"),
    ).distinct()
    return (without_overlaps(hits, existing) if existing is not None else hits), fields


def covered_values(hits: DataFrame, chars: DataFrame, truth: DataFrame) -> DataFrame:
    """mode, n, covered: printed truth items (doc_id, page, box as shares) whose centre lies in a hit's box, per mode of a trial with or
    without templates. hits: mode, doc_id, page, rect; chars is the pages' size: doc_id, page, width, height."""
    sized = truth.join(chars, PAGE)
    b = F.col("box")
    cx, cy = (b[0] + b[2]) / 2 * F.col("width"), (b[1] + b[3]) / 2 * F.col("height")
    modes = hits.select("mode").distinct()
    items = sized.select(*PAGE, "item", cx.alias("cx"), cy.alias("cy"))
    own = hits.join(items, PAGE).where(F.col("cx").between(F.col("rect.x0"), F.col("rect.x1")) & F.col("cy").between(F.col("rect.y0"), F.col("rect.y1")))
    found = own.select("mode", *PAGE, "item").distinct().groupBy("mode").agg(F.count("*").alias("covered"))
    total = items.agg(F.count("*").alias("n"))
    return modes.join(found, "mode", "left").select("mode", total.scalar().alias("n"), F.coalesce("covered", F.lit(0)).alias("covered"))
