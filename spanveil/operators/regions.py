"""Boxes on pages: from hits to rectangles, merging, strips, suppression, repeated graphics."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.functions.geometry import KEYS, area, intersection, overlap, overlapping, rect
from spanveil.session import ship

RECT = "struct<x0:double,y0:double,x1:double,y1:double>"
PAGE = ["doc_id", "page"]


def span_rects(hits: DataFrame, chars: DataFrame) -> DataFrame:
    """hits (doc_id, page, line, start, end, source, ocr, strict) with `rect`: the box of their characters, padded by shares of the text height.

    chars: doc_id, page, line, place, box. Padding never reaches neighbours on the line, nor characters of the lines above and below, which
    it meets half way at most. A hit that covers no character has no row.
    """
    c = chars.select(*PAGE, F.col("line").alias("c_line"), F.col("place").alias("c_place"), F.col("box").alias("c_box"))
    own_line = hits.join(c, PAGE).where((F.col("c_line") == F.col("line")) & (F.col("c_place") >= F.col("start") - 1) & (F.col("c_place") <= F.col("end")))
    inside = (F.col("c_place") >= F.col("start")) & (F.col("c_place") < F.col("end"))
    b, keys = F.col("c_box"), list(hits.columns)
    boxes = own_line.groupBy(*keys).agg(
        *[f(F.when(inside, b[k])).alias(k) for f, k in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))],
        F.max(F.when(F.col("c_place") == F.col("start") - 1, b["x1"])).alias("left"),
        F.min(F.when(F.col("c_place") == F.col("end"), b["x0"])).alias("right"),
    ).where("x0 IS NOT NULL")
    h = F.greatest(F.col("y1") - F.col("y0"), F.lit(4.0))
    more = F.when(F.col("ocr") & (F.col("source") == "anchor"), 0.1).otherwise(0.0)
    px = h * (F.when(F.col("ocr") & F.col("strict"), 0.2).otherwise(0.12) + more)
    py = h * (F.when(F.col("ocr"), F.when(F.col("strict"), 0.2).otherwise(0.14)).otherwise(0.12) + more)
    padded = boxes.withColumns({
        "h": h, "px0": F.greatest(F.col("x0") - px, F.coalesce(F.col("left") + 1, F.col("x0") - px)), "px1": F.least(F.col("x1") + px, F.coalesce(F.col("right") - 1, F.col("x1") + px)),
        "top": F.col("y0") - py, "bottom": F.col("y1") + py, "mid": (F.col("y0") + F.col("y1")) / 2,
    })
    near = (F.col("p.doc_id") == F.col("c.doc_id")) & (F.col("p.page") == F.col("c.page")) & (F.col("c_line") != F.col("p.line")) & (b["x1"] > F.col("px0")) & (b["x0"] < F.col("px1"))
    joined = padded.alias("p").join(c.alias("c"), near & (b["y1"] > F.col("top")) & (b["y0"] < F.col("bottom")), "left")
    cy = (b["y0"] + b["y1"]) / 2
    above, under = cy < F.col("y0") + 0.3 * F.col("h"), cy > F.col("y1") - 0.3 * F.col("h")
    group = [F.col("p." + k).alias(k) for k in (*keys, "x0", "x1", "px0", "px1", "top", "bottom", "mid")]
    cut = joined.groupBy(*group).agg(F.max(F.when(above, F.least(b["y1"] + 1, F.col("mid")))).alias("up"), F.min(F.when(~above & under, F.greatest(b["y0"] - 1, F.col("mid")))).alias("down"))
    return cut.select(*keys, rect(F.least("px0", "x0"), F.greatest("top", F.coalesce("up", "top")), F.greatest("px1", "x1"), F.least("bottom", F.coalesce("down", "bottom"))).alias("rect"))


def _together(a: Column, b: Column) -> Column:
    ha, hb = a["y1"] - a["y0"], b["y1"] - b["y0"]
    low = F.least(ha, hb)
    shared = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    gap = F.greatest(a["x0"], b["x0"]) - F.least(a["x1"], b["x1"])
    return (shared > 0.5 * low) & (gap <= 0.3 * low)


def merge(regions: DataFrame) -> DataFrame:
    """Regions (doc_id, page, type, alias, rect, source) of one type and alias, in order of y and x, each joining the first
    earlier region on its line that it touches or nearly touches. Returns rect and the sorted `sources`. Not transitive."""
    kind = f"array<struct<r:{RECT},sources:array<string>>>"
    entry = F.struct(F.col("rect.y0").alias("y"), F.col("rect.x0").alias("x"), F.col("rect").alias("r"), F.col("source").alias("source"))
    groups = regions.groupBy(*PAGE, "type", "alias").agg(F.sort_array(F.collect_list(entry)).alias("rs"))

    def step(acc: Column, e: Column) -> Column:
        first = F.array_position(F.transform(acc, lambda y: _together(y["r"], e["r"])), True)
        grown = lambda y: F.struct(
            rect(F.least(y["r"]["x0"], e["r"]["x0"]), F.least(y["r"]["y0"], e["r"]["y0"]), F.greatest(y["r"]["x1"], e["r"]["x1"]), F.greatest(y["r"]["y1"], e["r"]["y1"])).alias("r"),
            F.array_sort(F.array_union(y["sources"], F.array(e["source"]))).alias("sources"),
        )
        joined = F.transform(acc, lambda y, i: F.when(i + 1 == first, grown(y)).otherwise(y))
        return F.when(first > 0, joined).otherwise(F.array_append(acc, F.struct(e["r"].alias("r"), F.array(e["source"]).alias("sources")))).cast(kind)

    merged = groups.select(*PAGE, "type", "alias", F.explode(F.aggregate("rs", F.array().cast(kind), step)).alias("m"))
    return merged.select(*PAGE, "type", "alias", F.col("m.r").alias("rect"), F.col("m.sources").alias("sources"))


def interval_union(spans: DataFrame, keys: list[str], low: str = "lo", high: str = "hi") -> DataFrame:
    """Union of intervals per key; touching ones join. Those without a low end come last, each by itself."""
    order = [F.asc_nulls_last(low), F.asc_nulls_last(high)]
    before = F.max(high).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((F.col(low) > before).cast("int"), F.lit(1))
    by = Window.partitionBy(*keys).orderBy(*order, F.desc("fresh"))  # of equal intervals the one that opens a run stands first
    runs = spans.select(*keys, low, high, fresh.alias("fresh")).withColumn("run", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "run").agg(F.min(low).alias(low), F.max(high).alias(high)).drop("run")


def verify_strips(regions: DataFrame, pages: DataFrame) -> DataFrame:
    """Vertical strips to read again: each region grown by its height, at least 40 pixels, clipped to the page, joined."""
    r = F.col("rect")
    pad = F.greatest(F.lit(40.0), r["y1"] - r["y0"])
    spans = regions.join(pages, PAGE).select(*PAGE, F.greatest(r["y0"] - pad, F.lit(0.0)).alias("lo"), F.least(r["y1"] + pad, F.col("height")).alias("hi"))
    return interval_union(spans, PAGE)


def strip_layout(strips: DataFrame, pages: DataFrame, gap: float = 48.0, least: int = 736, unit: int = 256) -> DataFrame:
    """Offsets at which a page's strips are stacked for reading, or `whole` if they cover more than 70 % of it."""
    by = Window.partitionBy(*PAGE).orderBy("lo")
    total = F.sum(F.col("hi") - F.col("lo")).over(Window.partitionBy(*PAGE))
    stacked = strips.join(pages, PAGE).withColumns({
        "whole": total > 0.7 * F.col("height"),
        "offset": F.coalesce(F.sum(F.col("hi") - F.col("lo") + gap).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "used": total + gap * (F.count("*").over(Window.partitionBy(*PAGE)) - 1),
    })
    return stacked.select(*PAGE, "lo", "hi", "whole", "offset", (F.ceil(F.greatest(F.col("used"), F.lit(float(least))) / unit) * unit).cast("int").alias("canvas"))


def suppress(boxes: DataFrame, same: float = 0.45, cross: float = 0.8) -> DataFrame:
    """Model boxes (doc_id, page, type, score, rect), best first; those that overlap a kept one of their type by more than
    `same`, or of another type by more than `cross`, go."""
    kind = f"array<struct<minus:double,type:string,r:{RECT}>>"
    entry = F.struct((-F.col("score")).cast("double").alias("minus"), F.col("type").alias("type"), F.col("rect").alias("r"))
    beats = lambda x, y: overlap(x["r"], y["r"]) > F.when(x["type"] == y["type"], F.lit(same)).otherwise(F.lit(cross))
    kept = F.aggregate(F.sort_array(F.collect_list(entry)), F.array().cast(kind), lambda acc, x: F.when(F.exists(acc, lambda y: beats(x, y)), acc).otherwise(F.array_append(acc, x)))
    out = boxes.groupBy(*PAGE).agg(kept.alias("k")).select(*PAGE, F.explode("k").alias("b"))
    return out.select(*PAGE, F.col("b.type").alias("type"), (-F.col("b.minus")).alias("score"), F.col("b.r").alias("rect"))


def tiles(pages: DataFrame, share: float = 0.65, least: int = 1000) -> DataFrame:
    """doc_id, page, x0, y0, x1, y1: what a model sees of each page (doc_id, page, width, height) - the whole, and of pages with a longer side than
    `least` also four overlapping corners of `share` of each side."""
    w, h = F.col("width"), F.col("height")
    cw, ch = F.floor(w * share).cast("double"), F.floor(h * share).cast("double")
    corner = lambda x, y: rect(x, y, x + cw, y + ch)
    corners = [corner(x, y) for y in (F.lit(0.0), h - ch) for x in (F.lit(0.0), w - cw)]
    whole = rect(F.lit(0.0), F.lit(0.0), w, h)
    return pages.select(*PAGE, F.explode(F.when(F.greatest(w, h) > least, F.array(whole, *corners)).otherwise(F.array(whole))).alias("t")).select(*PAGE, "t.*")


def stamp_parts(boxes: DataFrame, stamps: DataFrame) -> DataFrame:
    """Model boxes (doc_id, page, type, score, rect) where those that are a stamp's (doc_id, page, seal), or an arc at its rim, are of type SEAL."""
    s, r = F.col("seal"), F.col("rect")
    dx = (r["x0"] + r["x1"] - s["x0"] - s["x1"]) / F.greatest(s["x1"] - s["x0"], F.lit(1.0))
    dy = (r["y0"] + r["y1"] - s["y0"] - s["y1"]) / F.greatest(s["y1"] - s["y0"], F.lit(1.0))
    rim = (F.coalesce(F.try_divide(intersection(r, s), area(r)), F.lit(0.0)) > 0.85) & (dx * dx + dy * dy > 0.55)
    numbered = boxes.withColumn("__id", F.monotonically_increasing_id())
    part = numbered.join(stamps.select(*PAGE, "seal"), PAGE).where((overlap(r, s) > 0.8) | rim).select("__id", F.lit(True).alias("__seal")).distinct()
    out = numbered.join(part, "__id", "left")
    return out.withColumn("type", F.when(F.col("__seal"), "SEAL").otherwise(F.col("type"))).drop("__id", "__seal")


def too_many(boxes: DataFrame, most: int = 100) -> DataFrame:
    """doc_id, page of the pages with more boxes than a model may find without review."""
    return boxes.groupBy(*PAGE).agg(F.count("*").alias("n")).where(F.col("n") > most).select(*PAGE)


def effective_bands(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, bands: over how many bands (keys, band, n) pixels really spread, (sum n)^2 / sum n^2; the lower, the more concentrated."""
    return pixels.groupBy(*keys).agg((F.pow(F.sum("n").cast("double"), F.lit(2)) / F.greatest(F.sum(F.col("n").cast("double") * F.col("n")), F.lit(1.0))).alias("bands"))


def pick_class(logits: Column, names: list[str], least: float) -> Column:
    """struct<type, score>: the greatest logit's class and its logistic, null if too weak or not one of the wanted names."""
    best = F.array_position(logits, F.array_max(logits)).cast("int")
    score = 1 / (1 + F.exp(-F.array_max(logits)))
    name = F.try_element_at(F.array(*[F.lit(n) for n in names]), best)
    return F.when((score >= least) & (best <= len(names)), F.struct(name.alias("type"), score.alias("score")))


def protect_dates(boxes: DataFrame, dates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, concerns): boxes that overlap the characters of a date are not painted but reviewed."""
    d = dates.select(*PAGE, F.col("rect").alias("d_rect"))
    meets = (boxes["doc_id"] == d["doc_id"]) & (boxes["page"] == d["page"]) & overlapping(boxes["rect"], d["d_rect"])
    return boxes.join(d, meets, "left_anti"), boxes.join(d, meets, "left_semi")


def covered_share(boxes: DataFrame, printed: DataFrame) -> DataFrame:
    """boxes with `share`: how much of each the printed characters' boxes cover, counted singly."""
    p = printed.select(*PAGE, F.col("rect").alias("p_rect"))
    pairs = boxes.join(p, PAGE, "left")
    cut = F.coalesce(F.sum(intersection(F.col("rect"), F.col("p_rect"))), F.lit(0.0))
    return pairs.groupBy(*boxes.columns).agg(cut.alias("cut")).withColumn("share", F.coalesce(F.try_divide("cut", area(F.col("rect"))), F.lit(0.0))).drop("cut")


def repeated_digests(images: DataFrame) -> DataFrame:
    """doc_id, digest of images on two or more pages."""
    return images.groupBy("doc_id", "digest").agg(F.count_distinct("page").alias("pages")).where("pages >= 2").select("doc_id", "digest")


def repeated_so_far(images: DataFrame) -> DataFrame:
    """images with `repeated`: whether the digest was on an earlier page of the document."""
    first = F.min("page").over(Window.partitionBy("doc_id", "digest"))
    return images.withColumn("repeated", F.col("page") > first)


def classify_images(images: DataFrame) -> DataFrame:
    """doc_id, page, rect, digest, dpi, width, height -> `kind`: SIGNATURE, LOGO, keep or null for too small or too large.

    Pages that one image covers by 80 % or more are scans and yield nothing.
    """
    r = F.col("rect")
    cm, share = F.col("dpi") / 2.54, area(r) / (F.col("width") * F.col("height"))
    w, h = r["x1"] - r["x0"], r["y1"] - r["y0"]
    scan = F.max(share).over(Window.partitionBy(*PAGE)) >= 0.8
    repeats = repeated_digests(images).withColumn("repeated", F.lit(True))
    kind = (
        F.when(scan | (F.least(w, h) < 0.2 * cm) | (share > 0.3), None)
        .when((h < 1.4 * cm) & (w >= 1.4 * h) & (share < 0.02), "SIGNATURE")
        .when(F.coalesce("repeated", F.lit(False)), "LOGO")
        .otherwise("keep")
    )
    return images.join(repeats, ["doc_id", "digest"], "left").withColumn("kind", kind).drop("repeated")


def repeated_graphics(graphics: DataFrame, least: float = 0.6) -> DataFrame:
    """doc_id, id of graphics that recur on another page: centres within 4 % of the page, sizes within 25 %, thumbs alike.

    graphics: doc_id, id, page, cx, cy, w, h (as page shares), thumb. Pairs only within a document, and only in
    neighbouring cells of a 4 % grid, which every pair within the shift shares.
    """
    g = graphics.withColumns({"gx": F.floor(F.col("cx") / 0.04), "gy": F.floor(F.col("cy") / 0.04)})
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    a = g.select("*", near.alias("n")).withColumns({"gx": F.col("gx") + F.col("n.i"), "gy": F.col("gy") + F.col("n.j")}).drop("n")
    b = g.select("doc_id", "gx", "gy", *[F.col(c).alias("o_" + c) for c in ("id", "page", "cx", "cy", "w", "h", "thumb")])
    pairs = a.join(b, ["doc_id", "gx", "gy"]).where("page <> o_page AND abs(cx - o_cx) <= 0.04 AND abs(cy - o_cy) <= 0.04")
    ratio = lambda x: (F.col(x) / F.col("o_" + x)).between(0.8, 1.25)
    dot = F.aggregate(F.zip_with("thumb", "o_thumb", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x) / F.size("thumb")
    return pairs.where(ratio("w") & ratio("h") & (dot >= least)).select("doc_id", "id").distinct()


#: Values of the vectors of a block; what a task holds are two blocks. Rows and columns of the products that it holds at once.
BLOCK, ROWS, COLUMNS = 1 << 22, 512, 2048


def _by_size(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(size, ids, matrix of doubles) of the vectors of each size; those that are null or hold a null are none."""
    sizes = pc.list_value_length(vectors)
    for size in pc.unique(sizes.drop_null()).to_pylist():
        own = pc.fill_null(pc.equal(sizes, size), False)
        some, flat = ids.filter(own), vectors.filter(own).flatten()
        matrix = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(some), size)
        if flat.null_count:
            whole = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(len(some), size).any(axis=1)
            some, matrix = some.filter(pa.array(whole)), matrix[whole]
        yield size, some, matrix


def _close(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and of b whose dot product, summed from the first place on, is `least` or more. A matrix product sums in another order, so what it puts
    within its rounding error of `least` is summed again, as is what belongs to a vector without a finite length."""
    dots, x, y = a @ b.T, np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    error = lambda x, y: 1e-15 * (a.shape[1] + 1) * (x * y + abs(least))
    most = lambda n: n.max(initial=0.0, where=np.isfinite(n))
    maybe = ~(dots < least - error(most(x), most(y)))  # what is not a number counts as greater, as in SQL
    maybe[~np.isfinite(x)] = True
    maybe[:, ~np.isfinite(y)] = True
    i, j = np.divmod(np.flatnonzero(maybe), max(1, len(b)))
    exact = dots[i, j]
    near = np.flatnonzero(~(exact > least + error(x[i], y[j])))
    again = np.zeros(len(near))
    for k in range(a.shape[1]):
        again += a[i[near], k] * b[j[near], k]
    exact[near] = again
    ok = ~(exact < least)
    return i[ok], j[ok]


def _pairs(a: tuple[pa.Array, np.ndarray], b: tuple[pa.Array, np.ndarray] | None, least: float) -> Iterator[pa.RecordBatch]:
    """Pairs of a row of a and one of b, or of two rows of a where b is None, in both orders."""
    (ids, left), (others, right) = a, b or a
    for r in range(0, len(left), ROWS):
        for c in range(r if b is None else 0, len(right), COLUMNS):
            i, j = _close(left[r : r + ROWS], right[c : c + COLUMNS], least)
            i, j = i + r, j + c
            if b is None:  # products of the same rows are met once
                i, j = i[i < j], j[i < j]
            q, v = ids.take(pa.array(i)), others.take(pa.array(j))
            other = pc.not_equal(q, v)
            q, v = q.filter(other), v.filter(other)
            for columns in ([q, v], [v, q]):
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id"])


def _blocks_meet(least: float):
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [b for b in batches if b.num_rows]
        rows = pa.Table.from_batches(whole) if whole else None
        for p in pc.unique(rows["pair"]).to_pylist() if whole else []:
            own = rows.filter(pc.equal(rows["pair"], p))
            sides = {}
            for side in pc.unique(own["side"]).to_pylist():
                part = own.filter(pc.equal(own["side"], side))
                sides[side] = {size: (ids, matrix) for size, ids, matrix in _by_size(*(part[c].combine_chunks() for c in ("vec_id", "embedding")))}
            for size, a in sides.get("both", {}).items():
                yield from _pairs(a, None, least)
            for size, a in sides.get("low", {}).items():
                if size in sides.get("high", {}):
                    yield from _pairs(a, sides["high"][size], least)

    return meet


def similar_pairs(vectors: DataFrame, least: float) -> DataFrame:
    """Pairs (query_id, vec_id) of vectors whose dot product is at least `least`, in both orders; a vector is not its own partner.

    All pairs are compared, each once: rows are dealt to blocks by a hash, and each pair of blocks is a task that multiplies them as matrices. A task holds two
    blocks, of a counted size; each row is sent to as many tasks as there are blocks. The work grows with the square of the rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    own = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", "embedding")
    n, values = own.agg(F.count("*"), F.coalesce(F.sum(F.size("embedding").cast("long")), F.lit(0))).first()
    busy = math.isqrt(6 * spark.sparkContext.defaultParallelism) + 1  # blocks whose pairs are three tasks a core
    blocks = max(-(-values // BLOCK), min(busy, -(-n // ROWS)), 1)
    b, k = F.col("b"), F.col("k")
    met = own.withColumn("b", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    low, high = F.least(b, k).cast("long"), F.greatest(b, k).cast("long")
    pair = (F.call_function("div", high * (high + 1), F.lit(2)) + low).cast("int")
    side = F.when(b == k, "both").when(b < k, "low").otherwise("high")
    dealt = met.select("vec_id", "embedding", pair.alias("pair"), side.alias("side")).repartitionById(blocks * (blocks + 1) // 2, "pair")
    kind = own.schema["vec_id"].dataType.simpleString()
    return dealt.mapInArrow(_blocks_meet(least), f"query_id {kind}, vec_id {kind}")


def rect_key(r: Column, digits: int = 4) -> Column:
    return F.concat_ws(",", *[F.round(r[k], digits).cast("string") for k in KEYS])
