"""Rectangles (struct<x0, y0, x1, y1>) and points as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEYS = ("x0", "y0", "x1", "y1")


def rect(*values) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(k) for k, v in zip(KEYS, values)])


def area(r: Column) -> Column:
    return F.greatest(r["x1"] - r["x0"], F.lit(0.0)) * F.greatest(r["y1"] - r["y0"], F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    """Shared area."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for empty rectangles."""
    i = intersection(a, b)
    return F.coalesce(F.try_divide(i, area(a) + area(b) - i), F.lit(0.0))


def overlapping(a: Column, b: Column) -> Column:
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def centre_in(c: Column, r: Column) -> Column:
    x, y = (c["x0"] + c["x1"]) / 2, (c["y0"] + c["y1"]) / 2
    return (x >= r["x0"]) & (x <= r["x1"]) & (y >= r["y0"]) & (y <= r["y1"])


def unrotate(r: Column, rotation: Column, w: Column, h: Column) -> Column:
    """A rectangle found on a page turned by 90, 180 or 270 degrees, in coordinates of the w x h original."""
    corners = [(r[x], r[y]) for x in ("x0", "x1") for y in ("y0", "y1")]
    xs = lambda f: [f(x, y) for x, y in corners]

    def turned(fx, fy) -> Column:
        a, b = xs(fx), xs(fy)
        return rect(F.least(*a), F.least(*b), F.greatest(*a), F.greatest(*b))

    return (
        F.when(rotation == 90, turned(lambda x, y: y, lambda x, y: h - 1 - x))
        .when(rotation == 180, turned(lambda x, y: w - 1 - x, lambda x, y: h - 1 - y))
        .when(rotation == 270, turned(lambda x, y: w - 1 - y, lambda x, y: x))
        .otherwise(rect(*[r[k] for k in KEYS]))
    )


def normalised(r: Column, w: Column, h: Column, digits: int = 4) -> Column:
    """Clamped to the page and divided by its size."""
    clamp = lambda v, top: F.round(F.least(F.greatest(v, F.lit(0.0)), top) / top, digits)
    return rect(clamp(r["x0"], w), clamp(r["y0"], h), clamp(r["x1"], w), clamp(r["y1"], h))


def padded(r: Column, w: Column, h: Column, share: float = 0.08, least: float = 4.0) -> Column:
    """Grown by a share of its own size, at least `least` pixels, and clipped to the page."""
    px = F.greatest((r["x1"] - r["x0"]) * share, F.lit(least))
    py = F.greatest((r["y1"] - r["y0"]) * share, F.lit(least))
    return rect(F.greatest(r["x0"] - px, F.lit(0.0)), F.greatest(r["y0"] - py, F.lit(0.0)), F.least(r["x1"] + px, w), F.least(r["y1"] + py, h))


def plausible_code(r: Column, dpi: Column) -> Column:
    """Sides of 0.6 to 6 cm, nearly square."""
    w, h = r["x1"] - r["x0"], r["y1"] - r["y0"]
    cm = dpi / 2.54
    return w.between(cm * 0.6, cm * 6) & h.between(cm * 0.6, cm * 6) & F.coalesce(F.try_divide(w, h), F.lit(0.0)).between(0.75, 1.33)


def beside(name: Column, r: Column) -> Column:
    """r stands in the height band of a name and near it sideways; heights are the name's."""
    h = name["y1"] - name["y0"]
    mid = (r["y0"] + r["y1"]) / 2
    gap = F.greatest(name["x0"] - r["x1"], r["x0"] - name["x1"])
    w = r["x1"] - r["x0"]
    return mid.between(name["y0"] - h * 0.3, name["y1"] + h * 0.3) & gap.between(-0.1 * w, 1.5 * w)


def points(px: Column, dpi: Column) -> Column:
    """Pixels to points; a resolution outside [36, 2400] counts as 200."""
    return px * 72.0 / F.when(dpi.between(36, 2400), dpi).otherwise(F.lit(200.0))


def token_boxes(token: Column, r: Column) -> Column:
    """A token's box divided evenly among its characters: array<struct<ch, x0, y0, x1, y1>>, blanks dropped."""
    n = F.length(token)
    w = (r["x1"] - r["x0"]) / n
    chars = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(F.substring(token, i + 1, F.lit(1)).alias("ch"), (r["x0"] + w * i).alias("x0"), r["y0"].alias("y0"), (r["x0"] + w * (i + 1)).alias("x1"), r["y1"].alias("y1")),
    )
    return F.filter(chars, lambda c: F.trim(c["ch"]) != "")
