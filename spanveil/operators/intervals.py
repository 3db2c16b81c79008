"""Overlap join of intervals, and as-of neighbours, without comparing all rows of a key.

An interval's level is the power of two of the bin width that its length fits in, so it covers two bins of its level at most. Two intervals meet on
the higher of their levels: every interval is placed in the bins of its own level and of each higher one that occurs, two a level. Of the bins that a
pair shares, the one in which the later of the two begins reports it. Bins of many rows are split: one side's rows are dealt out, the other's copied to each share.

Neighbours along an order are looked for inside slices of it; what a slice doesn't hold comes from the first row of the next slice that has one, by a
window over one row a slice. So a key of any size is spread over its slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.session import keep

#: Rows of a bin's side that one share holds.
SHARE = 2_000


def _placed(rows: DataFrame, levels: list[int], width: float) -> DataFrame:
    """One row for each level from the interval's own on, and for each of its two bins there."""
    here = F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x >= F.col("__level"))
    by_level = rows.select("*", F.explode(here).alias("__at"))
    bin_of = lambda x: F.floor(x / (F.lit(float(width)) * F.pow(F.lit(2.0), F.col("__at")))).cast("long")
    first, last = bin_of(F.col("__lo")), bin_of(F.col("__hi"))
    return by_level.withColumn("__first", first).withColumn("__bin", F.explode(F.sequence(F.col("__first"), last)))


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], width: float | None = None, share: int = SHARE, closed: bool = False) -> DataFrame:
    """Pairs of rows of a and b with equal keys whose intervals [lo, hi) overlap, each once: keys, then `a` and `b` as structs of all columns.

    lo and hi are numbers, lo <= hi; with `closed` intervals that only touch, and empty ones inside others, count as well. Rows with a null key, lo or hi meet nothing. `width`: the narrowest
    bin, by default the mean length.
    """
    names = lambda df: F.struct(*[F.col(c) for c in df.columns])
    shape = lambda df, side: df.select(*keys, names(df).alias(side), F.col("lo").cast("double").alias("__lo"), F.col("hi").cast("double").alias("__hi")).where("__lo IS NOT NULL AND __hi IS NOT NULL AND __lo <= __hi")
    left, right = shape(a, "a"), shape(b, "b")
    if width is None:
        mean = left.select("__lo", "__hi").unionByName(right.select("__lo", "__hi")).agg(F.avg(F.col("__hi") - F.col("__lo"))).first()[0]
        width = mean or 1.0
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("__hi") - F.col("__lo"), F.lit(width)) / F.lit(float(width))))).cast("int")
    left, right = left.withColumn("__level", level), right.withColumn("__level", level)
    levels = sorted(r[0] for r in left.select("__level").unionByName(right.select("__level")).distinct().collect())  # at most some sixty
    where = [*keys, "__at", "__bin"]
    left, right = _placed(left, levels, width), _placed(right, levels, width)
    crowded = left.groupBy(*where).count().where(F.col("count") > share).select(*where, F.ceil(F.col("count") / share).cast("int").alias("__shares"))
    crowded = keep(crowded, "crowded")
    if crowded.isEmpty():
        left, right = left.withColumn("__share", F.lit(0)), right.withColumn("__share", F.lit(0))
    else:
        one = F.coalesce("__shares", F.lit(1))
        left = left.join(crowded, where, "left").withColumn("__share", F.pmod(F.xxhash64("a"), one).cast("int")).drop("__shares")
        right = right.join(crowded, where, "left").withColumn("__share", F.explode(F.sequence(F.lit(0), one - 1))).drop("__shares")
    rename = lambda df, p: df.withColumnsRenamed({c: p + c for c in ("__lo", "__hi", "__level", "__first")})
    met = rename(left, "l").join(rename(right, "r"), [*where, "__share"])
    touch = (F.col("l__lo") <= F.col("r__hi")) & (F.col("r__lo") <= F.col("l__hi")) if closed else (F.col("l__lo") < F.col("r__hi")) & (F.col("r__lo") < F.col("l__hi"))
    own = F.col("__at") == F.greatest("l__level", "r__level")
    once = F.col("__bin") == F.greatest("l__first", "r__first")
    return met.where(own & once & touch).select(*keys, "a", "b")


def _slice(at: Column, width: float) -> Column:
    return F.floor(at / F.lit(float(width))).cast("long")


def next_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, width: float) -> DataFrame:
    """left with `found`: `value` (a struct or plain column) of the first row of right with equal keys and a greater `at`; null where there is none.

    Union and one sorted window a slice of `width`, no pairs. Of right rows with equal `at` the one with the least value counts.
    """
    carry = F.lit(None).cast(right.schema[value].dataType)
    rows = left.select(*keys, F.col(at).alias("__at"), F.struct(*left.columns).alias("__row"), carry.alias("__value"), F.lit(1).alias("__side"))
    others = right.select(*keys, F.col(at).alias("__at"), F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"), F.col(value).alias("__value"), F.lit(0).alias("__side"))
    both = rows.unionByName(others).withColumn("__slice", _slice(F.col("__at"), width))
    # Equal places: right rows first, so that only later ones follow a left row.
    ahead = Window.partitionBy(*keys, "__slice").orderBy("__at", "__side", "__value").rowsBetween(1, Window.unboundedFollowing)
    near = both.withColumn("__near", F.first(F.when(F.col("__side") == 0, F.struct(F.col("__value"))), ignorenulls=True).over(ahead)).where("__side = 1")
    heads = others.withColumn("__slice", _slice(F.col("__at"), width)).groupBy(*keys, "__slice").agg(F.min(F.struct("__at", "__value")).alias("__head"))
    spots = both.select(*keys, "__slice").distinct().join(heads, [*keys, "__slice"], "left")
    later = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(1, Window.unboundedFollowing)
    beyond = spots.select(*keys, "__slice", F.first("__head", ignorenulls=True).over(later).alias("__beyond"))
    whole = near.join(beyond, [*keys, "__slice"], "left")
    return whole.select("__row.*", F.coalesce(F.col("__near.__value"), F.col("__beyond.__value")).alias("found"))


def run_starts(df: DataFrame, keys: list[str], at: str, kind: str, width: float) -> DataFrame:
    """The rows of df whose `kind` differs from that of the row before it by (at, kind) with equal keys; a key's first row is one."""
    sliced = df.withColumn("__slice", _slice(F.col(at), width))
    by = Window.partitionBy(*keys, "__slice").orderBy(at, kind)
    marked = sliced.withColumn("__before", F.lag(F.struct(kind)).over(by))
    tails = sliced.groupBy(*keys, "__slice").agg(F.max(F.struct(at, kind)).alias("__tail"))
    earlier = Window.partitionBy(*keys).orderBy("__slice")
    carried = tails.select(*keys, "__slice", F.lag("__tail").over(earlier).alias("__carried"))
    whole = marked.join(carried, [*keys, "__slice"])
    before = F.coalesce(F.col("__before")[kind], F.col("__carried")[kind])
    first = F.col("__before").isNull() & F.col("__carried").isNull()
    return whole.where(first | ~before.eqNullSafe(F.col(kind))).drop("__slice", "__before", "__carried")


def right_neighbours(labels: DataFrame, lines: DataFrame, height: str = "h") -> DataFrame:
    """labels with `found`, the ordinal of the line right beside each: labels (doc_id, page, line, x1, y0, y1, h), lines (doc_id, page, line, x0, y0, y1).

    A line is beside a label if it starts between half a height before its end and ten heights behind it and its middle is on the label's row, three tenths
    of a height aside; the leftmost counts. An interval meets a point: the label's reach against the line's start.
    """
    h = F.greatest(F.col(height), F.lit(1.0))
    a = labels.select("*", (F.col("x1") - 0.5 * h).alias("lo"), (F.col("x1") + 10 * h).alias("hi"), h.alias("__h"))
    b = lines.select("*", F.col("x0").alias("lo"), F.col("x0").alias("hi"))
    met = overlap_join(a, b, ["doc_id", "page"], closed=True)
    middle = (F.col("b.y0") + F.col("b.y1")) / 2
    row = (middle >= F.col("a.y0") - 0.3 * F.col("a.__h")) & (middle <= F.col("a.y1") + 0.3 * F.col("a.__h")) & (F.col("a.line") != F.col("b.line"))
    best = met.where(row).groupBy("doc_id", "page", F.col("a.line").alias("line")).agg(F.min(F.struct(F.col("b.x0"), F.col("b.line"))).alias("best"))
    return labels.join(best, ["doc_id", "page", "line"], "left").withColumn("found", F.col("best.line")).drop("best")
