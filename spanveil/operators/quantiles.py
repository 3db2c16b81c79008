"""Quantiles per group: exact by counting, and by mergeable sketches with a stated error.

The exact form counts equal values first, with partial aggregation, and walks along a group's distinct values in a window: no group's values are ever
a list. A group of very many distinct values is walked in blocks: a window over the blocks' sums tells what comes before each.

The sketch is a KLL sketch, a few kilobytes whatever the group: the rank of what it returns is off by ERROR of the group's size at most, with 99 % probability,
and it is exact for groups smaller than its parameter K. Sketches may be kept and merged over other groupings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parameter of the sketch, and the rank error that follows from it.
K, ERROR = 400, 0.0068


def exact(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], blocks: int = 64) -> DataFrame:
    """keys, n, and one column a share: the element at place floor(share * n) (from 0, the last one at most) of the group's sorted values. Nulls don't count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    ends = counts.groupBy(*keys).agg(F.sum("__c").alias("n"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    spread = (F.col("__high") - F.col("__low")).cast("double")
    block = F.when(spread > 0, F.least(F.lit(blocks - 1), F.floor((F.col("__v") - F.col("__low")) / spread * blocks))).otherwise(0).cast("int")
    placed = (counts.join(ends, keys) if keys else counts.crossJoin(F.broadcast(ends))).withColumn("__b", block)  # without keys `ends` is one row
    sums = placed.groupBy(*keys, "__b").agg(F.sum("__c").alias("__s"))
    earlier = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*keys, "__b", F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*keys, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    walked = placed.join(before, [*keys, "__b"]).withColumn("__upto", F.col("__before") + F.sum("__c").over(inside))

    def pick(share: float) -> Column:
        place = F.least(F.floor(F.lit(float(share)) * F.col("n")), F.col("n") - 1)
        return F.min(F.when(F.col("__upto") > place, F.col("__v")))

    return walked.groupBy(*keys).agg(F.max("n").alias("n"), *[pick(p).alias(name) for name, p in shares.items()])


def sketches(df: DataFrame, keys: list[str], value: str, k: int = K) -> DataFrame:
    """keys, sketch: to be kept, merged by `merged` and read by `quantile`."""
    return df.groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"))


def merged(parts: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    return parts.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"))


def quantile(sketch: Column, share: float) -> Column:
    """The sketch's element at that share of the ranks."""
    return F.kll_sketch_get_quantile_double(sketch, F.lit(float(share)))
