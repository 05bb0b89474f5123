"""Order statistics of groups of any size: ranks, quantiles and running minima by a prefix scan in two levels.

A group's distinct values, with how often each stands, are dealt into buckets of about half a hundredth of their size. Within a bucket
a window counts on; across a group's buckets, of which there are at most as many as doubles have such steps, a second window
counts the buckets' totals. So no buffer holds a group, a group that has a third of all rows is many tasks' work, and a value
that is repeated a third of all times is one row after the map side.

A group's key is one struct, so null keys are equal. Null and NaN values take no part.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets for each doubling of a value's size.
PER_OCTAVE = 128


def bucket(x: Column) -> Column:
    """A whole number that grows with a double: its sign and the floor of its logarithm in steps of 2 ** (1 / PER_OCTAVE)."""
    size = F.abs(x)
    step = F.when(size == float("inf"), F.lit(1 << 40)).otherwise(F.floor(F.log2(F.when((size > 0) & (size < float("inf")), size)) * PER_OCTAVE) + 1100 * PER_OCTAVE)
    return F.when(x > 0, step).when(x < 0, -step).otherwise(F.lit(0)).cast("long")


def group(keys: list[str]) -> Column:
    return F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))


def _counted(df: DataFrame, keys: list[str], value: str | Column, n: str | None = None) -> DataFrame:
    """(g, value, n): the distinct values of each group and how often each stands."""
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = df.select(group(keys).alias("g"), x.alias("value"), (F.col(n) if n else F.lit(1)).cast("long").alias("n")).where("value IS NOT NULL AND NOT isnan(value)")
    return rows.groupBy("g", "value").agg(F.sum("n").alias("n"))


def _scanned(counted: DataFrame, *more: str) -> DataFrame:
    """(g, bucket, value, n, before, total and ``more``): with the rows of the group that are smaller, and all of them."""
    dealt = counted.withColumn("bucket", bucket(F.col("value")))
    over = Window.partitionBy("g").orderBy("bucket")
    sums = dealt.groupBy("g", "bucket").agg(F.sum("n").alias("m"))
    starts = sums.select("g", "bucket", F.coalesce(F.sum("m").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"), F.sum("m").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("g", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("inside", inside).join(starts, ["g", "bucket"]).select("g", "bucket", "value", "n", (F.col("inside") + F.col("earlier")).alias("before"), "total", *more)


def cumulative(df: DataFrame, keys: list[str], value: str | Column, n: str | None = None) -> DataFrame:
    """(g, bucket, value, n, before, total) of the distinct values; ``g`` is the struct of ``keys``, ``n`` a column of how often a row's value stands."""
    return _scanned(_counted(df, keys, value, n))


def at_quantiles(qs: Mapping[str, float]) -> tuple[list[Column], list[Column]]:
    """Aggregates over ``cumulative`` that pick the two order statistics of each quantile, and then the interpolated quantiles."""
    picks, values = [], []
    for name, q in qs.items():
        at = (F.col("total") - 1) * F.lit(float(q))
        for end, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks.append(F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("n")), F.col("value"))).alias(f"{name}_{end}"))
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        values.append(F.when(lo == hi, lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi).alias(name))
    return picks, values


def quantiles(df: DataFrame, keys: list[str], value: str | Column, qs: Mapping[str, float]) -> DataFrame:
    """(keys, n, one column a quantile): exact, with linear interpolation between order statistics."""
    picks, values = at_quantiles(qs)
    return cumulative(df, keys, value).groupBy("g").agg(F.max("total").alias("total"), *picks).select(*[F.col(f"g.{k}").alias(k) for k in keys], F.col("total").alias("n"), *values)


def spread(scanned: DataFrame, middles: DataFrame, middle: str, mean: str) -> DataFrame:
    """``middles`` (g and more, a row a group) with ``mad`` and ``squares``: the median distance to its ``middle`` and summed squares around its ``mean``."""
    own = [c for c in middles.columns if c != "g"]
    apart = scanned.select("g", "value", "n").join(middles.select("g", F.struct(*own).alias("own")), "g")
    far = apart.groupBy("g", F.abs(F.col("value") - F.col(f"own.{middle}")).alias("value")).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("value") - F.col(f"own.{mean}"), 2)).alias("squares"), F.first("own").alias("own"))
    picks, values = at_quantiles({"mad": 0.5})
    return _scanned(far, "squares", "own").groupBy("g").agg(F.max("total").alias("total"), F.sum("squares").alias("squares"), F.first("own").alias("own"), *picks).select("g", "own.*", *values, "squares")


def weighted_by_rank() -> Column:
    """Aggregate over ``cumulative``: sum of (2 i - n - 1) x over the group's values in order, i from 1; twice the sum over pairs of their distance is of it."""
    return F.sum((2 * F.col("before") + F.col("n") - F.col("total")) * F.col("n") * F.col("value"))


def average_ranks(scanned: DataFrame) -> DataFrame:
    """(g, value, rank): equal values share the mean of their ranks, from 1."""
    return scanned.select("g", "value", (F.col("before") + (F.col("n") + 1) / F.lit(2.0)).alias("rank"))


def adjusted(scanned: DataFrame) -> DataFrame:
    """(g, value, adjusted): the running minimum, from the largest value on, of value * total / rank, in [0, 1]."""
    down = Window.partitionBy("g", "bucket").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0)
    raw = scanned.withColumn("raw", F.col("value") * F.col("total") / (F.col("before") + F.col("n")))
    least = raw.groupBy("g", "bucket").agg(F.min("raw").alias("m"))
    later = least.select("g", "bucket", F.min("m").over(Window.partitionBy("g").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)).alias("later"))
    q = F.least(F.min("raw").over(down), F.col("later"))
    return raw.join(later, ["g", "bucket"]).select("g", "value", F.least(F.lit(1.0), F.greatest(F.lit(0.0), q)).alias("adjusted"))
