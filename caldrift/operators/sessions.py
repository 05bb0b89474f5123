"""Sessions whose anchor doesn't slide, for keys of any number of times: anchors by jump pointers over stretches that double.

A session begins at its anchor and holds the times up to the tolerance after it; the next anchor is the first later time. So each time has a
pointer: the first time more than the tolerance after it. A time with no other within the tolerance before it is an anchor whatever came
earlier (a head), and the anchors are what the heads' pointers reach before the next head.

Time is cut into stretches. In stretches no longer than the tolerance, at most one anchor stands, so a pointer always leaves its stretch. From level to level stretches
double: a pointer that ends in the second half of the doubled stretch goes on by that half's own pointer. Only heads and times that some
pointer enters a stretch at can be the first anchor of one, so about half of the pointers are left at each level, and all levels together
handle about twice the times once. On the way back each stretch's first anchor marks the one where its pointer enters the second
half. Rounds are the logarithm of the longest dense run over the tolerance; where no run is longer than the tolerance there are none. No array
of times is made, no key is one task, and every table between rounds is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caldrift.functions.scratch import Scratch

from .grid import STRETCH, as_of


def _pointers(times: DataFrame, keys: list[str], tolerance_us: int) -> DataFrame:
    """(keys, x, next, head): each time's first one more than the tolerance later, and whether none is within the tolerance before it."""
    shift = tolerance_us + 1
    later = as_of(times.select(*keys, (F.col("x") + shift).alias("t"), "x"), times.select(*keys, F.col("x").alias("t"), F.lit(1).alias("one")), keys, ["one"], "next", forward=True, crowded=True)
    both = as_of(later.select(*keys, (F.col("x") - 1).alias("t"), "x", F.col("next_t").alias("next")), times.select(*keys, F.col("x").alias("t"), F.lit(1).alias("one")), keys, ["one"], "last", crowded=True)
    return both.select(*keys, "x", "next", F.coalesce(F.col("x") - F.col("last_t") > tolerance_us, F.lit(True)).alias("head"))


def anchors(times: DataFrame, keys: list[str], time: str, tolerance_us: int, scratch: Scratch) -> DataFrame:
    """(keys, anchor): where sessions begin, of the distinct times of each key; rows with a null key or time are left out."""
    known = " AND ".join(f"{c} IS NOT NULL" for c in [*keys, time])
    distinct = scratch.write(times.where(known).select(*keys, F.col(time).alias("x")).distinct(), "times")
    pointers = scratch.write(_pointers(distinct, keys, tolerance_us), "pointers")
    heads = pointers.where("head").select(*keys, "x")
    of_heads = heads.withColumnRenamed("x", "next")
    # a pointer at a head isn't needed: heads are marked anyway
    level = scratch.write(pointers.where("next IS NOT NULL").join(of_heads, [*keys, "next"], "left_anti").select(*keys, "x", "next", "head"), "level-0")
    least = pointers.agg(F.min("x").alias("x")).first().x
    levels, width = [], tolerance_us + 1
    while not level.isEmpty():
        width *= 2
        stretch = lambda c, of=width: F.expr(f"({c} - {least}L) div {of}L")
        crossing = level.where(stretch("x") != stretch("next"))
        entered = crossing.select(*keys, F.col("next").alias("x"), F.lit(True).alias("entered")).distinct()
        levels.append((level, stretch))
        first = level.join(entered, [*keys, "x"], "left").where("head OR entered").drop("entered")
        on = level.select(*keys, F.col("x").alias("next"), F.col("next").alias("after"))
        gone_on = first.join(on, [*keys, "next"], "left").select(*keys, "x", F.when(stretch("x") != stretch("next"), F.col("next")).otherwise(F.col("after")).alias("next"), "head")
        level = scratch.write(gone_on.where("next IS NOT NULL"), f"level-{len(levels)}")
    marked = heads
    for pointed, stretch in reversed(levels):
        halves = pointed.where(stretch("x") == stretch("next")).select(*keys, "x", "next")
        marked = marked.join(halves, [*keys, "x"], "left").select(*keys, F.explode(F.array_compact(F.array("x", "next"))).alias("x"))
    return marked.withColumnRenamed("x", "anchor")


def numbered(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, anchor, number): the anchors of each key in order from 0, counted in stretches of time and on from the stretches before."""
    dealt = found.withColumn("stretch", F.expr(f"anchor div {STRETCH}L"))
    counts = dealt.groupBy(*keys, "stretch").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*keys, "stretch", before.alias("before"))
    place = F.row_number().over(Window.partitionBy(*keys, "stretch").orderBy("anchor"))
    return dealt.withColumn("place", place).join(starts, [*keys, "stretch"]).select(*keys, "anchor", (F.col("before") + F.col("place") - 1).cast("int").alias("number"))


def dense(df: DataFrame, keys: list[str], time: str, tolerance_us: int) -> DataFrame:
    """``df`` with ``anchor`` and ``number`` of each row's session, for few keys with many times each."""
    scratch = Scratch(df.sparkSession)
    found = scratch.write(numbered(anchors(df, keys, time, tolerance_us, scratch), keys), "anchors")
    right = found.select(*keys, F.col("anchor").alias(time), "number")
    return as_of(df, right, keys, ["number"], "session", time=time, crowded=True).withColumnsRenamed({"session_t": "anchor", "session_number": "number"})
