"""Evaluation grids, as-of joins and window loads: unions of both sides under one range frame, no interval join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caldrift.functions.expr import HOUR, MINUTE
from caldrift.functions.scratch import Scratch


#: Time of one key that a task takes at once.
STRETCH = 7 * 24 * HOUR


def make_grid(coverage: DataFrame, grid_minutes: int = 60) -> DataFrame:
    """(backend, t): every grid time within a backend's study; none where the study ends before it starts."""
    if grid_minutes <= 0:
        raise ValueError("grid_minutes must be positive")
    step = grid_minutes * MINUTE
    lo, hi = F.expr(f"(study_start + {step - 1}) div {step}"), F.expr(f"study_end div {step}")
    return (
        coverage.select("backend", lo.alias("lo"), hi.alias("hi"))
        .where("hi >= lo")
        .select("backend", F.explode(F.sequence("lo", "hi")).alias("k"))
        .select("backend", (F.col("k") * step).alias("t"))
    )


def slot(time: str, grid_minutes: int) -> Column:
    """The grid time whose interval (t - step, t] holds a time."""
    step = grid_minutes * MINUTE
    return F.expr(f"(({time} + {step - 1}) div {step}) * {step}")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], prefix: str, forward: bool = False, time: str = "t", crowded: bool = False) -> DataFrame:
    """``left`` with the values and the time of the last row of ``right`` at or before its time (or the first at or after).

    Both sides lie in one window per key, so a left row needs no join; rows of ``right`` at the same time are decided by the
    largest values. Where a few keys hold all rows (``crowded``: devices, not components) a task has a stretch of a key's time, and what
    lies before it is carried in from the stretches' ends; rows without a key or a time are then left out.
    """
    names = [c for c in left.columns if c not in keys and c != time]
    picked = F.struct(F.col(time).alias("at"), *values)
    one = right.groupBy(*keys, time).agg(F.max(F.struct(*values)).alias("v")).select(*keys, time, *[F.col(f"v.{v}").alias(v) for v in values])
    both = left.select(*keys, time, F.lit(True).alias("is_left"), F.struct(*names).alias("l") if names else F.lit(None).alias("l"), F.lit(None).cast(one.select(picked.alias("p")).schema["p"].dataType).alias("r"))
    other = one.select(*keys, time, F.lit(False).alias("is_left"), F.lit(None).cast(both.schema["l"].dataType).alias("l"), picked.alias("r"))
    shown = lambda df: df.select(*keys, time, *[F.col(f"l.{c}").alias(c) for c in names], F.col("m.at").alias(f"{prefix}_t"), *[F.col(f"m.{v}").alias(f"{prefix}_{v}") for v in values])
    # a frame up to the current row is read once, one from the current row on would be read anew for each row
    seen = lambda *of: Window.partitionBy(*of).orderBy(F.desc(time) if forward else F.col(time)).rangeBetween(Window.unboundedPreceding, 0)
    if not crowded:
        return shown(both.unionByName(other).withColumn("m", F.last("r", ignorenulls=True).over(seen(*keys))).where("is_left"))
    rows = both.unionByName(other).withColumn("stretch", F.expr(f"{time} div {STRETCH}"))
    over = Window.partitionBy(*keys).orderBy(F.desc("stretch") if forward else F.col("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.last("r", ignorenulls=True).over(seen(*keys, "stretch"))
    ends = rows.groupBy(*keys, "stretch").agg((F.min if forward else F.max)("r").alias("end"))
    carried = ends.select(*keys, "stretch", F.last("end", ignorenulls=True).over(over).alias("carried"))
    return shown(rows.withColumn("own", inside).where("is_left").join(carried, [*keys, "stretch"]).withColumn("m", F.coalesce("own", "carried")))


def nearest(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` with the nearest time of ``right`` by key, the earlier one at a tie, and the distance in minutes."""
    stamped = right.select(*keys, "t", F.lit(1).alias("one"))
    back = as_of(left, stamped, keys, ["one"], "anchor_before", crowded=True).drop("anchor_before_one")
    both = as_of(back, stamped, keys, ["one"], "anchor_after", forward=True, crowded=True).drop("anchor_after_one")
    before, after = F.col("t") - F.col("anchor_before_t"), F.col("anchor_after_t") - F.col("t")
    anchor = F.when(F.col("anchor_after_t").isNull() | (before <= after), F.col("anchor_before_t")).otherwise(F.col("anchor_after_t"))
    return (
        both.withColumn("nearest_t", anchor)
        .withColumn("signed_minutes", (F.col("t") - F.col("nearest_t")) / F.lit(float(MINUTE)))
        .withColumn("absolute_minutes", F.abs((F.col("t") - F.col("nearest_t")) / F.lit(float(MINUTE))))
    )


def device_load(targets: DataFrame, status: DataFrame, windows: list[int], max_staleness_minutes: int = 120) -> DataFrame:
    """``targets`` (backend, t, ...) with the load at t and the mean, maximum, deviation and count over [t - w, t).

    The value at t goes when it is older than the staleness, its time and age stay.
    """
    load = status.where(F.col("pending_jobs").isNotNull())
    at = as_of(targets, load, ["backend"], ["pending_jobs"], "current", crowded=True)
    age = (F.col("t") - F.col("current_t")) / F.lit(float(MINUTE))
    at = at.withColumn("current_age_minutes", age).withColumn("load_current", F.when(age <= max_staleness_minutes, F.col("current_pending_jobs").cast("double"))).drop("current_pending_jobs")
    for h in windows:
        at = at.join(_trailing(targets, load, h), ["backend", "t"])
    return at


def _trailing(targets: DataFrame, load: DataFrame, hours: int) -> DataFrame:
    """The load over [t - hours, t) for each backend and time of ``targets``: mean, maximum, deviation and count.

    A device's time is cut into blocks as long as the window, so a window is the end of one block and the start of the next: two running aggregates, one
    back from a block's end, read at t - hours, and one on from a block's start, read at t. Work doesn't grow with the rows in a window.
    """
    length = hours * HOUR
    asked = targets.where("backend IS NOT NULL AND t IS NOT NULL").select("backend", "t").distinct()
    mark = lambda at, tail: F.struct(at.alias("at"), F.lit(tail).alias("tail"), F.col("t").alias("of"))
    marks = asked.select("backend", F.explode(F.array(mark(F.col("t") - length, True), mark(F.col("t"), False))).alias("m")).select("backend", "m.*", F.lit(None).cast("double").alias("x"))
    seen = load.select("backend", F.col("t").alias("at"), F.lit(None).cast("boolean").alias("tail"), F.lit(None).cast("long").alias("of"), F.col("pending_jobs").cast("double").alias("x"))
    rows = marks.unionByName(seen).withColumn("block", F.expr(f"(at - pmod(at, {length}L)) div {length}L"))
    w = Window.partitionBy("backend", "block")
    head, tail = w.orderBy("at").rangeBetween(Window.unboundedPreceding, -1), w.orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, 0)
    part = lambda over: F.struct(F.count("x").over(over).alias("n"), F.sum("x").over(over).alias("total"), F.max("x").over(over).alias("most"), F.var_pop("x").over(over).alias("spread"))
    both = rows.select("*", part(head).alias("head"), part(tail).alias("end")).where("of IS NOT NULL")
    both = both.groupBy("backend", F.col("of").alias("t")).agg(F.max(F.when(F.col("tail"), F.col("end"))).alias("a"), F.max(F.when(~F.col("tail"), F.col("head"))).alias("b"))
    n = F.col("a.n") + F.col("b.n")
    means = [F.try_divide(F.col(f"{k}.total"), F.col(f"{k}.n")) for k in "ab"]
    squares = sum((F.coalesce(F.col(f"{k}.spread") * F.col(f"{k}.n"), F.lit(0.0)) for k in "ab"), F.coalesce(F.pow(means[0] - means[1], 2) * F.col("a.n") * F.col("b.n") / n, F.lit(0.0)))
    return both.select(
        "backend",
        "t",
        F.try_divide(F.coalesce("a.total", F.lit(0.0)) + F.coalesce("b.total", F.lit(0.0)), n).alias(f"load_mean_{hours}h"),
        F.greatest("a.most", "b.most").alias(f"load_max_{hours}h"),
        F.when(n >= 2, F.sqrt(squares / (n - 1))).alias(f"load_std_{hours}h"),
        n.alias(f"load_count_{hours}h"),
    )


def frequency(events: DataFrame, grid: DataFrame, coverage: DataFrame, windows: list[int]) -> DataFrame:
    """Events of each component in (t - w, t] at each grid time, the exposure since study start, the rate, and whether the window is complete.

    Counts are differences of one running count read at t and at t - w, so their cost doesn't grow with the window.
    """
    keys = ["backend", "component_type", "component_id"]
    events = Scratch(events.sparkSession).write(events.select(*keys, "t"), "events")  # read for the cells and for the counts
    cells = events.select(*keys).distinct().join(grid, "backend")
    marks = cells.select(*keys, F.explode(F.array(*[F.struct((F.col("t") - h * HOUR).alias("at"), F.lit(h).alias("h"), F.col("t").alias("t")) for h in (0, *windows)])).alias("m"))
    asked = marks.select(*keys, F.col("m.at").alias("at"), F.col("m.h").alias("h"), F.col("m.t").alias("t"), F.lit(0).alias("one"))
    happened = events.select(*keys, F.col("t").alias("at"), F.lit(None).cast("int").alias("h"), F.lit(None).cast("long").alias("t"), F.lit(1).alias("one"))
    running = F.sum("one").over(Window.partitionBy(*keys).orderBy("at").rangeBetween(Window.unboundedPreceding, 0))
    read = asked.unionByName(happened).withColumn("n", running).where("t is not null")
    wide = read.groupBy(*keys, "t").agg(*[F.max(F.when(F.col("h") == h, F.col("n"))).alias(f"n{h}") for h in (0, *windows)])
    out = wide.join(coverage.select("backend", "study_start"), "backend")
    for h in windows:
        exposure = F.least(F.lit(float(h)), F.greatest(F.lit(0.0), (F.col("t") - F.col("study_start")) / F.lit(float(HOUR))))
        out = (
            out.withColumn(f"count_{h}h", F.col("n0") - F.col(f"n{h}"))
            .withColumn(f"exposure_{h}h", exposure)
            .withColumn(f"rate_{h}h", F.try_divide(F.col(f"count_{h}h").cast("double"), exposure))
            .withColumn(f"complete_{h}h", F.col("t") - F.col("study_start") >= h * HOUR)
        )
    return out.drop("study_start", *[f"n{h}" for h in (0, *windows)])


def long_frequency(freq: DataFrame, windows: list[int]) -> DataFrame:
    """One row per window of each row of ``frequency``."""
    keys = ["backend", "component_type", "component_id", "t"]
    rows = F.array(*[F.struct(F.lit(h).alias("window_hours"), F.col(f"count_{h}h").alias("count"), F.col(f"rate_{h}h").alias("rate"), F.col(f"complete_{h}h").alias("complete")) for h in windows])
    return freq.select(*keys, F.explode(rows).alias("w")).select(*keys, "w.*")
