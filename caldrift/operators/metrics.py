"""Metrics over events, series and grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caldrift.functions.expr import HOUR, MINUTE, ratio, rms
from caldrift.functions.scratch import Scratch

from . import ranks, sessions
from .grid import slot
from .series import COMPONENT, IDENTITY

KIND = ["backend", "component_type"]


def in_study(df: DataFrame, coverage: DataFrame, time: str = "t") -> DataFrame:
    """``df`` with its backend's study bounds and whether its time lies within them. Bounds are one row per backend."""
    return df.join(coverage.select("backend", "study_start", "study_end"), "backend", "left").withColumn("in_study_period", F.col(time).between(F.col("study_start"), F.col("study_end")))


def study_coverage(cycles: DataFrame) -> DataFrame:
    """(backend, study_start, study_end, successful_fetch_count) over the successful polls."""
    return cycles.where("success").groupBy("backend").agg(F.min("started").alias("study_start"), F.max(F.coalesce("finished", "started")).alias("study_end"), F.count("*").alias("successful_fetch_count"))


def concentration(freq: DataFrame) -> DataFrame:
    """How unevenly a window's events fall on a type's components, from the long form of ``frequency``."""
    keys = [*KIND, "t", "window_hours"]
    w = Window.partitionBy(*keys).orderBy("count", "component_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = freq.withColumn("up", F.row_number().over(w)).withColumn("total", F.sum("count").over(whole)).withColumn("n", F.count("*").over(whole))
    share = F.when(F.col("total") > 0, F.col("count") / F.col("total"))
    top = F.greatest(F.lit(1), F.ceil(F.col("n") * 0.1))
    out = ranked.withColumn("p", share).groupBy(*keys).agg(
        F.count("*").alias("component_count"),
        F.sum("count").alias("event_count"),
        F.count_if(F.col("count") > 0).alias("active_component_count"),
        F.sum(F.col("p") * F.col("p")).alias("hhi"),
        (-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log(F.when(F.col("p") > 0, F.col("p")))).otherwise(F.when(F.col("p").isNotNull(), 0.0)))).alias("entropy"),
        F.max("p").alias("top_share"),
        F.sum(F.when(F.col("n") - F.col("up") < top, F.col("p"))).alias("top_decile_share"),
        F.sum((2 * F.col("up") - F.col("n") - 1) * F.col("count")).alias("weighted"),
        F.avg("count").alias("mean"),
        F.stddev_samp("count").alias("sd"),
        F.bool_and("complete").alias("window_complete"),
    )
    n, k = F.col("component_count"), F.col("event_count")
    return out.select(
        *keys,
        "component_count",
        "event_count",
        "active_component_count",
        ratio(F.col("active_component_count"), n).alias("coverage_fraction"),
        "hhi",
        F.when(k > 0, F.when(n == 1, 1.0).otherwise(ratio(F.col("hhi") - 1 / n, 1 - 1 / n))).alias("normalized_hhi"),
        F.when(k > 0, F.when(n == 1, 0.0).otherwise(ratio(F.col("entropy"), F.log(n.cast("double"))))).alias("normalized_entropy"),
        F.when(k > 0, F.exp("entropy")).alias("effective_components"),
        "top_share",
        "top_decile_share",
        F.when(k > 0, ratio(F.col("weighted"), n * k)).otherwise(0.0).alias("gini"),
        F.when((n >= 2) & (F.col("mean") > 0), F.col("sd") / F.col("mean")).alias("cv"),
        "window_complete",
    )


#: Time in which ages and grid times meet.
DAY = 24 * HOUR


def _ages(events: DataFrame, grid: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """How often each age (hours since the last event at or before it) stands at each grid time of a type: (backend, component_type, t, age, n), and
    the cells of each: (g, cells), g the struct of type and time.

    From an event to the next of its series the grid times see that event. So equal gaps of a type are counted first, and meet the grid by the
    days that they cover; no row a series and grid time is made. Events are read twice and so written.
    """
    scratch = Scratch(events.sparkSession)
    times = scratch.write(events.where("backend IS NOT NULL").groupBy(*keys, "t").agg(F.lit(1).alias("one")).drop("one"), "times")
    until = F.lead("t").over(Window.partitionBy(*keys).orderBy("t"))
    gaps = times.withColumn("until", until).where("t IS NOT NULL").groupBy(*KIND, "t", "until").agg(F.count("*").alias("n"))
    day = lambda c: F.expr(f"({c} - pmod({c}, {DAY}L)) div {DAY}L")
    last = grid.groupBy("backend").agg(F.max("t").alias("last"))
    days = F.explode(F.sequence(day("t"), day("stop")))
    met = gaps.join(last, "backend").withColumn("stop", F.least(F.coalesce(F.col("until") - 1, F.col("last")), F.col("last"))).where("stop >= t").withColumn("day", days)
    seen = met.join(grid.select("backend", F.col("t").alias("at"), day("t").alias("day")), ["backend", "day"]).where("at >= t AND at <= stop")
    age = (F.col("at") - F.col("t")) / F.lit(float(HOUR))
    ages = seen.groupBy(*KIND, F.col("at").alias("t"), age.alias("age")).agg(F.sum("n").alias("n"))
    universe = times.select(*keys).distinct().groupBy(*KIND).agg(F.count("*").alias("cells"))
    return ages, universe.join(grid.select("backend", "t"), "backend").select(ranks.group([*KIND, "t"]).alias("g"), "cells")


AGE_QUANTILES = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}


def timing_discrepancy(events: DataFrame, grid: DataFrame, thresholds: list[int]) -> DataFrame:
    """Spread of the components' ages at each grid time; quantiles, gaps and Gini are read off the ages' ranks."""
    keys = [*KIND, "t"]
    scratch = Scratch(events.sparkSession)
    ages, cells = _ages(events, grid, COMPONENT)
    values = scratch.write(ranks.cumulative(ages, keys, "age", "n"), "ranks")
    picks, quantiles = ranks.at_quantiles(AGE_QUANTILES)
    n, x = F.col("n"), F.col("value")
    known = values.groupBy("g").agg(
        F.max("total").alias("total"), (F.sum(n * x) / F.sum("n")).alias("mean"), F.sum(n * x).alias("sum"), (F.max("value") - F.min("value")).alias("range"), ranks.weighted_by_rank().alias("weighted"), *picks,
        *[(F.sum(F.when(x > h, n).otherwise(0)) / F.sum("n")).alias(f"fraction_age_gt_{h}h") for h in thresholds],
    ).select("g", F.col("total").alias("known"), "mean", "sum", "range", "weighted", *quantiles, *[f"fraction_age_gt_{h}h" for h in thresholds])
    both = ranks.spread(values, known, "p50", "mean")
    cells = cells.withColumnRenamed("cells", "component_count")
    known_count = F.coalesce("known", F.lit(0))
    return cells.join(both, "g", "left").select(
        "g.*",
        "component_count",
        known_count.alias("known_count"),
        ratio(known_count, F.col("component_count")).alias("known_fraction"),
        F.col("mean").alias("age_mean_hours"),
        F.col("p50").alias("age_median_hours"),
        F.sqrt(ratio(F.col("squares"), F.col("known") - 1)).alias("age_std_hours"),
        F.col("mad").alias("age_mad_hours"),
        (F.col("p75") - F.col("p25")).alias("age_iqr_hours"),
        (F.col("p90") - F.col("p10")).alias("age_p90_p10_hours"),
        F.col("range").alias("age_range_hours"),
        F.when(F.col("known") == 1, 0.0).otherwise(ratio(2 * F.col("weighted"), F.col("known") * (F.col("known") - 1))).alias("mean_pairwise_age_gap_hours"),
        F.when(F.col("known") > 0, F.coalesce(ratio(F.col("weighted"), F.col("known") * F.col("sum")), F.lit(0.0))).alias("age_gini"),
        *[f"fraction_age_gt_{h}h" for h in thresholds],
    )


def property_staleness(drift: DataFrame, grid: DataFrame, thresholds: list[int]) -> DataFrame:
    """Ages of the property series of each type at each grid time."""
    keys = [*KIND, "t"]
    ages, cells = _ages(drift, grid, IDENTITY)
    values = Scratch(drift.sparkSession).write(ranks.cumulative(ages, keys, "age", "n"), "ranks")
    picks, quantiles = ranks.at_quantiles({"p50": 0.5, "p90": 0.9})
    n, x = F.col("n"), F.col("value")
    known = values.groupBy("g").agg(F.max("total").alias("total"), F.max("value").alias("age_max_hours"), *picks, *[(F.sum(F.when(x > h, n).otherwise(0)) / F.sum("n")).alias(f"fraction_age_gt_{h}h") for h in thresholds])
    known = known.select("g", F.col("total").alias("known"), *quantiles, "age_max_hours", *[f"fraction_age_gt_{h}h" for h in thresholds])
    known_count = F.coalesce("known", F.lit(0))
    return cells.join(known, "g", "left").select("g.*", F.col("cells").alias("series_count"), known_count.alias("known_count"), ratio(known_count, F.col("cells")).alias("known_fraction"), F.col("p50").alias("age_median_hours"), F.col("p90").alias("age_p90_hours"), "age_max_hours", *[f"fraction_age_gt_{h}h" for h in thresholds])


def cadence(events: DataFrame, coverage: DataFrame) -> DataFrame:
    """Events and inter-arrival times within the study of every component, those without any included."""
    w = Window.partitionBy(*COMPONENT).orderBy("t", "component_event_number")
    inside = in_study(events, coverage).where("in_study_period").withColumn("gap", (F.col("t") - F.lag("t").over(w)) / F.lit(float(HOUR)))
    found = inside.groupBy(*COMPONENT).agg(
        F.count("*").alias("n"),
        F.min("t").alias("first_event"),
        F.max("t").alias("last_event"),
        F.count("gap").alias("gaps"),
        F.avg("gap").alias("interarrival_mean_hours"),
        F.expr("percentile(gap, 0.5D)").alias("interarrival_median_hours"),
        F.stddev_samp("gap").alias("interarrival_std_hours"),
        F.min("gap").alias("interarrival_min_hours"),
        F.max("gap").alias("interarrival_max_hours"),
    )
    days = (F.col("study_end") - F.col("study_start")) / F.lit(24.0 * HOUR)
    mean, sd = F.col("interarrival_mean_hours"), F.col("interarrival_std_hours")
    return (
        events.select(*COMPONENT).distinct().join(coverage.select("backend", "study_start", "study_end"), "backend").join(found, COMPONENT, "left")
        .select(
            *COMPONENT,
            F.coalesce("n", F.lit(0)).alias("calibration_event_count"),
            F.try_divide(F.coalesce("n", F.lit(0)).cast("double"), days).alias("calibration_events_per_day"),
            "first_event",
            "last_event",
            "interarrival_mean_hours",
            "interarrival_median_hours",
            "interarrival_std_hours",
            F.when((F.col("gaps") >= 2) & (mean > 0), sd / mean).alias("interarrival_cv"),
            F.when(F.col("gaps") >= 2, ratio(sd - mean, sd + mean)).alias("interarrival_burstiness"),
            "interarrival_min_hours",
            "interarrival_max_hours",
        )
    )


def episodes(events: DataFrame, coverage: DataFrame, tolerance_minutes: int = 15) -> DataFrame:
    """The events within the study with the ``anchor`` and ``number`` of their episode: events of any component of a type within the tolerance of an anchor.

    The events are written first; a type's times, of which a device may have very many in a row, are anchored by jump pointers.
    """
    inside = Scratch(events.sparkSession).write(in_study(events, coverage).where("in_study_period"), "events")
    return sessions.dense(inside, KIND, "t", tolerance_minutes * MINUTE)


def synchrony(events: DataFrame, coverage: DataFrame, tolerance_minutes: int = 15) -> DataFrame:
    """Episodes: events of any component of a type within the tolerance of an anchor. What the events come from is worked out once, for them and the universe."""
    events = Scratch(events.sparkSession).write(events.select(*KIND, "component_id", "t", "drift_rms"), "universe")
    universe = events.groupBy(*KIND).agg(F.countDistinct("component_id").alias("component_count"))
    return (
        episodes(events, coverage, tolerance_minutes).groupBy(*KIND, F.col("number").alias("episode_number"))
        .agg(
            F.min("t").alias("episode_start"),
            F.max("t").alias("episode_end"),
            F.count("*").alias("component_event_count"),
            F.countDistinct("component_id").alias("distinct_component_count"),
            F.array_join(F.array_sort(F.collect_set("component_id")), ",").alias("components"),
            rms(F.col("drift_rms")).alias("episode_drift_rms"),
            F.avg("drift_rms").alias("episode_drift_mean"),
        )
        .join(universe, KIND)
        .withColumn("episode_span_minutes", (F.col("episode_end") - F.col("episode_start")) / F.lit(float(MINUTE)))
        .withColumn("component_coverage_fraction", ratio(F.col("distinct_component_count"), F.col("component_count")))
    )


#: A group's values cancel out if its mean is at most this part of its largest one.
CANCELLED = 1e-6


def _moments_by_time(values: DataFrame) -> DataFrame:
    """(key, value_mean_by_time, value_std_by_time) of (key, t, value): the sum and Welford's squares are taken in order of time, one value after the other. A group is an array."""
    zero = F.lit(0.0)
    start = F.struct(zero.alias("n"), zero.alias("total"), zero.alias("mean"), zero.alias("squares"))

    def step(a: Column, x: Column) -> Column:
        n = a["n"] + 1
        mean = a["mean"] + (x["value"] - a["mean"]) / n
        return F.struct(n.alias("n"), (a["total"] + x["value"]).alias("total"), mean.alias("mean"), (a["squares"] + (x["value"] - mean) * (x["value"] - a["mean"])).alias("squares"))

    folded = values.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("t", "value"))).alias("all")).select("key", F.aggregate("all", start, step).alias("m"))
    return folded.select("key", (F.col("m.total") / F.col("m.n")).alias("value_mean_by_time"), F.sqrt(F.col("m.squares") / (F.col("m.n") - 1)).alias("value_std_by_time"))


def property_summary(drift: DataFrame, coverage: DataFrame) -> DataFrame:
    """Values and drift of each component's properties within the study; a null unit is a group of its own."""
    keys = [*COMPONENT, "property_name", "unit"]
    scratch = Scratch(drift.sparkSession)
    inside = scratch.write(in_study(drift, coverage).where("in_study_period").select(*keys, "t", "value", "drift_score", "symmetric_relative_change"), "within")
    sums = inside.groupBy(ranks.group(keys).alias("key")).agg(
        F.count("value").alias("calibration_value_count"),
        F.avg("value").alias("value_mean"),
        F.stddev_samp("value").alias("value_std"),
        F.min("value").alias("value_min"),
        F.max("value").alias("value_max"),
        F.count("drift_score").alias("drift_observation_count"),
        F.avg("drift_score").alias("drift_mean"),
        rms(F.col("drift_score")).alias("drift_rms"),
        F.max("drift_score").alias("drift_max"),
    )
    # the three quantities whose quantiles are asked for, in one scan
    measures = {"value": ("value_median", 0.5), "drift_score": ("drift_p90", 0.9), "symmetric_relative_change": ("symmetric_relative_drift_median", 0.5)}
    long = inside.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("x")) for m in measures])).alias("m")).select(*keys, "m.measure", "m.x")
    values = scratch.write(ranks.cumulative(long, [*keys, "measure"], "x"), "ranks")
    picks, quantiles = ranks.at_quantiles({"median": 0.5, "p90": 0.9})
    found = values.groupBy("g").agg(F.max("total").alias("total"), *picks).select("g", *quantiles, F.lit(0.0).alias("zero"))
    apart = ranks.spread(values.where("g.measure = 'value'"), found.where("g.measure = 'value'"), "median", "zero").select("g", F.col("mad").alias("value_mad"))
    key = F.struct(*[F.col(f"g.{k}").alias(k) for k in keys])
    pick = lambda m, q: F.max(F.when(F.col("g.measure") == m, F.col("p90" if q == 0.9 else "median")))
    wide = found.join(apart, "g", "left").groupBy(key.alias("key")).agg(*[pick(m, q).alias(name) for m, (name, q) in measures.items()], F.max("value_mad").alias("value_mad"))
    # where values cancel out, a mean is the rounding of its sum, and the ratio to it hangs on the order of the sum: these few groups, by time
    cancelled = scratch.write(sums.where((F.col("calibration_value_count") >= 2) & (F.abs("value_mean") <= CANCELLED * F.greatest(F.abs("value_min"), F.abs("value_max")))).select("key"), "cancelled")
    exact = _moments_by_time(inside.select(ranks.group(keys).alias("key"), "t", "value").where("value IS NOT NULL").join(cancelled, "key"))
    out = sums.join(wide, "key", "left").join(exact, "key", "left").withColumns({c: F.coalesce(f"{c}_by_time", c) for c in ("value_mean", "value_std")}).select(
        "key.*", "calibration_value_count", "value_mean", "value_median", "value_std", "value_mad", "value_min", "value_max", "drift_observation_count", "drift_mean", "drift_rms", "drift_p90", "drift_max", "symmetric_relative_drift_median"
    )
    return out.withColumn("value_cv", F.when((F.col("calibration_value_count") >= 2) & (F.col("value_mean") != 0), F.col("value_std") / F.abs("value_mean")))


def snapshot_drift(drift: DataFrame, grid: DataFrame, grid_minutes: int = 60) -> DataFrame:
    """Change of a device in each grid interval (t - step, t]: each update falls in one slot, so no interval join."""
    known = drift.where("signed_drift_score is not null").withColumn("slot", slot("t", grid_minutes))
    series = known.groupBy(*KIND, "slot", "component_id", "property_key").agg(
        F.sum("signed_drift_score").alias("signed"), F.sum("adverse_drift_score").alias("adverse"), F.count("*").alias("n")
    )
    parts = series.groupBy(*KIND, "slot", "component_id").agg(F.sum(F.coalesce("adverse", F.lit(0.0))).alias("adverse"), F.collect_list(F.struct("signed", "adverse", "n")).alias("s"))
    component = parts.groupBy(*KIND, "slot").agg(F.count("*").alias("changed_component_count"), F.count_if(F.col("adverse") > 0).alias("degraded_component_count"), F.count_if(F.col("adverse") < 0).alias("improved_component_count"))
    size = F.abs("signed")
    whole = series.groupBy(*KIND, "slot").agg(
        F.count("*").alias("changed_series_count"),
        F.sum("n").alias("raw_update_count"),
        F.count_if(F.col("adverse") > 0).alias("degraded_series_count"),
        F.count_if(F.col("adverse") < 0).alias("improved_series_count"),
        F.sum(size * size).alias("squares"),
        F.percentile(size, [0.5, 0.9]).alias("q"),
        F.max(size).alias("top"),
    )
    universe = drift.groupBy(*KIND).agg(F.countDistinct("component_id", "property_key").alias("series_count"))
    cells = universe.join(grid, "backend")
    zero = F.lit(0.0)
    return (
        cells.withColumn("slot", F.col("t")).join(whole, [*KIND, "slot"], "left").join(component, [*KIND, "slot"], "left")
        .select(
            *KIND, "t", "series_count",
            *[F.coalesce(c, F.lit(0)).alias(c) for c in ("changed_series_count", "raw_update_count", "changed_component_count", "degraded_component_count", "improved_component_count", "degraded_series_count", "improved_series_count")],
            ratio(F.coalesce("changed_series_count", F.lit(0)), F.col("series_count")).alias("changed_series_fraction"),
            F.sqrt(F.coalesce("squares", zero)).alias("device_drift_l2"),
            F.sqrt(F.coalesce("squares", zero) / F.col("series_count")).alias("device_drift_rms_all_properties"),
            F.coalesce(F.col("q")[0], zero).alias("changed_drift_median"),
            F.coalesce(F.col("q")[1], zero).alias("changed_drift_p90"),
            F.coalesce("top", zero).alias("changed_drift_max"),
        )
    )


def grid_outcomes(events: DataFrame, grid: DataFrame, grid_minutes: int = 60) -> DataFrame:
    """Events and drift of each type in each grid interval of every backend."""
    events = Scratch(events.sparkSession).write(events.select(*COMPONENT, "t", "drift_rms"), "events")  # read for the slots and for the types
    found = events.withColumn("slot", slot("t", grid_minutes)).groupBy(*KIND, F.col("slot").alias("t")).agg(
        F.count("*").alias("n"), F.countDistinct("component_id").alias("m"), F.count("drift_rms").alias("k"), F.avg("drift_rms").alias("drift_mean"), rms(F.col("drift_rms")).alias("drift_rms"), F.max("drift_rms").alias("drift_max")
    )
    # types and backends, both few and distinct, meet first; the grid then finds its types by backend
    types = events.where("component_type is not null").select("component_type").distinct().withColumn("one", F.lit(1))
    kinds = grid.select("backend").distinct().withColumn("one", F.lit(1)).join(types, "one").drop("one")
    cells = grid.select("backend", "t").join(kinds, "backend")
    return cells.join(found, [*KIND, "t"], "left").select(
        *KIND, "t", F.coalesce("n", F.lit(0)).alias("calibration_event_count"), F.coalesce("m", F.lit(0)).alias("calibrated_component_count"), F.coalesce("k", F.lit(0)).alias("drift_event_count"), "drift_mean", "drift_rms", "drift_max"
    )


def gini(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Null for no values or a negative one; 0 where they sum to 0."""
    x = F.col("value")
    out = ranks.cumulative(df, keys, value).groupBy("g").agg(ranks.weighted_by_rank().alias("s"), F.max("total").alias("n"), F.sum(F.col("n") * x).alias("t"), F.min("value").alias("least"))
    return out.select("g.*", F.when(F.col("least") < 0, None).when(F.col("t") == 0, 0.0).otherwise(ratio(F.col("s"), F.col("n") * F.col("t"))).alias("gini"))


def pairwise_gap(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean absolute difference of all pairs, from ranks: no pair is formed."""
    out = ranks.cumulative(df, keys, value).groupBy("g").agg(ranks.weighted_by_rank().alias("s"), F.max("total").alias("n"))
    return out.select("g.*", F.when(F.col("n") == 1, 0.0).otherwise(ratio(2 * F.col("s"), F.col("n") * (F.col("n") - 1))).alias("gap"))
