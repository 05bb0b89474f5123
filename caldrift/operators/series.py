"""Irregular series of property values: de-duplication, drift and robust scale, events by anchored sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caldrift.functions.expr import HOUR, MINUTE, quality_direction, ratio, rms
from caldrift.functions.scratch import Scratch

from . import ranks

IDENTITY = ["backend", "component_type", "component_id", "property_key"]
COMPONENT = ["backend", "component_type", "component_id"]
TINY = 1e-12


def require_columns(df: DataFrame, names: set[str]) -> None:
    if missing := names - set(df.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")


def positive_windows(hours: list[int]) -> list[int]:
    found = sorted(set(hours))
    if not found or found[0] <= 0:
        raise ValueError("windows must be positive")
    return found


def latest_observation(obs: DataFrame) -> DataFrame:
    """The row that was observed last for each series and calibration time; the value decides a tie.

    Rows are dealt by series, so windows over a series' times need neither another shuffle nor another sort.
    """
    w = Window.partitionBy(*IDENTITY, "t").orderBy(F.desc("observed"), F.desc("value"))
    return obs.repartition(*IDENTITY).withColumn("caldrift_rank", F.row_number().over(w)).where("caldrift_rank = 1").drop("caldrift_rank")


def robust_scale(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, scale): 1.4826 MAD; if tiny IQR/1.349; if tiny the sample deviation; if tiny a billionth of the median.

    Exact, from the distinct values' ranks (``ranks``), which are written: no buffer grows with a property's observations, and what
    ``df`` comes from is computed once for all of it.
    """
    values = Scratch(df.sparkSession).write(ranks.cumulative(df, keys, value), "changes")
    picks, quartiles = ranks.at_quantiles({"lower": 0.25, "med": 0.5, "upper": 0.75})
    first = values.groupBy("g").agg(F.max("total").alias("total"), (F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("mean"), *picks).select("g", F.col("total").alias("n"), "mean", *quartiles)
    both = ranks.spread(values, first, "med", "mean")
    iqr = (F.col("upper") - F.col("lower")) / 1.349
    sd = F.sqrt(F.try_divide(F.col("squares"), (F.col("n") - 1).cast("double")))
    scale = (
        F.when(1.4826 * F.col("mad") > TINY, 1.4826 * F.col("mad"))
        .when((F.col("n") >= 2) & (iqr > TINY), iqr)
        .when((F.col("n") >= 2) & (sd > TINY), sd)
        .otherwise(F.greatest(F.abs("med") * 1e-9, F.lit(TINY)))
    )
    return both.select(*[F.col(f"g.{k}").alias(k) for k in keys], scale.alias("scale"))


def property_drift(obs: DataFrame) -> DataFrame:
    """Each value's change since the last of its series, scaled by its property's usual change.

    One window over the series, one two-level aggregate for the scales; the scales have a row per property and are joined
    by key (adaptive execution broadcasts them while they are small).
    """
    require_columns(obs, {*IDENTITY, "property_name", "t", "value"})
    for name, default in (("scale_property_key", F.col("property_key")), ("observed", F.col("t"))):
        if name not in obs.columns:
            obs = obs.withColumn(name, default)
    w = Window.partitionBy(*IDENTITY).orderBy("t")
    value, previous = F.col("value"), F.col("previous_value")
    total = F.abs(value) + F.abs(previous)
    both = (value > 0) & (previous > 0)
    change = F.when(both, F.when(both, F.log(value)) - F.when(both, F.log(previous))).otherwise(value - previous)
    lagged = (
        latest_observation(obs)
        .withColumn("previous_value", F.lag("value").over(w))
        .withColumn("previous_t", F.lag("t").over(w))
        .withColumn("elapsed_hours", (F.col("t") - F.col("previous_t")) / F.lit(float(HOUR)))
        .withColumn("signed_absolute_change", value - previous)
        .withColumn("absolute_change", F.abs(value - previous))
        .withColumn("symmetric_relative_change", F.when(total > 0, ratio(2.0 * F.abs(value - previous), total)).when(F.abs(value - previous) == 0, 0.0))
        .withColumn("transform", F.when(both, "log").otherwise("identity"))
        .withColumn("signed_transformed_change", F.when(F.col("elapsed_hours") > 0, change))
    )
    keys = ["backend", "component_type", "scale_property_key"]
    scales = robust_scale(lagged, keys, "signed_transformed_change").withColumnRenamed("scale", "robust_property_scale")
    score, adverse = F.col("signed_drift_score"), F.col("adverse_drift_score")
    return (
        lagged.join(scales, keys, "left")
        .withColumn("signed_drift_score", F.when(F.col("robust_property_scale") > 0, F.col("signed_transformed_change") / F.col("robust_property_scale")))
        .withColumn("drift_score", F.abs(score))
        .withColumn("quality_direction", quality_direction(F.col("property_name")))
        .withColumn("adverse_drift_score", F.when(F.col("quality_direction") == "lower_is_better", score).when(F.col("quality_direction") == "higher_is_better", -score))
        .withColumn("is_degradation", adverse > 0)
        .withColumn("is_improvement", adverse < 0)
        .withColumn("drift_score_per_hour", F.when(F.col("elapsed_hours") > 0, F.col("drift_score") / F.col("elapsed_hours")))
        .withColumn("symmetric_relative_drift_per_hour", F.when(F.col("elapsed_hours") > 0, F.col("symmetric_relative_change") / F.col("elapsed_hours")))
    )


def reported_change(obs: DataFrame) -> DataFrame:
    """Whether a series has an earlier value and a different one."""
    w = Window.partitionBy(*IDENTITY).orderBy("t")
    lagged = latest_observation(obs).withColumn("previous_value", F.lag("value").over(w)).withColumn("previous_t", F.lag("t").over(w))
    return lagged.withColumn("has_prior", F.col("previous_t").isNotNull()).withColumn("value_changed", F.coalesce(F.col("has_prior") & (F.col("value") != F.col("previous_value")), F.lit(False)))


def anchored(df: DataFrame, keys: list[str], time: str, tolerance_us: int) -> DataFrame:
    """``df`` with ``anchor`` and ``number``: a session begins when a time is more than the tolerance after its anchor, the
    session's first time, which doesn't slide.

    For keys with few times in a dense run each, as a component's: each key's distinct times are cut where a time is more than the tolerance after the
    one before it, which always begins a session; only such a run is folded, and rows find theirs by an equi-join. ``sessions.dense``
    is for the others.
    """
    empty = F.expr("cast(array() as array<struct<at: bigint, anchor: bigint, number: int>>)")
    step = lambda acc, x: F.concat(acc, F.array(_next(F.try_element_at(acc, F.lit(-1)), x, tolerance_us)))
    w = Window.partitionBy(*keys).orderBy(time)
    times = df.select(*keys, time).where(F.col(time).isNotNull()).distinct()
    begins = F.coalesce(F.col(time) - F.lag(time).over(w) > tolerance_us, F.lit(True)).cast("int")
    chains = times.withColumn("begins", begins).withColumn("chain", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "chain").agg(F.array_sort(F.collect_list(time)).alias("times"))
    folded = chains.select(*keys, F.explode(F.aggregate("times", empty, step)).alias("s")).select(*keys, F.col("s.at").alias(time), F.col("s.anchor").alias("anchor"))
    numbered = folded.withColumn("number", (F.sum((F.col(time) == F.col("anchor")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    return df.join(numbered, [*keys, time])


def _next(last: Column, x: Column, tolerance_us: int) -> Column:
    same = F.coalesce(x - last["anchor"] <= tolerance_us, F.lit(False))
    return F.struct(
        x.alias("at"), F.when(same, last["anchor"]).otherwise(x).alias("anchor"), F.when(same, last["number"]).otherwise(F.coalesce(last["number"] + 1, F.lit(0))).cast("int").alias("number")
    )


def component_times(obs: DataFrame, tolerance_minutes: int = 15) -> DataFrame:
    """(component, component_event_number, t): the events of ``component_events`` without their drift. Which updates make an event, and when it
    is, hangs on times alone, so no change is worked out or scaled."""
    times = latest_observation(obs).select(*COMPONENT, "t")
    return anchored(times, COMPONENT, "t", tolerance_minutes * MINUTE).groupBy(*COMPONENT, F.col("number").alias("component_event_number")).agg(F.max("t").alias("t"))


def component_events(drift: DataFrame, tolerance_minutes: int = 15) -> DataFrame:
    """Updates of one component within the tolerance of an anchor, as one event; its time is the last update's."""
    grouped = anchored(drift, COMPONENT, "t", tolerance_minutes * MINUTE).groupBy(*COMPONENT, F.col("number").alias("component_event_number"))
    adverse = F.col("adverse_drift_mean")
    return (
        grouped.agg(
            F.min("t").alias("event_start"),
            F.max("t").alias("t"),
            F.countDistinct("property_key").alias("updated_property_count"),
            F.count("drift_score").alias("drift_property_count"),
            F.avg("drift_score").alias("drift_mean"),
            F.expr("percentile(drift_score, 0.5D)").alias("drift_median"),
            F.max("drift_score").alias("drift_max"),
            F.avg("signed_drift_score").alias("signed_drift_mean"),
            F.avg("symmetric_relative_change").alias("symmetric_relative_drift_mean"),
            F.max("symmetric_relative_change").alias("symmetric_relative_drift_max"),
            F.count("adverse_drift_score").alias("quality_property_count"),
            F.avg("adverse_drift_score").alias("adverse_drift_mean"),
            F.count_if("is_degradation").alias("degraded_property_count"),
            F.count_if("is_improvement").alias("improved_property_count"),
            rms(F.col("drift_score")).alias("drift_rms"),
        )
        .withColumn("event_span_minutes", (F.col("t") - F.col("event_start")) / F.lit(float(MINUTE)))
        .withColumn("component_degraded", F.when(F.col("quality_property_count") > 0, adverse > 0))
        .withColumn("component_improved", F.when(F.col("quality_property_count") > 0, adverse < 0))
        .withColumn("event_id", F.concat_ws(":", "backend", "component_type", "component_id", F.col("component_event_number").cast("string")))
    )
