"""Queries over the analysis operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caldrift.operators import grid as G
from caldrift.operators import metrics as M
from caldrift.operators import series as S

from . import proxies as P
from .oracles import GRID, HOUR, MINUTE, TOLERANCE, statement

WINDOWS, THRESHOLDS = [8, 48], [6, 48]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str, rounded: str = "", digits: int = 4) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[(F.round(F.col(c) + F.lit(1e-9), digits) + F.lit(0.0)).alias(c) if c in rounded.split() else F.col(c) for c in df.columns])

        QUERIES[name], ORACLES[name] = run, statement(sql, rounded, digits)
        return f

    return add


def drift(spark: SparkSession, d: str) -> DataFrame:
    return S.property_drift(P.observations(spark, d))


def events(spark: SparkSession, d: str) -> DataFrame:
    return S.component_events(drift(spark, d), TOLERANCE)


def grid(spark: SparkSession, d: str) -> DataFrame:
    return G.make_grid(P.coverage(spark, d), GRID)


def freq(spark: SparkSession, d: str) -> DataFrame:
    return G.frequency(events(spark, d), grid(spark, d), P.coverage(spark, d), WINDOWS)


C = "backend, component_type, component_id"
SERIES = f"{C}, property_key, t"

query("src_table_scan", "SELECT backend, t, value FROM obs WHERE backend = 'click' AND value > 10")(lambda s, d: P.observations(s, d).where("backend = 'click' AND value > 10").select("backend", "t", "value"))
query("filter_backend_time", f"SELECT backend, component_id, t, value FROM obs WHERE backend IN ('click', 'view') AND t >= 1704844800000000 - 168 * {HOUR} AND t <= 1705276800000000")(
    lambda s, d: P.observations(s, d).where(F.col("backend").isin("click", "view") & F.col("t").between(1704844800000000 - 168 * HOUR, 1705276800000000)).select("backend", "component_id", "t", "value")
)
query("filter_not_operational", f"SELECT {SERIES} FROM obs WHERE lower(trim(property_name)) <> 't2'")(lambda s, d: P.observations(s, d).where(F.lower(F.trim("property_name")) != "t2").select(*SERIES.split(", ")))
query("distinct_on_latest", f"SELECT {SERIES}, observed, value FROM dedup")(lambda s, d: S.latest_observation(P.observations(s, d)).select(*SERIES.split(", "), "observed", "value"))
query("drop_duplicates_last", f"SELECT {SERIES}, max(observed) AS observed FROM obs GROUP BY ALL")(lambda s, d: S.latest_observation(P.observations(s, d)).select(*SERIES.split(", "), "observed"))
query("win_lag_value", f"SELECT {SERIES}, previous_value, previous_t FROM lagged")(lambda s, d: S.reported_change(P.observations(s, d)).select(*SERIES.split(", "), "previous_value", "previous_t"))
query("win_reported_change", f"SELECT {SERIES}, previous_t IS NOT NULL AS has_prior, coalesce(value <> previous_value, false) AS value_changed FROM lagged")(lambda s, d: S.reported_change(P.observations(s, d)).select(*SERIES.split(", "), "has_prior", "value_changed"))
query("quality_direction", "SELECT DISTINCT property_name, quality_direction FROM drift")(lambda s, d: drift(s, d).select("property_name", "quality_direction").distinct())
query("property_keys", "SELECT DISTINCT property_name || '[' || coalesce(unit, '') || ']' AS property_key FROM obs")(lambda s, d: P.observations(s, d).select(F.concat("property_name", F.lit("["), F.coalesce("unit", F.lit("")), F.lit("]")).alias("property_key")).distinct())
query("agg_robust_scale", "SELECT * FROM scales", "robust_property_scale", 6)(
    lambda s, d: drift(s, d).where("robust_property_scale IS NOT NULL").groupBy("backend", "component_type", "property_key").agg(F.max("robust_property_scale").alias("robust_property_scale"))
)
DRIFT = "elapsed_hours signed_absolute_change absolute_change symmetric_relative_change signed_transformed_change signed_drift_score drift_score adverse_drift_score drift_score_per_hour symmetric_relative_drift_per_hour"
query(
    "win_property_drift",
    f"""SELECT {SERIES}, transform, quality_direction, elapsed_hours, signed_absolute_change, absolute_change, symmetric_relative_change, signed_transformed_change, signed_drift_score, drift_score,
        adverse_drift_score, adverse_drift_score > 0 AS is_degradation, adverse_drift_score < 0 AS is_improvement, drift_score / elapsed_hours AS drift_score_per_hour,
        symmetric_relative_change / elapsed_hours AS symmetric_relative_drift_per_hour FROM drift""",
    DRIFT,
)(lambda s, d: drift(s, d).select(*SERIES.split(", "), "transform", "quality_direction", *DRIFT.split(), "is_degradation", "is_improvement"))
query("sess_component_events", f"SELECT {SERIES}, number FROM grouped")(lambda s, d: S.anchored(drift(s, d), S.COMPONENT, "t", TOLERANCE * MINUTE).select(*SERIES.split(", "), "number"))
query("conditional_case", "SELECT transform, quality_direction, count(*) AS n FROM drift GROUP BY ALL")(lambda s, d: drift(s, d).groupBy("transform", "quality_direction").agg(F.count("*").alias("n")))
EV = "drift_mean drift_median drift_max signed_drift_mean symmetric_relative_drift_mean symmetric_relative_drift_max adverse_drift_mean drift_rms"
query(
    "agg_events",
    f"""SELECT *, (t - event_start) / {MINUTE}.0::DOUBLE AS event_span_minutes, CASE WHEN quality_property_count > 0 THEN adverse_drift_mean > 0 END AS component_degraded,
        CASE WHEN quality_property_count > 0 THEN adverse_drift_mean < 0 END AS component_improved, backend || ':' || component_type || ':' || component_id || ':' || component_event_number AS event_id FROM ev""",
    EV,
)(events)
query("make_grid", "SELECT * FROM grid")(grid)
query("agg_coverage", "SELECT backend, min(started) AS study_start, max(coalesce(finished, started)) AS study_end, count(*) AS successful_fetch_count FROM cycles WHERE success GROUP BY 1")(lambda s, d: M.study_coverage(P.cycles(s, d)))
query("filter_in_study", f"SELECT {C}, component_event_number, t BETWEEN study_start AND study_end AS in_study_period FROM ev JOIN coverage USING (backend)")(
    lambda s, d: M.in_study(events(s, d), P.coverage(s, d)).select(*C.split(", "), "component_event_number", "in_study_period")
)
query("join_coverage", f"SELECT {C}, component_event_number, study_start, study_end FROM ev JOIN coverage USING (backend)")(
    lambda s, d: M.in_study(events(s, d), P.coverage(s, d)).select(*C.split(", "), "component_event_number", "study_start", "study_end")
)
query("join_cross_universe", f"SELECT {C}, t FROM cells")(lambda s, d: events(s, d).select(*S.COMPONENT).distinct().join(grid(s, d), "backend"))
query(
    "win_frequency",
    f"""SELECT {C}, t, max(count) FILTER (window_hours = 8) AS count_8h, max(exposure) FILTER (window_hours = 8) AS exposure_8h, max(count / nullif(exposure, 0)) FILTER (window_hours = 8) AS rate_8h, bool_or(complete) FILTER (window_hours = 8) AS complete_8h,
        max(count) FILTER (window_hours = 48) AS count_48h, max(exposure) FILTER (window_hours = 48) AS exposure_48h, max(count / nullif(exposure, 0)) FILTER (window_hours = 48) AS rate_48h, bool_or(complete) FILTER (window_hours = 48) AS complete_48h FROM freq GROUP BY ALL""",
    "exposure_8h rate_8h exposure_48h rate_48h",
)(freq)
MELT = f"SELECT {C}, t, window_hours, count, count / nullif(exposure, 0) AS rate, complete FROM freq"
query("melt_windows", MELT, "rate")(lambda s, d: G.long_frequency(freq(s, d), WINDOWS))
query("win_hopping_grid", f"SELECT {C}, t, count FROM freq WHERE window_hours = 48")(lambda s, d: G.long_frequency(freq(s, d), WINDOWS).where("window_hours = 48").select(*C.split(", "), "t", "count"))
query("join_range_trailing", f"SELECT {C}, t, count FROM freq WHERE window_hours = 8")(lambda s, d: G.long_frequency(freq(s, d), WINDOWS).where("window_hours = 8").select(*C.split(", "), "t", "count"))
CONC = "coverage_fraction hhi normalized_hhi normalized_entropy effective_components top_share top_decile_share gini cv"
query(
    "agg_concentration",
    """SELECT backend, component_type, t, window_hours, component_count, event_count, active_component_count, active_component_count / component_count AS coverage_fraction, hhi,
        CASE WHEN event_count > 0 THEN CASE WHEN component_count = 1 THEN 1.0 ELSE (hhi - 1.0::DOUBLE / component_count) / (1 - 1.0::DOUBLE / component_count) END END AS normalized_hhi,
        CASE WHEN event_count > 0 THEN CASE WHEN component_count = 1 THEN 0.0 ELSE entropy / ln(component_count) END END AS normalized_entropy,
        CASE WHEN event_count > 0 THEN exp(entropy) END AS effective_components, top_share, top_decile_share, CASE WHEN event_count > 0 THEN weighted / (component_count * event_count) ELSE 0.0 END AS gini,
        CASE WHEN component_count >= 2 AND mean > 0 THEN sd / mean END AS cv, window_complete
      FROM (SELECT backend, component_type, t, window_hours, count(*) AS component_count, CAST(sum(count) AS BIGINT) AS event_count, count(*) FILTER (count > 0) AS active_component_count, sum(p * p) AS hhi,
              -sum(CASE WHEN p > 0 THEN p * ln(CASE WHEN p > 0 THEN p END) WHEN p IS NOT NULL THEN 0.0 END) AS entropy, max(p) AS top_share, sum(p) FILTER (down <= greatest(1, ceil(n * 0.1))) AS top_decile_share,
              sum((2 * up - n - 1) * count)::DOUBLE AS weighted, avg(count) AS mean, stddev_samp(count) AS sd, bool_and(complete) AS window_complete
            FROM (SELECT *, count / nullif(sum(count) OVER w, 0) AS p, count(*) OVER w AS n, row_number() OVER (PARTITION BY backend, component_type, t, window_hours ORDER BY count, component_id) AS up,
                    row_number() OVER (PARTITION BY backend, component_type, t, window_hours ORDER BY count DESC, component_id) AS down FROM freq WINDOW w AS (PARTITION BY backend, component_type, t, window_hours)) GROUP BY ALL)""",
    CONC,
)(lambda s, d: M.concentration(G.long_frequency(freq(s, d), WINDOWS)))
AGES = f"""(SELECT c.backend, c.component_type, c.component_id, c.t, (c.t - e.t) / {HOUR}.0::DOUBLE AS age FROM cells c ASOF LEFT JOIN (SELECT DISTINCT {C}, t FROM ev) e
      ON c.backend = e.backend AND c.component_type = e.component_type AND c.component_id = e.component_id AND c.t >= e.t)"""
TIMING = "known_fraction age_mean_hours age_median_hours age_std_hours age_mad_hours age_iqr_hours age_p90_p10_hours age_range_hours mean_pairwise_age_gap_hours age_gini fraction_age_gt_6h fraction_age_gt_48h"
query(
    "agg_timing_discrepancy",
    f"""SELECT backend, component_type, t, count(*) AS component_count, count(age) AS known_count, count(age) / count(*) AS known_fraction, avg(age) AS age_mean_hours, median(age) AS age_median_hours,
        stddev_samp(age) AS age_std_hours, mad(age) AS age_mad_hours, quantile_cont(age, 0.75) - quantile_cont(age, 0.25) AS age_iqr_hours, quantile_cont(age, 0.9) - quantile_cont(age, 0.1) AS age_p90_p10_hours,
        max(age) - min(age) AS age_range_hours, CASE WHEN count(age) = 1 THEN 0.0 ELSE 2 * sum((2 * up - known - 1) * age) / nullif(count(age) * (count(age) - 1), 0) END AS mean_pairwise_age_gap_hours,
        CASE WHEN count(age) > 0 THEN coalesce(sum((2 * up - known - 1) * age) / nullif(count(age) * sum(age), 0), 0.0) END AS age_gini,
        avg(CASE WHEN age > 6 THEN 1.0 WHEN age IS NOT NULL THEN 0.0 END) AS fraction_age_gt_6h, avg(CASE WHEN age > 48 THEN 1.0 WHEN age IS NOT NULL THEN 0.0 END) AS fraction_age_gt_48h
      FROM (SELECT *, row_number() OVER (PARTITION BY backend, component_type, t ORDER BY age NULLS LAST, component_id) AS up, count(age) OVER (PARTITION BY backend, component_type, t) AS known FROM {AGES}) GROUP BY ALL""",
    TIMING,
)(lambda s, d: M.timing_discrepancy(events(s, d), grid(s, d), THRESHOLDS))
query(
    "agg_property_staleness",
    f"""SELECT backend, component_type, t, count(*) AS series_count, count(age) AS known_count, count(age) / count(*) AS known_fraction, median(age) AS age_median_hours, quantile_cont(age, 0.9) AS age_p90_hours, max(age) AS age_max_hours,
        avg(CASE WHEN age > 6 THEN 1.0 WHEN age IS NOT NULL THEN 0.0 END) AS fraction_age_gt_6h, avg(CASE WHEN age > 48 THEN 1.0 WHEN age IS NOT NULL THEN 0.0 END) AS fraction_age_gt_48h
      FROM (SELECT c.backend, c.component_type, c.component_id, c.property_key, c.t, (c.t - e.t) / {HOUR}.0::DOUBLE AS age FROM (SELECT u.*, g.t FROM (SELECT DISTINCT {C}, property_key FROM dedup) u JOIN grid g USING (backend)) c
            ASOF LEFT JOIN (SELECT {SERIES} FROM dedup) e ON c.backend = e.backend AND c.component_type = e.component_type AND c.component_id = e.component_id AND c.property_key = e.property_key AND c.t >= e.t) GROUP BY ALL""",
    "known_fraction age_median_hours age_p90_hours age_max_hours fraction_age_gt_6h fraction_age_gt_48h",
)(lambda s, d: M.property_staleness(S.latest_observation(P.observations(s, d)), grid(s, d), THRESHOLDS))
CAD = "calibration_events_per_day interarrival_mean_hours interarrival_median_hours interarrival_std_hours interarrival_cv interarrival_burstiness interarrival_min_hours interarrival_max_hours"
query(
    "agg_cadence",
    f"""SELECT {C}, count(t) AS calibration_event_count, count(t) / nullif((max(study_end) - max(study_start)) / (24.0::DOUBLE * {HOUR}), 0) AS calibration_events_per_day, min(t) AS first_event, max(t) AS last_event,
        avg(gap) AS interarrival_mean_hours, median(gap) AS interarrival_median_hours, stddev_samp(gap) AS interarrival_std_hours, CASE WHEN count(gap) >= 2 AND avg(gap) > 0 THEN stddev_samp(gap) / avg(gap) END AS interarrival_cv,
        CASE WHEN count(gap) >= 2 THEN (stddev_samp(gap) - avg(gap)) / nullif(stddev_samp(gap) + avg(gap), 0) END AS interarrival_burstiness, min(gap) AS interarrival_min_hours, max(gap) AS interarrival_max_hours
      FROM (SELECT u.*, v.study_start, v.study_end, i.t, i.gap FROM (SELECT DISTINCT {C} FROM ev) u JOIN coverage v USING (backend) LEFT JOIN
            (SELECT {C}, t, (t - lag(t) OVER (PARTITION BY {C} ORDER BY t)) / {HOUR}.0::DOUBLE AS gap FROM ev JOIN coverage USING (backend) WHERE t BETWEEN study_start AND study_end) i USING ({C})) GROUP BY ALL""",
    CAD,
)(lambda s, d: M.cadence(events(s, d), P.coverage(s, d)))
query("win_diff", f"SELECT {C}, t, (t - lag(t) OVER (PARTITION BY {C} ORDER BY t)) / {HOUR}.0::DOUBLE AS gap_hours FROM ev", "gap_hours")(
    lambda s, d: events(s, d).selectExpr(*C.split(", "), "t", f"(t - lag(t) OVER (PARTITION BY {C} ORDER BY t)) / {HOUR}D AS gap_hours")
)
PS = "value_mean value_median value_std value_mad value_min value_max drift_mean drift_rms drift_p90 drift_max symmetric_relative_drift_median value_cv"
query(
    "agg_property_summary",
    f"""SELECT {C}, property_name, unit, count(value) AS calibration_value_count, avg(value) AS value_mean, median(value) AS value_median, stddev_samp(value) AS value_std, mad(value) AS value_mad, min(value) AS value_min, max(value) AS value_max,
        count(drift_score) AS drift_observation_count, avg(drift_score) AS drift_mean, sqrt(avg(drift_score * drift_score)) AS drift_rms, quantile_cont(drift_score, 0.9) AS drift_p90, max(drift_score) AS drift_max,
        median(symmetric_relative_change) AS symmetric_relative_drift_median, CASE WHEN count(value) >= 2 AND avg(value) <> 0 THEN stddev_samp(value) / abs(avg(value)) END AS value_cv
      FROM drift JOIN coverage USING (backend) WHERE t BETWEEN study_start AND study_end GROUP BY ALL""",
    PS,
)(lambda s, d: M.property_summary(drift(s, d), P.coverage(s, d)))
SLOT = f"(t + {GRID * MINUTE} - 1) // {GRID * MINUTE} * {GRID * MINUTE}"
query(
    "agg_snapshot_drift",
    f"""SELECT u.backend, u.component_type, g.t, u.series_count, coalesce(w.changed_series_count, 0) AS changed_series_count, coalesce(w.raw_update_count, 0) AS raw_update_count, coalesce(c.n, 0) AS changed_component_count,
        coalesce(c.worse, 0) AS degraded_component_count, coalesce(c.better, 0) AS improved_component_count, coalesce(w.worse, 0) AS degraded_series_count, coalesce(w.better, 0) AS improved_series_count,
        coalesce(w.changed_series_count, 0) / u.series_count AS changed_series_fraction, sqrt(coalesce(w.squares, 0)) AS device_drift_l2, sqrt(coalesce(w.squares, 0) / u.series_count) AS device_drift_rms_all_properties,
        coalesce(w.q50, 0) AS changed_drift_median, coalesce(w.q90, 0) AS changed_drift_p90, coalesce(w.top, 0) AS changed_drift_max
      FROM (SELECT backend, component_type, count(DISTINCT component_id || '/' || property_key) AS series_count FROM drift GROUP BY ALL) u JOIN grid g USING (backend)
      LEFT JOIN (SELECT backend, component_type, slot, count(*) AS changed_series_count, CAST(sum(n) AS BIGINT) AS raw_update_count, count(*) FILTER (adverse > 0) AS worse, count(*) FILTER (adverse < 0) AS better, sum(signed * signed) AS squares,
                   median(abs(signed)) AS q50, quantile_cont(abs(signed), 0.9) AS q90, max(abs(signed)) AS top FROM
                   (SELECT backend, component_type, component_id, property_key, {SLOT} AS slot, sum(signed_drift_score) AS signed, sum(adverse_drift_score) AS adverse, count(*) AS n FROM drift WHERE signed_drift_score IS NOT NULL GROUP BY ALL) GROUP BY ALL) w
        ON w.backend = u.backend AND w.component_type = u.component_type AND w.slot = g.t
      LEFT JOIN (SELECT backend, component_type, slot, count(*) AS n, count(*) FILTER (adverse > 0) AS worse, count(*) FILTER (adverse < 0) AS better FROM
                   (SELECT backend, component_type, component_id, {SLOT} AS slot, coalesce(sum(adverse_drift_score), 0) AS adverse FROM drift WHERE signed_drift_score IS NOT NULL GROUP BY ALL) GROUP BY ALL) c
        ON c.backend = u.backend AND c.component_type = u.component_type AND c.slot = g.t""",
    "changed_series_fraction device_drift_l2 device_drift_rms_all_properties changed_drift_median changed_drift_p90 changed_drift_max",
)(lambda s, d: M.snapshot_drift(drift(s, d), grid(s, d), GRID))
OUTCOMES = f"""SELECT k.backend, k.component_type, k.t, coalesce(n, 0) AS calibration_event_count, coalesce(m, 0) AS calibrated_component_count, coalesce(kk, 0) AS drift_event_count, drift_mean, drift_rms, drift_max
      FROM (SELECT g.backend, y.component_type, g.t FROM grid g CROSS JOIN (SELECT DISTINCT component_type FROM ev) y) k
      LEFT JOIN (SELECT backend, component_type, {SLOT} AS t, count(*) AS n, count(DISTINCT component_id) AS m, count(drift_rms) AS kk, avg(drift_rms) AS drift_mean, sqrt(avg(drift_rms * drift_rms)) AS drift_rms, max(drift_rms) AS drift_max FROM ev GROUP BY ALL) e USING (backend, component_type, t)"""
query("agg_grid_outcomes", OUTCOMES, "drift_mean drift_rms drift_max")(lambda s, d: M.grid_outcomes(events(s, d), grid(s, d), GRID))
SYN = f"""SELECT a.backend, a.component_type, a.number, e.t, e.component_id, e.drift_rms FROM (SELECT * FROM ev JOIN coverage USING (backend) WHERE t BETWEEN study_start AND study_end) e
      ASOF JOIN (SELECT * FROM ep WHERE anchor IS NOT NULL) a ON e.backend = a.backend AND e.component_type = a.component_type AND e.t >= a.anchor"""
EP = f"""WITH RECURSIVE tm AS (SELECT DISTINCT backend, component_type, t FROM ev JOIN coverage USING (backend) WHERE t BETWEEN study_start AND study_end),
      ep AS (SELECT backend, component_type, min(t) AS anchor, 0 AS number FROM tm GROUP BY ALL UNION ALL
        SELECT a.backend, a.component_type, (SELECT min(d.t) FROM tm d WHERE d.backend = a.backend AND d.component_type = a.component_type AND d.t > a.anchor + {TOLERANCE * MINUTE}), a.number + 1 FROM ep a WHERE a.anchor IS NOT NULL)"""
query("sess_synchrony", f"SELECT * FROM ({EP} SELECT backend, component_type, component_id, t, number FROM ({SYN}))")(
    lambda s, d: M.episodes(S.component_times(P.observations(s, d), TOLERANCE), P.coverage(s, d), TOLERANCE).select(*M.KIND, "component_id", "t", "number")
)
query(
    "agg_synchrony",
    f"""SELECT * FROM ({EP} SELECT backend, component_type, number AS episode_number, min(t) AS episode_start, max(t) AS episode_end, count(*) AS component_event_count, count(DISTINCT component_id) AS distinct_component_count,
        string_agg(DISTINCT component_id, ',' ORDER BY component_id) AS components, sqrt(avg(drift_rms * drift_rms)) AS episode_drift_rms, avg(drift_rms) AS episode_drift_mean, max(u.n) AS component_count,
        (max(t) - min(t)) / {MINUTE}.0::DOUBLE AS episode_span_minutes, count(DISTINCT component_id) / max(u.n)::DOUBLE AS component_coverage_fraction
      FROM ({SYN}) JOIN (SELECT backend, component_type, count(DISTINCT component_id) AS n FROM ev GROUP BY ALL) u USING (backend, component_type) GROUP BY ALL)""",
    "episode_drift_rms episode_drift_mean component_coverage_fraction",
)(lambda s, d: M.synchrony(events(s, d), P.coverage(s, d), TOLERANCE))
LOAD = "current_age_minutes load_current load_mean_8h load_max_8h load_std_8h"


def load(s: SparkSession, d: str) -> DataFrame:
    return G.device_load(grid(s, d), P.status(s, d), [8])


query("agg_load_summary", "SELECT * FROM load", LOAD)(load)
query("join_asof_backward_stale", "SELECT backend, t, current_t, current_age_minutes, load_current FROM load", "current_age_minutes load_current")(lambda s, d: load(s, d).select("backend", "t", "current_t", "current_age_minutes", "load_current"))
query("join_range_prior", "SELECT backend, t, load_count_8h, load_max_8h FROM load", "load_max_8h")(lambda s, d: load(s, d).select("backend", "t", "load_count_8h", "load_max_8h"))
query("join_grid_load", f"SELECT o.*, l.load_current, l.load_mean_8h FROM ({OUTCOMES}) o LEFT JOIN load l USING (backend, t)", "drift_mean drift_rms drift_max load_current load_mean_8h")(
    lambda s, d: M.grid_outcomes(events(s, d), grid(s, d), GRID).join(load(s, d).select("backend", "t", "load_current", "load_mean_8h"), ["backend", "t"], "left")
)
query("stat_gini", "SELECT backend, component_type, CASE WHEN min(x) < 0 THEN NULL WHEN sum(x) = 0 THEN 0.0 ELSE sum((2 * i - n - 1) * x) / (max(n) * sum(x)) END AS gini FROM (SELECT backend, component_type, drift_rms AS x, row_number() OVER (PARTITION BY backend, component_type ORDER BY drift_rms) AS i, count(*) OVER (PARTITION BY backend, component_type) AS n FROM ev WHERE drift_rms IS NOT NULL) GROUP BY ALL", "gini")(
    lambda s, d: M.gini(events(s, d), M.KIND, "drift_rms")
)
query("stat_pairwise_gap", "SELECT backend, component_type, CASE WHEN max(n) = 1 THEN 0.0 ELSE 2 * sum((2 * i - n - 1) * x) / (max(n) * (max(n) - 1)) END AS gap FROM (SELECT backend, component_type, drift_rms AS x, row_number() OVER (PARTITION BY backend, component_type ORDER BY drift_rms) AS i, count(*) OVER (PARTITION BY backend, component_type) AS n FROM ev WHERE drift_rms IS NOT NULL) GROUP BY ALL", "gap")(
    lambda s, d: M.pairwise_gap(events(s, d), M.KIND, "drift_rms")
)
query("stat_rms", "SELECT backend, component_type, sqrt(avg(drift_score * drift_score)) AS rms, stddev_samp(drift_score) AS sd, CASE WHEN avg(drift_score) > 0 THEN stddev_samp(drift_score) / avg(drift_score) END AS cv FROM drift GROUP BY ALL", "rms sd cv")(
    lambda s, d: drift(s, d).groupBy(*M.KIND).agg(F.sqrt(F.avg(F.col("drift_score") * F.col("drift_score"))).alias("rms"), F.stddev_samp("drift_score").alias("sd"), F.when(F.avg("drift_score") > 0, F.stddev_samp("drift_score") / F.avg("drift_score")).alias("cv"))
)
query("stat_burstiness", f"SELECT {C}, interarrival_burstiness FROM (SELECT {C}, (stddev_samp(gap) - avg(gap)) / nullif(stddev_samp(gap) + avg(gap), 0) AS interarrival_burstiness, count(gap) AS n FROM (SELECT {C}, (t - lag(t) OVER (PARTITION BY {C} ORDER BY t)) / {HOUR}.0::DOUBLE AS gap FROM ev JOIN coverage USING (backend) WHERE t BETWEEN study_start AND study_end) GROUP BY ALL) WHERE n >= 2", "interarrival_burstiness")(
    lambda s, d: M.cadence(events(s, d), P.coverage(s, d)).where("interarrival_cv IS NOT NULL OR interarrival_burstiness IS NOT NULL").select(*C.split(", "), "interarrival_burstiness")
)
