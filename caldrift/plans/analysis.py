"""The whole offline analysis as one plan graph: every output a DataFrame, shared nodes persisted once."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caldrift.operators import grid as G
from caldrift.operators import metrics as M
from caldrift.operators import series as S
from caldrift.operators import stats as Z
from caldrift.sinks import files

WINDOWS = (1, 2, 8, 24, 48)
LAGS = (-48, -24, -8, -2, -1, 0, 1, 2, 8, 24, 48)

#: Columns of microseconds that are written as ISO-8601 times.
TIMES = frozenset("t observed previous_t current_t last_t event_start first_event last_event episode_start episode_end study_start study_end".split())
CAVEATS = [
    "Report times of properties are taken as they are; a calibration that changed no reported value shows as an update without drift.",
    "Queue lengths between polls are unknown; a value older than the staleness bound counts as none.",
    "Correlations and fixed effects describe association, not cause.",
]


def run_analysis(
    observations: DataFrame,
    status: DataFrame,
    coverage: DataFrame,
    *,
    windows: tuple[int, ...] = WINDOWS,
    lags: tuple[int, ...] = LAGS,
    tolerance_minutes: int = 15,
    grid_minutes: int = 60,
    max_staleness_minutes: int = 120,
    min_n: int = 8,
    output: str | None = None,
) -> dict[str, DataFrame]:
    """All outputs by name. With ``output`` they are written there as gzip CSV, with ISO-8601 times, beside run_metadata.json, and the
    frames that they share are let go; without, they stay for the caller to read and unpersist."""
    hours = S.positive_windows(list(windows))
    for name, df in (("observations", observations), ("coverage", coverage)):
        if df.isEmpty():
            raise ValueError(f"{name} is empty")
    shared: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        shared.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return shared[-1]

    drift = keep(S.property_drift(observations))
    every = keep(S.component_events(drift, tolerance_minutes))
    study = M.in_study(every, coverage).where("in_study_period")
    grid = keep(G.make_grid(coverage, grid_minutes))
    if grid.isEmpty():
        raise ValueError("the evaluation grid is empty")
    freq = keep(G.frequency(every, grid, coverage, hours))
    load = keep(G.device_load(grid, status, hours, max_staleness_minutes))
    loads = ["load_current", *[f"load_mean_{h}h" for h in hours]]
    snapshot = M.snapshot_drift(drift, grid, grid_minutes).join(load, ["backend", "t"], "left")
    outcomes = keep(M.grid_outcomes(study, grid, grid_minutes).join(load, ["backend", "t"], "left"))
    event_load = G.device_load(study.select("backend", "t", "component_type", "component_id", "event_id", "drift_rms", "drift_mean"), status, hours, max_staleness_minutes)
    cadence = M.cadence(every, coverage)
    summary = M.property_summary(drift, coverage)
    steps = sorted({lag * 60 // grid_minutes for lag in lags if lag * 60 % grid_minutes == 0})
    name = lambda k: f"lag_{k}" if k >= 0 else f"lead_{-k}"
    complete = G.long_frequency(freq, hours).where("complete").join(load, ["backend", "t"], "left")
    out = {
        "property_drift": drift,
        "component_events": M.in_study(every, coverage),
        "calibration_frequency": freq,
        "calibration_concentration": M.concentration(G.long_frequency(freq, hours)),
        "timing_discrepancy": M.timing_discrepancy(every, grid, hours),
        "component_cadence": cadence,
        "component_property_summary": summary,
        "property_staleness": M.property_staleness(drift, grid, S.positive_windows([*hours, 6])),
        "synchrony_episodes": M.synchrony(every, coverage, tolerance_minutes),
        "device_load": load,
        "snapshot_drift": snapshot,
        "event_load": event_load,
        "grid_outcomes": outcomes,
        "fixed_effects": Z.two_way(snapshot, ["component_type"], "backend", "t", ["device_drift_l2", "changed_series_fraction"], loads, min_n),
        "event_correlations": Z.with_p(Z.correlations(event_load, ["backend", "component_type"], ["drift_rms", "drift_mean"], loads, min_n)),
        "frequency_correlations": Z.with_p(Z.correlations(complete, ["backend", "component_type", "window_hours"], ["count", "rate"], loads, min_n), ["window_hours"]),
        "lagged_correlations": Z.with_p(Z.correlations(Z.lagged(outcomes, M.KIND, "t", "load_current", steps), M.KIND, ["calibration_event_count", "drift_mean", "drift_rms"], [name(k) for k in steps], min_n)),
        "frequency_property_correlations": Z.with_p(
            Z.correlations(summary.join(cadence.select(*S.COMPONENT, "calibration_events_per_day"), S.COMPONENT), ["backend", "component_type", "property_name", "unit"], ["value_mean", "value_cv", "drift_mean", "drift_rms"], ["calibration_events_per_day"], min_n)
        ),
    }
    if output:
        counts = {}
        for key, df in out.items():
            flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])
            counts[key] = files.write_csv(flat, f"{output}/{key}", times=tuple(c for c, t in flat.dtypes if t == "bigint" and c in TIMES))
        parameters = {"windows": list(windows), "lags": list(lags), "tolerance_minutes": tolerance_minutes, "grid_minutes": grid_minutes, "max_staleness_minutes": max_staleness_minutes, "min_n": min_n}
        files.write_metadata(observations.sparkSession, f"{output}/run_metadata.json", parameters, counts, CAVEATS)
        release(shared)
    return out


def release(shared: list[DataFrame]) -> None:
    """Let go of the frames that outputs share; they are worked out anew if asked again."""
    for df in shared:
        df.unpersist()
