"""Queries over poll metrics, backfill, statistics, studies and graphs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caldrift.functions.expr import HOUR, MINUTE, seconds_between
from caldrift.functions.scratch import Scratch
from caldrift.operators import cycles as Y
from caldrift.operators import grid as G
from caldrift.operators import metrics as M
from caldrift.operators import series as S
from caldrift.operators import stats as Z
from caldrift.operators import studies as U
from caldrift.sinks import files

from . import proxies as P
from .metric_queries import C, GRID, ORACLES, OUTCOMES, QUERIES, TOLERANCE, drift, events, freq, grid, load, query
from .oracles import CTES

D = DataFrame
CTES |= {
    "latest_q": "SELECT cycle, qubit, max(date) AS date FROM props GROUP BY ALL",
    "latest_e": "SELECT cycle, edge_id, max(date) AS date FROM props GROUP BY ALL",
    "weekly": f"SELECT backend, (t - study_start) // {U.WEEK} AS week, component_id, count(*) AS n FROM ev JOIN coverage USING (backend) WHERE component_type = 'edge' AND t >= study_start AND (t - study_start) // {U.WEEK} < (study_end - study_start) // {U.WEEK} GROUP BY ALL",
    "extremes": "SELECT backend, week, arg_min(component_id, (-n, component_id)) AS peak_edge, max(n) AS peak, arg_min(component_id, (n, component_id)) AS least_edge, min(n) AS least, count(*) AS active_edges, CAST(sum(n) AS BIGINT) AS total, max(n) / min(n)::DOUBLE AS peak_ratio FROM weekly GROUP BY ALL",
    "cad": f"SELECT component_type, backend, component_id, count(*) FILTER (t BETWEEN study_start AND study_end) AS n FROM ev JOIN coverage USING (backend) GROUP BY ALL",
    "full_ratio": "SELECT backend, max(n) AS most, min(n) AS least, arg_min(component_id, (-n, component_id)) AS most_edge, arg_min(component_id, (n, component_id)) AS least_edge, max(n) / nullif(min(n), 0)::DOUBLE AS max_min_ratio FROM cad WHERE component_type = 'edge' GROUP BY ALL",
    "near": f"""SELECT d.backend, d.component_id, d.property_key, d.t, p.t AS previous_t, q.t AS next_t, CASE WHEN q.t IS NULL OR d.t - p.t <= q.t - d.t THEN p.t ELSE q.t END AS nearest_t FROM dedup d
        ASOF LEFT JOIN (SELECT DISTINCT backend, t FROM anchors) p ON d.backend = p.backend AND d.t >= p.t ASOF LEFT JOIN (SELECT DISTINCT backend, t FROM anchors) q ON d.backend = q.backend AND d.t <= q.t""",
    "shares": "SELECT *, ops / sum(ops) OVER (PARTITION BY backend, level, run_id)::DOUBLE AS within_run_share FROM (SELECT backend, level, run_id, component_id, CAST(sum(ops) AS BIGINT) AS ops FROM usage GROUP BY ALL)",
    "edge_use": "SELECT backend, level, component_id, total_runs, count(DISTINCT run_id) AS used_runs, CAST(sum(ops) AS BIGINT) AS ops, sum(within_run_share) / count(DISTINCT run_id) AS mean_share, count(DISTINCT run_id) / max(total_runs)::DOUBLE AS presence FROM shares JOIN (SELECT backend, level, count(DISTINCT run_id) AS total_runs FROM usage GROUP BY ALL) USING (backend, level) GROUP BY ALL",
    "degree": "SELECT backend, node, count(*) AS d FROM (SELECT backend, a AS node FROM edges UNION ALL SELECT backend, b FROM edges) GROUP BY ALL",
}


def same(name: str, as_name: str) -> None:
    """An entry of the inventory that another one's query covers whole."""
    QUERIES[name], ORACLES[name] = QUERIES[as_name], ORACLES[as_name]


def latest(s: SparkSession, d: str, c: str) -> D:
    return Y.latest_dates(P.properties(s, d), c)


def metrics(s: SparkSession, d: str) -> D:
    return Y.cycle_metrics(P.cycles(s, d), latest(s, d, "qubit"), latest(s, d, "edge_id"))


query("win_lag_cycle", "SELECT cycle, backend, started, prev, prev_started FROM valid")(lambda s, d: Y.previous_cycle(P.cycles(s, d)).select("cycle", "backend", "started", "prev", "prev_started"))
query("agg_latest_qubit", "SELECT * FROM latest_q")(lambda s, d: latest(s, d, "qubit"))
query("agg_latest_edge", "SELECT * FROM latest_e")(lambda s, d: latest(s, d, "edge_id"))
query(
    "agg_cycle_metrics",
    """SELECT v.cycle, v.backend, coalesce(q.ids, '') AS qubits, coalesce(q.n, 0) AS num_qubits_calibrated, q.oldest AS oldest_qubit, CASE WHEN q.date IS NOT NULL THEN greatest(0, coalesce(v.finished, v.started) - q.date) / 1e6 END AS max_qubit_age_seconds,
        coalesce(e.ids, '') AS edges_listed, coalesce(e.n, 0) AS num_edges_calibrated, e.oldest AS oldest_edge, CASE WHEN e.date IS NOT NULL THEN greatest(0, coalesce(v.finished, v.started) - e.date) / 1e6 END AS max_edge_age_seconds FROM valid v
      LEFT JOIN (SELECT v.cycle, string_agg(CAST(n.qubit AS VARCHAR), ',' ORDER BY n.qubit) FILTER (n.date > p.date) AS ids, CAST(count(*) FILTER (n.date > p.date) AS INT) AS n, arg_min(n.qubit, (n.date, n.qubit)) AS oldest, min(n.date) AS date
                 FROM valid v JOIN latest_q n ON n.cycle = v.cycle LEFT JOIN latest_q p ON p.cycle = v.prev AND p.qubit = n.qubit GROUP BY 1) q USING (cycle)
      LEFT JOIN (SELECT v.cycle, string_agg(n.edge_id, ',' ORDER BY n.edge_id) FILTER (n.date > p.date) AS ids, CAST(count(*) FILTER (n.date > p.date) AS INT) AS n, arg_min(n.edge_id, (n.date, n.edge_id)) AS oldest, min(n.date) AS date
                 FROM valid v JOIN latest_e n ON n.cycle = v.cycle LEFT JOIN latest_e p ON p.cycle = v.prev AND p.edge_id = n.edge_id GROUP BY 1) e USING (cycle)""",
    "max_qubit_age_seconds max_edge_age_seconds",
)(
    lambda s, d: metrics(s, d).select(
        "cycle", "backend", F.array_join(F.col("qubits_calibrated").cast("array<string>"), ",").alias("qubits"), "num_qubits_calibrated", "oldest_qubit", "max_qubit_age_seconds", F.array_join("edges_calibrated", ",").alias("edges_listed"), "num_edges_calibrated", "oldest_edge", "max_edge_age_seconds"
    )
)
query("join_prev_cycle", "SELECT v.cycle, n.qubit, n.date, p.date AS before FROM valid v JOIN latest_q n ON n.cycle = v.cycle LEFT JOIN latest_q p ON p.cycle = v.prev AND p.qubit = n.qubit")(
    lambda s, d: latest(s, d, "qubit").join(Y.previous_cycle(P.cycles(s, d)).select("cycle", "prev"), "cycle").join(latest(s, d, "qubit").select(F.col("cycle").alias("prev"), "qubit", F.col("date").alias("before")), ["prev", "qubit"], "left").select("cycle", "qubit", "date", "before")
)
query("join_interval_view", "SELECT v.cycle, v.backend, v.started, v.prev_started, v.price, s.jobs, (v.started - v.prev_started) / 1e6 AS interval_seconds FROM valid v LEFT JOIN (SELECT l_orderkey AS cycle, count(*) AS jobs FROM lineitem GROUP BY 1) s USING (cycle)")(
    lambda s, d: Y.interval_observations(Y.previous_cycle(P.cycles(s, d)), P.cycles(s, d), P.properties(s, d).groupBy("cycle").agg(F.count("*").alias("jobs")))
)
GATES = "SELECT cycle, qubit AS a, qubit + 1 AS b, edge_id, gate, reported FROM props"
query(
    "join_edge_operational",
    f"""WITH g AS (SELECT cycle, edge_id, a, b, bool_or(coalesce(reported, true)) AS any_gate, bool_and(reported IS NOT NULL) AS gates_explicit, count(*) FILTER (coalesce(reported, true)) AS working_gates, count(*) AS gate_count FROM ({GATES}) GROUP BY ALL),
        s AS (SELECT cycle, qubit, bool_and(coalesce(reported, true)) AS effective, bool_and(reported IS NOT NULL) AS explicit FROM props GROUP BY ALL)
      SELECT g.cycle, g.edge_id, g.any_gate, g.working_gates, g.gate_count, bool_and(coalesce(s.effective, true)) AS all_endpoints, g.any_gate AND bool_and(coalesce(s.effective, true)) AS effective, g.gates_explicit AND bool_and(coalesce(s.explicit, false)) AS fully_explicit
      FROM (SELECT *, unnest([a, b]) AS qubit FROM g) g LEFT JOIN s USING (cycle, qubit) GROUP BY g.cycle, g.edge_id, g.any_gate, g.working_gates, g.gate_count, g.gates_explicit""",
)(
    lambda s, d: Y.edge_operational(P.properties(s, d).select("cycle", F.col("qubit").alias("a"), (F.col("qubit") + 1).alias("b"), "edge_id", "gate", "reported"), P.properties(s, d).select("cycle", "qubit", "reported")).select(
        "cycle", "edge_id", "any_gate", "working_gates", "gate_count", "all_endpoints", "effective", "fully_explicit"
    )
)
query("agg_filtered", "SELECT backend, count(*) AS n, count(*) FILTER (success) AS ok, string_agg(CAST(cycle AS VARCHAR), ',' ORDER BY cycle) FILTER (cycle < 100) AS few FROM cycles GROUP BY 1")(
    lambda s, d: P.cycles(s, d).groupBy("backend").agg(F.count("*").alias("n"), F.count_if("success").alias("ok"), F.expr("array_join(array_sort(collect_list(cycle) FILTER (WHERE cycle < 100)), ',')").alias("few"))
)
query("distinct_on_edge_latest", "SELECT gate AS backend, edge_id, date, value FROM props QUALIFY row_number() OVER (PARTITION BY gate, edge_id ORDER BY date DESC, value DESC) = 1")(
    lambda s, d: P.properties(s, d).groupBy(F.col("gate").alias("backend"), "edge_id").agg(F.max(F.struct("date", "value")).alias("v")).select("backend", "edge_id", "v.date", "v.value")
)
query("top_n_recent", "SELECT cycle, started FROM cycles ORDER BY started DESC, cycle LIMIT 10")(lambda s, d: P.cycles(s, d).select("cycle", "started").orderBy(F.desc("started"), "cycle").limit(10))
query("sort_multi", "SELECT backend, cycle, started FROM cycles ORDER BY backend, started DESC, cycle")(lambda s, d: P.cycles(s, d).select("backend", "cycle", "started").orderBy("backend", F.desc("started"), "cycle"))
SEQ = "SELECT *, row_number() OVER (ORDER BY backend, started, cycle) AS sequence_no FROM valid"


def items(s: SparkSession, d: str) -> D:
    return Y.sequence(Y.previous_cycle(P.cycles(s, d)))


query("win_row_number", f"SELECT cycle, sequence_no FROM ({SEQ})")(lambda s, d: items(s, d).select("cycle", "sequence_no"))
query("bf_freeze_inputs", f"SELECT sequence_no, cycle, backend, started, prev, prev_started FROM ({SEQ})")(lambda s, d: items(s, d).select("sequence_no", "cycle", "backend", "started", "prev", "prev_started"))
query("bf_batch", f"SELECT cycle, sequence_no FROM ({SEQ}) WHERE sequence_no > 500 AND sequence_no <= 1000")(lambda s, d: Y.batch(items(s, d), 500, 500).select("cycle", "sequence_no"))
query("union_distinct", f"WITH b AS (SELECT * FROM ({SEQ}) WHERE sequence_no > 500 AND sequence_no <= 1000) SELECT cycle FROM b UNION SELECT prev FROM b WHERE prev IS NOT NULL")(lambda s, d: Y.with_previous(Y.batch(items(s, d), 500, 500)))
query("bf_status", f"SELECT count(*) AS total_cycles, count(*) FILTER (sequence_no <= 1000) AS processed_cycles, max(sequence_no) FILTER (sequence_no <= 1000) AS last_sequence_no, arg_max(cycle, sequence_no) FILTER (sequence_no <= 1000) AS last_cycle, CASE WHEN count(*) FILTER (sequence_no <= 1000) = count(*) THEN 'completed' ELSE 'running' END AS status FROM ({SEQ})")(
    lambda s, d: Y.run_status(items(s, d), 1000)
)
query("bf_recompute", "SELECT v.cycle, CAST(count(*) FILTER (n.date > p.date) AS INT) AS num_qubits_calibrated FROM valid v LEFT JOIN latest_q n ON n.cycle = v.cycle LEFT JOIN latest_q p ON p.cycle = v.prev AND p.qubit = n.qubit GROUP BY 1")(
    lambda s, d: metrics(s, d).select("cycle", "num_qubits_calibrated")
)


def quarantined(s: SparkSession, d: str) -> tuple[D, D, D]:
    c = P.cycles(s, d).withColumn("error_message", F.when(F.col("cycle") % 2 == 0, "late").otherwise(""))
    return Y.quarantine(c, c.where("success").select("cycle"), F.when(F.col("cycle") % 11 == 0, "payload is not an object"))


query("bf_quarantine", "SELECT cycle, success AND cycle % 11 <> 0 AS success, CASE WHEN success AND cycle % 11 = 0 THEN concat_ws(' | ', CASE WHEN cycle % 2 = 0 THEN 'late' END, 'payload is not an object') WHEN cycle % 2 = 0 THEN 'late' ELSE '' END AS error_message FROM cycles")(
    lambda s, d: quarantined(s, d)[0].select("cycle", "success", "error_message")
)
query("bf_quarantine_metrics", "SELECT cycle FROM cycles WHERE success AND cycle % 11 <> 0")(lambda s, d: quarantined(s, d)[1])
query("bf_quarantine_audit", "SELECT cycle, 'payload is not an object' AS reason FROM cycles WHERE success AND cycle % 11 = 0")(lambda s, d: quarantined(s, d)[2].select("cycle", "reason"))
query("sink_failed_cycle", "SELECT cycle, substr(repeat('x', CAST(cycle % 6000 AS INT)), 1, 5000) AS error_message FROM cycles WHERE NOT success")(
    lambda s, d: Y.failed_rows(P.cycles(s, d).withColumn("error_message", F.expr("repeat('x', cast(cycle % 6000 as int))"))).select("cycle", "error_message")
)
def upserted(s: SparkSession, d: str) -> D:
    """The table is written by backend, a third of its rows are upserted, and it is read again."""
    rows = P.cycles(s, d).select("cycle", "backend", "price")
    path = f"{Scratch(s).folder}/cycles"
    for new in (rows, rows.where("cycle % 3 = 0").withColumn("price", F.col("price") * 2)):
        files.upsert_table(path, new, ["cycle"], "backend")
    return s.read.parquet(path).select("cycle", "price")


query("sink_upsert", "SELECT cycle, CASE WHEN cycle % 3 = 0 THEN price * 2 ELSE price END AS price FROM cycles")(
    lambda s, d: upserted(s, d)
)
query("union_all_obs", f"SELECT backend, component_id, t FROM dedup WHERE component_type = 'qubit' UNION ALL SELECT backend, component_id, t FROM dedup WHERE component_type = 'edge' UNION ALL SELECT backend, '' , t FROM status")(
    lambda s, d: (lambda o: o.where("component_type = 'qubit'").select("backend", "component_id", "t").unionByName(o.where("component_type = 'edge'").select("backend", "component_id", "t")).unionByName(P.status(s, d).select("backend", F.lit("").alias("component_id"), "t")))(S.latest_observation(P.observations(s, d)))
)
ORDER_AGE = "SELECT cycle, CASE WHEN finished IS NOT NULL THEN greatest(0.0::DOUBLE, (finished - started) / 1e6) END AS seconds FROM cycles"
query("seconds_between", ORDER_AGE, "seconds")(lambda s, d: P.cycles(s, d).select("cycle", seconds_between(F.col("started"), F.col("finished")).alias("seconds")))

# ---------------------------------------------------------------- statistics
PAIRS = f"""SELECT backend, component_type, outcome, predictor, y, x FROM (SELECT backend, component_type, unnest(['calibration_event_count', 'drift_rms']) AS outcome, unnest([calibration_event_count::DOUBLE, drift_rms]) AS y, load_current, load_mean_8h
      FROM (SELECT o.*, l.load_current, l.load_mean_8h FROM ({OUTCOMES}) o LEFT JOIN load l USING (backend, t))) a, LATERAL (SELECT unnest(['load_current', 'load_mean_8h']) AS predictor, unnest([a.load_current, a.load_mean_8h]) AS x)"""
RANKED = f"""SELECT *, rank() OVER (PARTITION BY backend, component_type, outcome, predictor ORDER BY x) + (count(*) OVER (PARTITION BY backend, component_type, outcome, predictor, x) - 1) / 2.0::DOUBLE AS rx,
      rank() OVER (PARTITION BY backend, component_type, outcome, predictor ORDER BY y) + (count(*) OVER (PARTITION BY backend, component_type, outcome, predictor, y) - 1) / 2.0::DOUBLE AS ry FROM ({PAIRS}) WHERE x IS NOT NULL AND y IS NOT NULL"""


def outcome_load(s: SparkSession, d: str) -> D:
    return M.grid_outcomes(events(s, d), grid(s, d), GRID).join(load(s, d).select("backend", "t", "load_current", "load_mean_8h"), ["backend", "t"], "left")


def correlated(s: SparkSession, d: str) -> D:
    return Z.correlations(outcome_load(s, d), M.KIND, ["calibration_event_count", "drift_rms"], ["load_current", "load_mean_8h"])


CORR = f"""SELECT backend, component_type, outcome, predictor, method, count(*) AS sample_count, CASE WHEN count(*) >= 8 AND max(x) > min(x) AND max(y) > min(y) THEN covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) END AS correlation
      FROM (SELECT backend, component_type, outcome, predictor, 'pearson' AS method, x, y FROM ({RANKED}) UNION ALL SELECT backend, component_type, outcome, predictor, 'spearman', rx, ry FROM ({RANKED})) GROUP BY ALL"""
query("stat_correlations", CORR, "correlation")(correlated)
query("win_rank_avg", f"SELECT backend, component_type, outcome, predictor, x, rx FROM ({RANKED})", "x rx")(
    lambda s, d: Z.ranked(Z.pairs(outcome_load(s, d), M.KIND, ["calibration_event_count", "drift_rms"], ["load_current", "load_mean_8h"]).where("x IS NOT NULL AND y IS NOT NULL"), [*M.KIND, "outcome", "predictor"], {"x": "rx"}).select(
        *M.KIND, "outcome", "predictor", "x", "rx"
    )
)
QUERIES["stat_correlation_p_values"] = lambda s, d: Z.with_p(correlated(s, d))
query("win_shift_grid", f"SELECT backend, component_type, t, lag(calibration_event_count, 2) OVER w AS lag_2, lead(calibration_event_count, 1) OVER w AS lead_1 FROM ({OUTCOMES}) WINDOW w AS (PARTITION BY backend, component_type ORDER BY t)")(
    lambda s, d: Z.lagged(M.grid_outcomes(events(s, d), grid(s, d), GRID), M.KIND, "t", "calibration_event_count", [2, -1]).select(*M.KIND, "t", "lag_2", "lead_1")
)
query(
    "stat_lagged",
    f"""SELECT backend, component_type, outcome, predictor, method, count(*) AS sample_count, CASE WHEN count(*) >= 8 AND max(x) > min(x) AND max(y) > min(y) THEN covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) END AS correlation FROM (
        WITH lg AS (SELECT backend, component_type, calibration_event_count::DOUBLE AS y, lag(load_current, 1) OVER w AS lag_1, lead(load_current, 1) OVER w AS lead_1 FROM (SELECT o.*, l.load_current FROM ({OUTCOMES}) o LEFT JOIN load l USING (backend, t)) WINDOW w AS (PARTITION BY backend, component_type ORDER BY t)),
          pr AS (SELECT backend, component_type, 'calibration_event_count' AS outcome, 'lag_1' AS predictor, y, lag_1 AS x FROM lg UNION ALL SELECT backend, component_type, 'calibration_event_count', 'lead_1', y, lead_1 FROM lg)
        SELECT backend, component_type, outcome, predictor, 'pearson' AS method, x, y FROM pr WHERE x IS NOT NULL UNION ALL
        SELECT backend, component_type, outcome, predictor, 'spearman', rank() OVER (PARTITION BY backend, component_type, predictor ORDER BY x) + (count(*) OVER (PARTITION BY backend, component_type, predictor, x) - 1) / 2.0::DOUBLE,
          rank() OVER (PARTITION BY backend, component_type, predictor ORDER BY y) + (count(*) OVER (PARTITION BY backend, component_type, predictor, y) - 1) / 2.0::DOUBLE FROM pr WHERE x IS NOT NULL) GROUP BY ALL""",
    "correlation",
)(lambda s, d: Z.correlations(Z.lagged(outcome_load(s, d), M.KIND, "t", "load_current", [1, -1]), M.KIND, ["calibration_event_count"], ["lag_1", "lead_1"]))
BH = "SELECT backend, component_type, component_id, p FROM (SELECT backend, component_type, component_id, 1.0::DOUBLE / (1 + count(*)) AS p FROM ev GROUP BY ALL)"
query(
    "stat_bh",
    f"SELECT backend, component_type, component_id, p, least(1.0, min(p * n / k) OVER (PARTITION BY backend ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM (SELECT *, row_number() OVER (PARTITION BY backend ORDER BY p) AS k, count(*) OVER (PARTITION BY backend) AS n FROM ({BH}))",
    "p q",
)(lambda s, d: Z.benjamini_hochberg(events(s, d).groupBy(*S.COMPONENT).agg(F.try_divide(F.lit(1.0), 1 + F.count("*")).alias("p")), "p", "q", ["backend"]))
same("win_bh_running_min", "stat_bh")
PANEL = f"SELECT o.component_type, o.backend, o.t, o.calibration_event_count::DOUBLE AS y, (o.t // {GRID * MINUTE} * (1 + length(o.backend)) % 17)::DOUBLE AS x FROM ({OUTCOMES}) o JOIN (SELECT max(lo) AS lo, min(hi) AS hi FROM (SELECT backend, min(t) AS lo, max(t) AS hi FROM grid GROUP BY 1)) b ON o.t BETWEEN b.lo AND b.hi"
WITHIN = f"SELECT *, y - avg(y) OVER (PARTITION BY component_type, backend) - avg(y) OVER (PARTITION BY component_type, t) + avg(y) OVER (PARTITION BY component_type) AS yw, x - avg(x) OVER (PARTITION BY component_type, backend) - avg(x) OVER (PARTITION BY component_type, t) + avg(x) OVER (PARTITION BY component_type) AS xw FROM ({PANEL})"


def panel(s: SparkSession, d: str) -> D:
    o = M.grid_outcomes(events(s, d), grid(s, d), GRID)
    b = grid(s, d).groupBy("backend").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"))
    x = F.expr(f"cast((t div {GRID * MINUTE}) * (1 + length(backend)) % 17 as double)")
    return o.join(b, F.col("t").between(F.col("lo"), F.col("hi"))).select("component_type", "backend", "t", F.col("calibration_event_count").cast("double").alias("y"), x.alias("x"))


query("stat_residualize", f"SELECT component_type, backend, t, yw AS y_within, xw AS x_within FROM ({WITHIN})", "y_within x_within")(lambda s, d: Z.demeaned(panel(s, d), ["component_type"], "backend", "t", ["y", "x"]).select("component_type", "backend", "t", "y_within", "x_within"))
query("stat_cluster_meat", f"SELECT component_type, sum(s * s) AS meat FROM (SELECT component_type, t, sum(xw * yw) AS s FROM ({WITHIN}) GROUP BY ALL) GROUP BY ALL", "meat", 2)(
    lambda s, d: Z.cluster_meat(Z.demeaned(panel(s, d), ["component_type"], "backend", "t", ["y", "x"]).withColumn("score", F.col("y_within") * F.col("x_within")), ["component_type"], "t", "score")
)
query(
    "stat_two_way_fe",
    f"""WITH w AS ({WITHIN}), b AS (SELECT component_type, count(*) AS n, count(DISTINCT backend) AS entities, count(DISTINCT t) AS times, sum(xw * xw) AS sxx, sum(xw * yw) AS sxy, sum(yw * yw) AS syy FROM w GROUP BY 1),
        e AS (SELECT w.*, yw - sxy / sxx * xw AS u FROM w JOIN b USING (component_type)),
        m AS (SELECT component_type, sum(s * s) AS me FROM (SELECT component_type, backend, sum(xw * u) AS s FROM e GROUP BY ALL) GROUP BY 1), k AS (SELECT component_type, sum(s * s) AS mt FROM (SELECT component_type, t, sum(xw * u) AS s FROM e GROUP BY ALL) GROUP BY 1),
        h AS (SELECT component_type, sum(xw * u * xw * u) AS mw, sum(u * u) AS ssr FROM e GROUP BY 1)
      SELECT component_type, n, entities, times, sxy / sxx AS coefficient, CASE WHEN me + mt - mw > 0 THEN sqrt(CASE WHEN me + mt - mw > 0 THEN me + mt - mw END) / sxx END AS standard_error, (syy - ssr) / syy AS within_r2 FROM b JOIN m USING (component_type) JOIN k USING (component_type) JOIN h USING (component_type)""",
    "coefficient standard_error within_r2",
)(lambda s, d: Z.two_way_balanced(panel(s, d), ["component_type"], "backend", "t", "y", "x"))
QUERIES["stat_two_way_fe_unbalanced"] = lambda s, d: Z.two_way(outcome_load(s, d), ["component_type"], "backend", "t", ["drift_rms", "calibration_event_count"], ["load_current", "load_mean_8h"])

# ---------------------------------------------------------------- studies


def cad(s: SparkSession, d: str) -> D:
    return M.cadence(events(s, d), P.coverage(s, d))


def weekly(s: SparkSession, d: str) -> D:
    return U.weekly_counts(events(s, d), P.coverage(s, d))


query("agg_weekly_counts", "SELECT * FROM weekly")(weekly)
same("win_tumbling_origin", "agg_weekly_counts")
query("agg_weekly_extremes", "SELECT * FROM extremes", "peak_ratio")(lambda s, d: U.weekly_extremes(weekly(s, d)))
query("agg_best_week", "SELECT * FROM extremes QUALIFY row_number() OVER (PARTITION BY backend ORDER BY peak_ratio DESC, peak DESC, week) = 1", "peak_ratio")(lambda s, d: U.best_week(U.weekly_extremes(weekly(s, d))))
query("agg_weekly_volume", "SELECT backend, week, CAST(sum(n) AS BIGINT) AS events FROM weekly GROUP BY ALL")(lambda s, d: weekly(s, d).groupBy("backend", "week").agg(F.sum("n").alias("events")))
query("agg_full_period_ratio", "SELECT * FROM full_ratio", "max_min_ratio")(lambda s, d: U.full_period_ratio(cad(s, d)))
query("agg_choose_backend", "SELECT backend, max_min_ratio FROM full_ratio ORDER BY max_min_ratio DESC NULLS LAST, backend LIMIT 1", "max_min_ratio")(lambda s, d: U.full_period_ratio(cad(s, d)).orderBy(F.desc_nulls_last("max_min_ratio"), "backend").limit(1).select("backend", "max_min_ratio"))
query("agg_value_change_diag", "SELECT backend, component_id, count(*) AS events, count(*) FILTER (drift_property_count > 0) AS events_with_change, count(*) FILTER (quality_property_count > 0) AS events_with_adverse, count(*) FILTER (drift_property_count > 0) / count(*)::DOUBLE AS change_fraction FROM ev JOIN (SELECT backend, most_edge AS component_id FROM full_ratio) USING (backend, component_id) WHERE component_type = 'edge' GROUP BY ALL", "change_fraction")(
    lambda s, d: U.value_change(events(s, d), U.full_period_ratio(cad(s, d)))
)
CONST = "SELECT backend, component_id, property_key, count(value) AS n, count(DISTINCT value) AS distinct_values, min(value) AS least, max(value) AS most, coalesce(bool_and(value = 1.0), false) AS constant_one FROM obs WHERE component_type = 'edge' AND property_name = 'readout_error' GROUP BY ALL"
query("agg_constant_one", CONST)(lambda s, d: U.constant_one(P.observations(s, d), "readout_error"))
query("agg_constant_one_edge", f"SELECT backend, component_id, bool_or(constant_one) AS any_constant_one, count(*) FILTER (constant_one) AS constant_series FROM ({CONST}) GROUP BY ALL")(lambda s, d: U.constant_one_edge(U.constant_one(P.observations(s, d), "readout_error")))
query("agg_anchor_observations", "SELECT backend, t, min(observed) AS first_observed, max(observed) AS last_observed, count(*) AS poll_count FROM anchors GROUP BY ALL")(lambda s, d: U.anchor_observations(P.anchors(s, d)))


def near(s: SparkSession, d: str) -> D:
    return U.aligned(S.reported_change(P.observations(s, d)), P.anchors(s, d))


query("join_asof_nearest", f"SELECT backend, component_id, property_key, t, previous_t AS anchor_before_t, next_t AS anchor_after_t, nearest_t, (t - nearest_t) / {MINUTE}.0::DOUBLE AS signed_minutes, abs(t - nearest_t) / {MINUTE}.0::DOUBLE AS absolute_minutes FROM near", "signed_minutes absolute_minutes")(
    lambda s, d: near(s, d).select("backend", "component_id", "property_key", "t", "anchor_before_t", "anchor_after_t", "nearest_t", "signed_minutes", "absolute_minutes")
)
MINUTES_T = (1, 5, 15, 30, 60, 120, 240, 480, 720, 1440)
DISTANCES = {"within": "abs(t - nearest_t)", "before_next": "next_t - t", "after_previous": "t - previous_t"}
WITHIN_T = ", ".join(f"avg(CASE WHEN {x} BETWEEN 0 AND {t * MINUTE} THEN 1.0 ELSE 0.0 END) AS fraction_{k}_{t}m" for k, x in DISTANCES.items() for t in MINUTES_T)
query(
    "agg_alignment_summary",
    f"""SELECT backend, count(*) AS n, median((t - nearest_t) / {MINUTE}.0::DOUBLE) AS median_signed, median(abs(t - nearest_t) / {MINUTE}.0::DOUBLE) AS median_absolute, quantile_cont(abs(t - nearest_t) / {MINUTE}.0::DOUBLE, 0.9) AS p90_absolute, quantile_cont(abs(t - nearest_t) / {MINUTE}.0::DOUBLE, 0.95) AS p95_absolute,
        avg(CASE WHEN t < nearest_t THEN 1.0 ELSE 0.0 END) AS fraction_before, avg(CASE WHEN t = nearest_t THEN 1.0 ELSE 0.0 END) AS fraction_exact, avg(CASE WHEN t > nearest_t THEN 1.0 ELSE 0.0 END) AS fraction_after, {WITHIN_T} FROM near GROUP BY 1""",
    "median_signed median_absolute p90_absolute p95_absolute fraction_before fraction_exact fraction_after " + " ".join(f"fraction_{k}_{t}m" for k in DISTANCES for t in MINUTES_T),
)(lambda s, d: U.alignment_summary(near(s, d), ["backend"]))
GROUPED_CHANGE = f"SELECT g.*, coalesce(g.value <> g.previous_value, false) AS value_changed FROM grouped g"
query("sess_anchor_bucket", f"SELECT {C}, property_key, t, number FROM grouped")(lambda s, d: S.anchored(S.reported_change(P.observations(s, d)), S.COMPONENT, "t", TOLERANCE * MINUTE).select(*C.split(", "), "property_key", "t", "number"))
query("agg_anchor_events", f"SELECT {C}, number AS bucket, min(t) AS t, max(t) AS bucket_end, count(*) AS row_count, count(DISTINCT property_name) AS families, count(*) FILTER (value_changed) AS changed_count, bool_or(value_changed) AS any_changed, string_agg(DISTINCT property_name, ';' ORDER BY property_name) AS family_list FROM ({GROUPED_CHANGE}) GROUP BY ALL")(
    lambda s, d: U.anchor_events(S.anchored(S.reported_change(P.observations(s, d)), S.COMPONENT, "t", TOLERANCE * MINUTE), S.COMPONENT)
)

# ---------------------------------------------------------------- graphs and compiler usage


def coupling(s: SparkSession, d: str) -> D:
    return U.undirected(P.topology(s, d))


query("graph_undirected_edges", "SELECT * FROM edges")(coupling)
DEG = "SELECT edges.backend, CAST(a AS VARCHAR) || '-' || CAST(b AS VARCHAR) AS component_id, a, b, x.d + y.d AS degree_sum, greatest(x.d, y.d) AS degree_max, least(x.d, y.d) AS degree_min FROM edges JOIN degree x ON x.node = a AND x.backend = edges.backend JOIN degree y ON y.node = b AND y.backend = edges.backend"
query("graph_degree", DEG)(lambda s, d: U.edge_degrees(coupling(s, d)))
QUERIES["graph_edge_betweenness"] = lambda s, d: U.edge_betweenness(coupling(s, d))
NAMED = "SELECT *, CASE component_type WHEN 'qubit' THEN CAST(x AS VARCHAR) ELSE CAST(least(x, (x + 1) % 400) AS VARCHAR) || '-' || CAST(greatest(x, (x + 1) % 400) AS VARCHAR) END AS name FROM (SELECT *, CAST(component_id AS BIGINT) % 400 AS x FROM {0})"
CTES["rates"] = f"SELECT backend, component_type, name AS component_id, CAST(sum(n) AS BIGINT) AS n, round(sum(n) / 30.0::DOUBLE, 6) AS rate FROM ({NAMED.format('cad')}) GROUP BY ALL"


def rates(s: SparkSession, d: str) -> D:
    named = cad(s, d).withColumn("component_id", P.coupling_id(F.col("component_id"), F.col("component_type")))
    return named.groupBy("backend", "component_type", "component_id").agg(F.sum("calibration_event_count").alias("n"), F.round(F.sum("calibration_event_count") / 30.0, 6).alias("rate"))


query("graph_topology_table", "SELECT k.*, r.n, r.rate FROM (SELECT DISTINCT backend, 'qubit' AS component_type, CAST(unnest([a, b]) AS VARCHAR) AS component_id FROM edges UNION ALL SELECT backend, 'edge', CAST(a AS VARCHAR) || '-' || CAST(b AS VARCHAR) FROM edges) k LEFT JOIN rates r USING (backend, component_type, component_id)", "rate")(
    lambda s, d: U.topology_table(coupling(s, d), rates(s, d))
)
query("topology_frequency", "SELECT backend, component_type, count(*) AS components, count(r.n) AS calibrated, CAST(sum(coalesce(r.n, 0)) AS BIGINT) AS events FROM (SELECT DISTINCT backend, 'qubit' AS component_type, CAST(unnest([a, b]) AS VARCHAR) AS component_id FROM edges UNION ALL SELECT backend, 'edge', CAST(a AS VARCHAR) || '-' || CAST(b AS VARCHAR) FROM edges) k LEFT JOIN rates r USING (backend, component_type, component_id) GROUP BY ALL")(
    lambda s, d: U.topology_table(coupling(s, d), rates(s, d)).groupBy("backend", "component_type").agg(F.count("*").alias("components"), F.count("n").alias("calibrated"), F.sum(F.coalesce("n", F.lit(0))).alias("events"))
)
CTES |= {
    "cusage": "SELECT backend, level, component_id, count(DISTINCT run_id) AS used_runs, sum(ops) AS ops, avg(share) AS mean_share FROM (SELECT *, ops / sum(ops) OVER (PARTITION BY backend, level, run_id)::DOUBLE AS share FROM (SELECT backend, level, run_id, component_id, CAST(sum(ops) AS BIGINT) AS ops FROM compiled GROUP BY ALL)) GROUP BY ALL",
    "cruns": "SELECT backend, level, count(DISTINCT run_id) AS total_runs FROM compiled GROUP BY ALL",
    "cconst": f"SELECT backend, name AS component_id, bool_or(one) AS any_constant_one, count(*) FILTER (one) AS constant_series FROM (SELECT backend, name, property_key, coalesce(bool_and(value = 1.0), false) AS one FROM (SELECT *, CASE WHEN x % 6 = 1 THEN 1.0 ELSE v END AS value FROM ({NAMED.format('(SELECT *, value AS v FROM obs)').replace('SELECT *, CASE', 'SELECT * EXCLUDE (value), CASE', 1)})) WHERE component_type = 'edge' AND property_name = 'readout_error' GROUP BY ALL) GROUP BY ALL",
    "etab": f"""SELECT g.backend, c.level, g.component_id, g.degree_sum, c.total_runs, coalesce(u.used_runs, 0) AS used_runs, CAST(coalesce(u.ops, 0) AS BIGINT) AS ops, coalesce(u.mean_share, 0.0::DOUBLE) AS mean_share, r.n AS calibration_event_count, r.rate AS calibration_events_per_day,
        coalesce(k.any_constant_one, false) AS any_constant_one, coalesce(k.constant_series, 0) AS constant_series, coalesce(u.used_runs, 0) / c.total_runs::DOUBLE AS presence, coalesce(u.ops, 0) / sum(coalesce(u.ops, 0)) OVER (PARTITION BY g.backend, c.level)::DOUBLE AS global_share
      FROM ({DEG}) g JOIN cruns c USING (backend) LEFT JOIN cusage u ON u.backend = g.backend AND u.level = c.level AND u.component_id = g.component_id
      LEFT JOIN (SELECT * FROM rates WHERE component_type = 'edge') r ON r.backend = g.backend AND r.component_id = g.component_id LEFT JOIN cconst k ON k.backend = g.backend AND k.component_id = g.component_id""",
    "escoped": "SELECT *, 'all' AS scope FROM etab UNION ALL SELECT *, 'filtered' FROM etab WHERE NOT any_constant_one",
}


def edge_table(s: SparkSession, d: str) -> D:
    obs = P.observations(s, d)
    ones = obs.withColumn("value", F.when(F.col("component_id").cast("long") % P.NODES % 6 == 1, 1.0).otherwise(F.col("value")))
    ones = ones.withColumn("component_id", P.coupling_id(F.col("component_id"), F.col("component_type")))
    rate = rates(s, d).withColumnsRenamed({"n": "calibration_event_count", "rate": "calibration_events_per_day"})
    return U.edge_table(U.edge_degrees(coupling(s, d)).select("backend", "component_id", "degree_sum"), P.compiled(s, d), rate, U.constant_one_edge(U.constant_one(ones, "readout_error")))


query("join_topology_left", "SELECT * FROM etab", "mean_share calibration_events_per_day presence global_share", 6)(edge_table)
query("fillna_cast", "SELECT backend, level, CAST(sum(used_runs) AS BIGINT) AS used_runs, count(*) FILTER (used_runs = 0) AS unused, count(*) FILTER (any_constant_one) AS constant_edges, CAST(sum(constant_series) AS BIGINT) AS constant_series FROM etab GROUP BY ALL")(
    lambda s, d: edge_table(s, d).groupBy("backend", "level").agg(F.sum("used_runs").alias("used_runs"), F.count_if(F.col("used_runs") == 0).alias("unused"), F.count_if("any_constant_one").alias("constant_edges"), F.sum("constant_series").alias("constant_series"))
)
query("circ_run_share", "SELECT * FROM shares", "within_run_share")(lambda s, d: U.run_share(P.usage(s, d)))
query("win_transform_total", "SELECT backend, level, component_id, ops, ops / sum(ops) OVER (PARTITION BY backend, level)::DOUBLE AS global_share FROM edge_use", "global_share", 6)(lambda s, d: U.edge_usage(P.usage(s, d)).select("backend", "level", "component_id", "ops", "global_share"))
query("agg_edge_usage", "SELECT *, ops / sum(ops) OVER (PARTITION BY backend, level)::DOUBLE AS global_share FROM edge_use", "mean_share presence global_share", 6)(lambda s, d: U.edge_usage(P.usage(s, d)))
query("circ_edge_counts", "SELECT l_orderkey AS circuit, least(l_linenumber, l_suppkey % 5) AS a, greatest(l_linenumber, l_suppkey % 5) AS b, count(*) AS n FROM lineitem WHERE l_quantity < 25 GROUP BY ALL")(
    lambda s, d: U.instruction_pairs(P.table(s, d, "lineitem").where("l_quantity < 25").select(F.col("l_orderkey").alias("circuit"), F.array(F.col("l_linenumber").cast("long"), F.col("l_suppkey") % 5).alias("qubits")))
)
query("circ_logical_2q", "SELECT l_orderkey AS circuit, count(*) FILTER (l_quantity < 25) AS two_qubit FROM lineitem GROUP BY 1")(
    lambda s, d: P.table(s, d, "lineitem").select(F.col("l_orderkey").alias("circuit"), F.when(F.col("l_quantity") < 25, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("q")).groupBy("circuit").agg(F.count_if(F.size("q") == 2).alias("two_qubit"))
)
SUITE = """SELECT family, replace(name, '#', CAST(n AS VARCHAR)) AS circuit_name, CAST(n AS INT) AS n, CAST(layers AS INT) AS layers,
        CAST(CASE family WHEN 'GHZ' THEN n - 1 WHEN 'QFT' THEN n * (n - 1) // 2 + n // 2 WHEN 'Bernstein-Vazirani' THEN ceil((n - 1) / 2) WHEN 'QAOA-ring' THEN layers * n WHEN 'Ising-Trotter' THEN layers * (n - 1)
          WHEN 'Random-brickwork' THEN layers // 2 * (n // 2 + (n - 1) // 2) ELSE layers * (n * (n - 1) // 2) END AS BIGINT) AS two_qubit_ops
      FROM (SELECT family, name, unnest(sizes) AS n, layers FROM (VALUES ('GHZ', 'ghz_#', [4, 8, 16, 24], 1), ('QFT', 'qft_#', [4, 8, 12], 1), ('Bernstein-Vazirani', 'bv_#', [5, 9, 17, 25], 1), ('QAOA-ring', 'qaoa_ring_#_p2', [6, 12, 18, 24], 2),
        ('Ising-Trotter', 'ising_#_l4', [8, 16, 24], 4), ('Random-brickwork', 'random_brickwork_#_l6', [8, 16, 24], 6), ('Dense-entangling', 'dense_#_l2', [6, 10, 14], 2)) v(family, name, sizes, layers))"""


def suite_runs(s: SparkSession, d: str) -> D:
    """The compiled runs by the circuit that they are of: run k is of the (k mod 24)th by name."""
    named = U.circuit_suite(s).select((F.row_number().over(Window.orderBy("circuit_name")) - 1).cast("long").alias("k"), "circuit_name")
    return P.compiled(s, d).withColumn("k", F.col("run_id") % len(U.circuit_names())).join(named, "k").select("run_id", "circuit_name", "ops")


query(
    "circ_suite",
    f"""WITH suite AS ({SUITE}), named AS (SELECT *, row_number() OVER (ORDER BY circuit_name) - 1 AS k FROM suite)
      SELECT family, circuit_name, n, layers, two_qubit_ops, count(DISTINCT run_id) AS runs, CAST(sum(ops) AS BIGINT) AS compiled_ops, sum(ops) / (count(DISTINCT run_id) * max(two_qubit_ops))::DOUBLE AS overhead
      FROM named LEFT JOIN compiled ON run_id % 24 = k GROUP BY ALL""",
    "overhead",
)(lambda s, d: U.suite_overhead(U.circuit_suite(s), suite_runs(s, d)))
def usage_study(s: SparkSession, d: str) -> D:
    u = U.edge_usage(P.usage(s, d))
    return u.withColumn("degree", (F.col("component_id").cast("long") % 7).cast("double")).withColumn("load", (F.col("component_id").cast("long") * 3 % 11).cast("double"))


USE = "SELECT *, (CAST(component_id AS BIGINT) % 7)::DOUBLE AS degree, (CAST(component_id AS BIGINT) * 3 % 11)::DOUBLE AS load FROM edge_use"
query(
    "stat_spearman_compiler",
    f"""SELECT backend, level, 'ops' AS outcome, predictor, 'spearman' AS method, count(*) AS sample_count, CASE WHEN max(rx) > min(rx) AND max(ry) > min(ry) THEN covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) END AS correlation FROM
      (SELECT *, rank() OVER (PARTITION BY backend, level, predictor ORDER BY x) + (count(*) OVER (PARTITION BY backend, level, predictor, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY backend, level, predictor ORDER BY ops) + (count(*) OVER (PARTITION BY backend, level, predictor, ops) - 1) / 2.0::DOUBLE AS ry
       FROM (SELECT backend, level, ops, 'degree' AS predictor, degree AS x FROM ({USE}) UNION ALL SELECT backend, level, ops, 'load', load FROM ({USE}))) GROUP BY ALL HAVING count(*) >= 8""",
    "correlation",
)(lambda s, d: Z.correlations(usage_study(s, d), ["backend", "level"], ["ops"], ["degree", "load"]).where("method = 'spearman' AND sample_count >= 8"))
query(
    "stat_standardized_ols",
    f"""SELECT backend, level, n, (ry1 - r12 * ry2) / (1 - r12 * r12) AS beta_degree, (ry2 - r12 * ry1) / (1 - r12 * r12) AS beta_load, ((ry1 - r12 * ry2) * ry1 + (ry2 - r12 * ry1) * ry2) / (1 - r12 * r12) AS r2
      FROM (SELECT backend, level, count(*) AS n, corr(ln(1 + ops), degree) AS ry1, corr(ln(1 + ops), load) AS ry2, corr(degree, load) AS r12 FROM ({USE}) GROUP BY ALL)""",
    "beta_degree beta_load r2",
)(lambda s, d: Z.standardized_ols(usage_study(s, d), ["backend", "level"], "ops", ["degree", "load"], drop_constant=False))
RANKED = "rank() OVER (PARTITION BY backend, level, scope, p ORDER BY {0}) + (count(*) OVER (PARTITION BY backend, level, scope, p, {0}) - 1) / 2.0::DOUBLE"
CTES |= {
    "erho": f"""SELECT backend, level, scope, p, CASE WHEN max(x) > min(x) AND max(y) > min(y) THEN corr(rx, ry) END AS rho FROM
      (SELECT *, {RANKED.format('x')} AS rx, {RANKED.format('y')} AS ry FROM (SELECT backend, level, scope, 'share' AS p, mean_share AS x, calibration_events_per_day AS y FROM escoped UNION ALL SELECT backend, level, scope, 'presence', presence, calibration_events_per_day FROM escoped) WHERE y IS NOT NULL) GROUP BY ALL HAVING count(*) >= 8""",
    "ebeta": """SELECT backend, level, scope, (ry1 - r12 * ry2) / (1 - r12 * r12) AS beta, ((ry1 - r12 * ry2) * ry1 + (ry2 - r12 * ry1) * ry2) / (1 - r12 * r12) AS r2 FROM
      (SELECT backend, level, scope, corr(ln(1 + calibration_events_per_day), mean_share) AS ry1, corr(ln(1 + calibration_events_per_day), degree_sum) AS ry2, corr(mean_share, degree_sum) AS r12 FROM escoped WHERE calibration_events_per_day IS NOT NULL GROUP BY ALL HAVING count(*) > 4)""",
}
SCOPED = ", ".join(f"max({v}) FILTER (scope = '{k}'{e}) AS {n}_{k}" for n, v, e in (("rho_share", "rho", " AND p = 'share'"), ("rho_presence", "rho", " AND p = 'presence'")) for k in ("all", "filtered"))
BETAS = ", ".join(f"max({v}) FILTER (scope = '{k}') AS {v}_{k}" for v in ("beta", "r2") for k in ("all", "filtered"))
query(
    "agg_backend_summary",
    f"""SELECT * FROM (SELECT backend, level, count(*) AS edges, count(*) FILTER (any_constant_one) AS constant_edges, avg(CASE WHEN used_runs > 0 THEN 1.0 ELSE 0.0 END) AS used_all, avg(CASE WHEN used_runs > 0 THEN 1.0 ELSE 0.0 END) FILTER (NOT any_constant_one) AS used_filtered FROM etab GROUP BY ALL)
      LEFT JOIN (SELECT backend, level, {SCOPED} FROM erho GROUP BY ALL) USING (backend, level) LEFT JOIN (SELECT backend, level, {BETAS} FROM ebeta GROUP BY ALL) USING (backend, level)""",
    "used_all used_filtered rho_share_all rho_share_filtered rho_presence_all rho_presence_filtered beta_all beta_filtered r2_all r2_filtered",
)(lambda s, d: U.backend_summary(edge_table(s, d), ("degree_sum",), drop_constant=False))
query("join_summary_lookup", "SELECT backend, max(edges) FILTER (level = 0) AS edges_0, max(edges) FILTER (level = 1) AS edges_1, max(rho) FILTER (level = 0) AS rho_0, max(rho) FILTER (level = 1) AS rho_1 FROM (SELECT backend, level, count(*) AS edges FROM etab GROUP BY ALL) LEFT JOIN (SELECT backend, level, rho FROM erho WHERE scope = 'all' AND p = 'share') USING (backend, level) GROUP BY 1", "rho_0 rho_1")(
    lambda s, d: U.backend_summary(edge_table(s, d), ("degree_sum",), drop_constant=False).groupBy("backend").agg(*[F.max(F.when(F.col("level") == k, F.col(v))).alias(f"{n}_{k}") for n, v in (("edges", "edges"), ("rho", "rho_share_all")) for k in (0, 1)])
)
