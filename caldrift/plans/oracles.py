"""DuckDB SQL for the queries: common table expressions of the frames and operators, and a statement builder."""

from __future__ import annotations

import re

HOUR, MINUTE, GRID, TOLERANCE = 3_600_000_000, 60_000_000, 360, 60

CTES = {
    "obs": f"""SELECT event_type AS backend, CASE WHEN user_id % 2 = 0 THEN 'qubit' ELSE 'edge' END AS component_type,
        CAST(user_id AS VARCHAR) AS component_id, (['T1[s]','T2[s]','readout_error[]','cz:frequency[]'])[CAST(event_id % 4 + 1 AS INT)] AS property_key,
        (['T1','T2','readout_error','cz:frequency'])[CAST(event_id % 4 + 1 AS INT)] AS property_name, CASE WHEN event_id % 4 < 2 THEN 's' END AS unit,
        epoch_us(ts) // {HOUR} * {HOUR} AS t, epoch_us(ts) AS observed, CASE WHEN event_id % 4 = 3 THEN value - 50 ELSE value END AS value FROM events""",
    "dedup": """SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY backend, component_type, component_id, property_key, t ORDER BY observed DESC, value DESC) = 1""",
    "lagged": f"""SELECT *, value - previous_value AS signed_absolute_change, abs(value - previous_value) AS absolute_change,
        (t - previous_t) / {HOUR}.0::DOUBLE AS elapsed_hours,
        CASE WHEN abs(value) + abs(previous_value) > 0 THEN 2.0::DOUBLE * abs(value - previous_value) / (abs(value) + abs(previous_value)) WHEN value = previous_value THEN 0.0::DOUBLE END AS symmetric_relative_change,
        CASE WHEN value > 0 AND previous_value > 0 THEN 'log' ELSE 'identity' END AS transform,
        CASE WHEN t > previous_t THEN CASE WHEN value > 0 AND previous_value > 0 THEN ln(CASE WHEN value > 0 THEN value END) - ln(CASE WHEN previous_value > 0 THEN previous_value END) ELSE value - previous_value END END AS signed_transformed_change
      FROM (SELECT *, lag(value) OVER w AS previous_value, lag(t) OVER w AS previous_t FROM dedup
            WINDOW w AS (PARTITION BY backend, component_type, component_id, property_key ORDER BY t))""",
    "scales": """SELECT backend, component_type, property_key, CASE WHEN 1.4826 * mad > 1e-12 THEN 1.4826 * mad WHEN n >= 2 AND iqr / 1.349 > 1e-12 THEN iqr / 1.349
          WHEN n >= 2 AND sd > 1e-12 THEN sd ELSE greatest(abs(med) * 1e-9, 1e-12) END AS robust_property_scale
      FROM (SELECT backend, component_type, property_key, mad(x) AS mad, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr, stddev_samp(x) AS sd, median(x) AS med, count(*) AS n
            FROM (SELECT *, signed_transformed_change AS x FROM lagged) WHERE x IS NOT NULL GROUP BY ALL)""",
    "drift": """SELECT *, abs(signed_drift_score) AS drift_score,
        CASE quality_direction WHEN 'lower_is_better' THEN signed_drift_score WHEN 'higher_is_better' THEN -signed_drift_score END AS adverse_drift_score
      FROM (SELECT l.*, s.robust_property_scale, l.signed_transformed_change / s.robust_property_scale AS signed_drift_score,
              CASE WHEN contains(lower(property_name), 'error') OR contains(lower(property_name), 'infidelity') THEN 'lower_is_better'
                   WHEN lower(property_name) IN ('t1', 't2') OR contains(lower(property_name), 'fidelity') THEN 'higher_is_better' END AS quality_direction
            FROM lagged l LEFT JOIN scales s USING (backend, component_type, property_key))""",
    "anchor_rows": f"""SELECT backend, component_type, component_id, min(t) AS anchor, 0 AS number FROM drift GROUP BY ALL
      UNION ALL SELECT a.backend, a.component_type, a.component_id, (SELECT min(d.t) FROM drift d WHERE d.backend = a.backend AND d.component_type = a.component_type AND d.component_id = a.component_id AND d.t > a.anchor + {TOLERANCE * MINUTE}), a.number + 1
      FROM anchor_rows a WHERE a.anchor IS NOT NULL""",
    "grouped": """SELECT d.*, a.number FROM drift d ASOF JOIN (SELECT * FROM anchor_rows WHERE anchor IS NOT NULL) a
      ON d.backend = a.backend AND d.component_type = a.component_type AND d.component_id = a.component_id AND d.t >= a.anchor""",
    "ev": """SELECT backend, component_type, component_id, number AS component_event_number, min(t) AS event_start, max(t) AS t, count(DISTINCT property_key) AS updated_property_count,
        count(drift_score) AS drift_property_count, avg(drift_score) AS drift_mean, median(drift_score) AS drift_median, max(drift_score) AS drift_max, avg(signed_drift_score) AS signed_drift_mean,
        avg(symmetric_relative_change) AS symmetric_relative_drift_mean, max(symmetric_relative_change) AS symmetric_relative_drift_max, count(adverse_drift_score) AS quality_property_count,
        avg(adverse_drift_score) AS adverse_drift_mean, count(*) FILTER (adverse_drift_score > 0) AS degraded_property_count, count(*) FILTER (adverse_drift_score < 0) AS improved_property_count,
        sqrt(avg(drift_score * drift_score)) AS drift_rms FROM grouped GROUP BY ALL""",
    "coverage": "SELECT event_type AS backend, min(epoch_us(ts)) AS study_start, max(epoch_us(ts)) AS study_end, count(*) AS successful_fetch_count FROM events GROUP BY 1",
    "status": "SELECT event_type AS backend, epoch_us(ts) AS t, CAST(floor(value) AS INT) AS pending_jobs FROM events",
    "grid": f"SELECT backend, unnest(range((study_start + {GRID * MINUTE} - 1) // {GRID * MINUTE}, study_end // {GRID * MINUTE} + 1)) * {GRID * MINUTE} AS t FROM coverage",
    "cells": "SELECT c.*, g.t FROM (SELECT DISTINCT backend, component_type, component_id FROM ev) c JOIN grid g USING (backend)",
    "freq": f"""SELECT c.*, w.h AS window_hours, count(e.t) AS count, least(w.h::DOUBLE, greatest(0.0::DOUBLE, (c.t - v.study_start) / {HOUR}.0::DOUBLE)) AS exposure, c.t - v.study_start >= w.h * {HOUR} AS complete
      FROM cells c CROSS JOIN (SELECT unnest([8, 48]) AS h) w JOIN coverage v USING (backend)
      LEFT JOIN ev e ON e.backend = c.backend AND e.component_type = c.component_type AND e.component_id = c.component_id AND e.t > c.t - w.h * {HOUR} AND e.t <= c.t
      GROUP BY c.backend, c.component_type, c.component_id, c.t, w.h, v.study_start""",
    "load": f"""SELECT g.backend, g.t, s.t AS current_t, (g.t - s.t) / {MINUTE}.0::DOUBLE AS current_age_minutes, CASE WHEN g.t - s.t <= {120 * MINUTE} THEN s.pending_jobs::DOUBLE END AS load_current,
        (SELECT avg(x.pending_jobs) FROM status x WHERE x.backend = g.backend AND x.t >= g.t - 8 * {HOUR} AND x.t < g.t) AS load_mean_8h,
        (SELECT max(x.pending_jobs) FROM status x WHERE x.backend = g.backend AND x.t >= g.t - 8 * {HOUR} AND x.t < g.t)::DOUBLE AS load_max_8h,
        (SELECT stddev_samp(x.pending_jobs) FROM status x WHERE x.backend = g.backend AND x.t >= g.t - 8 * {HOUR} AND x.t < g.t) AS load_std_8h,
        (SELECT count(x.pending_jobs) FROM status x WHERE x.backend = g.backend AND x.t >= g.t - 8 * {HOUR} AND x.t < g.t) AS load_count_8h
      FROM grid g ASOF LEFT JOIN (SELECT backend, t, max(pending_jobs) AS pending_jobs FROM status GROUP BY ALL) s ON g.backend = s.backend AND g.t >= s.t""",
    "cycles": f"""SELECT o_orderkey AS cycle, o_orderpriority AS backend, epoch_us(o_orderdate) AS started,
        CASE WHEN o_orderkey % 7 <> 0 THEN epoch_us(o_orderdate) + {MINUTE} * (o_orderkey % 5) END AS finished, o_orderstatus <> 'F' AS success, o_totalprice AS price FROM orders""",
    "props": """SELECT l_orderkey AS cycle, l_linenumber AS qubit, CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_linenumber + 1 AS VARCHAR) AS edge_id, l_returnflag AS gate,
        CASE WHEN l_linestatus = 'O' THEN true WHEN l_quantity >= 10 THEN false END AS reported, epoch_us(l_shipdate) AS date, l_extendedprice AS value FROM lineitem""",
    "valid": "SELECT *, lag(cycle) OVER w AS prev, lag(started) OVER w AS prev_started FROM cycles WHERE success WINDOW w AS (PARTITION BY backend ORDER BY started, cycle)",
    "usage": "SELECT l_orderkey AS run_id, l_returnflag AS backend, l_linenumber % 2 AS level, CAST(l_suppkey AS VARCHAR) AS component_id, CAST(l_quantity AS BIGINT) AS ops FROM lineitem",
    "edges": "SELECT DISTINCT backend, least(a, b) AS a, greatest(a, b) AS b FROM (SELECT event_type AS backend, user_id % 400 AS a, (user_id + event_id % 4) % 400 AS b FROM events) WHERE a <> b",
    "compiled": "SELECT event_id // 40 AS run_id, event_type AS backend, event_id // 40 % 2 AS level, CAST(least(a, b) AS VARCHAR) || '-' || CAST(greatest(a, b) AS VARCHAR) AS component_id, user_id % 7 + 1 AS ops FROM (SELECT *, user_id % 400 AS a, (user_id + CASE WHEN event_id % 4 = 2 THEN 2 ELSE 1 END) % 400 AS b FROM events)",
    "anchors": f"SELECT event_type AS backend, epoch_us(ts) AS observed, epoch_us(ts) // {24 * HOUR} * {24 * HOUR} AS t FROM events",
}


def needs(text: str, own: str = "") -> list[str]:
    """Names of the expressions that a statement uses, each after those that it uses itself."""
    out: list[str] = []
    for name in CTES:
        if name != own and re.search(rf"(FROM|JOIN|,)\s+{name}\b", text):
            out += [x for x in [*needs(CTES[name], name), name] if x not in out]
    return out


def statement(body: str, rounded: str = "", digits: int = 4) -> str:
    """``body`` with the expressions it needs in front; ``rounded`` names its columns of doubles. (A billionth keeps exact halves from
    rounding either way with the last bit.)"""
    names = list(dict.fromkeys(needs(body)))
    head = "WITH RECURSIVE " + ", ".join(f"{n} AS ({CTES[n]})" for n in names) + " " if names else ""
    if not rounded:
        return head + (f"SELECT * FROM ({body})" if head and body.lstrip().startswith("WITH") else body)
    replace = ", ".join(f"round(CAST({c} AS DOUBLE) + 1e-9::DOUBLE, {digits}) + 0.0::DOUBLE AS {c}" for c in rounded.split())
    return f"{head}SELECT * REPLACE ({replace}) FROM ({body})"
