"""Operators against plain recomputation over small random tables, closed forms, raw payloads, sources, sinks and the stream."""

import json
import math
import random
import statistics
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from caldrift.functions.expr import HOUR, MINUTE
from caldrift.functions.pvalues import normal_tail, student_tail
from caldrift.operators import grid as G
from caldrift.operators import metrics as M
from caldrift.operators import series as S
from caldrift.operators import stats as Z
from caldrift.operators import studies as U
from caldrift.sinks import files
from caldrift.sources import catalog, ingest
from caldrift.streaming import poll

BEGIN = 1_700_000_000_000_000 // HOUR * HOUR
OBS = "backend string, component_type string, component_id string, property_key string, property_name string, unit string, t long, observed long, value double"


@pytest.fixture(scope="module")
def readings():
    """Three devices, two kinds of components, uneven gaps, repeated times, negative values and unit-less properties."""
    rng = random.Random(17)
    rows = []
    for device in ("ada", "bell", "curie"):
        for kind, ids in (("qubit", "0123"), ("edge", ("0-1", "1-2"))):
            for c in ids:
                for key, name, unit in (("T2[us]", "T2", "us"), ("gate_error[]", "gate_error", None)):
                    t = BEGIN + rng.randrange(40) * MINUTE
                    for _ in range(rng.randrange(1, 14)):
                        rows.append((device, kind, c, key, name, unit, t, t + rng.randrange(9) * MINUTE, round(rng.uniform(-0.2, 1), 3) if name == "gate_error" else rng.uniform(20, 90)))
                        t += rng.choice([0, 4, 11, 16, 55, 190, 900]) * MINUTE
    return rows


@pytest.fixture(scope="module")
def obs(spark, readings):
    return spark.createDataFrame(readings, OBS).persist()


@pytest.fixture(scope="module")
def cover(spark, readings):
    ends = defaultdict(list)
    for r in readings:
        ends[r[0]].append(r[6])
    return spark.createDataFrame([(b, min(t) + 70 * MINUTE, max(t), 5) for b, t in ends.items()], "backend string, study_start long, study_end long, successful_fetch_count long")


def latest(readings):
    """One reading of a series and time: the one observed last, the larger value at a tie."""
    found = {}
    for b, kind, c, key, name, _, t, seen, v in readings:
        if ((b, kind, c, key), t) not in found or (seen, v) > found[(b, kind, c, key), t][:2]:
            found[(b, kind, c, key), t] = (seen, v, name)
    out = defaultdict(list)
    for (series, t), (_, v, name) in sorted(found.items()):
        out[series].append((t, v, name))
    return out


def test_drift_is_the_scaled_change_of_neighbours(obs, readings):
    changes, scale = {}, defaultdict(list)
    for series, points in latest(readings).items():
        for (_, v0, _), (t, v, _) in zip(points[:-1], points[1:], strict=True):
            x = math.log(v) - math.log(v0) if v > 0 and v0 > 0 else v - v0
            changes[series, t] = x
            scale[series[0], series[1], series[3]].append(x)

    def spread(xs):
        mid = statistics.median(xs)
        mad = 1.4826 * statistics.median(abs(x - mid) for x in xs)
        iqr = float(np.subtract(*np.percentile(xs, [75, 25]))) / 1.349
        return next((s for s in (mad, iqr if len(xs) > 1 else 0, statistics.stdev(xs) if len(xs) > 1 else 0) if s > 1e-12), max(abs(mid) * 1e-9, 1e-12))

    got = {((r.backend, r.component_type, r.component_id, r.property_key), r.t): r for r in S.property_drift(obs).collect()}
    assert len(got) == sum(map(len, latest(readings).values()))
    for at, r in got.items():
        if at not in changes:
            assert r.drift_score is None
            continue
        s = changes[at] / spread(scale[at[0][0], at[0][1], at[0][3]])
        assert math.isclose(r.drift_score, abs(s), rel_tol=1e-9, abs_tol=1e-9)
        assert r.is_degradation == ((s if "error" in r.property_name else -s) > 0)
    with pytest.raises(ValueError):
        S.property_drift(obs.drop("value"))


@pytest.mark.parametrize("tolerance", [0, 10, 20, 60])
def test_sessions_against_a_loop(obs, readings, tolerance):
    times = defaultdict(set)
    for (b, kind, c, _), points in latest(readings).items():
        times[b, kind, c] |= {t for t, _, _ in points}
    want = {}
    for key, own in times.items():
        anchor, n = None, -1
        for t in sorted(own):
            if anchor is None or t - anchor > tolerance * MINUTE:
                anchor, n = t, n + 1
            want[key, t] = (anchor, n)
    got = S.anchored(S.property_drift(obs), S.COMPONENT, "t", tolerance * MINUTE).select(*S.COMPONENT, "t", "anchor", "number").distinct().collect()
    assert {((r.backend, r.component_type, r.component_id), r.t): (r.anchor, r.number) for r in got} == want


def test_frequency_and_cadence_against_counting(obs, cover):
    events, grid = S.component_events(S.property_drift(obs), 20).persist(), G.make_grid(cover, 90)
    at = defaultdict(list)
    for r in events.collect():
        at[r.backend, r.component_type, r.component_id].append(r.t)
    study = {r.backend: (r.study_start, r.study_end) for r in cover.collect()}
    rows = G.frequency(events, grid, cover, [3, 7]).collect()
    slots = {b: [t for t in range(0, hi + 1, 90 * MINUTE) if t >= lo] if lo == 0 else [k * 90 * MINUTE for k in range(-(-lo // (90 * MINUTE)), hi // (90 * MINUTE) + 1)] for b, (lo, hi) in study.items()}
    assert len(rows) == sum(len(slots[k[0]]) for k in at)
    for r in rows:
        own = at[r.backend, r.component_type, r.component_id]
        for h in (3, 7):
            assert r[f"count_{h}h"] == sum(r.t - h * HOUR < t <= r.t for t in own) and r[f"complete_{h}h"] == (r.t - study[r.backend][0] >= h * HOUR)
    for r in M.cadence(events, cover).collect():
        lo, hi = study[r.backend]
        own = sorted(t for t in at[r.backend, r.component_type, r.component_id] if lo <= t <= hi)
        gaps = [(b - a) / HOUR for a, b in zip(own[:-1], own[1:], strict=True)]
        assert r.calibration_event_count == len(own) and (r.interarrival_mean_hours is None if not gaps else math.isclose(r.interarrival_mean_hours, sum(gaps) / len(gaps)))


def test_as_of_nearest_and_load_over_long_times(spark):
    """Stretches of one device, with gaps that are longer than a stretch."""
    rng = random.Random(23)
    span = 9 * G.STRETCH
    anchors = [("d" + str(k % 2), BEGIN + rng.randrange(span)) for k in range(12)] + [("d0", BEGIN + 5), ("d1", BEGIN + span)]
    left = [("d" + str(rng.randrange(3)), BEGIN + rng.randrange(-HOUR, span)) for _ in range(300)] + [("d0", BEGIN + 5)]
    frame = lambda rows: spark.createDataFrame(rows, "backend string, t long")
    for r in G.nearest(frame(left), frame(anchors), ["backend"]).collect():
        own = sorted(t for b, t in anchors if b == r.backend)
        before, after = [t for t in own if t <= r.t], [t for t in own if t >= r.t]
        assert (r.anchor_before_t, r.anchor_after_t) == (before[-1] if before else None, after[0] if after else None)
        assert r.nearest_t == min(own, key=lambda t: (abs(t - r.t), t), default=None)
    polls = [("d0", BEGIN + rng.randrange(span), rng.randrange(50)) for _ in range(400)] + [("d0", BEGIN + 7, None)]
    got = G.device_load(frame(left), spark.createDataFrame(polls, "backend string, t long, pending_jobs int"), [8, 200]).collect()
    assert len(got) == len(left)
    for r in got:
        own = [(t, n) for b, t, n in polls if b == r.backend and n is not None]
        for h in (8, 200):
            inside = [n for t, n in own if r.t - h * HOUR <= t < r.t]
            assert r[f"load_count_{h}h"] == len(inside) and r[f"load_max_{h}h"] == (max(inside) if inside else None)
        last = max((x for x in own if x[0] <= r.t), default=None)
        assert r.current_t == (last[0] if last else None) and (r.load_current is not None) == (last is not None and r.t - last[0] <= 120 * MINUTE)


def panel(rng, full):
    cells = [(e, t) for e in range(6) for t in range(9) if full or rng.random() < 0.7]
    x = {c: rng.normalvariate(0, 1) for c in cells}
    return [("p", f"e{e}", t, x[e, t], 0.75 * x[e, t] + e * e - 0.4 * t + rng.normalvariate(0, 0.3)) for e, t in cells]


@pytest.mark.parametrize("full", [True, False])
def test_fixed_effects_equal_dummies(spark, full):
    rows = panel(random.Random(31), full)
    df = spark.createDataFrame(rows, "g string, entity string, t int, x double, y double")
    e, t = np.array([int(r[1][1:]) for r in rows]), np.array([r[2] for r in rows])
    design = np.column_stack([[r[3] for r in rows], e[:, None] == np.arange(6), t[:, None] == np.arange(1, 9)]).astype(float)
    slope = np.linalg.lstsq(design, np.array([r[4] for r in rows]), rcond=None)[0][0]
    assert math.isclose(Z.two_way(df, ["g"], "entity", "t", ["y"], ["x"]).first().coefficient, slope, rel_tol=1e-7)
    balanced = Z.two_way_balanced(df, ["g"], "entity", "t", "y", "x").first().coefficient
    assert math.isclose(balanced, slope, rel_tol=1e-9) if full else balanced is None
    assert Z.two_way(df, ["g"], "entity", "t", ["y"], ["x"], min_n=500).first().coefficient is None


def test_tails_against_sums_of_their_density():
    for x, n in ((0.4, 3), (1.7, 8), (2.9, 25)):
        grid = np.linspace(-x, x, 400_001)
        density = math.exp(math.lgamma((n + 1) / 2) - math.lgamma(n / 2)) / math.sqrt(n * math.pi) * (1 + grid**2 / n) ** (-(n + 1) / 2)
        assert math.isclose(student_tail(x, n), 1 - np.trapezoid(density, grid), rel_tol=1e-8)
        assert math.isclose(normal_tail(x), 1 - np.trapezoid(np.exp(-(grid**2) / 2) / math.sqrt(2 * math.pi), grid), rel_tol=1e-8)


def test_betweenness_against_all_shortest_paths():
    rng = random.Random(41)
    for _ in range(6):
        edges = {(a, b) for a in range(9) for b in range(a + 1, 9) if rng.random() < 0.3} | {(0, 1)}
        near = defaultdict(set)
        for a, b in edges:
            near[a].add(b)
            near[b].add(a)

        def paths(a, b):
            level = [[a]]
            while level:
                done = [p for p in level if p[-1] == b]
                if done:
                    return done
                level = [[*p, v] for p in level for v in near[p[-1]] if v not in p]
                level = [p for p in level if len(p) <= 9]
            return []

        want = dict.fromkeys(edges, 0.0)
        for a in near:
            for b in near:
                for p in (found := paths(a, b)) if a != b else ():
                    for u, v in zip(p[:-1], p[1:], strict=True):
                        want[min(u, v), max(u, v)] += 1 / len(found)
        n = len(near)
        assert U.flows_of(sorted(edges), sorted(near)) == pytest.approx(want)


def test_edge_table_and_summary(spark):
    """Devices share edge names; an edge no run used, one never calibrated and one constantly at one."""
    rng = random.Random(43)
    topology, usage, cadence = [], [], []
    for device in ("x", "y"):
        for k in range(20):
            topology.append((device, f"{k}-{k + 1}", rng.randrange(2, 7)))
            if k != 3:
                cadence.append((device, "edge", f"{k}-{k + 1}", k + (50 if device == "y" else 0), float(k % 7) + rng.random()))
            usage += [(run, device, run % 2, f"{k}-{k + 1}", rng.randrange(1, 9)) for run in range(6) if k != 5 and rng.random() < 0.6]
    table = U.edge_table(
        spark.createDataFrame(topology, "backend string, component_id string, degree_sum int"), spark.createDataFrame(usage, "run_id int, backend string, level int, component_id string, ops int"),
        spark.createDataFrame(cadence, "backend string, component_type string, component_id string, calibration_event_count int, calibration_events_per_day double"),
        spark.createDataFrame([("x", "7-8", True, 2)], "backend string, component_id string, any_constant_one boolean, constant_series int"),
    ).persist()
    rows = {(r.backend, r.level, r.component_id): r for r in table.collect()}
    assert len(rows) == 80 and rows["x", 0, "5-6"].ops == 0 and rows["x", 0, "5-6"].presence == 0 and rows["y", 1, "3-4"].calibration_events_per_day is None
    assert rows["y", 0, "9-10"].calibration_event_count == 59 and rows["x", 1, "7-8"].any_constant_one and not rows["y", 1, "7-8"].any_constant_one
    one = rows["x", 0, "0-1"]
    runs = defaultdict(int)
    for run, b, level, _, n in usage:
        runs[run] += n if (b, level) == ("x", 0) else 0
    shares = [sum(n for r, b, _, c, n in usage if (r, b, c) == (run, "x", "0-1")) / runs[run] for run in (0, 2, 4) if any((r, b, c) == (run, "x", "0-1") for r, b, _, c, _ in usage)]
    assert math.isclose(one.mean_share, sum(shares) / len(shares)) and one.used_runs == len(shares) and math.isclose(one.presence, len(shares) / 3)
    for r in U.backend_summary(table, ("degree_sum",)).collect():
        own = [x for (b, level, _), x in rows.items() if (b, level) == (r.backend, r.level)]
        assert r.edges == 20 and r.constant_edges == (r.backend == "x") and math.isclose(r.used_all, sum(x.used_runs > 0 for x in own) / 20)
        for scope in ("all", "filtered"):
            full = [x for x in own if x.calibration_events_per_day is not None and (scope == "all" or not x.any_constant_one)]
            rank = lambda v: np.array([sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v])
            rate = np.array([x.calibration_events_per_day for x in full])
            assert math.isclose(r[f"rho_share_{scope}"], np.corrcoef(rank([x.mean_share for x in full]), rank(rate))[0, 1], rel_tol=1e-9)
            z = lambda v: (v - v.mean()) / v.std()
            design, y = np.column_stack([z(np.array([x.mean_share for x in full])), z(np.array([float(x.degree_sum) for x in full]))]), z(np.log1p(rate))
            beta = np.linalg.lstsq(design, y, rcond=None)[0]
            assert math.isclose(r[f"beta_{scope}"], beta[0], rel_tol=1e-9) and math.isclose(r[f"r2_{scope}"], 1 - float(((y - design @ beta) ** 2).sum()) / len(y), rel_tol=1e-9)


def entry(name, value, **more):
    return {"name": name, "value": value, "unit": "u", **more}


def test_payloads(spark):
    """What fails a payload as a whole, and what only loses its own row."""
    fine = {
        "qubits": [[entry("T2", "0.5", date="2031-02-03T04:05:06Z"), entry(" OPERATIONAL", True), "junk", {"value": 3}], [entry("operational", 0.0)], "junk", []],
        "gates": [{"gate": "ecr", "qubits": ["5", 2], "parameters": [entry("gate_error", 0.25), entry("Operational", "no")], "operational": "maybe"}, {"name": "rz", "qubits": [4], "operational": 1}, {"gate": "sx", "qubits": ["q"]}, {"qubits": [1]}, 7],
    }
    states = [("yes", True), ("1", True), (1, True), (1.0, True), (False, False), ("0", False), ("1.0", None), ("maybe", None), (2, None), (None, None), ([], None)]
    cases = {
        "fine": (fine, None), "null": (None, "null"), "list": ([fine], "object"), "no gates": ({"qubits": []}, "lacks"), "errors": ({"qubits": [], "gates": [], "errors": {"a": 1}}, "errors"),
        "blank errors": ({"qubits": [], "gates": [], "errors": []}, None), "falsy lists": ({"qubits": {}, "gates": None}, None), "qubits": ({"qubits": {"a": 1}, "gates": []}, "qubits is no list"), "gates": ({"qubits": [], "gates": "x"}, "gates is no list"),
    }
    cases |= {f"qubit {i}": ({"qubits": [[entry("operational", v)]], "gates": []}, None if ok is not None else "qubit's operational") for i, (v, ok) in enumerate(states)}
    cases |= {f"gate {i}": ({"qubits": [], "gates": [{"gate": "x", "qubits": [0], "operational": v}]}, None if ok is not None else "gate's operational") for i, (v, ok) in enumerate(states)}
    raw = spark.createDataFrame([(k, None if p is None else json.dumps(p)) for k, (p, _) in cases.items()] + [("torn", '{"qubits": [')], "poll string, properties string")
    errors = {r.poll: r.error for r in ingest.payloads(raw).collect()}
    assert all((errors[k] is None) if want is None else want in errors[k] for k, (_, want) in cases.items()) and "null" in errors["torn"]
    assert sorted((r.qubit, r.property_name) for r in ingest.qubit_properties(raw).where("poll = 'fine'").collect()) == [(0, " OPERATIONAL"), (0, "T2"), (1, "operational")]
    found = {(r.poll, r.qubit): (r.reported, r.effective, r.is_explicit) for r in ingest.qubit_operational(raw).collect()}
    assert [found["fine", q] for q in (0, 1, 3)] == [(True, True, True), (False, False, True), (None, True, False)] and ("fine", 2) not in found
    assert all(found[f"qubit {i}", 0][0] == ok for i, (_, ok) in enumerate(states) if ok is not None)
    gates = {r.gate_name: (r.qubits_key, r.edge_id, r.reported, r.effective) for r in ingest.gate_operational(raw).where("poll = 'fine'").collect()}
    assert gates == {"ecr": ("5,2", "2-5", False, False), "rz": ("4", None, True, True)}
    status = spark.createDataFrame([("a", '{"state": "off", "status": "paused"}', None), ("b", '{"state": null, "operational": 0}', None), ("c", "{}", '{"status": {"name": " Online"}, "queue_length": 3}')], "poll string, status string, summary string")
    assert {r.poll: (r.operational, r.pending_jobs) for r in ingest.parse_status(status).collect()} == {"a": (True, None), "b": (False, None), "c": (True, 3)}


def test_sources(spark, monkeypatch):
    tables = {"polls": ("device_name", "Last_Updated", "updated_at"), "public.calibration_snapshot": ("backend", "calibration_date", "created_at", "last_update_date"), "backend_properties": ("backend", "poll_started_at")}
    inventory = [(t, c, "string") for t, columns in tables.items() for c in columns]
    best = catalog.discover_anchor_source(inventory)
    assert (best.table, best.anchor, best.score) == ("public.calibration_snapshot", "last_update_date", 135)
    other = catalog.discover_anchor_source([x for x in inventory if x[0] == "polls"])
    assert (other.anchor, other.backend, other.poll, other.score) == ("Last_Updated", "device_name", "updated_at", 80)
    with pytest.raises(LookupError):
        catalog.discover_anchor_source([x for x in inventory if x[0] == "backend_properties"])
    spark.createDataFrame([("d", 1, "no json"), ("d", 2, '{"props": {"last_update": "x"}}')], "device string, created_at int, body string").createOrReplaceTempView("raw_polls_for_test")
    kinds = [("raw_polls_for_test", c, k) for c, k in (("device", "string"), ("created_at", "int"), ("body", "string"))]
    assert catalog.discover_json_anchor(spark, kinds)[1] == "$.props.last_update"
    spark.createDataFrame([("d", 1, '{"a": [1, {"b c": {"Last_Updated": 1}}], "z": {}}')], "device string, created_at int, raw string").createOrReplaceTempView("backend_calibration_for_test")
    kinds += [("backend_calibration_for_test", c, k) for c, k in (("device", "string"), ("created_at", "int"), ("raw", "string"))]
    source, path = catalog.discover_json_anchor(spark, kinds)  # the better name wins over the table's place
    assert (source.table, source.score, path) == ("backend_calibration_for_test", 80, "$.a[1]['b c'].Last_Updated")
    names = frozenset(catalog.ANCHOR_NAMES)
    assert catalog.key_path({"x": {"last_update": 1}, "LAST_UPDATED": 2}, names) == ["LAST_UPDATED"]  # own keys first
    assert catalog.key_path([0, 1, 2, {"last_update": 1}], names) is None and catalog.key_path("text", names) is None
    deep: object = {"last_update": 1}
    for _ in range(5000):
        deep = {"k": [deep]}
    assert len(catalog.key_path(deep, names)) == 10001
    named = catalog.named_anchor_source(inventory, "calibration_snapshot")
    assert (named.table, named.anchor) == ("public.calibration_snapshot", "last_update_date")
    assert catalog.named_anchor_source(inventory, "polls", anchor="updated_at").anchor == "updated_at"
    for bad in (("nothing", None), ("polls", "no_such_column"), ("backend_properties", None)):
        with pytest.raises(LookupError):
            catalog.named_anchor_source(inventory, bad[0], anchor=bad[1])
    with pytest.raises(ValueError):
        catalog.CollectorConfig(("a",), -5)
    monkeypatch.setenv("BACKENDS", " p ,, q")
    assert catalog.CollectorConfig.from_env().backends == ("p", "q")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(4, BEGIN + 1)], "a long, t long")
    files.write_csv(df, f"{tmp_path}/csv", compress=False, times=("t",))
    assert spark.read.csv(f"{tmp_path}/csv", header=True).first().t == "2023-11-14T22:00:00.000001Z"
    counts = {"df": files.write_csv(df, f"{tmp_path}/gz"), "none": files.write_csv(df.where("a > 9"), f"{tmp_path}/none")}
    assert files.write_metadata(spark, f"file://{tmp_path}/meta.json", {"k": [1]}, counts, ["c"]) == json.loads((tmp_path / "meta.json").read_text()) == {"parameters": {"k": [1]}, "row_counts": {"df": 1, "none": 0}, "caveats": ["c"]}


def test_batches_are_committed_whole(spark, tmp_path):
    """A repeat that fails in the middle leaves the batch as it was; one that ends replaces it; folders without a marker are not read."""
    root, frame = f"{tmp_path}/w", lambda *a: spark.createDataFrame([(x,) for x in a], "a long")
    files.write_cycle({"fetch_cycles": frame(1), "facts": frame(1, 2)}, root, "7")
    files.write_cycle({"fetch_cycles": frame(8), "facts": frame(8)}, root, "8")
    torn = frame(5).selectExpr("assert_true(a < 0) AS bad", "a").select("a", F.coalesce(F.col("bad").cast("int"), F.lit(0)).alias("b"))
    with pytest.raises(Exception):  # noqa: B017, PT011
        files.write_cycle({"facts": frame(9, 9, 9), "fetch_cycles": torn}, root, "7")
    read = lambda t: sorted((r.batch, r.a) for r in files.read_committed(spark, root, t).collect())
    assert read("facts") == [(7, 1), (7, 2), (8, 8)] and read("fetch_cycles") == [(7, 1), (8, 8)]
    files.write_cycle({"fetch_cycles": frame(3), "facts": frame(4)}, root, "7")
    assert read("facts") == [(7, 4), (8, 8)] and read("fetch_cycles") == [(7, 3), (8, 8)]
    assert files.drop_superseded(spark, root) >= 3 and read("facts") == [(7, 4), (8, 8)] and files.drop_superseded(spark, root) == 0


def test_upsert_rewrites_touched_partitions_only(spark, tmp_path):
    path = f"{tmp_path}/t"
    frame = lambda *rows: spark.createDataFrame(rows, "k int, p string, v int")
    state = lambda: {str(f.relative_to(path)): f.read_bytes() for f in (tmp_path / "t").rglob("*.parquet")}
    files.upsert_table(path, frame((1, "a", 1), (2, "a", 2), (3, "b", 3), (4, None, 4), (5, "c", 5)), ["k"], "p")
    before = state()
    for _ in range(2):  # a repeat changes nothing; key 5 moves out of c, which is then empty
        files.upsert_table(path, frame((2, "a", 20), (5, "a", 50), (6, "d", 6)), ["k"], "p")
        assert sorted(((r.k, r.p, r.v) for r in spark.read.parquet(path).collect()), key=str) == [(1, "a", 1), (2, "a", 20), (3, "b", 3), (4, None, 4), (5, "a", 50), (6, "d", 6)]
    after = state()
    assert {f: x for f, x in before.items() if f.startswith(("p=b", "p=__H"))}.items() <= after.items()
    assert {f.split("/")[0] for f in after} == {"p=a", "p=b", "p=d", "p=__HIVE_DEFAULT_PARTITION__"}


def test_csv_in_archives(spark, tmp_path):
    import gzip
    import zipfile

    text = "a,b,c,t\n1,x,0.5,2031-02-03T04:05:06.000007Z\n2,,,\n" + "".join(f"{k},\"q,{k}\",1,\n" for k in range(3, 30000))
    for n in range(2):
        with zipfile.ZipFile(tmp_path / f"{n}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("in/data.csv.gz", gzip.compress(text.encode()))
            z.writestr("in/plain.csv", text)
    schema = spark.createDataFrame([], "a int, b string, c double, t timestamp").schema
    for member in ("in/data.csv.gz", "in/plain.csv"):
        df = catalog.read_csv_from_zip(spark, f"file://{tmp_path}/*.zip", member, schema)
        assert df.count() == 2 * 29999 and df.where("a = 2").distinct().collect() == [(2, None, None, None)]
        assert df.where("a = 1").selectExpr("b", "c", "unix_micros(t) % 60000000 AS us").distinct().collect() == [("x", 0.5, 6000007)]
        assert catalog.read_csv_from_zip(spark, f"file://{tmp_path}/1.zip", member, schema, ["b"]).where("b = 'q,9'").count() == 1


def test_device_service(spark):
    """The data source against a local server: tokens, devices side by side, answers that are no object or have errors, a device that isn't there."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from caldrift.sources import rest

    asked, tokens = [], []

    class Handler(BaseHTTPRequestHandler):
        def answer(self, body, code=200):
            self.send_response(code)
            self.end_headers()
            self.wfile.write(body if isinstance(body, bytes) else json.dumps(body).encode())

        def do_POST(self):
            tokens.append(self.rfile.read(int(self.headers["Content-Length"])).decode())
            self.answer({"access_token": f"t{len(tokens)}", "expires_in": 100})

        def do_GET(self):
            asked.append((self.path, self.headers["Authorization"], self.headers["X-Version"]))
            name = self.path.split("/")[4] if self.path.count("/") > 3 else ""
            bodies = {"": {"devices": [1]}, "fine": {"qubits": [], "é": 1}, "list": [1], "bad": {"errors": [{"code": 7}]}, "torn": b"{", "a%20b": {"errors": []}}
            self.answer(bodies.get(name, {}), 404 if name == "lost" else 200)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    spark.dataSource.register(rest.DeviceService)
    read = lambda r, **o: r.format("device_service").options(url=url, token_url=f"{url}/token", api_key="k/e", headers='{"X-Version": "3"}', timeout_seconds="5", **o).load()
    rows = {(r.backend, r.kind): r for r in read(spark.read, backends="fine, list,bad,torn,lost,a b,fine").collect()}
    assert len(rows) == 13 and {k for k, r in rows.items() if r.error is None} == {(None, "index"), ("fine", "status"), ("fine", "properties"), ("a b", "status"), ("a b", "properties")}
    assert json.loads(rows["fine", "status"].body) == {"qubits": [], "é": 1} and all((r.body is None) != (r.error is None) for r in rows.values())
    assert "object was expected" in rows["list", "status"].error and '"code": 7' in rows["bad", "properties"].error and "404" in rows["lost", "status"].error
    assert "apikey=k%2Fe" in tokens[0] and all(t.startswith("Bearer t") and v == "3" for _, t, v in asked)
    clock = [1000.0]
    service = rest.Service({"url": url, "token_url": f"{url}/token"}, now=lambda: clock[0])
    first = service.bearer()
    clock[0] += 39
    assert service.bearer() == first
    clock[0] += 1  # sixty seconds before its end
    assert service.bearer() != first
    stream = read(spark.readStream, backends="fine,lost", poll_interval_seconds="100000")
    query = stream.writeStream.format("memory").queryName("device_polls_for_test").trigger(processingTime="1 second").start()
    try:
        query.processAllAvailable()
        got = spark.table("device_polls_for_test").collect()
    finally:
        query.stop()
        server.shutdown()
    assert sorted((str(r.backend), r.kind, r.error is None) for r in got) == [("None", "index", True), ("fine", "properties", True), ("fine", "status", True), ("lost", "properties", False), ("lost", "status", False)]
    assert len({r.poll for r in got}) == 1
    with pytest.raises(ValueError):
        rest.DeviceService({}).reader(None)


def test_stream_carries_state_over_landings(spark, tmp_path):
    rng = random.Random(47)
    polls, known, want = [], {}, {}
    for k in range(1, 41):
        device, good = rng.choice("mn"), rng.random() < 0.7
        dates = {f"q{j}": rng.randrange(4) for j in range(rng.randrange(1, 4))}
        polls.append((k, device, 100 * k, good, json.dumps(dates) if good else None))
        cycle, before = known.get(device, (None, {}))
        want[k] = (good, cycle, sum(d > before[q] for q, d in dates.items() if q in before) if good else 0)
        if good:
            known[device] = (k, dates)
    for part in (polls[:13], polls[13:14], polls[14:]):
        spark.createDataFrame(part, poll.SCHEMA).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        poll.run_once(poll.diff_polls(poll.landed(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/ck")
    assert {r.cycle: (r.success, r.prev_cycle, r.num_calibrated) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want
    long = poll.failures(spark.createDataFrame([(1, "é" * 7000), (2, None)], "c long, error string")).orderBy("c").collect()
    assert [len(r.error_message) for r in long] == [5000, 0] and [r.success for r in long] == [False, True]


def test_alignment_shares(spark):
    rows = [("d", m * MINUTE, -7 * MINUTE, 0, 500 * MINUTE) for m in (-4, 0, 3, 40, 250, 499)] + [("d", 5, None, None, None)]
    df = spark.createDataFrame([(b, t, back if t < 0 else zero, ahead if t > 0 else zero) for b, t, back, zero, ahead in rows], "backend string, t long, anchor_before_t long, anchor_after_t long")
    near = F.when(F.col("anchor_after_t").isNull() | (F.col("t") - F.col("anchor_before_t") <= F.col("anchor_after_t") - F.col("t")), F.col("anchor_before_t")).otherwise(F.col("anchor_after_t"))
    df = df.withColumn("signed_minutes", (F.col("t") - near) / float(MINUTE)).withColumn("absolute_minutes", F.abs("signed_minutes"))
    r, found = U.alignment_summary(df, ["backend"]).first(), df.collect()
    assert r.n == 7 and U.TOLERANCES[-1] == 1440
    for m in U.TOLERANCES:
        assert math.isclose(r[f"fraction_within_{m}m"], sum(x.absolute_minutes is not None and x.absolute_minutes <= m for x in found) / 7)
        assert math.isclose(r[f"fraction_before_next_{m}m"], sum(x.anchor_after_t is not None and 0 <= x.anchor_after_t - x.t <= m * MINUTE for x in found) / 7)
        assert math.isclose(r[f"fraction_after_previous_{m}m"], sum(x.anchor_before_t is not None and 0 <= x.t - x.anchor_before_t <= m * MINUTE for x in found) / 7)


def test_cancelled_values_are_summed_by_time(spark):
    """Where values cancel out the ratio to their mean hangs on each rounding: it is that of the SQL, whatever the order of the rows."""
    import random

    import duckdb

    from caldrift.operators import metrics

    rng = random.Random(3)
    rows = []
    for c in range(60):
        half = [round(rng.uniform(0, 100), 2) - 50 for _ in range(3)]
        rows += [("x", "qubit", str(c), "p", "s", i, v, 0.5, 0.5) for i, v in enumerate([*half, *[-v for v in half[::-1]], 0.1, 0.2, -0.3])]
    con = duckdb.connect()
    con.execute("CREATE TABLE x (c VARCHAR, t INT, v DOUBLE)")
    con.executemany("INSERT INTO x VALUES (?, ?, ?)", [(r[2], r[5], r[6]) for r in rows])
    want = {r[0]: r[1:] for r in con.execute("SELECT c, avg(v), CASE WHEN avg(v) <> 0 THEN stddev_samp(v) / abs(avg(v)) END FROM x GROUP BY 1").fetchall()}
    rng.shuffle(rows)
    drift = spark.createDataFrame(rows, "backend string, component_type string, component_id string, property_name string, unit string, t long, value double, drift_score double, symmetric_relative_change double")
    coverage = spark.createDataFrame([("x", 0, 99)], "backend string, study_start long, study_end long")
    got = {r.component_id: (r.value_mean, r.value_cv) for r in metrics.property_summary(drift.repartition(4), coverage).collect()}
    assert got == want and any(x[1] and x[1] > 1e9 for x in want.values())
