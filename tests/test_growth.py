"""Steps whose work must grow with the rows, and results at the edges that larger tables reach."""

import math
import random
import statistics

import pandas as pd

from caldrift.functions.expr import HOUR
from caldrift.operators import grid as G
from caldrift.operators import metrics as M
from caldrift.operators import series as S
from caldrift.operators import stats as Z
from caldrift.operators import studies as U
from caldrift.sources import ingest as I
from caldrift.streaming import poll


def test_trailing_loads_have_no_sliding_frame(spark):
    rng = random.Random(5)
    polls = [(b, rng.randrange(-30, 30) * HOUR // 2 + rng.choice([0, 1]), rng.randrange(1000)) for b in "ab" for _ in range(80)]
    left = [("a", t * HOUR // 4) for t in range(-130, 130)] + [("b", 0), ("b", 0), ("none", 3)]
    targets = spark.createDataFrame(left, "backend string, t long")
    got = G.device_load(targets, spark.createDataFrame(polls, "backend string, t long, pending_jobs int"), [8, 3])
    assert not {line for line in got._jdf.queryExecution().toString().splitlines() if "RangeFrame" in line and "unboundedpreceding" not in line}
    found = got.collect()
    assert sorted((r.backend, r.t) for r in found) == sorted(left)
    for r in found:
        for h in (8, 3):
            inside = [n for b, t, n in polls if b == r.backend and r.t - h * HOUR <= t < r.t]
            want = (len(inside), max(inside, default=None), statistics.mean(inside) if inside else None, statistics.stdev(inside) if len(inside) > 1 else None)
            for x, y in zip(want, [r[f"load_{k}_{h}h"] for k in ("count", "max", "mean", "std")], strict=True):
                assert (x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9))


class Store:
    """A value and map state that count their calls."""

    def __init__(self):
        self.calls, self.value, self.map = 0, None, {}

    def getValueState(self, *_):  # noqa: N802
        return self

    getMapState = getValueState  # noqa: N815

    def _call(self, out=None):
        self.calls += 1
        return out

    def exists(self):
        return self._call(self.value is not None)

    def get(self):
        return self._call(self.value)

    def update(self, value):
        self.value = self._call(value)

    def iterator(self):
        return iter(self._call([((k,), (v,)) for k, v in self.map.items()]))

    def keys(self):
        return iter(self._call([(k,) for k in self.map]))

    def containsKey(self, key):  # noqa: N802
        return self._call(key[0] in self.map)

    def getValue(self, key):  # noqa: N802
        return self._call((self.map[key[0]],))

    def updateValue(self, key, value):  # noqa: N802
        self.map[key[0]] = self._call(value[0])

    def removeKey(self, key):  # noqa: N802
        self.calls += 1
        del self.map[key[0]]


def test_a_batch_of_polls_calls_the_store_once(monkeypatch):
    monkeypatch.setattr(poll, "CHUNK", 7, raising=False)
    rng = random.Random(8)
    store, processor = Store(), poll.LastPoll()
    processor.init(store)
    rows = [(k, "a", k // 3, rng.random() < 0.8, None) for k in range(300)]
    rows = [(*r[:4], "{%s}" % ", ".join(f'"q{i}": {r[0] // (i + 2)}' for i in range(4) if rng.random() < 0.7) if r[3] else None) for r in rows]
    prev, known, want = None, {}, []
    for cycle, backend, started, success, text in rows:
        now = dict(eval(text)) if success else None  # noqa: S307
        want.append((cycle, backend, started, success, prev, sum(c in known and d > known[c] for c, d in now.items()) if success else 0))
        if success:
            prev, known = cycle, now
    got = []
    for part in (rows[:200], rows[200:]):
        mixed = rng.sample(part, len(part))
        frames = [pd.DataFrame(mixed[i : i + 50], columns=["cycle", "backend", "started", "success", "dates"]) for i in range(0, len(mixed), 50)]
        got += [(*r[:4], None if pd.isna(r[4]) else r[4], r[5]) for f in processor.handleInputRows(("a",), iter(frames), None) for r in f.itertuples(index=False)]
    assert got == want and store.map == known and store.value[0] == prev
    assert store.calls < 40


def test_a_constant_column_is_no_number_where_correlations_are_asked(spark):
    rows = [("g", float(k), float(k % 3), 5.0) for k in range(12)] + [("h", float(k), float(k % 3), float(k % 5)) for k in range(12)]
    df = spark.createDataFrame(rows, "g string, y double, a double, b double")
    dropped, asked = ({r.g: r for r in Z.standardized_ols(df, ["g"], "y", ["a", "b"], **o).collect()} for o in ({}, {"drop_constant": False}))
    assert dropped["g"].beta_a is not None and dropped["g"].beta_b is None and dropped["h"] == asked["h"]
    assert all(math.isnan(asked["g"][c]) for c in ("beta_a", "beta_b", "r2"))


def test_staleness_counts_gaps_and_not_cells(spark):
    rng = random.Random(3)
    rows = [(b, k, f"c{c}", p, t * HOUR // 2) for b, k in (("a", "qubit"), ("a", "edge"), ("b", None)) for c in range(3) for p in "xy" for t in rng.sample(range(-60, 130), rng.randrange(1, 9))]
    times = [("a", t * 6 * HOUR) for t in range(-3, 9)] + [("b", t * 6 * HOUR) for t in range(3)] + [("none", 0)]
    got = M.property_staleness(spark.createDataFrame(rows, "backend string, component_type string, component_id string, property_key string, t long"), spark.createDataFrame(times, "backend string, t long"), [6, 48])
    assert "percentile(" not in got._jdf.queryExecution().toString()
    series, found = {r[:4] for r in rows}, {(r.backend, r.component_type, r.t): r for r in got.collect()}
    assert set(found) == {(b, k, t) for b, k in {r[:2] for r in rows} for of, t in times if of == b}
    for (b, k, t), r in found.items():
        own = [[x[4] for x in rows if x[:4] == s and x[4] <= t] for s in series if s[:2] == (b, k)]
        ages = [(t - max(x)) / HOUR for x in own if x]
        assert (r.series_count, r.known_count) == (len(own), len(ages))
        assert r.age_max_hours == max(ages, default=None) and r.age_median_hours == (statistics.median(ages) if ages else None)
        assert (r.fraction_age_gt_6h is None) == (not ages) and (not ages or math.isclose(r.fraction_age_gt_6h, sum(a > 6 for a in ages) / len(ages)))


def test_payload_members_are_listed_once(spark):
    texts = ['{"qubits": [], "gates": [{"gate": "cx", "qubits": [0, 1], "operational": null, "parameters": []}]}', '{"qubits": [], "gates": [{"gate": "cx", "qubits": [0, 1], "parameters": []}]}', '{"qubits": []}', "[]"]
    got = I.payloads(spark.createDataFrame(list(enumerate(texts)), "poll int, properties string"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapType") <= 1
    errors = {r.poll: r.error for r in got.select("poll", "error").collect()}
    assert errors[1] is None and errors[2] == "payload lacks qubits or gates" and errors[3] == "payload is not an object"
    assert errors[0] == "a gate's operational state is unreadable"


def test_payload_lists_are_read_in_one_step(spark):
    """A payload's members aren't copied to see their keys, nor a gate's parameters one by one; odd gates come out all the same."""
    gate = '{"gate": "cx", "qubits": [0, "1"], "parameters": [{"name": "e", "value": 0.5, "unit": "", "date": "2024-01-01T00:00:00Z"}, 7], "operational": "1"}'
    texts = ['{"qubits": [[{"name": " Operational", "value": true}, 3]], "gates": [%s]}' % gate, '{"qubits": 0, "gates": [%s, {"name": "x", "operational": 1.0}, {"gate": "y", "qubits": {"a": 1}}, {"gate": "z", "qubits": [0.5]}]}' % gate]
    raw = spark.createDataFrame(list(enumerate(texts)), "poll int, properties string")
    assert "MapType(StringType,VariantType" not in I.payloads(raw)._jdf.queryExecution().optimizedPlan().toString()
    plan = I.gate_properties(raw)._jdf.queryExecution().optimizedPlan().toString()
    assert "StructField(parameters,ArrayType(StructType(StructField(name,StringType" in plan
    assert [r.error for r in I.payloads(raw).orderBy("poll").collect()] == [None, None]
    assert sorted((r.poll, r.gate_name, r.qubits_key, r.parameter_name, r.value) for r in I.gate_properties(raw).collect()) == [(0, "cx", "0,1", "e", 0.5), (1, "cx", "0,1", "e", 0.5)]
    assert sorted((r.poll, r.gate_name, r.qubits_key, r.reported) for r in I.gate_operational(raw).collect()) == [(0, "cx", "0,1", True), (1, "cx", "0,1", True), (1, "x", "", True), (1, "z", "0", None)]
    assert [tuple(r)[:5] for r in I.qubit_operational(raw).collect()] == [(0, 0, True, True, True)]


def exchanges(df, *names):
    """Lines of the plan that deal rows anew and name these columns."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line and all(n in line for n in names)]


def test_usage_is_dealt_by_run_and_shares_are_counted_as_they_are(spark):
    rows = [("a", 0, r, str(c), 1 + (r or 0) * c % 3) for r in (None, 1, 2, 3) for c in range(4) if r is None or c <= r] * 2 + [("b", 1, None, "0", 5)]
    got = U.edge_usage(spark.createDataFrame(rows, "backend string, level int, run_id long, component_id string, ops long"))
    # no sum is dealt by run and component, whose rows are about as many as the given ones
    assert not exchanges(got, "run_id", "component_id")
    found = {(r.backend, r.component_id): (r.total_runs, r.used_runs, r.ops) for r in got.collect()}
    assert found["b", "0"] == (0, 0, 5)
    for c in range(4):
        own = [x for x in rows if x[0] == "a" and x[3] == str(c)]
        assert found["a", str(c)] == (3, len({x[2] for x in own} - {None}), sum(x[4] for x in own))


def test_synchrony_works_its_events_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [("a", "qubit", str(k % 3), 60_000_000 * (k // 3) * 7, float(k)) for k in range(30)]
    schema = "backend string, component_type string, component_id string, t long, drift_rms double"
    events = spark.createDataFrame(rows, schema).mapInArrow(count, schema)
    coverage = spark.createDataFrame([("a", 0, 60_000_000 * 35)], "backend string, study_start long, study_end long")
    found = M.synchrony(events, coverage, 15).collect()
    assert seen.value == len(rows)
    assert sorted((r.episode_number, r.component_event_count, r.component_count) for r in found) == [(0, 9, 3), (1, 9, 3)]


def test_event_times_are_those_of_the_events_with_drift(spark):
    rng = random.Random(11)
    rows = [("a", "qubit", str(rng.randrange(4)), rng.choice("xy"), "T1", t, t, rng.random()) for t in (60_000_000 * rng.randrange(900) for _ in range(300))]
    obs = spark.createDataFrame(rows, "backend string, component_type string, component_id string, property_key string, property_name string, t long, observed long, value double")
    keys = [*S.COMPONENT, "component_event_number", "t"]
    assert sorted(S.component_times(obs, 15).select(*keys).collect()) == sorted(S.component_events(S.property_drift(obs), 15).select(*keys).collect())
