"""Ranks, quantiles, adjusted values, dense sessions, fixed effects and betweenness of groups of any size, against plain recomputation."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from caldrift.functions.scratch import Scratch
from caldrift.operators import metrics as M
from caldrift.operators import ranks as R
from caldrift.operators import series as S
from caldrift.operators import sessions
from caldrift.operators import stats as Z
from caldrift.operators import studies as U

ODD = [None, float("nan"), 0.0, -0.0, 5e-324, -1e300, 1e300, math.pi, -math.pi, 1.0, 1.0 + 2**-52]


def values(rng, n):
    kinds = [lambda: rng.choice(ODD), lambda: rng.gauss(0, 1), lambda: rng.lognormvariate(0, 9), lambda: float(rng.randrange(4)), lambda: 5e9 + rng.random()]
    return [rng.choice(kinds)() for _ in range(n)]


def groups(rng):
    rows = [(k, u, x) for k, u, n in (("a", "s", 400), ("a", None, 300), (None, None, 50), ("b", "s", 1), ("c", "s", 2)) for x in values(rng, n)]
    rows += [("hot", "s", 2.5)] * 500 + [("none", "s", None)]
    of = defaultdict(list)
    for k, u, x in rows:
        if x is not None and not math.isnan(x):
            of[k, u].append(x)
    return rows, of


def test_quantiles_scales_gini_and_gap(spark):
    rows, of = groups(random.Random(3))
    df = spark.createDataFrame(rows, "k string, u string, x double").repartition(3)
    got = {(r.k, r.u): r for r in R.quantiles(df, ["k", "u"], "x", {"least": 0, "q1": 0.25, "half": 0.5, "q9": 0.9, "most": 1}).collect()}
    assert set(got) == set(of)
    for key, xs in of.items():
        assert got[key].n == len(xs)
        want = np.quantile(np.array(xs), [0, 0.25, 0.5, 0.9, 1])
        assert [got[key][c] for c in ("least", "q1", "half", "q9", "most")] == pytest.approx(want.tolist(), rel=1e-12, abs=1e-300)
    scales = {(r.k, r.u): r.scale for r in S.robust_scale(df.where("abs(x) < 1e9 OR x IS NULL"), ["k", "u"], "x").collect()}
    for key, xs in of.items():
        x = np.array([v for v in xs if abs(v) < 1e9])
        if not len(x):
            continue
        mad, (a, med, b) = 1.4826 * np.median(np.abs(x - np.median(x))), np.quantile(x, [0.25, 0.5, 0.75])
        want = mad if mad > 1e-12 else (b - a) / 1.349 if (b - a) / 1.349 > 1e-12 else x.std(ddof=1) if len(x) > 1 and x.std(ddof=1) > 1e-12 else max(abs(med) * 1e-9, 1e-12)
        assert scales[key] == pytest.approx(want, rel=1e-9)
    small = df.where("x BETWEEN 0 AND 1000")
    gaps = {(r.k, r.u): r.gap for r in M.pairwise_gap(small, ["k", "u"], "x").collect()}
    for key, xs in of.items():
        x = np.array([v for v in xs if 0 <= v <= 1000])
        if len(x) > 1:
            assert gaps[key] == pytest.approx(np.abs(x[:, None] - x).sum() / len(x) / (len(x) - 1), rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("families", [[], ["k", "u"]])
def test_adjusted_values(spark, families):
    rng = random.Random(5)
    rows = [(rng.choice(["a", None]), rng.choice(["s", None]), rng.choice([None, float("nan"), 0.0, 1.0, 0.03, rng.random(), rng.random() ** 9])) for _ in range(700)] + [("a", "s", 0.2)] * 200
    df = spark.createDataFrame(rows, "k string, u string, p double")
    got = Z.benjamini_hochberg(df, "p", "q", families).collect()
    assert len(got) == len(rows)
    of = defaultdict(list)
    for r in got:
        of[(r.k, r.u) if families else ()].append((r.p, r.q))
    for pairs in of.values():
        known = sorted(((p, q) for p, q in pairs if p is not None and not math.isnan(p)), reverse=True)
        assert all(q is None for p, q in pairs if p is None or math.isnan(p))
        least = 1.0
        for k, (p, q) in enumerate(known):
            least = min(least, p * len(known) / (len(known) - k))
            assert q == pytest.approx(least, rel=1e-12)


def test_no_window_over_a_whole_group(spark):
    """Windows over a group's rows are by group and bucket; those by group alone read a row a bucket."""
    df = spark.range(10).selectExpr("cast(id as double) AS x", "'a' AS k")
    plan = R.adjusted(R.cumulative(df, ["k"], "x"))._jdf.queryExecution().optimizedPlan().toString()
    over = [line for line in plan.splitlines() if "Window [" in line]
    assert over and all("bucket" in line.split("],")[1] or "sum(m" in line or "min(m" in line for line in over)


def test_correlations_of_tied_ranks(spark):
    rng = random.Random(8)
    rows = [("g", float(rng.randrange(3)), rng.gauss(0, 1)) for _ in range(300)]
    got = {r.method: r.correlation for r in Z.correlations(spark.createDataFrame(rows, "g string, y double, x double"), ["g"], ["y"], ["x"]).collect()}
    mean_rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    x, y = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    assert got["pearson"] == pytest.approx(np.corrcoef(x, y)[0, 1]) and got["spearman"] == pytest.approx(np.corrcoef(mean_rank(x), mean_rank(y))[0, 1])


def loop(times, tolerance):
    out, anchor, n = {}, None, -1
    for t in sorted(times):
        if anchor is None or t - anchor > tolerance:
            anchor, n = t, n + 1
        out[t] = (anchor, n)
    return out


def test_dense_sessions_against_a_loop(spark):
    rng = random.Random(11)
    times = {
        ("a", 1): {rng.randrange(0, 4000) for _ in range(900)}, ("a", 2): set(range(100, 700, 7)), ("b", 1): {10**15 + k for k in range(0, 3000, 11)} | {5}, ("b", 2): {-50, -20, 3}, ("c", 1): {rng.randrange(0, 10**6) for _ in range(300)},
    }
    rows = [(*k, t, i) for k, ts in times.items() for t in ts for i in range(2)] + [("d", None, 3, 0), ("d", 1, None, 0)]
    df = spark.createDataFrame(rows, "k string, u int, t long, row int")
    for tolerance in (0, 10, 64, 5000):
        got = sessions.dense(df, ["k", "u"], "t", tolerance).collect()
        assert len(got) == sum(2 * len(ts) for ts in times.values())
        want = {key: loop(ts, tolerance) for key, ts in times.items()}
        assert all((r.anchor, r.number) == want[r.k, r.u][r.t] for r in got)


def test_one_dense_run_of_a_million_times(spark):
    n, step, tolerance = 10**6, 1_000_000, 16_500_000
    df = spark.range(n).select(F.lit("k").alias("k"), (F.col("id") * step + F.pmod(F.xxhash64("id"), F.lit(step))).alias("t"))
    got = sessions.dense(df, ["k"], "t", tolerance)
    found = np.array(got.select("t", "anchor", "number").toPandas().sort_values("t"))
    want = loop(found[:, 0].tolist(), tolerance)
    assert len(found) == n == len(want) and (found[:, 1:] == np.array([want[t] for t in found[:, 0].tolist()])).all()


@pytest.mark.parametrize("share", [1.0, 0.4])
def test_fixed_effects_of_panels_with_holes(spark, share):
    rng = random.Random(17)
    rows = []
    for g in ("p", "q", None):
        for e in range(9):
            for t in range(14):
                if rng.random() < share:
                    x = rng.gauss(0, 1) + 0.3 * e
                    rows.append((g, f"e{e}", t, x, rng.choice([None, float("nan")]) if rng.random() < 0.05 else 1.5 * x + e * e - 0.4 * t + rng.gauss(0, 0.5)))
    rows += [("flat", f"e{k % 4}", k, 1.0, float(k)) for k in range(12)] + [("none", "e", 1, 1.0, None)]
    df = spark.createDataFrame(rows, "g string, entity string, t int, x double, y double")
    got = {r.g: r for r in Z.two_way(df, ["g"], "entity", "t", ["y"], ["x"]).collect()}
    assert set(got) == {"p", "q", None, "flat", "none"} and got["none"].n == 0 and got["flat"].coefficient is None and got["flat"].n == 12
    for g in ("p", "q", None):
        own = [(e, t, x, y) for k, e, t, x, y in rows if k == g and y is not None and not math.isnan(y)]
        es, ts = sorted({r[0] for r in own}), sorted({r[1] for r in own})
        dummies = np.array([[r[0] == e for e in es] + [r[1] == t for t in ts] for r in own], float)
        away = lambda v: v - dummies @ np.linalg.lstsq(dummies, v, rcond=None)[0]  # noqa: E731, B023
        x, y = away(np.array([r[2] for r in own])), away(np.array([r[3] for r in own]))
        slope = x @ y / (x @ x)
        u = y - slope * x
        meat = lambda k: sum(sum((x * u)[[r[k] == c for r in own]]) ** 2 for c in {r[k] for r in own})  # noqa: E731, B023
        variance = (meat(0) + meat(1) - ((x * u) ** 2).sum()) / (x @ x) ** 2
        assert (got[g].n, got[g].entities, got[g].times) == (len(own), len(es), len(ts))
        assert got[g].coefficient == pytest.approx(slope, rel=1e-8) and got[g].within_r2 == pytest.approx(1 - u @ u / (y @ y), rel=1e-7)
        assert got[g].standard_error == pytest.approx(math.sqrt(variance), rel=1e-6) if variance > 0 else got[g].standard_error is None


def test_betweenness_with_one_and_many_shards(spark):
    rng = random.Random(23)
    rows = {(g, *sorted(rng.sample(range(n), 2))) for g, n in (("a", 40), ("b", 12)) for _ in range(2 * n)} | {("path", k, k + 1) for k in range(4)} | {("pair", 3, 9)}
    df = spark.createDataFrame(sorted(rows), "backend string, a long, b long")
    one, many = ({(r.backend, r.component_id): r.edge_betweenness for r in U.edge_betweenness(df, n).collect()} for n in (1, 64))
    assert one == pytest.approx(many, rel=1e-12) and len(one) == len(rows)
    assert [one["path", f"{k}-{k + 1}"] for k in range(4)] == pytest.approx([0.4, 0.6, 0.6, 0.4]) and one["pair", "3-9"] == 1.0


def test_scratch_is_deleted(spark):
    with Scratch(spark) as s:
        assert s.write(spark.range(3), "x").count() == 3
        files, path = s._path()
        assert files.exists(path)
    assert not files.exists(path)
