"""Follow-up studies: weekly extremes, alignment to anchors, coupling graphs and compiler usage."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caldrift.functions.expr import HOUR, MINUTE, flag, ratio

from . import stats
from .grid import nearest

WEEK = 7 * 24 * HOUR
#: Minutes for which the shares of aligned changes are told.
TOLERANCES = (1, 5, 15, 30, 60, 120, 240, 480, 720, 1440)


def weekly_counts(events: DataFrame, coverage: DataFrame) -> DataFrame:
    """Edge events in whole weeks from the study's start."""
    e = events.where("component_type = 'edge'").join(coverage.select("backend", "study_start", "study_end"), "backend").where(F.col("t") >= F.col("study_start"))
    week = F.expr(f"(t - study_start) div {WEEK}")
    full = F.expr(f"(study_end - study_start) div {WEEK}")
    return e.withColumn("week", week).where(F.col("week") < full).groupBy("backend", "week", "component_id").agg(F.count("*").alias("n"))


def weekly_extremes(weekly: DataFrame) -> DataFrame:
    """Each week's peak and least edge (smaller id at a tie), their ratio, the active edges and the total."""
    return weekly.groupBy("backend", "week").agg(
        F.min_by("component_id", F.struct(-F.col("n"), "component_id")).alias("peak_edge"), F.max("n").alias("peak"), F.min_by("component_id", F.struct("n", "component_id")).alias("least_edge"), F.min("n").alias("least"), F.count("*").alias("active_edges"), F.sum("n").alias("total")
    ).withColumn("peak_ratio", ratio(F.col("peak"), F.col("least")))


def best_week(extremes: DataFrame) -> DataFrame:
    w = Window.partitionBy("backend").orderBy(F.desc("peak_ratio"), F.desc("peak"), "week")
    return extremes.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def full_period_ratio(cadence: DataFrame) -> DataFrame:
    """Most and least calibrated edge of each backend; the ratio is null where the least has none."""
    c = cadence.where("component_type = 'edge'")
    n = F.col("calibration_event_count")
    return c.groupBy("backend").agg(F.max(n).alias("most"), F.min(n).alias("least"), F.min_by("component_id", F.struct(-n, "component_id")).alias("most_edge"), F.min_by("component_id", F.struct(n, "component_id")).alias("least_edge")).withColumn("max_min_ratio", ratio(F.col("most"), F.col("least")))


def value_change(events: DataFrame, peaks: DataFrame) -> DataFrame:
    """Of the peak edge's events, those with a defined drift (named for a value change, as users know it) and with a defined adverse one."""
    e = events.join(peaks.select("backend", F.col("most_edge").alias("component_id")), ["backend", "component_id"]).where("component_type = 'edge'")
    return e.groupBy("backend", "component_id").agg(F.count("*").alias("events"), F.sum(flag(F.col("drift_property_count") > 0)).alias("events_with_change"), F.sum(flag(F.col("quality_property_count") > 0)).alias("events_with_adverse")).withColumn("change_fraction", ratio(F.col("events_with_change"), F.col("events")))


def constant_one(obs: DataFrame, part: str = "gate_error") -> DataFrame:
    """Series of the edge properties whose names contain a text, and whether they only ever read one."""
    return obs.where((F.col("component_type") == "edge") & F.lower("property_name").contains(part.lower())).groupBy("backend", "component_id", "property_key").agg(
        F.count("value").alias("n"), F.countDistinct("value").alias("distinct_values"), F.min("value").alias("least"), F.max("value").alias("most"), F.coalesce(F.bool_and(F.col("value") == 1.0), F.lit(False)).alias("constant_one")
    )


def constant_one_edge(series: DataFrame) -> DataFrame:
    """By edge: whether any, and how many, of its series are constantly one; texts for true count."""
    truth = F.lower(F.trim(F.col("constant_one").cast("string"))).isin("true", "1", "yes")
    return series.groupBy("backend", "component_id").agg(F.bool_or(truth).alias("any_constant_one"), F.count_if(truth).alias("constant_series"))


def anchor_observations(anchors: DataFrame) -> DataFrame:
    return anchors.groupBy("backend", "t").agg(F.min("observed").alias("first_observed"), F.max("observed").alias("last_observed"), F.count("*").alias("poll_count"))


def aligned(changes: DataFrame, anchors: DataFrame) -> DataFrame:
    """Property changes with their nearest anchor of the same backend."""
    return nearest(changes, anchors.select("backend", "t").distinct(), ["backend"])


def alignment_summary(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Distances to the nearest anchor, and to the next and the previous one; an unknown distance counts as not within, in the denominators."""
    signed, size = F.col("signed_minutes"), F.col("absolute_minutes")
    to_next, since = ((F.col(a) - F.col(b)) / F.lit(float(MINUTE)) for a, b in (("anchor_after_t", "t"), ("t", "anchor_before_t")))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return rows.groupBy(*groups).agg(
        F.count("*").alias("n"), F.expr("percentile(signed_minutes, 0.5D)").alias("median_signed"), F.expr("percentile(absolute_minutes, array(0.5D, 0.9D, 0.95D))").alias("q"),
        share(signed < 0).alias("fraction_before"), share(signed == 0).alias("fraction_exact"), share(signed > 0).alias("fraction_after"),
        *[share(size <= t).alias(f"fraction_within_{t}m") for t in TOLERANCES],
        *[share(to_next.between(0, t)).alias(f"fraction_before_next_{t}m") for t in TOLERANCES],
        *[share(since.between(0, t)).alias(f"fraction_after_previous_{t}m") for t in TOLERANCES],
    ).select("*", F.col("q")[0].alias("median_absolute"), F.col("q")[1].alias("p90_absolute"), F.col("q")[2].alias("p95_absolute")).drop("q")


def anchor_events(buckets: DataFrame, keys: list[str]) -> DataFrame:
    """Buckets of aligned changes; a bucket's time is its start."""
    return buckets.groupBy(*keys, F.col("number").alias("bucket")).agg(
        F.min("t").alias("t"), F.max("t").alias("bucket_end"), F.count("*").alias("row_count"), F.countDistinct("property_name").alias("families"), F.count_if("value_changed").alias("changed_count"), F.bool_or("value_changed").alias("any_changed"), F.array_join(F.array_sort(F.collect_set("property_name")), ";").alias("family_list")
    )


# ---------------------------------------------------------------- coupling graphs


def undirected(couplings: DataFrame) -> DataFrame:
    return couplings.where("a <> b").select("backend", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def edge_degrees(edges: DataFrame) -> DataFrame:
    d = edges.select("backend", F.explode(F.array("a", "b")).alias("node")).groupBy("backend", "node").agg(F.count("*").alias("d"))
    left, right = d.select("backend", F.col("node").alias("a"), F.col("d").alias("da")), d.select("backend", F.col("node").alias("b"), F.col("d").alias("db"))
    return edges.join(left, ["backend", "a"]).join(right, ["backend", "b"]).select("backend", F.concat_ws("-", "a", "b").alias("component_id"), "a", "b", (F.col("da") + F.col("db")).alias("degree_sum"), F.greatest("da", "db").alias("degree_max"), F.least("da", "db").alias("degree_min"))


#: Tasks among which the searches of one device's graph are dealt.
SHARDS = 64


def flows_of(edges: list[tuple[int, int]], roots: list[int]) -> dict[tuple[int, int], float]:
    """What the shortest paths from some roots to all nodes carry over each edge: a breadth-first search and back-propagation from each root."""
    near: dict[int, list[int]] = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    out = dict.fromkeys(((min(e), max(e)) for e in edges), 0.0)
    for root in roots:
        depth, paths, order, queue = {root: 0}, {root: 1.0}, [], deque([root])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in depth:
                    depth[w], paths[w] = depth[v] + 1, 0.0
                    queue.append(w)
                if depth[w] == depth[v] + 1:
                    paths[w] += paths[v]
        flow = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if depth[v] == depth[w] - 1:
                    c = paths[v] / paths[w] * (1.0 + flow[w])
                    out[min(v, w), max(v, w)] += c
                    flow[v] += c
    return out


def edge_betweenness(edges: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(backend, component_id, edge_betweenness): share of all ordered pairs of a device's nodes whose shortest paths run over each edge.

    The searches are independent, so their roots are dealt to (backend, shard) by hash and the edges' flows summed by Spark. A task holds one device's
    edges and one search, and does a shard's part of its searches; edges are sent once for each shard. ``edges`` are distinct with a < b.
    """
    nodes = edges.select("backend", F.explode(F.array("a", "b")).alias("root")).distinct()
    roots = nodes.select("backend", F.pmod(F.xxhash64("root"), F.lit(shards)).cast("int").alias("shard"), F.col("root").alias("a"), F.lit(None).cast("long").alias("b"))
    used = roots.select("backend", "shard").distinct()
    sent = edges.select("backend", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).join(used, "backend").select("backend", "shard", "a", "b")

    def of(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        is_root = rows["b"].isna()
        pairs = rows[~is_root].astype({"a": int, "b": int})
        found = flows_of(list(zip(pairs["a"].tolist(), pairs["b"].tolist(), strict=True)), sorted(rows.loc[is_root, "a"].astype(int)))
        return pd.DataFrame([(key[0], a, b, x) for (a, b), x in found.items() if x], columns=["backend", "a", "b", "flow"])

    dealt = sent.unionByName(roots.select("backend", "shard", F.col("a").cast("long").alias("a"), "b"))
    flows = dealt.groupBy("backend", "shard").applyInPandas(of, "backend string, a long, b long, flow double").groupBy("backend", "a", "b").agg(F.sum("flow").alias("flow"))
    count = nodes.groupBy("backend").agg(F.count("*").alias("n"))
    share = F.coalesce(ratio(F.col("flow"), F.col("n") * (F.col("n") - 1)), F.lit(0.0))
    return flows.join(count, "backend").select("backend", F.concat_ws("-", "a", "b").alias("component_id"), share.alias("edge_betweenness"))


def topology_table(edges: DataFrame, cadence: DataFrame) -> DataFrame:
    """Nodes and edges of the coupling graph with their rates, in one tidy table."""
    nodes = edges.select("backend", F.explode(F.array("a", "b")).alias("n")).distinct().select("backend", F.lit("qubit").alias("component_type"), F.col("n").cast("string").alias("component_id"))
    links = edges.select("backend", F.lit("edge").alias("component_type"), F.concat_ws("-", "a", "b").alias("component_id"))
    return nodes.unionByName(links).join(cadence.select("backend", "component_type", "component_id", "rate", "n"), ["backend", "component_type", "component_id"], "left")


# ---------------------------------------------------------------- compiler usage


def run_share(usage: DataFrame) -> DataFrame:
    """Operations of each run on each edge and their share of the run's. Rows are dealt by run once, for the sums and for the total."""
    by_edge = usage.repartition("backend", "level", "run_id").groupBy("backend", "level", "run_id", "component_id").agg(F.sum("ops").alias("ops"))
    total = F.sum("ops").over(Window.partitionBy("backend", "level", "run_id"))
    return by_edge.withColumn("within_run_share", ratio(F.col("ops"), total))


def edge_usage(usage: DataFrame) -> DataFrame:
    """By edge: runs that used it, operations, mean share within the runs that used it, presence among all runs, share of all operations.

    ``run_share`` has a row for each run and edge, so its rows are counted as they are; the runs themselves are counted from their own dealing.
    """
    shares = run_share(usage)
    runs = usage.select("backend", "level", "run_id").repartition("backend", "level", "run_id").distinct().groupBy("backend", "level").agg(F.count("run_id").alias("total_runs"))
    out = shares.groupBy("backend", "level", "component_id").agg(F.count("run_id").alias("used_runs"), F.sum("ops").alias("ops"), F.sum("within_run_share").alias("s")).join(runs, ["backend", "level"])
    everything = F.sum("ops").over(Window.partitionBy("backend", "level"))
    return out.select("backend", "level", "component_id", "total_runs", "used_runs", "ops", ratio(F.col("s"), F.col("used_runs")).alias("mean_share"), ratio(F.col("used_runs"), F.col("total_runs")).alias("presence"), ratio(F.col("ops"), everything).alias("global_share"))


def edge_table(topology: DataFrame, usage: DataFrame, cadence: DataFrame, constants: DataFrame) -> DataFrame:
    """Every edge of each device's coupling graph at every level it was compiled at, with its usage, calibration rate and flags.

    Edges that no run used have no operations and no presence; those never calibrated keep null rates; those without a
    flag are not constant. Keys are (backend, component_id), and level where there is one.
    """
    used = edge_usage(usage).select("backend", "level", "component_id", "used_runs", "ops", "mean_share")
    runs = usage.groupBy("backend", "level").agg(F.countDistinct("run_id").alias("total_runs"))
    rates = cadence.where("component_type = 'edge'").select("backend", "component_id", "calibration_event_count", "calibration_events_per_day")
    full = topology.join(runs, "backend").join(used, ["backend", "level", "component_id"], "left").join(rates, ["backend", "component_id"], "left").join(constants, ["backend", "component_id"], "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("used_runs", "ops", "mean_share", "constant_series")}
    full = full.withColumns(zero | {"any_constant_one": F.coalesce("any_constant_one", F.lit(False))})
    everything = F.sum("ops").over(Window.partitionBy("backend", "level"))
    return full.withColumn("presence", ratio(F.col("used_runs"), F.col("total_runs"))).withColumn("global_share", ratio(F.col("ops"), everything))


def scoped(table: DataFrame) -> DataFrame:
    """The edges twice: all of them, and those that aren't constantly one."""
    return table.withColumn("scope", F.explode(F.when(F.col("any_constant_one"), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("filtered")))))


def backend_summary(table: DataFrame, controls: tuple[str, ...] = ("edge_betweenness", "degree_sum"), rate: str = "calibration_events_per_day", drop_constant: bool = True) -> DataFrame:
    """By device and level: edges, the share that the compiler used, rank correlations of usage with the calibration rate, and the usage's
    beta and R2 beside the topology's controls; for all edges and for those that aren't constantly one."""
    groups, both = ["backend", "level"], scoped(table)
    rho = stats.correlations(both, [*groups, "scope"], [rate], ["mean_share", "presence"]).where("method = 'spearman'")
    beta = stats.standardized_ols(both, [*groups, "scope"], rate, ["mean_share", *controls], drop_constant)
    base = table.groupBy(*groups).agg(F.count("*").alias("edges"), F.count_if("any_constant_one").alias("constant_edges"), F.avg((F.col("used_runs") > 0).cast("double")).alias("used_all"), F.avg(F.when(~F.col("any_constant_one"), (F.col("used_runs") > 0).cast("double"))).alias("used_filtered"))
    pick = lambda value, scope, extra=F.lit(True): F.max(F.when((F.col("scope") == scope) & extra, F.col(value)))
    rhos = rho.groupBy(*groups).agg(*[pick("correlation", scope, F.col("predictor") == p).alias(f"rho_{name}_{scope}") for name, p in (("share", "mean_share"), ("presence", "presence")) for scope in ("all", "filtered")])
    betas = beta.groupBy(*groups).agg(*[pick(v, scope).alias(f"{name}_{scope}") for name, v in (("beta", "beta_mean_share"), ("r2", "r2")) for scope in ("all", "filtered")])
    return base.join(rhos, groups, "left").join(betas, groups, "left")


def instruction_pairs(instructions: DataFrame) -> DataFrame:
    """Two-qubit instructions of each circuit by unordered pair."""
    q = F.col("qubits")
    return instructions.where(F.size(q) == 2).select("circuit", F.least(q[0], q[1]).alias("a"), F.greatest(q[0], q[1]).alias("b")).groupBy("circuit", "a", "b").agg(F.count("*").alias("n"))


#: Families of the circuit suite, the names of their circuits, their sizes and layers.
SUITE = (
    ("GHZ", "ghz_{n}", (4, 8, 16, 24), 1),
    ("QFT", "qft_{n}", (4, 8, 12), 1),
    ("Bernstein-Vazirani", "bv_{n}", (5, 9, 17, 25), 1),
    ("QAOA-ring", "qaoa_ring_{n}_p2", (6, 12, 18, 24), 2),
    ("Ising-Trotter", "ising_{n}_l4", (8, 16, 24), 4),
    ("Random-brickwork", "random_brickwork_{n}_l6", (8, 16, 24), 6),
    ("Dense-entangling", "dense_{n}_l2", (6, 10, 14), 2),
)


def circuit_names() -> list[tuple[str, str, int, int]]:
    return [(family, name.format(n=n), n, layers) for family, name, sizes, layers in SUITE for n in sizes]


def suite_overhead(suite: DataFrame, runs: DataFrame) -> DataFrame:
    """The suite's circuits with their compiled runs (run_id, circuit_name, ops): how many, all their two-qubit operations, and those of a run over the logical ones."""
    made = runs.groupBy("circuit_name").agg(F.count_distinct("run_id").alias("runs"), F.sum("ops").alias("compiled_ops"))
    return suite.join(made, "circuit_name", "left").withColumn("runs", F.coalesce("runs", F.lit(0))).withColumn("overhead", ratio(F.col("compiled_ops"), F.col("runs") * F.col("two_qubit_ops"))).select(
        *suite.columns, "runs", "compiled_ops", "overhead"
    )


def circuit_suite(spark) -> DataFrame:
    """The suite's circuits with the numbers of their logical two-qubit operations, in closed form from size and layers."""
    rows = spark.createDataFrame(circuit_names(), "family string, circuit_name string, n int, layers int")
    n, layers = F.col("n"), F.col("layers")
    pairs = F.expr("n * (n - 1) div 2")
    ops = {
        "GHZ": n - 1, "QFT": pairs + F.expr("n div 2"), "Bernstein-Vazirani": F.expr("n div 2"), "QAOA-ring": layers * n, "Ising-Trotter": layers * (n - 1),
        "Random-brickwork": F.expr("(layers + 1) div 2 * (n div 2) + layers div 2 * ((n - 1) div 2)"), "Dense-entangling": layers * pairs,
    }
    count = F.coalesce(*[F.when(F.col("family") == f, x.cast("long")) for f, x in ops.items()])
    return rows.withColumn("two_qubit_ops", count)
