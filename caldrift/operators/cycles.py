"""Per-poll metrics against the previous successful poll, the two views, and the backfill's set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caldrift.functions.expr import flag, seconds_between


def previous_cycle(cycles: DataFrame) -> DataFrame:
    """Successful polls with the one before on their backend, by (start, id)."""
    w = Window.partitionBy("backend").orderBy("started", "cycle")
    return cycles.where("success").withColumn("prev", F.lag("cycle").over(w)).withColumn("prev_started", F.lag("started").over(w))


def latest_dates(properties: DataFrame, component: str, gates: DataFrame | None = None) -> DataFrame:
    """(cycle, component, date): the newest date over the properties, and over one-qubit gates if given; ``operational``
    rows are left out by the caller (``not_operational``)."""
    rows = properties.select("cycle", component, "date")
    if gates is not None:
        rows = rows.unionByName(gates.select("cycle", component, "date"))
    return rows.where(F.col("date").isNotNull() & F.col(component).isNotNull()).groupBy("cycle", component).agg(F.max("date").alias("date"))


def not_operational(df: DataFrame, name: str = "property_name") -> DataFrame:
    return df.where(F.lower(F.trim(name)) != "operational")


def cycle_metrics(cycles: DataFrame, qubits: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per successful poll: the components with a newer date than in the previous poll (those in both only), the
    oldest component (smallest id at a tie) and its age. The first poll of a backend has none calibrated."""
    valid = previous_cycle(cycles).select("cycle", "backend", "started", "finished", "prev", "prev_started")
    polled = F.coalesce("finished", "started")

    def side(latest: DataFrame, component: str, name: str) -> DataFrame:
        now = latest.join(valid.select("cycle", "prev"), "cycle")
        before = latest.select(F.col("cycle").alias("prev"), component, F.col("date").alias("before"))
        both = now.join(before, ["prev", component], "left")
        return both.groupBy("cycle").agg(
            F.array_sort(F.collect_list(F.when(F.col("date") > F.col("before"), F.col(component)))).alias(f"{name}s_calibrated"),
            F.min_by(component, F.struct("date", component)).alias(f"oldest_{name}"),
            F.min("date").alias(f"oldest_{name}_date"),
        )

    out = valid.join(side(qubits, "qubit", "qubit"), "cycle", "left").join(side(edges, "edge_id", "edge"), "cycle", "left")
    for name, kind in (("qubit", "int"), ("edge", "string")):
        listed = F.coalesce(f"{name}s_calibrated", F.expr(f"cast(array() as array<{kind}>)"))
        out = out.withColumn(f"{name}s_calibrated", listed).withColumn(f"num_{name}s_calibrated", F.size(listed)).withColumn(f"max_{name}_age_seconds", seconds_between(F.col(f"oldest_{name}_date"), polled))
    return out


def interval_observations(metrics: DataFrame, cycles: DataFrame, status: DataFrame) -> DataFrame:
    """The interval view: metrics with their poll and its status."""
    c = cycles.select("cycle", "price")
    return metrics.select("cycle", "backend", "started", "prev_started").join(c, "cycle").join(status, "cycle", "left").withColumn("interval_seconds", (F.col("started") - F.col("prev_started")) / F.lit(1e6))


def edge_operational(gates: DataFrame, qubits: DataFrame) -> DataFrame:
    """The edge view: an edge works if one of its gates and both its endpoints do; unreported ones count as working."""
    effective = F.coalesce("reported", F.lit(True))
    edge = gates.groupBy("cycle", "edge_id", "a", "b").agg(
        F.bool_or(effective).alias("any_gate"), F.bool_and(F.col("reported").isNotNull()).alias("gates_explicit"), F.array_sort(F.collect_set(F.struct("gate", effective.alias("effective")))).alias("gate_states"),
        F.count_if(effective).alias("working_gates"), F.count("*").alias("gate_count"),
    )
    state = qubits.groupBy("cycle", "qubit").agg(F.bool_and(F.coalesce("reported", F.lit(True))).alias("effective"), F.bool_and(F.col("reported").isNotNull()).alias("explicit"))
    ends = edge.select("cycle", "edge_id", F.explode(F.array_distinct(F.array("a", "b"))).alias("qubit")).join(state, ["cycle", "qubit"], "left")
    both = ends.groupBy("cycle", "edge_id").agg(F.bool_and(F.coalesce("effective", F.lit(True))).alias("all_endpoints"), F.bool_and(F.coalesce("explicit", F.lit(False))).alias("endpoints_explicit"))
    return edge.join(both, ["cycle", "edge_id"]).withColumn("effective", F.col("any_gate") & F.col("all_endpoints")).withColumn("fully_explicit", F.col("gates_explicit") & F.col("endpoints_explicit"))


def sequence(cycles: DataFrame) -> DataFrame:
    """``cycles`` with a global number by (backend, start, id): ranks within backends plus the sizes of those before, so no
    single task orders the whole table."""
    w = Window.partitionBy("backend").orderBy("started", "cycle")
    sizes = cycles.groupBy("backend").agg(F.count("*").alias("n"))
    # backends are few (devices), so their running sum may be ordered in one task
    base = sizes.select("backend", (F.sum("n").over(Window.orderBy("backend").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    return cycles.withColumn("k", F.row_number().over(w)).join(base, "backend").withColumn("sequence_no", F.col("base") + F.col("k")).drop("k", "base")


def batch(items: DataFrame, cursor: int, size: int) -> DataFrame:
    """The next items by sequence, which is gapless, so a range and not a sort."""
    if size <= 0:
        raise ValueError("batch size must be positive")
    return items.where((F.col("sequence_no") > cursor) & (F.col("sequence_no") <= cursor + size))


def with_previous(items: DataFrame) -> DataFrame:
    """The cycles of a batch and those before them, once each."""
    return items.select("cycle").union(items.where("prev IS NOT NULL").select(F.col("prev").alias("cycle"))).distinct()


def quarantine(cycles: DataFrame, metrics: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cycles with invalid successes failed, metrics without theirs, audit of what they were)."""
    judged = cycles.withColumn("reason", F.when(F.col("success"), reason))
    message = F.concat_ws(" | ", F.expr("nullif(error_message, '')"), "reason")
    fixed = judged.withColumn("success", F.col("success") & F.col("reason").isNull()).withColumn("error_message", F.when(F.col("reason").isNotNull(), message).otherwise(F.col("error_message"))).drop("reason")
    bad = judged.where("reason IS NOT NULL")
    left = metrics.join(bad.select("cycle"), "cycle", "left_anti")
    audit = bad.select("cycle", "reason", F.to_json(F.struct(*cycles.columns)).alias("cycle_before"))
    return fixed, left, audit


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose key isn't new, and the new rows; written by partition overwrite."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def failed_rows(cycles: DataFrame) -> DataFrame:
    """Failure rows: the message cut at 5000 characters."""
    return cycles.where(~F.col("success")).withColumn("error_message", F.substring("error_message", 1, 5000))


def run_status(items: DataFrame, done: int) -> DataFrame:
    """Progress of a run: totals, what is processed and the last item."""
    past = F.col("sequence_no") <= done
    return items.agg(F.count("*").alias("total_cycles"), F.sum(flag(past)).alias("processed_cycles"), F.max(F.when(past, F.col("sequence_no"))).alias("last_sequence_no"), F.max_by("cycle", F.when(past, F.col("sequence_no"))).alias("last_cycle")).withColumn(
        "status", F.when(F.col("processed_cycles") == F.col("total_cycles"), "completed").otherwise("running")
    )
