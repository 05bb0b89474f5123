"""The frames of the analysis as deterministic projections of the test tables, in Spark; ``oracles`` has them in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caldrift.functions.expr import HOUR, micros


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", micros("ts").alias("us"))
    k = F.col("event_id") % 4
    pick = lambda *xs: F.when(k == 0, xs[0]).when(k == 1, xs[1]).when(k == 2, xs[2]).otherwise(xs[3])
    return e.select(
        F.col("event_type").alias("backend"),
        F.when(F.col("user_id") % 2 == 0, "qubit").otherwise("edge").alias("component_type"),
        F.col("user_id").cast("string").alias("component_id"),
        pick("T1[s]", "T2[s]", "readout_error[]", "cz:frequency[]").alias("property_key"),
        pick("T1", "T2", "readout_error", "cz:frequency").alias("property_name"),
        F.when(k < 2, "s").alias("unit"),
        (F.expr(f"us div {HOUR}") * HOUR).alias("t"),
        F.col("us").alias("observed"),
        F.when(k == 3, F.col("value") - 50).otherwise(F.col("value")).alias("value"),
    )


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("backend"), micros("ts").alias("t"), F.floor("value").cast("int").alias("pending_jobs"))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("backend"), micros("ts").alias("us"))
    return e.groupBy("backend").agg(F.min("us").alias("study_start"), F.max("us").alias("study_end"), F.count("*").alias("successful_fetch_count"))


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchor dates as they were polled: one row a poll."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("backend"), micros("ts").alias("observed"))
    return e.withColumn("t", F.expr(f"observed div {24 * HOUR}") * (24 * HOUR))


def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    started = micros("o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("cycle"), F.col("o_orderpriority").alias("backend"), started.alias("started"),
        F.when(F.col("o_orderkey") % 7 != 0, started + 60_000_000 * (F.col("o_orderkey") % 5)).alias("finished"), (F.col("o_orderstatus") != "F").alias("success"), F.col("o_totalprice").alias("price"),
    )


def properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Property rows of polls: one qubit and one edge reading for each line."""
    x = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    return x.select(
        F.col("l_orderkey").alias("cycle"), n.alias("qubit"), F.concat_ws("-", n, n + 1).alias("edge_id"), F.col("l_returnflag").alias("gate"),
        F.when(F.col("l_linestatus") == "O", True).when(F.col("l_quantity") >= 10, False).alias("reported"), micros("l_shipdate").alias("date"), F.col("l_extendedprice").alias("value"),
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-qubit operations of compiled runs on each edge."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("backend"), (F.col("l_linenumber") % 2).alias("level"), F.col("l_suppkey").cast("string").alias("component_id"), F.col("l_quantity").cast("long").alias("ops"))


NODES = 400


def topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Couplings as they are listed: of near nodes, both directions, repeats and loops among them."""
    e = table(spark, sf_dir, "events")
    near = (F.col("user_id") + F.col("event_id") % 4) % NODES
    turned = F.col("event_id") % 8 > 3
    node = F.col("user_id") % NODES
    return e.select(F.col("event_type").alias("backend"), F.when(turned, near).otherwise(node).alias("a"), F.when(turned, node).otherwise(near).alias("b"))


def compiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-qubit operations of compiled runs on the couplings of ``topology``, one for each event; those of nodes three apart no run uses."""
    e = table(spark, sf_dir, "events")
    apart = F.when(F.col("event_id") % 4 == 2, 2).otherwise(1)
    a, b = F.col("user_id") % NODES, (F.col("user_id") + apart) % NODES
    run = F.expr("event_id div 40")
    return e.select(run.alias("run_id"), F.col("event_type").alias("backend"), (run % 2).alias("level"), F.concat_ws("-", F.least(a, b), F.greatest(a, b)).alias("component_id"), (F.col("user_id") % 7 + 1).alias("ops"))


def coupling_id(component_id: Column, component_type: Column) -> Column:
    """The name in ``topology`` of a component of ``observations``: a node, or a node and the next one."""
    n = component_id.cast("long") % NODES
    return F.when(component_type == "qubit", n.cast("string")).otherwise(F.concat_ws("-", F.least(n, (n + 1) % NODES), F.greatest(n, (n + 1) % NODES)))
