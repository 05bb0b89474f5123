"""The polling stream over landed files, run until nothing is left."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caldrift.streaming import poll

from . import proxies as P
from .metric_queries import ORACLES, QUERIES, query  # noqa: F401


def work_folder(spark: SparkSession) -> str:
    """A folder that the cluster shares, from its setting; a local one only where none is set on a local master, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the cluster shares")
    root = root or "file://" + tempfile.mkdtemp(prefix="caldrift-stream-")
    return f"{root}/caldrift-stream-{uuid.uuid4().hex}"


@query(
    "stream_prev_state",
    """SELECT cycle, backend, started, success, prev_cycle, CAST(CASE WHEN success AND started > prev_started THEN 1 ELSE 0 END AS INT) AS num_calibrated FROM
      (SELECT *, last_value(CASE WHEN success THEN cycle END IGNORE NULLS) OVER w AS prev_cycle, last_value(CASE WHEN success THEN started END IGNORE NULLS) OVER w AS prev_started FROM cycles
       WINDOW w AS (PARTITION BY backend ORDER BY started, cycle ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
)
def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = land(spark, sf_dir)
    poll.run_once(poll.diff_polls(poll.landed(spark, f"{root}/landing")), f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out").drop("batch")


def land(spark: SparkSession, sf_dir: str, part: str = "true") -> str:
    root = work_folder(spark)
    polls(spark, sf_dir).where(part).write.json(f"{root}/landing")
    return root


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.cycles(spark, sf_dir).select("cycle", "backend", "started", "success", F.when(F.col("success"), F.to_json(F.struct(F.col("started").alias("q0")))).alias("dates"))


@query("stream_poll_loop", "SELECT backend, count(*) AS polls, count(*) FILTER (success) AS good, count(*) FILTER (NOT success) AS failed, max(started) AS newest FROM cycles GROUP BY 1")
def loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loop stopped and started again: what landed before and after it is taken once each."""
    middle = P.cycles(spark, sf_dir).agg(F.expr("percentile_approx(started, 0.5)").alias("m")).first().m
    root = land(spark, sf_dir, f"started <= {middle}")
    run = lambda: poll.run_once(poll.diff_polls(poll.landed(spark, f"{root}/landing")), f"{root}/out", f"{root}/checkpoint")
    run()
    polls(spark, sf_dir).where(f"started > {middle}").write.mode("append").json(f"{root}/landing")
    run()
    out = spark.read.parquet(f"{root}/out")
    return out.groupBy("backend").agg(F.count("*").alias("polls"), F.count_if("success").alias("good"), F.count_if(~F.col("success")).alias("failed"), F.max("started").alias("newest"))


@query("stream_exactly_once", "SELECT cycle, backend, success FROM cycles")
def repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every batch is written a second time, as after a crash between writing and committing: each poll is still there once."""
    root = land(spark, sf_dir)
    for attempt in ("first", "again"):  # a fresh checkpoint replays the same batches under the same ids
        poll.run_once(poll.diff_polls(poll.landed(spark, f"{root}/landing")), f"{root}/out", f"{root}/checkpoint-{attempt}")
    return spark.read.parquet(f"{root}/out").select("cycle", "backend", "success")
