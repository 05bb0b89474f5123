"""Restartable backfill: a manifest of runs, batches by sequence, idempotent results."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caldrift.operators import cycles as Y

VERSION = "1"
RUN = "run_id string, version string, status string, total long, last_sequence_no long, at double, error string"


def _log(spark: SparkSession, root: str, row: tuple) -> None:
    """Runs are an append-only log; the newest row of a run is its state."""
    spark.createDataFrame([row], RUN).coalesce(1).write.mode("append").parquet(f"{root}/runs")


def states(spark: SparkSession, root: str) -> DataFrame:
    """The newest state of each run; none where no run has begun. Other failures to read are raised."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/runs")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], RUN)
    log = spark.read.schema(RUN).parquet(f"{root}/runs")
    return log.groupBy("run_id").agg(F.max_by(F.struct("version", "status", "total", "last_sequence_no", "at", "error"), "at").alias("s")).select("run_id", "s.*")


def runs(spark: SparkSession, root: str) -> DataFrame:
    """The newest state of each run, the latest ten first."""
    return states(spark, root).orderBy(F.desc("at")).limit(10)


def start(spark: SparkSession, root: str, cycles: DataFrame, run_id: str | None = None, new_run: bool = False) -> tuple[str, int]:
    """(run, last sequence done): a run by id, else the newest unfinished one of this version, else a new one whose inputs are frozen."""
    if run_id and new_run:
        raise ValueError("a new run can't have a given id")
    wanted = F.col("run_id") == run_id if run_id else (F.col("version") == VERSION) & F.col("status").isin("running", "failed")
    known = None if new_run else states(spark, root).where(wanted).orderBy(F.desc("at")).first()
    if known:
        return known.run_id, known.last_sequence_no
    if run_id:
        raise LookupError(f"no run {run_id}")
    run = uuid.uuid4().hex
    Y.sequence(Y.previous_cycle(cycles)).write.parquet(f"{root}/items/{run}")
    _log(spark, root, (run, VERSION, "running", spark.read.parquet(f"{root}/items/{run}").count(), 0, time.time(), None))
    return run, 0


def dry_run(cycles: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a new run over all its batches would give, as one plan; nothing is written, neither results nor a run.

    A batch's results depend on its own items alone, so the whole job's are those of all items at once.
    """
    return compute(Y.sequence(Y.previous_cycle(cycles)))


class Lease:
    """One runner at a time: a lock file that is created only if it isn't there, tells its owner and end, and is renewed between batches.

    A lease whose end has passed belongs to a runner that died; the next one takes it over.
    """

    def __init__(self, spark: SparkSession, root: str, seconds: float = 3600, now: Callable[[], float] = time.time):
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.path = jvm.org.apache.hadoop.fs.Path(f"{root}/lease")
        self.files = self.path.getFileSystem(conf)
        self.owner, self.seconds, self.now = uuid.uuid4().hex, seconds, now

    def _write(self, replace: bool) -> None:
        out = self.files.create(self.path, replace)
        out.write(bytearray(json.dumps({"owner": self.owner, "ends": self.now() + self.seconds}).encode()))
        out.close()

    def held(self) -> dict | None:
        if not self.files.exists(self.path):
            return None
        size = self.files.getFileStatus(self.path).getLen()
        source = self.files.open(self.path)
        text = bytes(source.readNBytes(size))
        source.close()
        return json.loads(text) if text else {"owner": "", "ends": self.now() + self.seconds}  # being written just now

    def renew(self) -> None:
        if (self.held() or {}).get("owner") != self.owner:
            raise RuntimeError("the lease was taken over by another runner")
        self._write(True)

    def __enter__(self) -> Lease:
        known = self.held()
        if known and known["ends"] > self.now():
            raise RuntimeError(f"another runner holds the lease until {known['ends']:.0f}")
        if known:
            self.files.delete(self.path, False)
        self._write(False)  # fails if another runner was quicker
        return self

    def __exit__(self, *_: object) -> None:
        if (self.held() or {}).get("owner") == self.owner:
            self.files.delete(self.path, False)


def execute(spark: SparkSession, root: str, cycles: DataFrame, compute: Callable[[DataFrame], DataFrame], batch_size: int = 500, max_batches: int | None = None, lease_seconds: float = 3600, **options: object) -> str:
    """Every batch's results under its own folder (a repeated batch overwrites itself), then the run is complete; ``max_batches`` stops it cleanly before.

    Under a lease, so that no two runners work on one root.
    """
    if batch_size <= 0 or (max_batches is not None and max_batches <= 0):
        raise ValueError("batch size and number of batches must be positive")
    with Lease(spark, root, lease_seconds) as lease:
        run, done = start(spark, root, cycles, **options)
        items = spark.read.parquet(f"{root}/items/{run}")
        total, batches = items.count(), 0
        try:
            while done < total and batches != max_batches:
                compute(Y.batch(items, done, batch_size)).write.mode("overwrite").parquet(f"{root}/metrics/{run}/from={done}")
                done, batches = min(total, done + batch_size), batches + 1
                _log(spark, root, (run, VERSION, "completed" if done == total else "running", total, done, time.time(), None))
                lease.renew()
        except Exception as e:
            _log(spark, root, (run, VERSION, "failed", total, done, time.time(), str(e)[:5000]))
            raise
    return run


def with_retries(step: Callable[[], object], most: int = 8, sleep: Callable[[float], None] = time.sleep) -> object:
    """For driver-side I/O only: up to ``most`` more tries, waiting 2^k seconds, a minute at most."""
    for k in range(most + 1):
        try:
            return step()
        except OSError:
            if k == most:
                raise
            sleep(min(60.0, 2.0**k))
    return None
