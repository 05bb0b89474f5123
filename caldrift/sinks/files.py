"""File sinks: compressed CSV, run metadata, batches of tables committed by a marker, upserts by partition."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from caldrift.functions.expr import moment
from caldrift.functions.scratch import Scratch
from caldrift.operators.cycles import upsert


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A file that is there whole or not at all: written beside its place and renamed, in any file system that Spark reaches."""
    files, target = _files(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{uuid.uuid4().hex}")
    out = files.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    if files.exists(target):
        files.delete(target, False)
    if not files.rename(beside, target):
        raise OSError(f"{path} was not written")


def write_csv(df: DataFrame, path: str, compress: bool = True, times: tuple[str, ...] = ()) -> int:
    """A folder of CSV files with header; times as ISO-8601 with microseconds and Z. The rows are counted as they are written."""
    for c in times:
        df = df.withColumn(c, F.date_format(moment(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("header", True).option("compression", "gzip" if compress else "none").csv(path)
    return seen.get["rows"]


def write_metadata(spark: SparkSession, path: str, parameters: dict, row_counts: dict[str, int], caveats: list[str]) -> dict:
    """A JSON file with parameters, the row counts that the writes gave, and caveats."""
    meta = {"parameters": parameters, "row_counts": row_counts, "caveats": caveats}
    _put(spark, path, json.dumps(meta, indent=2, sort_keys=True))
    return meta


MARKERS = "committed"


def write_cycle(tables: dict[str, DataFrame], root: str, batch: str) -> str:
    """All tables of one batch as an attempt of their own, then a marker that names it: the attempt's name.

    A repeated batch writes a new attempt; until its marker is there, readers see the one before, whole. What a failed attempt left is never
    read, and goes with ``drop_superseded``. One writer at a time commits a batch.
    """
    spark = next(iter(tables.values())).sparkSession
    attempt = f"a-{uuid.uuid4().hex}"
    for t, df in tables.items():
        df.write.parquet(f"{root}/{t}/batch={batch}/attempt={attempt}")
    files, folder = _files(spark, f"{root}/{MARKERS}")
    files.mkdirs(folder)
    before = [s.getPath().getName() for s in files.listStatus(folder)]
    n = 1 + max((int(x.rsplit(".", 2)[1]) for x in before if x.startswith(f"{batch}.")), default=0)
    _put(spark, f"{root}/{MARKERS}/{batch}.{n}.json", json.dumps({"batch": str(batch), "attempt": attempt, "n": n}))
    return attempt


def committed(spark: SparkSession, root: str) -> DataFrame:
    """(batch, attempt): the attempt that each batch's last marker names."""
    marks = spark.read.schema("batch string, attempt string, n long").json(f"{root}/{MARKERS}")
    return marks.groupBy("batch").agg(F.max_by("attempt", "n").alias("attempt"))


def read_committed(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Rows of the committed attempts; the join is on the folders' column, so others are not read."""
    rows = spark.read.parquet(f"{root}/{table}")
    return rows.join(committed(spark, root).select("attempt"), "attempt", "left_semi").drop("attempt")


def drop_superseded(spark: SparkSession, root: str) -> int:
    """Delete the folders of attempts that no marker names, when no reader or writer is at work: how many."""
    kept, gone = {r.attempt for r in committed(spark, root).collect()}, 0
    files, folder = _files(spark, root)
    for table in files.listStatus(folder):
        for batch in files.listStatus(table.getPath()) if table.getPath().getName() != MARKERS else ():
            for attempt in files.listStatus(batch.getPath()) if batch.isDirectory() else ():
                name = attempt.getPath().getName().removeprefix("attempt=")
                if name.startswith("a-") and name not in kept:
                    files.delete(attempt.getPath(), True)
                    gone += 1
    return gone


def upsert_table(path: str, new: DataFrame, keys: list[str], partition: str) -> None:
    """Rows of ``new`` take the places of those with their keys in the partitioned Parquet table at ``path``; only touched partitions are written.

    Touched are the partitions of new rows and those that hold an old row of their keys (a key may move); of the others no file is opened but for
    the keys. The merged partitions are staged first, as they are read from where they go. A repeat gives the same table.
    """
    spark = new.sparkSession
    files, target = _files(spark, path)
    if not files.exists(target):
        new.write.partitionBy(partition).parquet(path)
        return
    with Scratch(spark) as scratch:
        new = scratch.write(new, "new")
        kind = new.schema[partition].dataType
        old = spark.read.parquet(path)
        old = old.withColumn(partition, F.col(partition).cast(kind)).select(*new.columns)
        moved = old.select(partition, *keys).join(new.select(*keys), keys, "left_semi").select(partition)
        touched = scratch.write(new.select(partition).unionByName(moved).distinct(), "touched")
        inside = old.join(touched, old[partition].eqNullSafe(touched[partition]), "left_semi")
        merged = scratch.write(upsert(inside, new, keys), "merged")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
        emptied = touched.join(merged.select(F.col(partition).alias("caldrift_kept")).distinct(), F.col(partition).eqNullSafe(F.col("caldrift_kept")), "left_anti")
        for (name,) in emptied.select(F.coalesce(F.col(partition).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))).collect():
            files.delete(_files(spark, f"{path}/{partition}={name}")[1], True)
