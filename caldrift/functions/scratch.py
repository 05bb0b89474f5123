"""Tables written between the rounds of an operator: they cut lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``); on a local master without one, a folder of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the cluster shares")
    spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='caldrift-shared-')}")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


class Scratch:
    """Tables of one operator, deleted together once nothing reads them: ``with Scratch(spark) as s``, or by ``close`` when the result was written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/caldrift/{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        self._path()[0].deleteOnExit(self._path()[1])  # what a result still reads is deleted when the driver ends
        return self.spark.read.schema(df.schema).parquet(path)

    def _path(self):  # noqa: ANN202
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def close(self) -> None:
        files, path = self._path()
        files.delete(path, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
