"""Byte-level text kernels shared by the Arrow operators of this subpackage.

A *slice* is a run of documents whose UTF-8 bytes lie end to end in one ``uint8`` array; ``offs`` has the
document boundaries. Everything a kernel allocates is a small multiple of the slice, so ``SLICE_BYTES`` (and the
longest single document) bounds a task's memory, whatever the size of the table.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20
#: Bytes of text that the JVM hands to Python at once.
BATCH_BYTES = 16 << 20
#: Whether Spark deletes an execution's shuffle files when it ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: ``[\x20\x09-\x0D]``, the white space of all word contracts here.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; one of our own only where none is configured on a local master, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = got.get() if got.isDefined() else None
    if not where and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the cluster shares")
    if not where:
        import tempfile

        where = "file://" + tempfile.mkdtemp(prefix="caldrift-checkpoint-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it again: cuts lineage and survives lost executors.

    The write's own shuffles, which nothing else reads, go as it ends: garbage collection may leave them until the next steps have filled the disk.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/caldrift/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.caldrift_path = path
    return out


def release(spark: SparkSession) -> None:
    """Have Spark drop shuffle files of finished jobs now: it does so when their plans are collected as garbage, which on a
    quiet driver may be long after they have filled the executors' disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.caldrift_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches are cut by bytes as well as rows, so that long documents don't pile up in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def id_text(docs: DataFrame) -> DataFrame:
    """The two columns that the operators read, whatever else the table carries."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


class Slice:
    """Documents of one batch: ``ids`` (Arrow int64, nulls allowed), ``buf`` and ``offs``. Null texts are empty."""

    __slots__ = ("ids", "buf", "offs", "doc")

    def __init__(self, ids: pa.Array, buf: np.ndarray, offs: np.ndarray):
        self.ids, self.buf, self.offs = ids, buf, offs

    def __len__(self) -> int:
        return len(self.offs) - 1

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a per-byte array in each document."""
        return span_sums(flags, self.offs[:-1], self.offs[1:])

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        """Document of each byte position."""
        return np.searchsorted(self.offs, at, side="right") - 1

    def text(self, k: int) -> bytes:
        return self.buf[self.offs[k] : self.offs[k + 1]].tobytes()


def span_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[ends] - total[starts]


def slices(batches: Iterable[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[Slice]:
    for batch in batches:
        ids, text = batch.column(0), batch.column(1).cast(pa.large_binary())
        text = pc.fill_null(text, b"")
        n = len(text)
        if not n:
            continue
        size = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        cut, at = [0], 0
        while at < n:
            base = ends[at - 1] if at else 0
            at = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            cut.append(min(at, n))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            part = text.slice(a, b - a)
            offs = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
            data = part.buffers()[2]
            raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
            yield Slice(ids.slice(a, b - a), raw, offs - offs[0])


def word_spans(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (maximal runs without white space), and the first word of each document."""
    if not len(s.buf):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(s) + 1, np.int64)
    inside = ~SPACE[s.buf]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    heads = s.offs[:-1][s.offs[:-1] < len(s.buf)]
    begin[heads] = inside[heads]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    tails = s.offs[1:][s.offs[1:] > 0] - 1
    stop[tails] = inside[tails]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, s.offs)


def line_spans(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the ``\\n``-split lines, and the first line of each document (an empty text has one)."""
    at = np.flatnonzero(s.buf == 10)
    doc = s.doc_of(at)
    count = np.bincount(doc, minlength=len(s)) + 1
    first = np.concatenate([[0], np.cumsum(count)])
    starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    starts[first[:-1]] = s.offs[:-1]
    ends[first[1:] - 1] = s.offs[1:]
    line = np.arange(len(at)) + doc
    ends[line], starts[line + 1] = at, at + 1
    return starts, ends, first


def intern(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Number of each span's content among the slice's distinct contents, and those as an Arrow binary array.

    The spans are ascending and disjoint, so spans and gaps in turn form a binary array over the same bytes: no copy.
    """
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), pa.array([], pa.binary())
    touching = bool((starts[1:] == ends[:-1]).all())
    if touching:
        offs = np.append(starts, ends[-1])
    else:
        offs = np.empty(2 * n, np.int64)
        offs[0::2], offs[1::2] = starts, ends
    kind, width = (pa.binary(), np.int32) if len(buf) < 2**31 - 1 else (pa.large_binary(), np.int64)
    found = pa.Array.from_buffers(kind, len(offs) - 1, [None, pa.py_buffer(offs.astype(width)), pa.py_buffer(buf)])
    coded = found.dictionary_encode()
    index = coded.indices.to_numpy()
    return (index if touching else index[0::2]).astype(np.int64), coded.dictionary


def ragged(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions ``starts[i] .. starts[i]+lengths[i]`` of all i, end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    skip = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return np.arange(total) + skip
