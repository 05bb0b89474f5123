"""Merkle manifest of a dataset: a tree of fanout 16 over each group's rows in order, and one over the groups' roots.

Every row has an index in its group. A task reads its rows in order and keeps a mountain range: a stack with the open run of
each level. Sixteen nodes of a run carry into a node one level up, which is recorded; a run that the task sees only in part
(its other nodes are in another task, or it is a group's short last run) leaves its nodes as edges. Edges are merged level
by level: all nodes of such a run are edges, so a grouping by (group, run) of at most 16 rows gives its node, with no padding
of short runs. There are at most 30 edges for each level and stretch of rows in a task, so this part is small.

Proofs go the other way: a node's path is its siblings and then its parent's path, joined top-down by (group, node). A run's 16
rows share the path of their parent, so paths are made once for a run, and only hashed for each row.

H is the lowercase hex SHA-256 of the inputs concatenated, digests as hex text. A leaf is H of the five columns doc_id, source,
lang, n_chars and text: ``-`` for null, else byte count, ``:``, value. While a group has several nodes, each 16 in a row (the last
run: those that are left, even one) become their H; a group of one row has its leaf as root.

Defined cases: rows ascend by doc_id, null ones first, then by leaf, so repeated rows are leaves side by side and each has its own
proof. A null source is a group of its own, before the empty one. The tampering check lower-cases the text of rows where 5
divides crc32 of the decimal doc_id; a null doc_id has none, so its row is left as it is, and a null text stays null.
An empty table gives no rows. Texts are read whole, once, and only their digests go on. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textops import materialize

FANOUT = 16
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
MANIFEST = "doc_id long, source string, leaf_index long, leaf string, subroot string, root string, proof array<struct<left string, right string>>, proof_sha256 string, tampered boolean, folded_root string, verified boolean"
RECORD = "grp string, level int, number long, hash string, is_node boolean, is_edge boolean"


def rendered(c: Column) -> Column:
    value = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_hash(columns: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[rendered(columns[c]) for c in LEAF_COLUMNS]), 256)


def group_key(c: Column) -> Column:
    """A text that tells null and empty apart and sorts null first, then by bytes."""
    return F.when(c.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), c.cast("string")))


class Range:
    """The stack of one stretch of rows: the open run of each level as (number of its first node, hashes)."""

    def __init__(self, group: str, out: list[tuple]):
        self.group, self.out, self.open = group, out, []

    def push(self, level: int, number: int, digest: str) -> None:
        while True:
            if level == len(self.open):
                self.open.append((number, []))
            first, run = self.open[level]
            if run and number // FANOUT != first // FANOUT:
                self.leave(level)
                first, run = number, []
            if not run:
                first, run = self.open[level] = (number, [])
            run.append(digest)
            if len(run) < FANOUT or number % FANOUT != FANOUT - 1:
                return
            if level:
                self.record(level, first, run, edge=False)
            run_hash = hashlib.sha256("".join(run).encode()).hexdigest()
            self.open[level] = (number + 1, [])
            level, number, digest = level + 1, number // FANOUT, run_hash

    def record(self, level: int, first: int, run: list[str], edge: bool) -> None:
        self.out.extend((self.group, level, first + k, h, level > 0, edge) for k, h in enumerate(run))

    def leave(self, level: int) -> None:
        first, run = self.open[level]
        self.record(level, first, run, edge=True)

    def close(self) -> None:
        for level in range(len(self.open)):
            self.leave(level)


def _mountains(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stack: Range | None = None
    due, out = -1, []

    def handed_over() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[]] * 6
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["grp", "level", "number", "hash", "is_node", "is_edge"])
        out.clear()
        return batch

    for batch in batches:
        for group, number, digest in zip(batch.column("grp").to_pylist(), batch.column("number").to_numpy().tolist(), batch.column("hash").to_pylist(), strict=True):
            if stack is None or group != stack.group or number != due:
                if stack is not None:
                    stack.close()
                stack = Range(group, out)
            stack.push(0, number, digest)
            due = number + 1
        if out:
            yield handed_over()
    if stack is not None:
        stack.close()
    yield handed_over()


def index_rows(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` (grp and the columns of ``order`` among them) with ``number``: a row's place in its group, from 0.

    Rows are sorted by range, written with the number of their range and their place in it; a range's start in each of its groups is then a
    running sum over counts, of which there are at most groups plus ranges.
    """
    keys = [F.col("grp"), *[F.col(c).asc_nulls_first() for c in order]]
    spark = rows.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    placed = rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"))
    table = materialize(placed, name)
    counts = table.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("head"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("grp", "part", (before - F.col("head")).alias("shift"))
    return table.join(starts, ["grp", "part"]).select(*rows.columns, (F.col("place") + F.col("shift")).alias("number"), "part")


def nodes(rows: DataFrame, name: str) -> DataFrame:
    """(grp, level, number, hash) of all nodes above the rows (grp, number, hash)."""
    seen = materialize(rows.select("grp", "number", "hash").sortWithinPartitions("grp", "number").mapInArrow(_mountains, RECORD), name)
    found = seen.where("is_node").select("grp", "level", "number", "hash")
    most = rows.agg(F.max("number")).first()[0] or 0
    carried = None
    level = 0
    while FANOUT**level <= most:
        edges = seen.where(f"is_edge AND level = {level}").select("grp", "number", "hash")
        if carried is not None:
            edges = edges.unionByName(carried)
        run = F.array_sort(F.collect_list(F.struct("number", "hash")))
        merged = edges.groupBy("grp", F.floor(F.col("number") / FANOUT).alias("up")).agg(run.alias("run"))
        carried = materialize(merged.select("grp", F.col("up").alias("number"), F.sha2(F.array_join(F.col("run.hash"), ""), 256).alias("hash")), f"{name}-merged")
        level += 1
        found = found.unionByName(carried.select("grp", F.lit(level).alias("level"), "number", "hash"))
    return found


def _siblings(run: DataFrame) -> DataFrame:
    """A row for each child of the runs: the siblings' digests on its left and on its right."""
    child = F.posexplode("run").alias("k", "c")
    run = run.select("*", child)
    left = F.array_join(F.slice(F.col("run.hash"), F.lit(1), F.col("k")), "")
    right = F.array_join(F.slice(F.col("run.hash"), F.col("k") + 2, F.lit(FANOUT)), "")
    return run.withColumn("path", F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), F.col("path"))).drop("run", "k")


def paths(rows: DataFrame, above: DataFrame, tops: DataFrame, levels: int) -> DataFrame:
    """``rows`` (grp, number, hash and more) with the ``path`` of each: its siblings level by level, then the path of ``tops``.

    ``tops`` (grp, height, path and more columns, which are handed down) has a row for each group.
    """
    carry = [c for c in tops.columns if c not in ("grp", "height", "path")]
    at_top = tops.withColumn("number", F.lit(0).cast("long"))
    reached = None
    for level in range(levels, 0, -1):
        here = at_top.where(F.col("height") == level).drop("height")
        if reached is not None:
            runs = above.where(F.col("level") == level).groupBy("grp", F.floor(F.col("number") / FANOUT).alias("up")).agg(F.array_sort(F.collect_list(F.struct("number", "hash"))).alias("run"))
            below = _siblings(runs.join(reached.withColumnRenamed("number", "up"), ["grp", "up"]))
            here = here.unionByName(below.select("grp", F.col("c.number").alias("number"), "path", *carry))
        reached = here
    extra = [c for c in rows.columns if c not in ("grp", "number", "hash")]
    alone = rows.join(at_top.where("height = 0").drop("height", "number"), "grp").select("grp", "number", "hash", *extra, *carry, "path")
    if reached is None:
        return alone
    runs = rows.groupBy("grp", F.floor(F.col("number") / FANOUT).alias("up")).agg(F.array_sort(F.collect_list(F.struct("number", "hash", *extra))).alias("run"))
    below = _siblings(runs.join(reached.withColumnRenamed("number", "up"), ["grp", "up"]))
    return alone.unionByName(below.select("grp", "c.number", "c.hash", *[f"c.{c}" for c in extra], *carry, "path"))


def heights(rows: DataFrame) -> DataFrame:
    """(grp, height): how often a group's nodes are hashed in runs until one is left."""
    n = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    grown = F.expr("size(filter(sequence(0, 15), k -> shiftleft(1L, 4 * k) < n))")
    return n.select("grp", grown.alias("height"))


def manifest(docs: DataFrame) -> DataFrame:
    """A row for each row: doc_id, source, leaf_index in its source, leaf, subroot, root, proof (array of left and right siblings), proof_sha256,
    tampered, folded_root and verified."""
    as_is = {"doc_id": F.col("doc_id").cast("long"), "source": F.col("source").cast("string"), "lang": F.col("lang").cast("string"), "n_chars": F.col("n_chars").cast("long"), "text": F.col("text").cast("string")}
    lowered = as_is | {"text": F.translate(as_is["text"], LETTERS, LETTERS.lower())}
    chosen = F.coalesce(F.crc32(as_is["doc_id"].cast("string").cast("binary")) % 5 == 0, F.lit(False))
    rows = docs.select(group_key(as_is["source"]).alias("grp"), as_is["doc_id"].alias("doc_id"), leaf_hash(as_is).alias("hash"), F.when(chosen, leaf_hash(lowered)).alias("other"))
    # Written first: sorting by range reads its keys twice, and texts should be hashed once.
    leaves = index_rows(materialize(rows, "hashed"), ["doc_id", "hash"], "leaves").drop("part")
    above = nodes(leaves, "peaks")
    height = heights(leaves)
    single = leaves.join(height.where("height = 0"), "grp").select("grp", "hash", "height")
    subroots = materialize(single.unionByName(above.join(height, "grp").where(F.col("level") == F.col("height")).select("grp", "hash", "height")), "subroots")

    # The same tree once more over the groups' roots, in the groups' order.
    groups = index_rows(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "hash", F.col("height").alias("own_height")), ["name"], "groups").drop("part")
    over = nodes(groups, "group-peaks")
    most = groups.agg(F.max("number")).first()[0]
    if most is None:
        return docs.sparkSession.createDataFrame([], MANIFEST)
    top = _height(most + 1)
    root = over.where(F.col("level") == top).first().hash if top else groups.first().hash
    ends = groups.select("grp", F.lit(top).alias("height")).limit(1).select("*", F.expr("cast(array() as array<struct<left string, right string>>)").alias("path"))
    tops = paths(groups, over, ends, top).select(F.col("name").alias("grp"), F.col("own_height").alias("height"), "path", F.col("hash").alias("subroot"))

    tallest = _height((leaves.agg(F.max("number")).first()[0] or 0) + 1)
    found = paths(leaves, above, tops, tallest)
    proof = F.array_join(F.transform("path", lambda x: F.concat(x.left, x.right)), "")
    folded = F.aggregate("path", F.coalesce("other", "hash"), lambda acc, x: F.sha2(F.concat(x.left, acc, x.right), 256))
    out = found.select("doc_id", F.when(F.col("grp") != "", F.substring("grp", 2, 2**31 - 1)).alias("source"), F.col("number").alias("leaf_index"), F.col("hash").alias("leaf"), "subroot", F.lit(root).alias("root"), F.col("path").alias("proof"),
                       F.sha2(proof, 256).alias("proof_sha256"), F.col("other").isNotNull().alias("tampered"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _height(n: int) -> int:
    level = 0
    while FANOUT**level < n:
        level += 1
    return level
