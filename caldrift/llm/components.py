"""Connected components of an edge table, without a node's neighbours ever meeting in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import discard, materialize


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node of its component. The caller discards it.

    Every node points at its smallest neighbour or itself, whichever is smaller, and paths are followed to their ends. Then each tree becomes its root, and the
    edges between different roots are the next round's graph, which has at most half as many nodes with edges: settled
    components are never read again. All steps are equi-joins and minima with map-side aggregation; a hub is a hot key of a
    join whose other side has one row a key, which adaptive execution may split. Tables between rounds are written in the
    shared folder.
    """
    links, labels = materialize(edges.select("a", "b").where("a <> b").distinct(), "links"), []
    for _ in range(most_rounds):
        ends = links.select(F.col("a").alias("node"), F.col("b").alias("m")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("m")))
        label = _followed(materialize(ends.groupBy("node").agg(F.min("m").alias("m")).select("node", F.least("node", "m").alias("root")), "labels"))
        labels.append(label)
        left = label.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = label.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        across = links.join(left, "a").join(right, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        across = materialize(across, "links")
        discard(links)
        links = across
        if links.isEmpty():
            discard(links)
            break
    else:
        raise RuntimeError("components did not settle")
    if len(labels) == 1:
        return labels[0]
    out = labels[0]
    for label in labels[1:]:
        out = out.join(label.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    out = materialize(out, "labels")
    discard(*labels)
    return out


def _followed(label: DataFrame) -> DataFrame:
    """``label`` with each node pointing at the end of its path; ends point at themselves. The table that is given is discarded.

    Only nodes within a path, which others point at and which point on, are followed by doubling; all others then read off theirs.
    """
    on = label.where("node <> root")
    inner = materialize(on.join(on.select(F.col("root").alias("node")).distinct(), "node", "left_semi").select("node", F.col("root").alias("top")), "labels")
    while True:
        further = inner.select(F.col("node").alias("top"), F.col("top").alias("far"))
        step = materialize(inner.join(further, "top", "left").select("node", F.coalesce("far", "top").alias("top"), F.col("far").isNotNull().alias("moved")), "labels")
        discard(inner)
        inner = step
        if inner.where("moved").isEmpty():
            break
    ends = inner.select(F.col("node").alias("root"), "top")
    out = materialize(label.join(ends, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "labels")
    discard(label, inner)
    return out
