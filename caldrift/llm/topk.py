"""Exact top-k inner-product search by Fagin's threshold algorithm.

Candidates lie in blocks. A block has a sorted list for each dimension; a query walks all lists at once, from the end
that its sign favours, and scores what it meets. The threshold at a depth is the score of a made-up vector with the
values at that depth; when it can't beat the query's kth score so far, nothing unmet in the block can either. The
state goes on from block to block, so later blocks often stop at their first threshold, before any list is walked. Depths grow by
a factor, and only vectors met at a depth are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops as T

K = 5
SCALE = 256
BLOCK_ROWS, BLOCK_QUERIES = 8192, 4096
#: Candidate blocks that one task takes a block of queries through at most; the state goes on between them.
CHAIN = 8
#: Depth of the first stop, and the factor to the next.
FIRST_DEPTH, DEEPER = 4, 3
LONG = 2**63 - 1


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, dims, v array<double>): components as floor(256 x), whole doubles; rows null or with null or non-finite ones are
    left out (a component that 256 times over is no double any more, beyond 7e305, counts as non-finite)."""
    whole = F.transform("embedding", lambda x: x.cast("double") * SCALE)
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dims"), whole.alias("v"))
    # rint after the comparison instead of floor(), which gives longs and fails beyond them
    down = F.transform("v", lambda x: F.rint(x) - F.when(F.rint(x) > x, 1.0).otherwise(0.0))
    return rows.where(good).select("vec_id", "dims", down.alias("v"))


def exact(v: np.ndarray, bound: int) -> np.ndarray:
    """Whole doubles in a type that holds every partial sum of their products: floats up to 2^52, 64-bit integers, or Python's own."""
    return v if bound < 2**52 else v.astype(np.int64) if bound < 2**62 else np.array([[int(x) for x in row] for row in v.tolist()], object).reshape(v.shape)


def most(v: np.ndarray) -> int:
    return int(np.abs(v).max(initial=0))


class Best:
    """The k best of each query so far: score, and the smaller id first at a tie."""

    def __init__(self, query_ids: np.ndarray, k: int):
        self.query_ids, self.k = query_ids, k
        self.score: list[np.ndarray] = [np.zeros(0, np.int64)] * len(query_ids)
        self.vec: list[np.ndarray] = [np.zeros(0, np.int64)] * len(query_ids)

    def kth(self, row: int) -> int | None:
        own = self.score[row]
        return int(own[-1]) if len(own) == self.k else None

    def offer(self, row: int, score: np.ndarray, vec: np.ndarray) -> None:
        kth, good = self.kth(row), vec != self.query_ids[row]
        if kth is not None:
            good &= (score >= kth).astype(bool)
        if not good.any():
            return
        score, vec = score[good], vec[good]
        if score.dtype == np.float64:
            score = np.rint(score).astype(np.int64)
        score, vec = np.concatenate([self.score[row], score]), np.concatenate([self.vec[row], vec])
        if score.dtype == object:
            order = np.array(sorted(range(len(score)), key=lambda i: (-score[i], vec[i]))[: self.k])
        else:
            if len(score) > 4 * self.k:
                least = np.partition(score, len(score) - self.k)[len(score) - self.k]
                score, vec = score[score >= least], vec[score >= least]
            order = np.lexsort((vec, -score))[: self.k]
        self.score[row], self.vec[row] = score[order], vec[order]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = [len(x) for x in self.score]
        shown = [np.array([max(-LONG, min(LONG, int(x))) for x in own], np.int64) if own.dtype == object else own for own in self.score]
        return np.repeat(self.query_ids, n), np.concatenate(self.vec or [[]]).astype(np.int64), np.concatenate(shown or [[]]).astype(np.int64)


class Block:
    """A block's vectors, and for each dimension its list: the vectors in ascending order, to be walked from either end."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, most_query: int):
        self.ids = ids
        n, dims = vectors.shape
        self.v = exact(vectors, most_query * most(vectors) * max(1, dims))
        self.order = np.ascontiguousarray(np.argsort(vectors, axis=0, kind="stable").T.astype(np.int16))
        self.sorted = np.take_along_axis(self.v, self.order.T.astype(np.int64), axis=0)

    def search(self, queries: np.ndarray, best: Best) -> None:
        n, dims = self.v.shape
        for row, q in enumerate(exact(queries, most(queries) * (LONG if self.v.dtype == object else 1)).astype(self.v.dtype)):
            lists = np.flatnonzero(q != 0)
            if self.beaten(q, lists, 0, best.kth(row)):
                continue
            if not len(lists):  # no list to walk: every score is 0
                best.offer(row, np.zeros(n, np.int64), self.ids)
                continue
            up, down = lists[q[lists] < 0], lists[q[lists] > 0]
            seen = np.zeros(n, bool)
            done, depth = 0, min(n, FIRST_DEPTH)
            while True:  # one stretch of every list, from the end that the query's sign favours
                met = np.concatenate([self.order[up, done:depth].ravel(), self.order[down, n - depth : n - done].ravel()])
                fresh = np.zeros(n, bool)
                fresh[met] = True
                fresh &= ~seen
                new = np.flatnonzero(fresh)
                if len(new):
                    best.offer(row, self.v[new] @ q, self.ids[new])
                    seen |= fresh
                done = depth
                if done == n or self.beaten(q, lists, done, best.kth(row)):
                    break
                depth = min(n, DEEPER * depth)

    def beaten(self, q: np.ndarray, lists: np.ndarray, depth: int, kth: int | None) -> bool:
        """Whether nothing unmet at this depth can reach the kth score; at a tie a smaller id still could."""
        if kth is None:
            return False
        n, own = len(self.ids), q[lists]
        edge = self.sorted[np.where((own > 0).astype(bool), n - 1 - depth, depth), lists]
        return int((own * edge).sum()) < kth


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other vectors for each query, ties to the smaller vec_id.

    ``queries`` are rows of the same form. Candidates are dealt evenly to blocks and queries to blocks; each block of
    queries meets each chain of candidate blocks once, in a task of its own, so no side is broadcast and no task holds
    more than a block of either. Only k rows per query and chain are shuffled for the last ranking. Vectors null or with null or
    non-finite components take no part; scores are exact whatever their size, and one beyond 64 bits is shown as the nearest long; vectors of another length than a query's
    are no candidates; repeated vec_ids are each candidates (but never of a query of the same id); empty tables give no rows.
    """
    spark = vectors.sparkSession
    T.bound_batches(spark)
    rows = T.materialize(integers(vectors), "vectors")
    asked = T.materialize(integers(queries), "queries")
    n, m = rows.count(), asked.count()
    groups = max(1, -(-m // BLOCK_QUERIES))
    # at least as many chains as keep all cores busy, if there are blocks for them
    chains = max(1, -(-n // (BLOCK_ROWS * CHAIN)), min(-(-n // BLOCK_ROWS), -(-spark.sparkContext.defaultParallelism // groups)))
    spread = max(1, min(2 * spark.sparkContext.defaultParallelism, chains * groups))
    # a query block goes to every chain and a chain to every query block: an equi-join on the pair, not a product of rows
    pair = F.concat_ws(":", "chain", "grp")
    left = rows.withColumn("chain", F.pmod(F.xxhash64("vec_id"), F.lit(chains))).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(pair.alias("pair"), F.lit(1).alias("side"), "vec_id", "dims", "v")
    right = asked.withColumn("grp", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups))).withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(chains - 1)))).select(pair.alias("pair"), F.lit(0).alias("side"), "vec_id", "dims", "v")
    met = left.unionByName(right).repartition(spread, "pair").sortWithinPartitions("pair", "dims", "side", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # of one pair, dimension and side, up to a block
        size = 0
        key: tuple | None = None
        best: Best | None = None
        asked_v: np.ndarray | None = None

        def flush() -> None:
            nonlocal size, best, asked_v
            if not size or key is None:
                return
            ids, v = np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held])
            held.clear()
            size = 0
            if key[2] == 0:
                best, asked_v = Best(ids, k), v
            elif best is not None and asked_v is not None:
                Block(ids, v, most(asked_v)).search(asked_v, best)

        def result() -> pa.RecordBatch | None:
            nonlocal best, asked_v
            if best is None:
                return None
            out = pa.RecordBatch.from_arrays([pa.array(x) for x in best.rows()], names=["query_id", "vec_id", "score"])
            best = asked_v = None
            return out if len(out) else None

        for b in batches:
            pairs, sides, ids, dims = (b.column(i).to_pylist() if i == 0 else b.column(i).to_numpy() for i in range(4))
            values, offs = b.column(4).values.to_numpy(), b.column(4).offsets.to_numpy()
            change = [0, *[i for i in range(1, len(ids)) if pairs[i] != pairs[i - 1] or sides[i] != sides[i - 1] or dims[i] != dims[i - 1]], len(ids)]
            for lo, hi in zip(change[:-1], change[1:], strict=True):
                new = (pairs[lo], int(dims[lo]), int(sides[lo]))
                if new != key:
                    flush()
                    if key is None or new[:2] != key[:2]:
                        if (out := result()) is not None:
                            yield out
                    key = new
                for at in range(lo, hi, BLOCK_ROWS):
                    stop = min(at + BLOCK_ROWS, hi)
                    held.append((ids[at:stop].copy(), values[offs[at] : offs[stop]].reshape(stop - at, new[1]).copy()))
                    size += stop - at
                    if new[2] == 1 and size >= BLOCK_ROWS:
                        flush()
        flush()
        if (out := result()) is not None:
            yield out

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = met.mapInArrow(run, "query_id long, vec_id long, score long")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
