"""SimHash near-duplicates by segment-popcount embedding.

A 64-bit fingerprint is mapped to its bit counts in 32 segments of two bits. The Manhattan distance of two such vectors
is at most the Hamming distance of the fingerprints, so fingerprints at two or fewer differing bits lie within
Manhattan distance two: their vectors are equal, or neighbours on the grid, or share a neighbour. Each distinct fingerprint is
filed under its own cell and the cells one step away; those that meet in a cell are candidates and are verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .components import components

SHINGLE_WORDS = 3
MOST_BITS = 2
SEED = 42
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Fixed value: the low bit of each two-bit segment.
LOW = 0x5555555555555555


def shingle_hashes(s: T.Slice, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of a slice, end to end, and their number in each document; fewer words are one shingle."""
    starts, ends, first = T.word_spans(s)
    words = np.diff(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(s), np.int64)
    # the words end to end, one space after each
    size = ends - starts
    at = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.full(at[-1], 0x20, np.uint8)
    text[T.ragged(size, at[:-1])] = _LOWER[s.buf[T.ragged(size, starts)]]
    text = text.tobytes()
    count = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
    begin = T.ragged(count, first[:-1])
    end = np.minimum(begin + shingle, np.repeat(first[1:], count)) - 1
    hashed = xxhash.xxh64_intdigest
    lo, hi = at[begin].tolist(), (at[end + 1] - 1).tolist()
    return np.fromiter((hashed(text[a:b], SEED) for a, b in zip(lo, hi, strict=True)), np.uint64, len(lo)), count


def fingerprints_of(s: T.Slice, shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """Fingerprint of each document of a slice, as uint64."""
    return majorities(*shingle_hashes(s, shingle))


def majorities(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The bits set in over half of each document's hashes; ``h`` has the documents' end to end, ``count`` their numbers."""
    out = np.zeros(len(count), np.uint64)
    edge = np.concatenate([[0], np.cumsum(count)])
    full = np.flatnonzero(count)
    for lo_doc in range(0, len(full), 2048):  # bounds the expanded bits, apart from a single long document's
        part = full[lo_doc : lo_doc + 2048]
        a, b = edge[part[0]], edge[part[-1] + 1]
        ones = np.zeros((len(part), 64), np.int64)
        for cut in range(a, b, 65_536):
            stop = min(cut + 65_536, b)
            bits = np.unpackbits(h[cut:stop].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            inside = np.flatnonzero((edge[part] < stop) & (edge[part + 1] > cut))
            ones[inside] += np.add.reduceat(bits, np.maximum(edge[part[inside]], cut) - cut, axis=0, dtype=np.int64)
        major = 2 * ones > count[part][:, None]
        out[part] = np.packbits(major, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp long) for each row of ``docs``, a narrow map over the scan. Null and blank texts have fingerprint 0."""
    T.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in T.slices(batches):
            yield pa.RecordBatch.from_arrays([s.ids, pa.array(fingerprints_of(s, shingle).view(np.int64))], names=["doc_id", "fp"])

    return T.id_text(docs).mapInArrow(run, "doc_id long, fp long")


def cells(fps: DataFrame) -> DataFrame:
    """(cell, fp): each fingerprint under its own cell and under each cell one step away on one axis.

    A vector of 32 counts between 0 and 2 is a long of two-bit fields, so a step on an axis adds or takes away a power of four.
    """
    low = F.lit(LOW)
    fp, half = F.col("fp"), F.shiftrightunsigned("fp", 1)
    one_set, both_set = fp.bitwiseXOR(half).bitwiseAND(low), fp.bitwiseAND(half).bitwiseAND(low)
    vector = one_set.bitwiseOR(F.shiftleft(both_set, 1))
    axis = F.explode(F.sequence(F.lit(-1), F.lit(31)))
    stepped = fps.select("fp", vector.alias("v"), axis.alias("axis"))
    field = F.expr("shiftrightunsigned(v, 2 * greatest(axis, 0)) & 3L")
    one = F.expr("shiftleft(1L, 2 * greatest(axis, 0))")
    # adding may pass the sign bit, so the fields are changed bit by bit: 0 -> 1, 1 -> 2 (xor 3), 2 -> 1 (xor 3), 1 -> 0
    up = F.when(field == 0, F.col("v").bitwiseXOR(one)).when(field == 1, F.expr("v ^ shiftleft(3L, 2 * greatest(axis, 0))"))
    down = F.when(field == 1, F.col("v").bitwiseXOR(one)).when(field == 2, F.expr("v ^ shiftleft(3L, 2 * greatest(axis, 0))"))
    near = F.when(F.col("axis") < 0, F.array("v")).otherwise(F.array(up, down))
    return stepped.select("fp", F.explode(near).alias("cell")).where("cell is not null").select("cell", "fp")


def links(fps: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(a, b): fingerprints at most ``most_bits`` (up to 2) apart that meet in a cell; each cell gives links that connect
    the same fingerprints as all its pairs would, not the pairs themselves.

    Rows come sorted by cell; a cell's fingerprints are compared in blocks. Distinct fingerprints of one cell are within
    one step of the same vector, so a cell's size is bounded by the embedding and doesn't follow the table's.
    """
    if not 0 <= most_bits <= 2:
        raise ValueError("the grid's steps cover two differing bits")
    filed = cells(fps.select("fp").distinct()).repartition("cell").sortWithinPartitions("cell", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_cell, kept_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        seen: set[tuple[int, int]] = set()
        for last, b in _with_last(batches):
            cell = np.concatenate([kept_cell, b.column(0).to_numpy()])
            fp = np.concatenate([kept_fp, b.column(1).to_numpy().view(np.uint64)])
            done = len(cell) if last else int(np.searchsorted(cell, cell[-1])) if len(cell) else 0
            found = _cell_links(cell[:done], fp[:done], most_bits)
            kept_cell, kept_fp = cell[done:], fp[done:]
            new = [x for x in found if x not in seen]
            if len(seen) > 500_000:
                seen.clear()
            seen.update(new)
            if new:
                a, c = zip(*new, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, c)], names=["a", "b"])

    return filed.mapInArrow(run, "a long, b long").distinct()


def _with_last(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    held = None
    for b in batches:
        if held is not None:
            yield False, held
        held = b
    if held is not None:
        yield True, held


def _cell_links(cell: np.ndarray, fp: np.ndarray, most_bits: int) -> set[tuple[int, int]]:
    """Verified links among sorted rows: by distance in the sort for small cells, by rows for large ones."""
    out: set[tuple[int, int]] = set()
    if len(cell) < 2:
        return out
    edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
    size = np.diff(edge)
    small = np.repeat(size <= 64, size)
    for lag in range(1, int(min(64, size.max()))):
        at = np.flatnonzero((cell[lag:] == cell[:-lag]) & small[lag:])
        if len(at):
            near = at[np.bitwise_count(fp[at] ^ fp[at + lag]) <= most_bits]
            if len(near):
                both = np.unique(np.stack([fp[near], fp[near + lag]], axis=1), axis=0)
                out.update(map(tuple, both.tolist()))
    for k in np.flatnonzero(size > 64):
        own = fp[edge[k] : edge[k + 1]]
        # a link from each fingerprint to those that no earlier one has reached: a spanning forest by breadth-first search
        rest = np.ones(len(own), bool)
        for root in range(len(own)):
            if not rest[root]:
                continue
            rest[root] = False
            queue = [root]
            while queue:
                x = queue.pop()
                left = np.flatnonzero(rest)
                near = left[np.bitwise_count(own[left] ^ own[x]) <= most_bits]
                rest[near] = False
                queue += near.tolist()
                out.update((min(a, b), max(a, b)) for a, b in ((int(own[x]), int(own[y])) for y in near))
    return out


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE_WORDS, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``; component_id is the smallest doc_id reachable over links.

    Texts are only read where they lie; what is shuffled are fingerprints. Equal fingerprints are grouped first (with
    map-side aggregation), so copies cost nothing further. Null, empty and blank texts have fingerprint 0 and are linked
    like any other; a null doc_id stays null and counts as larger than any other (a group of nulls has component
    null); repeated rows each give a row; other columns are ignored; an empty table gives no rows.
    """
    prints = T.materialize(fingerprints(docs, shingle), "fingerprints")
    least = T.materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    linked = components(T.materialize(links(least.select("fp"), most_bits), "near"))
    roots = T.materialize(
        linked.join(least.withColumnRenamed("fp", "node"), "node").groupBy("root").agg(F.min("first").alias("component_id")), "roots"
    )
    by_fp = (
        least.join(linked.withColumnRenamed("node", "fp"), "fp", "left")
        .join(roots, "root", "left")
        .select("fp", F.coalesce("component_id", "first").alias("component_id"))
    )
    return prints.join(by_fp, "fp").select("doc_id", "fp", "component_id")
