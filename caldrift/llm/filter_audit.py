"""Filter interaction audit: what five filters remove in each of their 120 orders, by part of the corpus.

A document's failures are one number of five bits, so what happens to it in every order is a row of a table of 32 masks
by 120 orders: the step at which it first fails. Tasks count masks with ``np.bincount``, look the steps up, and count again
by order and step; these partial arrays are sums, so Spark adds them by (part, order, step).

Failures, by letter: A fewer than 50 words; B 100 * distinct words < 65 * words; C 100 * ``[A-Z]`` > 5 * code points;
D any of ``#$%&*|``; E the same text as a row with a smaller doc_id anywhere in the table. Words are
``[^\\x20\\x09-\\x0D]+``, told apart by case.

Defined cases: a null text is empty, and an empty text fails A only (B and C compare 0 with 0), and E if an earlier one is
empty. A null doc_id is neither smaller nor larger than any, so such rows never fail E and have no label. Rows that
repeat a doc_id are counted each; copies under one doc_id don't fail E for each other. A doc_id with several label rows is
good (toxic) if any of them says so. A null part is ''. An empty table has no parts and gives no rows. Texts of any length
are read whole; a task holds one slice of ``textops.SLICE_BYTES`` or its longest text. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import Slice, bound_batches, intern, materialize, slices, word_spans

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
#: Fixed values of the filters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 50, 65, 5, b"#$%&*|"

FEATURES = "doc_id long, part string, digest binary, mask int"
PARTIAL = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
SUMS = [c.split()[0] for c in PARTIAL.split(", ")[3:]]


def first_failures() -> np.ndarray:
    """[mask, order]: the step (from 0) at which a document of that mask is removed, ``STEPS`` if it is kept."""
    table = np.full((1 << STEPS, len(ORDERS)), STEPS, np.int64)
    for o, order in enumerate(ORDERS):
        for step in reversed(range(STEPS)):
            fails = (np.arange(1 << STEPS) >> FILTERS.index(order[step])) & 1 == 1
            table[fails, o] = step
    return table


def text_masks(s: Slice) -> np.ndarray:
    """Bits A to D of each document of a slice."""
    starts, ends, first = word_spans(s)
    words = np.diff(first)
    code, known = intern(s.buf, starts, ends)
    doc = np.repeat(np.arange(len(s)), words)
    distinct = np.bincount(np.unique(doc * max(1, len(known)) + code) // max(1, len(known)), minlength=len(s))
    capitals = s.per_doc((s.buf >= ord("A")) & (s.buf <= ord("Z")))
    points = s.per_doc((s.buf & 0xC0) != 0x80)
    symbols = s.per_doc(np.isin(s.buf, np.frombuffer(SYMBOLS, np.uint8)))
    return (words < LEAST_WORDS) | (100 * distinct < LEAST_DISTINCT * words) * 2 | (100 * capitals > MOST_CAPITALS * points) * 4 | (symbols > 0) * 8


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for s in slices([batch.select(["doc_id", "text"])]):
            digests = pa.array([hashlib.sha256(s.text(k)).digest() for k in range(len(s))], pa.binary())
            masks = pa.array(text_masks(s).astype(np.int32))
            yield pa.RecordBatch.from_arrays([s.ids, batch.column("part").slice(at, len(s)), digests, masks], ["doc_id", "part", "digest", "mask"])
            at += len(s)


def removals(histogram: np.ndarray) -> dict[str, np.ndarray]:
    """Sums by [part, order, step] of documents counted by [part, mask, good + 2 * toxic]."""
    n, table = len(histogram), first_failures()
    letter = np.array([[FILTERS.index(c) for c in order] for order in ORDERS])
    masks = np.arange(1 << STEPS)

    def at_steps(counts: np.ndarray) -> np.ndarray:
        """Documents by [part, order, step of removal, the last being none]."""
        key = (np.arange(n)[:, None, None] * len(ORDERS) + np.arange(len(ORDERS))) * (STEPS + 1) + table
        weights = np.broadcast_to(counts[:, :, None], key.shape)
        return np.bincount(key.ravel(), weights.ravel(), n * len(ORDERS) * (STEPS + 1)).astype(np.int64).reshape(n, len(ORDERS), STEPS + 1)

    every = histogram.sum(2)
    steps = at_steps(every)
    removed = steps[:, :, :STEPS]
    fails = np.stack([every[:, masks >> f & 1 == 1].sum(1) for f in range(STEPS)], 1)
    by_filter = np.zeros((n, STEPS), np.int64)
    for f in range(STEPS):
        by_filter[:, f] = (removed * (letter == f)).sum((1, 2))
    return {
        "kept": steps.sum(2)[:, :, None] - removed.cumsum(2), "removed": removed, "redundant": fails[:, letter] - removed, "unique_fails": every[:, 1 << letter],
        "good_lost": at_steps(histogram[:, :, 1::2].sum(2))[:, :, :STEPS], "toxic_lost": at_steps(histogram[:, :, 2:].sum(2))[:, :, :STEPS], "shapley": by_filter[:, letter],
    }


#: Parts whose arrays a task holds at once; with more it hands over what it has and starts anew, the sums being the same.
PARTS_AT_ONCE = 256


def _partials(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, np.ndarray] = {}

    def handed_over() -> Iterator[pa.RecordBatch]:
        names = list(seen)
        for a in range(0, len(names), 32):
            some = names[a : a + 32]
            sums = removals(np.stack([seen[p] for p in some]))
            size = len(ORDERS) * STEPS
            columns = [pa.array(np.repeat(np.array(some, object), size)), pa.array(np.tile(np.repeat(np.array(ORDERS, object), STEPS), len(some))), pa.array(np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(some) * len(ORDERS)))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(np.ascontiguousarray(sums[c]).ravel()) for c in SUMS], ["part", "filter_order", "step", *SUMS])
        seen.clear()

    for batch in batches:
        part = batch.column("part").dictionary_encode()
        mask, label = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("mask", "label"))
        code = part.indices.to_numpy().astype(np.int64)
        size = (1 << STEPS) * 4
        counts = np.bincount(code * size + mask * 4 + label, minlength=len(part.dictionary) * size).reshape(-1, 1 << STEPS, 4)
        for p, own in zip(part.dictionary.to_pylist(), counts, strict=True):
            if p not in seen and len(seen) >= PARTS_AT_ONCE:
                yield from handed_over()
            seen[p] = seen[p] + own if p in seen else own.copy()
    yield from handed_over()


def failures(docs: DataFrame, part: str = "source") -> DataFrame:
    """doc_id, part and the mask of failures of each row.

    Equal texts meet by their SHA-256, only as the smallest doc_id of each that stands more than once; one text on a third of all rows is a
    hot key of a join whose other side has one row for it, which adaptive execution splits (that side is written first: the rows of an aggregate can't be split).
    """
    bound_batches(docs.sparkSession)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    rows = materialize(read.mapInArrow(_features, FEATURES), "failures")
    firsts = materialize(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"), "firsts")
    again = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return rows.join(firsts, "digest", "left").select("doc_id", "part", F.when(again, F.col("mask") + 16).otherwise(F.col("mask")).alias("mask"))


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """A row for each part, order of the filters and step: see the module for what is counted."""
    of = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        (F.max((F.coalesce(F.col("quality"), F.lit(0)) == 1).cast("int")) + 2 * F.max((F.coalesce(F.col("toxic"), F.lit(0)) == 1).cast("int"))).alias("label"))
    rows = failures(docs, part).join(of, "doc_id", "left").select("part", "mask", F.coalesce("label", F.lit(0)).alias("label"))
    return rows.mapInArrow(_partials, PARTIAL).groupBy("part", "filter_order", "step").agg(*[F.sum(c).alias(c) for c in SUMS])
