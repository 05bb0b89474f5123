"""Removal of repeated byte strings by longest-previous-factor arrays, over a corpus that no machine holds.

A byte goes when a string of ``min_len`` bytes that covers it also starts earlier (smaller doc_id, or the same document and
an earlier place). In suffix order a position's longest previous factor is the longer of its common prefixes with
the nearest smaller positions before and after it (``longest_previous_factor``); a string starts earlier exactly
where that factor reaches ``min_len``.

Only strings with equal content have to meet, so the corpus is cut by content. Each window of ``min_len`` bytes has an
anchor: the place of the smallest hash among the grams inside it, leftmost at a tie. Neighbouring windows share an
anchor, so they travel as one *stretch*, about one to 35 bytes of text. Equal windows have equal anchors. So:

1. each task cuts its documents into stretches and keeps the first of equal ones (the others' bytes go at once);
2. stretches meet by anchor: of equal ones the first is kept; anchors with more than one content are open;
3. the bytes of open stretches meet by anchor; their suffixes are ordered, and the factor array says which windows start
   earlier;
4. each document's removed runs are joined and its remaining bytes are hashed.

Stretches are identified by two independent 64-bit hashes. What tasks exchange is packed: a row for each target bucket
and slice of documents, not for each stretch. An anchor that is common among a sample of documents and stands in many contexts
would fill one bucket, so its windows travel singly, by their own hashes; the sample only chooses the way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T

MIN_LEN = 100
GRAM = 28
#: Positions worked on at once.
SEGMENT = 1 << 21
PLACE_BITS = 22
#: Bytes of open stretches whose suffixes are ordered at once (more if one anchor has more), and the contents of an anchor
#: from which its windows are dealt singly.
PART_BYTES, CROWD = 1 << 20, 4096
#: Finds that a task gathers before it packs them for their documents.
FLUSH = 1 << 19


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, 256, np.uint64) | np.uint64(1)


_TABLES = (_table(11), _table(12))
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2^64."""
    if which not in _powers or len(_powers[which][0]) < n:
        base = _BASES[which]
        inverse = np.uint64(pow(int(base), -1, 2**64))
        size = max(n, SEGMENT + 4 * MIN_LEN)
        both = []
        for b in (base, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _powers[which] = (both[0], both[1])
    return _powers[which]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Rolling:
    """Hashes of any substrings of a buffer."""

    def __init__(self, buf: np.ndarray, which: int):
        self.up, self.down = _power(which, len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_TABLES[which][buf] * self.up[: len(buf)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mix((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mix((self.sums[size:] - self.sums[:-size]) * self.down[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def stretches(buf: np.ndarray, offs: np.ndarray, min_len: int = MIN_LEN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Stretches of a slice of documents: first window, number of windows, anchor less first window, both hashes."""
    out: list[tuple[np.ndarray, ...]] = []
    total = len(buf)
    for lo in range(0, max(0, total - min_len + 1), SEGMENT):
        own = buf[lo : lo + SEGMENT + min_len - 1]
        n = len(own) - min_len + 1  # windows that begin here
        # windows that run over a document's end don't count
        inner = offs[(offs > lo) & (offs < lo + len(own))] - lo
        bad = np.zeros(n + 1, np.int32)
        np.add.at(bad, np.minimum(np.maximum(inner - min_len + 1, 0), n), 1)
        np.add.at(bad, np.minimum(inner, n), -1)
        valid = np.cumsum(bad[:-1]) == 0
        one = Rolling(own, 0)
        grams = one.grams(gram)
        place = np.arange(len(grams), dtype=np.uint64)
        mask = np.uint64((1 << PLACE_BITS) - 1)
        least = sliding_min((grams & ~mask) | place, min_len - gram + 1)
        anchor = (least & mask).astype(np.int64)
        edge = np.ones(n + 1, bool)
        edge[1:-1] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])
        at = np.flatnonzero(edge)
        starts, ends = at[:-1], at[1:]
        keep = valid[starts]
        starts, ends = starts[keep], ends[keep]
        two = Rolling(own, 1)
        lead = anchor[starts] - starts
        content = two.of(starts, ends + min_len - 1) + lead.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        out.append((starts + lo, ends - starts, lead, grams[anchor[starts]], content))
    if not out:
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def prefix_ranks(buf: np.ndarray, left: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(width, rank of each place by so many bytes from it) for widths 8, 16, 32 ... to ``length`` or more, by prefix doubling.

    ``left`` is the distance from each place to the end of its string; a string that ends sorts before those that go on.
    """
    n = len(buf)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = buf
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | np.where(left > k, padded[k : n + k], np.uint64(0))
    # zero bytes and ends look alike in the word; how many bytes there were tells them apart
    _, rank = np.unique(word, return_inverse=True)
    _, rank = np.unique(rank.astype(np.int64) * 9 + np.minimum(left, 8), return_inverse=True)
    out, width = [(8, rank.astype(np.int64))], 8
    while width < length:
        rank = out[-1][1]
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - width)] = rank[width:] + 1
        ahead[left <= width] = 0
        _, rank = np.unique(rank * (n + 1) + ahead, return_inverse=True)
        width *= 2
        out.append((width, rank.astype(np.int64)))
    return out


def nearest_smaller(values: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """For each element the least of ``shared`` (between neighbours, the first is unused) down to its previous smaller value; 0 if none.

    All pointers jump at once: one that stands on a larger value takes that value's own pointer.
    """
    n = len(values)
    at, least = np.arange(n) - 1, shared.copy()
    least[:1] = 0
    todo = np.arange(1, n)
    while len(todo):
        todo = todo[values[at[todo]] > values[todo]]
        over = at[todo]
        to, low = at[over], least[over]
        least[todo] = np.minimum(least[todo], low)
        at[todo] = to
        ended = to < 0
        least[todo[ended]] = 0
        todo = todo[~ended]
    return least


def longest_previous_factors(buf: np.ndarray, left: np.ndarray, at: np.ndarray, when: np.ndarray, most: int) -> np.ndarray:
    """For each place in ``at``, the length (up to ``most``) of the longest string there that also starts at one with a smaller ``when``.

    The suffixes at these places are put in order and the common prefixes of neighbours found from the ranks. A place's
    factor is the longer of its common prefixes with the previous and the next place in suffix order that is smaller.
    """
    ranks = prefix_ranks(buf, left, most)
    order = np.lexsort((when, ranks[-1][1][at]))
    place = at[order]
    a, b = place[:-1].copy(), place[1:].copy()
    room = np.minimum(np.minimum(left[a], left[b]), most)
    same = np.zeros(len(a), np.int64)
    for width, rank in reversed(ranks):
        equal = np.flatnonzero(same + width <= room)
        equal = equal[rank[a[equal] + same[equal]] == rank[b[equal] + same[equal]]]
        same[equal] += width
    for _ in range(7):
        go = np.flatnonzero(same < room)
        go = go[buf[a[go] + same[go]] == buf[b[go] + same[go]]]
        same[go] += 1
    lcp = np.concatenate([[0], same])[: len(place)]
    own = when[order]
    before = nearest_smaller(own, lcp)
    after = nearest_smaller(own[::-1], np.concatenate([[0], lcp[:0:-1]])[: len(place)])[::-1]
    out = np.zeros(len(at), np.int64)
    out[order] = np.maximum(before, after)
    return out


# ---------------------------------------------------------------- packed rows

TEXT, GONE, OPEN, MEET = range(4)
ROW = "bucket int, kind int, body binary"


def pack(arrays: list[np.ndarray]) -> bytes:
    raw = [np.ascontiguousarray(a) for a in arrays]
    head = np.array([len(raw), *(x for a in raw for x in (a.nbytes, ord(a.dtype.char)))], np.int64)
    plain = b"".join([head.tobytes(), *(a.tobytes() for a in raw)])
    return len(plain).to_bytes(8, "little") + pa.compress(plain, codec="zstd", asbytes=True)


def unpack(body: bytes) -> list[np.ndarray]:
    plain = pa.decompress(body[8:], int.from_bytes(body[:8], "little"), codec="zstd", asbytes=True)
    n = int(np.frombuffer(plain, np.int64, 1)[0])
    head = np.frombuffer(plain, np.int64, 2 * n, 8)
    out, at = [], 8 + 16 * n
    for size, kind in head.reshape(-1, 2).tolist():
        out.append(np.frombuffer(plain, np.dtype(chr(kind)), size // np.dtype(chr(kind)).itemsize, at))
        at += size
    return out


def dealt(keys: np.ndarray, buckets: int, kind: int, arrays: list[np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
    """A packed row for each bucket that keys fall in."""
    if not len(keys):
        return
    bucket = (_mix(keys.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]])
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        own = order[a:b]
        yield int(bucket[own[0]]), kind, pack([x[own] for x in arrays])


def rows_out(rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(rows), 2000):
        b, k, body = zip(*rows[lo : lo + 2000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(body, pa.binary())], names=["bucket", "kind", "body"])


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[list[np.ndarray]]]]]:
    """Buckets of a partition sorted by bucket, one at a time: arrays of each kind."""
    held: dict[int, list] = {}
    now = None
    for b in batches:
        for bucket, kind, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if bucket != now:
                if held:
                    yield now, held
                held, now = {}, bucket
            held.setdefault(kind, []).append(unpack(body))
    if held:
        yield now, held


def joined(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def ids_of(s: T.Slice) -> np.ndarray:
    """Row numbers."""
    return s.ids.to_numpy(zero_copy_only=False)


def firsts(key: np.ndarray, content: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (key, content, place); in it, which rows begin a content, and which lie later than their content's first."""
    order = np.lexsort((start, doc, content, key))
    k, c = key[order], content[order]
    new = np.ones(len(order), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
    later = (doc[order] != doc[head]) | (start[order] != start[head])
    return order, new, later


# ---------------------------------------------------------------- the operator


def common_anchors(docs: DataFrame, min_len: int, gram: int, sample_docs: int, contexts: int) -> np.ndarray:
    """Anchors in more than ``contexts`` different stretches of a sample of about ``sample_docs`` documents.

    No more than the sample's stretches over ``contexts`` of them exist, whatever the table's size.
    """
    n = docs.count()
    part = docs if n <= sample_docs else docs.where(F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < F.lit((sample_docs << 20) // n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in T.slices(batches):
            _, _, _, key, content = stretches(s.buf, s.offs, min_len, gram)
            order = np.lexsort((content, key))
            key, content = key[order], content[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
            keys, count = np.unique(key[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(count)], names=["key", "n"])

    found = part.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > contexts).select("key").collect()
    return np.sort(np.array([r.key for r in found], np.int64).view(np.uint64))


def remove_repeats(docs: DataFrame, min_len: int = MIN_LEN, gram: int = GRAM, sample_docs: int = 8192, contexts: int = 64, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for each row of ``docs``; ``kept`` has the remaining bytes.

    Each row is a document of its own. Null texts are empty; a null doc_id counts as the largest and comes back null; rows that
    repeat a doc_id, or have none, come one after the other in the order of their texts' hashes (equal rows in any order, which shows in
    nothing). Texts shorter than ``min_len`` lose nothing; a text of any length is cut in segments, though one task holds it whole.
    Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    T.bound_batches(spark)
    # rows in order of their place in the corpus, with numbers that are written with them; null or repeated ids are dealt by their texts
    placed = T.id_text(docs).orderBy(F.asc_nulls_last("doc_id"), F.xxhash64("text"))
    table = T.materialize(placed.select(F.monotonically_increasing_id().alias("row"), "text", "doc_id"), "rows")
    T.release(spark)
    docs = table.select("row", "text")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * tasks
    common = common_anchors(docs, min_len, gram, sample_docs, contexts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in T.slices(batches):
            start, windows, _, key, content = stretches(s.buf, s.offs, min_len, gram)
            if len(common) and len(start):
                hot = common[np.minimum(np.searchsorted(common, key), len(common) - 1)] == key
                if hot.any():  # each window on its own, known by its own hashes
                    single = T.ragged(windows[hot], start[hot])
                    one, two = _window_hashes(s.buf, single, min_len)
                    rest = ~hot
                    start, windows = np.concatenate([start[rest], single]), np.concatenate([windows[rest], np.ones(len(single), np.int64)])
                    key, content = np.concatenate([key[rest], one]), np.concatenate([content[rest], two])
            at = s.doc_of(start)
            doc, start = ids_of(s)[at], start - s.offs[at]
            order, new, later = firsts(key, content, doc, start)
            rows = list(dealt(doc[order][later], buckets, GONE, [doc[order][later], start[order][later], (start + windows + min_len - 1)[order][later]]))
            own = order[new]
            rows += dealt(key[own], buckets, MEET, [key[own], content[own], doc[own], start[own], windows[own].astype(np.uint16)])
            yield from rows_out(rows)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[list[np.ndarray]]] = {GONE: [], OPEN: []}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            for kind, parts in found.items():
                if parts:
                    arrays = joined(parts)
                    yield from rows_out(list(dealt(arrays[0], buckets, kind, arrays)))
                    parts.clear()
            size = 0

        for _, held in by_bucket(batches):
            found[GONE] += held.get(GONE, [])
            size += sum(len(x[0]) for x in held.get(GONE, []))
            if MEET in held:
                key, content, doc, start, windows = joined(held[MEET])
                order, new, later = firsts(key, content, doc, start)
                gone = order[later]
                found[GONE].append([doc[gone], start[gone], start[gone] + windows[gone] + min_len - 1])
                own = order[new]
                k = key[own]
                twin = np.zeros(len(k), bool)
                twin[1:] = k[1:] == k[:-1]
                twin[:-1] |= k[1:] == k[:-1]
                own, k = own[twin], k[twin]
                many = np.bincount(np.searchsorted(np.unique(k), k)) if len(k) else np.zeros(0, np.int64)
                crowded = (many[np.searchsorted(np.unique(k), k)] > crowd).astype(np.uint8) if len(k) else np.zeros(0, np.uint8)
                found[OPEN].append([doc[own], key[own], start[own], windows[own], crowded])
                size += len(gone) + len(own)
            if size > FLUSH:  # a row for each target of many buckets' finds, not of one's
                yield from flush()
        yield from flush()

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[T.Slice, pa.Array]]:
        for b in batches:
            at = 0
            for s in T.slices([b]):
                yield s, b.column(2).slice(at, len(s))
                at += len(s)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, names in named(batches):
            doc, known, name = ids_of(s), names.is_valid().to_numpy(zero_copy_only=False), names.fill_null(0).to_numpy(zero_copy_only=False)
            bucket = (_mix(doc.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            rows = []
            for b in np.unique(bucket):
                own = np.flatnonzero(bucket == b)
                size = np.diff(s.offs)[own]
                rows.append((int(b), TEXT, pack([doc[own], size, s.buf[T.ragged(size, s.offs[:-1][own])], name[own], known[own].astype(np.uint8)])))
            yield from rows_out(rows)

    def bytes_of_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in by_bucket(batches):
            if OPEN not in held or TEXT not in held:
                continue
            ids, size, buf, _, _ = joined(held[TEXT])
            offs = np.concatenate([[0], np.cumsum(size)])
            doc, key, start, windows, crowded = joined(held[OPEN])
            by_id = np.argsort(ids)
            row = by_id[np.searchsorted(ids[by_id], doc)]
            if crowded.any():  # windows of an anchor with very many contents are dealt one by one, by their own hash
                hot = crowded > 0
                times = np.where(hot, windows.astype(np.int64), 1)
                step = T.ragged(times, np.zeros(len(times), np.int64))
                doc, key, windows, row, hot = (np.repeat(x, times) for x in (doc, key, windows, row, hot))
                start = np.repeat(start, times) + step
                windows[hot] = 1
                key = key.copy()
                at = offs[row[hot]] + start[hot]
                key[hot] = _window_hashes(buf, at, min_len)[0]
            length = windows.astype(np.int64) + min_len - 1
            bucket = (_mix(key) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edge = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]])
            rows = []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                own = order[a:b]
                if len(own):
                    rows.append((int(bucket[own[0]]), OPEN, pack([key[own], doc[own], start[own], windows[own], buf[T.ragged(length[own], offs[row[own]] + start[own])]])))
            yield from rows_out(rows)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in by_bucket(batches):
            key, doc, start, windows, raw = joined(held[OPEN])
            windows = windows.astype(np.int64)
            offs = np.concatenate([[0], np.cumsum(windows + min_len - 1)])
            # equal windows have equal keys: stretches of some keys at a time bound the arrays
            by_key = np.argsort(key, kind="stable")
            ends = np.cumsum((windows + min_len - 1)[by_key])
            last = np.append(key[by_key][1:] != key[by_key][:-1], True)  # a key's last stretch
            lo, done = 0, 0
            while lo < len(key):
                hi = int(np.searchsorted(ends, done + PART_BYTES, side="right"))
                hi = lo + int(np.argmax(last[max(hi - 1, lo) :])) + max(hi - 1 - lo, 0) + 1
                own = by_key[lo:hi]
                lo, done = hi, ends[hi - 1]
                size = windows[own] + min_len - 1
                buf = raw[T.ragged(size, offs[own])]
                first = np.concatenate([[0], np.cumsum(size)[:-1]])
                left = np.repeat(first + size, size) - np.arange(len(buf))
                at = T.ragged(windows[own], first)
                who = np.repeat(own, windows[own])
                place = start[who] + at - np.repeat(first, windows[own])
                when = np.empty(len(at), np.int64)
                when[np.lexsort((place, doc[who]))] = np.arange(len(at))
                gone = longest_previous_factors(buf, left, at, when, min_len) >= min_len
                if gone.any():
                    d, p, w = doc[who[gone]], place[gone], who[gone]
                    new = np.ones(len(p), bool)  # runs of windows of one stretch become one interval
                    new[1:] = (p[1:] != p[:-1] + 1) | (w[1:] != w[:-1])
                    head = np.flatnonzero(new)
                    tail = np.append(head[1:], len(p)) - 1
                    yield from rows_out(list(dealt(d[head], buckets, GONE, [d[head], p[head], p[tail] + min_len])))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in by_bucket(batches):
            if TEXT not in held:
                continue
            ids, size, buf, name, known = joined(held[TEXT])
            offs = np.concatenate([[0], np.cumsum(size)])
            mark = np.zeros(len(buf) + 1, np.int32)
            if GONE in held:
                doc, lo, hi = joined(held[GONE])
                by_id = np.argsort(ids)
                row = by_id[np.searchsorted(ids[by_id], doc)]
                np.add.at(mark, offs[row] + lo, 1)
                np.add.at(mark, offs[row] + hi, -1)
            gone = np.cumsum(mark[:-1]) > 0
            run = gone.copy()
            run[1:] &= ~gone[:-1]
            heads = offs[:-1][size > 0]
            run[heads] = gone[heads]
            removed, spans = T.span_sums(gone, offs[:-1], offs[1:]), T.span_sums(run, offs[:-1], offs[1:])
            rest = buf[~gone]
            cut_at = np.concatenate([[0], np.cumsum(size - removed)])
            for lo_row in range(0, len(ids), 4096):
                span = range(lo_row, min(lo_row + 4096, len(ids)))
                kept = [rest[cut_at[k] : cut_at[k + 1]].tobytes() for k in span]
                own = slice(span.start, span.stop)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(name[own], mask=known[own] == 0),
                        pa.array(size[own]),
                        pa.array(removed[own]),
                        pa.array(spans[own]),
                        pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
                        pa.array(kept, pa.binary()),
                    ],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    def grouped(rows: DataFrame) -> DataFrame:
        return rows.repartition(tasks, "bucket").sortWithinPartitions("bucket")

    known = T.materialize(grouped(docs.mapInArrow(cut, ROW)).mapInArrow(meet, ROW), "stretches")
    held = table.mapInArrow(texts, ROW)
    open_ = grouped(held.unionByName(known.where(F.col("kind") == OPEN))).mapInArrow(bytes_of_open, ROW)
    # written, so that the shuffles behind it are gone before the texts are shuffled again
    later = T.materialize(grouped(open_).mapInArrow(decide, ROW), "later")
    T.release(spark)
    return grouped(held.unionByName(known.where(F.col("kind") == GONE)).unionByName(later)).mapInArrow(
        finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )


def _window_hashes(buf: np.ndarray, at: np.ndarray, min_len: int) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes of single windows, in segments like the stretches."""
    one, two = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for lo in range(0, len(buf), SEGMENT):
        own = np.flatnonzero((at >= lo) & (at < lo + SEGMENT))
        if len(own):
            part, x = buf[lo : lo + SEGMENT + min_len], at[own] - lo
            one[own], two[own] = Rolling(part, 0).of(x, x + min_len), Rolling(part, 1).of(x, x + min_len)
    return one, two
