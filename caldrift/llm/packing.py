"""Packing token sequences by Karmarkar-Karp multiway differencing.

Each document's ids, with the end id, are cut into whole windows and a rest. The rests of a block of documents are
dealt to m windows by multiway differencing: partial partitions are merged two at a time, the fullest slots of one
with the emptiest of the other, those with the largest spreads first. m begins at the least count that could hold
the block and rises whenever a window would overflow. Ids come from a ``tokenizers`` file; each distinct stretch between the tokenizer's
own pre-token boundaries is encoded once.
"""

from __future__ import annotations

import heapq
import itertools
import json
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import textops as T
from .token_counts import byte_alphabet

WINDOW = 1024
END_ID = 0
#: Documents whose rests are packed together, and the tokens after which a block closes before that.
BLOCK_DOCS = 128
BLOCK_TOKENS = 2_000_000
CACHED = 400_000
#: Code points that the array pre-tokenizer knows; texts with others go through the pattern itself.
KNOWN = 0x2000
#: Fixed value: the pre-token pattern of the byte-level tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _classes() -> np.ndarray:
    """0 white space but the space, 1 the space, 2 letters, 3 numbers, 4 others."""
    kind = np.full(KNOWN, 4, np.int8)
    for c in range(KNOWN):
        x = chr(c)
        group = unicodedata.category(x)[0]
        if x == " ":
            kind[c] = 1
        elif 0x09 <= c <= 0x0D or c in (0x85, 0xA0, 0x1680):
            kind[c] = 0
        elif group == "L":
            kind[c] = 2
        elif group == "N":
            kind[c] = 3
    return kind


class Encoder:
    """Ids of whole slices of documents, equal to the tokenizer's own over each text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        # the tokenizer takes the strings of added tokens out of a text before anything else
        self.added = [t.content.encode("utf-8") for t in self.own.get_added_tokens_decoder().values() if t.content]
        self.pattern = regex.compile(PATTERN)
        self.kind = _classes()
        self.merge = self.by_rank(path)
        self.forget()

    @staticmethod
    def by_rank(path: str):
        """The same vocabulary in the faster library, where the file's ids are in the order of its merges; else None."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = byte_alphabet()
        ranks = {bytes(letters[c] for c in piece): i for piece, i in model["vocab"].items() if all(c in letters for c in piece)}
        merges = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        if [model["vocab"].get(a + b) for a, b in merges] != list(range(256, 256 + len(merges))):
            return None
        ranks = {p: i for p, i in ranks.items() if i < 256 + len(merges)}
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def plain_starts(self, s: T.Slice) -> tuple[np.ndarray, np.ndarray]:
        """Byte starts of the pre-tokens, worked out on code points, and which documents need the pattern instead."""
        text = np.frombuffer(s.buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        place = np.flatnonzero((s.buf & 0xC0) != 0x80)
        odd = (text >= KNOWN) | (text == 0x27)
        kind = self.kind[np.minimum(text, KNOWN - 1)]
        n = len(text)
        edge = np.zeros(n + 1, bool)  # a document begins (or the slice ends) here
        edge[np.searchsorted(place, s.offs)] = True
        blank = kind <= 1
        before_blank = np.concatenate([[False], blank[:-1]]) & ~edge[:-1]
        after_word = np.concatenate([~blank[1:], [False]]) & ~edge[1:]
        start = edge[:-1].copy()
        start |= blank & ~before_blank  # a run of white space
        start |= blank & after_word  # its last sign, if a word follows
        changes = np.concatenate([[True], kind[1:] != kind[:-1]])
        start |= ~blank & changes
        joins = np.concatenate([[False], kind[:-1] == 1]) & ~edge[:-1]
        start &= ~(~blank & joins)  # a word takes the space before it
        slow = np.unique(s.doc_of(place[odd]))
        return place[start], slow

    def starts(self, s: T.Slice) -> np.ndarray:
        at, slow = self.plain_starts(s)
        if not len(slow):
            return at
        parts, doc = [], s.doc_of(at)
        lows, highs = np.searchsorted(doc, slow), np.searchsorted(doc, slow, side="right")
        done = 0
        for k, lo, hi in zip(slow, lows, highs, strict=True):
            size = np.array([len(m.encode("utf-8")) for m in self.pattern.findall(s.text(k).decode("utf-8"))])
            parts += [at[done:lo], s.offs[k] + np.concatenate([[0], np.cumsum(size)[:-1]])]
            done = hi
        return np.concatenate([*parts, at[done:]])

    def encode_new(self, stretches: list[bytes]) -> list[list[int]]:
        """Ids of stretches, each a pre-token of its own."""
        if self.merge is not None:
            return [self.merge(x) for x in stretches]
        return [e.ids for e in self.own.encode_batch_fast([x.decode("utf-8") for x in stretches], add_special_tokens=False)]

    def of_stretches(self, stretches: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all known stretches end to end, and where those asked for begin and how many they are."""
        stretches = stretches.cast(pa.large_binary())
        at = pc.index_in(stretches, value_set=self.known)
        if at.null_count:
            if len(self.known) > CACHED:
                self.forget()
                at = pc.index_in(stretches, value_set=self.known)
            new = stretches.filter(at.is_null())
            parts = self.encode_new(new.to_pylist())
            self.known = pa.concat_arrays([self.known, new])
            self.size = np.concatenate([self.size, [len(p) for p in parts]]).astype(np.int64)
            self.store = np.concatenate([self.store, np.fromiter(itertools.chain.from_iterable(parts), np.uint32)])
            at = pc.index_in(stretches, value_set=self.known)
        begins = np.concatenate([[0], np.cumsum(self.size)])
        at = at.to_numpy()
        return self.store, begins[at], self.size[at]

    def forget(self) -> None:
        self.known, self.size, self.store = pa.array([], pa.large_binary()), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def with_added(self, s: T.Slice) -> np.ndarray:
        """Documents in which the string of an added token stands."""
        raw, at = s.buf.tobytes(), []
        for token in self.added:
            k = raw.find(token)
            while k >= 0:
                at.append((k, k + len(token)))
                k = raw.find(token, k + 1)
        spans = np.array(at, np.int64).reshape(-1, 2)
        doc = s.doc_of(spans[:, 0])
        return np.unique(doc[spans[:, 1] <= s.offs[doc + 1]])

    def by_tokenizer(self, s: T.Slice, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode_slice``: those documents by the tokenizer itself, the runs between them as ever."""
        parts, sizes, done = [], [], 0
        for k in [*marked.tolist(), len(s)]:
            if k > done:
                lo, hi = s.offs[done], s.offs[k]
                ids, first = self.encode_slice(T.Slice(s.ids.slice(done, k - done), s.buf[lo:hi], s.offs[done : k + 1] - lo))
                parts.append(ids)
                sizes += np.diff(first).tolist()
            if k < len(s):
                parts.append(np.array(self.own.encode(s.text(k).decode("utf-8"), add_special_tokens=False).ids, np.uint32))
                sizes.append(len(parts[-1]))
            done = k + 1
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def encode_slice(self, s: T.Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids end to end and each document's first."""
        if not len(s.buf):
            return np.zeros(0, np.uint32), np.zeros(len(s) + 1, np.int64)
        marked = self.with_added(s)
        if len(marked):
            return self.by_tokenizer(s, marked)
        at = self.starts(s)
        index, stretches = T.intern(s.buf, at, np.append(at[1:], len(s.buf)))
        store, offset, size = self.of_stretches(stretches)
        length = size[index]
        ends = np.concatenate([[0], np.cumsum(length)])
        return store[T.ragged(length, offset[index])], ends[np.searchsorted(at, s.offs)]


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def differencing(sizes: list[int], m: int) -> list[list[int]]:
    """Items of each of m slots, near-equal in sum. A partial partition lists only its non-empty slots, fullest first."""
    heap = [(-w, k, [(w, [k])]) for k, w in enumerate(sizes)]  # spread, order, slots
    heapq.heapify(heap)
    count = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        spare = m - len(a)
        if len(b) <= spare:  # room enough: b takes a's empty slots
            slots = a + b
        else:
            slots = a[: m - len(b)] + b[:spare]
            # fullest of a with emptiest of b, for the slots that meet
            meet_a, meet_b = a[m - len(b) :], b[spare:]
            slots += [(x[0] + y[0], x[1] + y[1]) for x, y in zip(meet_a, reversed(meet_b), strict=True)]
        slots.sort(key=lambda x: -x[0])
        low = slots[-1][0] if len(slots) == m else 0
        heapq.heappush(heap, (low - slots[0][0], count, slots))
        count += 1
    return [items for _, items in heap[0][2]] if heap else []


def deal(sizes: list[int], capacity: int = WINDOW) -> list[list[int]]:
    """Slots whose sums fit the capacity: differencing with as few slots as it manages."""
    if not sizes:
        return []
    m = -(-sum(sizes) // capacity)
    while True:
        slots = differencing(sizes, m)
        worst = max(sum(sizes[k] for k in items) for items in slots)
        if worst <= capacity:
            return slots
        m += max(1, m * (worst - capacity) // (4 * capacity))


def pieces_of(tokens: np.ndarray, window: int = WINDOW) -> Iterator[tuple[int, list[tuple[int, int, int, int]]]]:
    """Windows of a block of documents with so many tokens each: (fill, [(document, start, length, offset)]).

    A rest over half a window is rarely matched well by another such rest, so rests are cut in halves of at most half a
    window: still one or two pieces to a document, and little padding.
    """
    items: list[tuple[int, int, int]] = []
    for d, n in enumerate(tokens.tolist()):
        whole = n // window
        for k in range(whole):
            yield window, [(d, k * window, window, 0)]
        rest = n - whole * window
        if rest:
            items.append((d, whole * window, rest))
    cut = []
    for d, start, n in items:
        if n > window // 2:
            cut += [(d, start, n // 2), (d, start + n // 2, n - n // 2)]
        else:
            cut.append((d, start, n))
    for slot in deal([n for _, _, n in cut], window):
        fill, out = 0, []
        for k in sorted(slot):
            d, start, n = cut[k]
            out.append((d, start, n, fill))
            fill += n
        yield fill, out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW) -> DataFrame:
    """One row per piece of a document's ids (with the end id 0): where it lies in its document and its sequence.

    A narrow map over the scan: blocks are documents that a task reads in turn, so nothing is shuffled, memory is a
    block's tokens, and a lost task gives the same rows again. sequence_id is the scan partition's number times 2^33 plus
    a count, so it is unique but has gaps. Null and empty texts are a single end id; a null doc_id stays null; repeated
    rows are packed each on its own; other columns are ignored. An empty table gives no rows.
    """
    T.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, serial = encoder(tokenizer_path), TaskContext.get().partitionId() << 33
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            nonlocal serial
            doc_ids = [i for part, _, _ in held for i in part]
            lengths = np.concatenate([np.diff(f) for _, _, f in held])
            ids = np.concatenate([np.insert(x, f[1:], END_ID) for _, x, f in held]).astype("<u4")
            tokens = lengths + 1
            first = np.concatenate([[0], np.cumsum(tokens)[:-1]])
            rows = []
            for fill, pieces in pieces_of(tokens, window):
                for d, start, n, offset in pieces:
                    a = int(first[d]) + start
                    rows.append((doc_ids[d], start, n, zlib.crc32(ids[a : a + n].tobytes()), int(tokens[d]), serial, offset, fill))
                serial += 1
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        docs_held = tokens_held = 0
        for s in T.slices(batches):
            ids, first = own.encode_slice(s)
            names = s.ids.to_pylist()
            for lo in range(0, len(s), BLOCK_DOCS):
                hi = min(lo + BLOCK_DOCS, len(s))
                held.append((names[lo:hi], ids[first[lo] : first[hi]], first[lo : hi + 1] - first[lo]))
                docs_held, tokens_held = docs_held + hi - lo, tokens_held + int(first[hi] - first[lo])
                if docs_held >= BLOCK_DOCS or tokens_held >= BLOCK_TOKENS:
                    yield close()
                    docs_held = tokens_held = 0
        if held:
            yield close()

    return T.id_text(docs).mapInArrow(run, SCHEMA)
