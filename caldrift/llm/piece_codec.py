"""Encoding and decoding with a SentencePiece vocabulary by streaming Viterbi.

The best segmentation has the largest sum of piece scores. The stream keeps a window of boundaries no longer than the
longest piece and commits ids as soon as every surviving backpointer path passes through one boundary.

Rules: a space becomes U+2581 and a text that isn't empty gets one in front. A character that isn't a piece (a
literal U+2581 counts as such) costs less than any piece and becomes its UTF-8 byte pieces. So decoding gives back
every text exactly. Of equal scores the path whose last piece is longest wins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import textops as T

MARK = "▁"
#: A literal U+2581 of a text, while the text is in the encoder's alphabet; not a character of any text.
LITERAL = "\U0010ffff\U0010fffe"
CACHED = 300_000
#: Longer stretches between shared boundaries go through the scalar stream.
LOCKSTEP_BYTES = 64
LOCKSTEP_ROWS = 16_384


class Codec:
    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = model.vocab_size()
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte_id = [0] * 256
        self.content: list[bytes] = [b""] * n
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                b = int(piece[1:-1], 16)
                self.byte_id[b], self.content[i] = i, bytes([b])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.score[piece], self.id[piece] = model.get_score(i), i
                self.content[i] = piece.replace(MARK, " ").encode()
        self.prefixes = {p[:k] for p in self.score for k in range(1, len(p) + 1)}
        self.longest = max(map(len, self.score), default=1)
        self.unknown = min(self.score.values(), default=0.0) - 10.0
        #: No piece spans a word's end and the next word's space: each space after a non-space is then a boundary that all paths share.
        self.by_word = not any(MARK in p.lstrip(MARK) for p in self.score)
        size = np.array([len(c) for c in self.content])
        self.size, self.at = size, np.concatenate([[0], np.cumsum(size)[:-1]])
        self.bytes = np.frombuffer(b"".join(self.content) or b"\0", np.uint8)
        self.forget()
        self._trie()

    def _trie(self) -> None:
        """Edges of a trie over the pieces' bytes in one sorted array; the piece at each node, or -1."""
        edge: dict[int, int] = {}
        piece = [-1]
        for p, i in self.id.items():
            at = 0
            for b in p.replace(MARK, " ").encode():
                to = edge.setdefault(at << 8 | b, len(piece))
                if to == len(piece):
                    piece.append(-1)
                at = to
            piece[at] = i
        keys = np.fromiter(edge, np.int64, len(edge))
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.fromiter(edge.values(), np.int64, len(edge))[order]
        self.piece = np.array(piece)
        self.value = np.array([self.score[p] for p in sorted(self.id, key=self.id.get)] or [0.0])
        self.rank = np.full(max(self.id.values(), default=0) + 1, -1)
        self.rank[sorted(self.id.values())] = np.arange(len(self.id))
        self.fallback = np.array(self.byte_id)

    def stream(self, chars: Iterable[str]) -> Iterator[int]:
        """Ids of a stream of characters in the encoder's alphabet (spaces already marked)."""
        score, prefixes, most = self.score, self.prefixes, self.longest
        done = 0  # boundary up to which ids have gone out
        best: dict[int, float] = {0: 0.0}
        back: dict[int, int] = {}
        window: list[str] = []  # characters from boundary `base` on
        base, end, reach = 0, 0, 0  # reach: the farthest end of a piece that begins before the boundary at hand
        source, open_ = iter(chars), True
        at = 0
        while True:
            while open_ and end - at < most:
                c = next(source, None)
                if c is None:
                    open_ = False
                else:
                    window.append(c)
                    end += 1
            if at == end:
                break
            here, text = best[at], ""
            first = window[at - base]
            if first not in score:
                self._offer(best, back, at, at + 1, here + self.unknown)
                reach = max(reach, at + 1)
            for k in range(at, end):
                text += window[k - base]
                if text not in prefixes:
                    break
                value = score.get(text)
                if value is not None:
                    self._offer(best, back, at, k + 1, here + value)
                    reach = max(reach, k + 1)
            at += 1
            if reach == at:  # nothing spans this boundary: all paths meet here
                meet = at
            elif at - done >= 4 * most and (at - done) % most == 0:
                meet = self._meeting(back, [b for b in best if b >= at], done)
            else:
                continue
            if meet > done:
                yield from self._ids(back, window, base, done, meet)
                for b in [b for b in best if b < min(meet, at)]:
                    best.pop(b)
                for b in [b for b in back if b <= meet]:
                    back.pop(b)
                done = meet
                cut = min(meet, at)
                if meet >= at:
                    best = {b: v - best[meet] for b, v in best.items() if b >= meet} if meet in best else best
                del window[: cut - base]
                base = cut
        if end > done:
            yield from self._ids(back, window, base, done, end)

    @staticmethod
    def _offer(best: dict, back: dict, start: int, end: int, value: float) -> None:
        if end not in best or value > best[end]:  # starts come in ascending order, so a tie keeps the longer piece
            best[end], back[end] = value, start

    @staticmethod
    def _meeting(back: dict, ends: list[int], done: int) -> int:
        """The last boundary that the paths of all surviving ends share: the farthest end steps back until one is left."""
        at = set(ends)
        while len(at) > 1:
            far = max(at)
            at.remove(far)
            at.add(back.get(far, done))
        return at.pop()

    def _ids(self, back: dict, window: list[str], base: int, start: int, end: int) -> list[int]:
        cuts = [end]
        while cuts[-1] > start:
            cuts.append(back[cuts[-1]])
        out: list[int] = []
        for a, b in zip(cuts[::-1][:-1], cuts[::-1][1:], strict=True):
            piece = "".join(window[a - base : b - base])
            if (i := self.id.get(piece)) is not None:
                out.append(i)
            else:
                out += [self.byte_id[x] for x in (MARK if piece == LITERAL[0] else piece).encode("utf-8", "surrogatepass")]
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        return list(self.stream(self._marked(" " + text))) if text else []

    @staticmethod
    def _marked(text: str) -> Iterator[str]:
        return (MARK if c == " " else LITERAL[0] if c == MARK else c for c in text)

    def decode(self, ids: Iterable[int]) -> str:
        raw = b"".join(self.content[i] for i in ids)
        return raw[1:].decode("utf-8", "surrogatepass")

    def in_step(self, size: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches that begin and end at shared boundaries, by the same recursion for all of them at once.

        Takes the stretches' sizes and their bytes end to end; returns their numbers of ids and the ids end to end.
        """
        n, most = len(size), int(size.max())
        buf = np.zeros((n, most), np.int64)
        buf[np.arange(most) < size[:, None]] = raw
        best = np.full((n, most + 1), -np.inf)
        back, via = np.zeros((n, most + 1), np.int64), np.full((n, most + 1), -1)
        best[:, 0] = 0.0
        for j in range(most):
            rows = np.flatnonzero((best[:, j] > -np.inf) & (size > j))
            if not len(rows):
                continue
            lead = buf[rows, j]
            width = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
            single = np.zeros(len(rows), bool)
            live, node, k = np.arange(len(rows)), np.zeros(len(rows), np.int64), 1
            while len(live):
                key = node << 8 | buf[rows[live], j + k - 1]
                at = np.searchsorted(self.keys, key)
                at[at == len(self.keys)] = 0
                hit = self.keys[at] == key
                live, node = live[hit], self.to[at[hit]]
                found = self.piece[node]
                whole = found >= 0
                self._offer_all(best, back, via, rows[live[whole]], j, j + k, self.value[self.rank[found[whole]]], found[whole])
                single[live[whole & (width[live] == k)]] = True
                k += 1
                room = size[rows[live]] >= j + k
                live, node = live[room], node[room]
            for w in range(1, 5):
                if not len(rest := rows[~single & (width == w)]):
                    continue
                self._offer_all(best, back, via, rest, j, j + w, np.full(len(rest), self.unknown), np.full(len(rest), -1))
        owner, cut, end = [], [], []
        rows, e = np.arange(n), size.copy()
        while len(rows):
            s = back[rows, e]
            owner.append(rows)
            cut.append(s)
            end.append(e)
            rows, e = rows[s > 0], s[s > 0]
        owner, cut, end = map(np.concatenate, (owner, cut, end))
        order = np.lexsort((cut, owner))
        owner, cut, end = owner[order], cut[order], end[order]
        piece = via[owner, end]
        count = np.where(piece >= 0, 1, end - cut)
        ids = np.repeat(piece, count)
        spelt = np.flatnonzero(ids < 0)
        inner = T.ragged(count, cut)[spelt]
        who = np.repeat(owner, count)
        ids[spelt] = self.fallback[buf[who[spelt], inner]]
        return np.bincount(who, minlength=n), ids.astype(np.int32)

    @staticmethod
    def _offer_all(best: np.ndarray, back: np.ndarray, via: np.ndarray, rows: np.ndarray, start: int, end: int, value: np.ndarray, piece: np.ndarray) -> None:
        total = best[rows, start] + value
        better = total > best[rows, end]
        rows = rows[better]
        best[rows, end], back[rows, end], via[rows, end] = total[better], start, piece[better]

    def of_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all known stretches end to end, and where those asked for begin and how many they are."""
        chunks = chunks.cast(pa.large_binary())
        at = pc.index_in(chunks, value_set=self.known)
        if at.null_count:
            if len(self.known) > CACHED:
                self.forget()
                at = pc.index_in(chunks, value_set=self.known)
            new = chunks.filter(at.is_null())
            size = pc.binary_length(new).to_numpy()
            short = new.filter(pa.array(size <= LOCKSTEP_BYTES))
            short = short.take(pc.sort_indices(pc.binary_length(short)))
            long = new.filter(pa.array(size > LOCKSTEP_BYTES))
            counts, ids = [self.known_n], [self.known_ids]
            for lo in range(0, len(short), LOCKSTEP_ROWS):
                part = short.slice(lo, LOCKSTEP_ROWS)
                text = b"".join(part.to_pylist())
                n, got = self.in_step(pc.binary_length(part).to_numpy(), np.frombuffer(text, np.uint8))
                counts.append(n)
                ids.append(got)
            for c in long.to_pylist():
                got = np.array(list(self.stream(self._marked(c.decode("utf-8")))), np.int32)
                counts.append([len(got)])
                ids.append(got)
            self.known = pa.concat_arrays([self.known, short, long])
            self.known_n, self.known_ids = np.concatenate(counts).astype(np.int64), np.concatenate(ids)
            at = pc.index_in(chunks, value_set=self.known)
        begins = np.concatenate([[0], np.cumsum(self.known_n)])
        at = at.to_numpy()
        return self.known_ids, begins[at], self.known_n[at]

    def forget(self) -> None:
        self.known, self.known_n, self.known_ids = pa.array([], pa.large_binary()), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode_slice(self, s: T.Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a slice's documents end to end, and each document's first."""
        n = np.diff(s.offs)
        full = np.flatnonzero(n)  # an empty text has no ids and no space in front
        at = s.offs[:-1][full] + np.arange(len(full))
        buf = np.insert(s.buf, s.offs[:-1][full], 0x20)  # the space in front of each text
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(len(s) + 1, np.int64)
        if self.by_word:
            space = buf == 0x20
            begin = space.copy()
            begin[1:] &= ~space[:-1]
            begin[at] = True
            starts = np.flatnonzero(begin)
        else:
            starts = at
        index, chunks = T.intern(buf, starts, np.append(starts[1:], len(buf)))
        store, offset, size = self.of_chunks(chunks)
        length = size[index]
        ids = store[T.ragged(length, offset[index])]
        ends = np.concatenate([[0], np.cumsum(length)])
        first = np.zeros(len(s) + 1, np.int64)
        first[full + 1] = ends[np.append(np.searchsorted(starts, at)[1:], len(starts))]
        return ids, np.maximum.accumulate(first)

    def decode_slice(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts of documents' ids: bytes end to end and their offsets; the inverse of encode_slice."""
        length = self.size[ids]
        raw = self.bytes[T.ragged(length, self.at[ids])]
        offs = np.concatenate([[0], np.cumsum(length)])[first]
        head = offs[:-1][np.diff(offs) > 0]
        return np.delete(raw, head), offs - np.searchsorted(head, offs)


_loaded: dict[str, Codec] = {}


def codec(model_path: str) -> Codec:
    if model_path not in _loaded:
        _loaded[model_path] = Codec(model_path)
    return _loaded[model_path]


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids array<int>) for each row of ``docs``.

    A narrow map over the scan. Null and empty texts give an empty array; a null doc_id stays null; repeated rows each
    give a row; other columns are ignored. The model file must be at the same path on every node.
    """
    T.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for s in T.slices(batches):
            ids, first = own.encode_slice(s)
            yield pa.RecordBatch.from_arrays([s.ids, pa.ListArray.from_arrays(first.astype(np.int32), ids)], names=["doc_id", "ids"])

    return T.id_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids decode to the empty text."""
    T.bound_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for b in batches:
            ids = b.column(1)
            size = np.array([0 if x is None else x for x in ids.value_lengths().to_pylist()], np.int64)
            raw, offs = own.decode_slice(ids.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)]))
            text = pa.Array.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([b.column(0), text.cast(pa.large_string()).cast(pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_bytes, n_ids, ids_crc32, text_crc32, same): each text encoded, decoded and compared with itself.

    ids_crc32 is over little-endian 32-bit ids, text_crc32 over the decoded bytes. Edge cases as in ``encode``.
    """
    T.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for s in T.slices(batches):
            ids, first = own.encode_slice(s)
            raw, offs = own.decode_slice(ids, first)
            ids = ids.astype("<u4")
            text = [raw[a:b] for a, b in zip(offs[:-1], offs[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    s.ids,
                    pa.array(np.diff(s.offs)),
                    pa.array(np.diff(first)),
                    pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(first[:-1], first[1:], strict=True)], pa.int64()),
                    pa.array([zlib.crc32(x.tobytes()) for x in text], pa.int64()),
                    pa.array([np.array_equal(x, s.buf[a:b]) for x, a, b in zip(text, s.offs[:-1], s.offs[1:], strict=True)]),
                ],
                names=["doc_id", "n_bytes", "n_ids", "ids_crc32", "text_crc32", "same"],
            )

    return T.id_text(docs).mapInArrow(run, "doc_id long, n_bytes long, n_ids long, ids_crc32 long, text_crc32 long, same boolean")
