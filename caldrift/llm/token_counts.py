"""Token counts by a linear longest-match automaton.

A vocabulary trie gets, for each node, a failure link and the number of pieces that following it pops, both worked
out once. Greedy longest-match piece counts then need one pass over a word and never build a piece.

Scheme: a document's words are runs without white space; a word is encoded as a space byte and its UTF-8 bytes,
as in byte-level vocabularies whose word-initial pieces carry the space. All single bytes are pieces, so every word
can be encoded. Words are counted once for each distinct word of a slice of documents.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textops as T

#: Longer words go one by one through the scalar matcher: lockstep would idle on a few very long ones.
LOCKSTEP_BYTES = 96


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def vocabulary(path: str) -> list[bytes]:
    """Pieces of a byte-level ``tokenizers`` file, without its special tokens."""
    with open(path, encoding="utf-8") as f:
        stored = json.load(f)
    special = {x["content"] for x in stored.get("added_tokens") or []}
    letters = byte_alphabet()
    return [bytes(letters[c] for c in piece) for piece in stored["model"]["vocab"] if piece not in special]


class LongestMatch:
    """Trie edges in one sorted array, failure links and popped-piece counts by node; node 0 is the root."""

    def __init__(self, pieces: list[bytes]):
        pieces = sorted({p for p in pieces if p} | {bytes([b]) for b in range(256)})
        edge: dict[int, int] = {}
        level, parent, byte, whole = [0], [0], [0], [False]
        for p in pieces:
            at = 0
            for b in p:
                key = at << 8 | b
                if (to := edge.get(key)) is None:
                    to = edge[key] = len(parent)
                    parent.append(at)
                    byte.append(b)
                    level.append(level[at] + 1)
                    whole.append(False)
                at = to
            whole[at] = True
        n = len(parent)
        fail, pops = [0] * n, [0] * n
        for v in sorted(range(1, n), key=level.__getitem__):  # shorter strings first
            if whole[v]:
                pops[v] = 1  # the piece itself; the match starts again at the root
                continue
            at, popped = fail[parent[v]], pops[parent[v]]
            while (to := edge.get(at << 8 | byte[v])) is None:
                popped += pops[at]
                at = fail[at]
            fail[v], pops[v] = to, popped
        left = [0] * n
        for v in sorted(range(1, n), key=level.__getitem__):
            left[v] = pops[v] + left[fail[v]]
        self.edge = edge
        keys = np.fromiter(edge, np.int64, len(edge))
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.fromiter(edge.values(), np.int64, len(edge))[order]
        self.fail, self.pops, self.left = np.array(fail), np.array(pops), np.array(left)

    def count(self, word: bytes) -> int:
        """Pieces of a space and the word."""
        edge, fail, pops = self.edge, self.fail, self.pops
        at, n = 0, 0
        for b in b" " + word:
            while (to := edge.get(at << 8 | b)) is None:
                n += int(pops[at])
                at = int(fail[at])
            at = to
        return n + int(self.left[at])

    def counts(self, words: pa.Array) -> np.ndarray:
        """Pieces of each word of a binary array, all words in step."""
        width = np.int32 if pa.types.is_binary(words.type) else np.int64
        offs = np.frombuffer(words.buffers()[1], width)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data = words.buffers()[2]
        buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        size = np.diff(offs)
        out = np.zeros(len(words), np.int64)
        for k in np.flatnonzero(size > LOCKSTEP_BYTES):
            out[k] = self.count(buf[offs[k] : offs[k + 1]].tobytes())
        order = np.argsort(-np.where(size > LOCKSTEP_BYTES, 0, size), kind="stable")
        order = order[(size[order] > 0) & (size[order] <= LOCKSTEP_BYTES)]
        if not len(order):
            return out
        at, n = np.full(len(order), self.edge[0x20]), np.zeros(len(order), np.int64)
        start, length = offs[order], size[order]
        for j in range(int(length[0])):
            live = int(np.searchsorted(-length, -j, side="left"))  # words longer than j
            todo = np.arange(live)
            b = buf[start[:live] + j].astype(np.int64)
            while len(todo):
                key = at[todo] << 8 | b[todo]
                hit = np.searchsorted(self.keys, key)
                hit[hit == len(self.keys)] = 0
                found = self.keys[hit] == key
                at[todo[found]] = self.to[hit[found]]
                todo = todo[~found]
                n[todo] += self.pops[at[todo]]
                at[todo] = self.fail[at[todo]]
        out[order] = n + self.left[at]
        return out


_loaded: dict[str, LongestMatch] = {}


def automaton(path: str) -> LongestMatch:
    if path not in _loaded:
        _loaded[path] = LongestMatch(vocabulary(path))
    return _loaded[path]


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, n_bytes, n_words, n_tokens) for each row of ``docs``.

    A narrow map over the scan: no shuffle, memory by slice. Null, empty and blank texts have 0 words and tokens; a
    null doc_id stays null; repeated rows each give a row; other columns are ignored, whatever their names.
    The vocabulary file must be at the same path on every node.
    """
    T.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = automaton(vocabulary_path)
        for s in T.slices(batches):
            starts, ends, first = T.word_spans(s)
            index, words = T.intern(s.buf, starts, ends)
            tokens = match.counts(words)[index] if len(index) else index
            yield pa.RecordBatch.from_arrays(
                [s.ids, pa.array(np.diff(s.offs)), pa.array(np.diff(first)), pa.array(T.span_sums(tokens, first[:-1], first[1:]))],
                names=["doc_id", "n_bytes", "n_words", "n_tokens"],
            )

    return T.id_text(docs).mapInArrow(run, "doc_id long, n_bytes long, n_words long, n_tokens long")
