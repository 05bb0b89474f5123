"""Quality rules: base counts of a text, and how far its character classes and common words lie from those of prose.

A document's histograms of character classes and of common words are compared with references of several languages
by Jensen-Shannon distance (the square root of the divergence in bits). The nearest language counts; texts too short
for a histogram to mean anything, and texts in scripts that no reference is in, pass by the guards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T

#: Rough shares, in prose, of lower-case letters, capitals, digits, white space, punctuation, other ASCII
#: signs and code points beyond ASCII.
CLASSES = {
    "en": (0.775, 0.025, 0.005, 0.165, 0.028, 0.001, 0.001),
    "de": (0.755, 0.045, 0.005, 0.145, 0.029, 0.001, 0.020),
    "fr": (0.745, 0.022, 0.005, 0.165, 0.027, 0.001, 0.035),
    "es": (0.760, 0.022, 0.005, 0.165, 0.022, 0.001, 0.025),
}
#: Rough shares of all words that the commonest words of each language make up in prose, in per mille.
WORDS = {
    "en": {"the": 60, "of": 31, "and": 28, "to": 26, "a": 22, "in": 20, "is": 11, "that": 11, "it": 9, "for": 9, "was": 9, "on": 7, "with": 7, "as": 7, "be": 6, "by": 5, "this": 5, "are": 5, "or": 4, "from": 4},
    "de": {"der": 34, "die": 33, "und": 29, "in": 20, "den": 12, "von": 11, "zu": 11, "das": 11, "mit": 9, "des": 9, "auf": 8, "für": 7, "ist": 7, "im": 7, "dem": 7, "nicht": 6, "ein": 6, "eine": 6, "als": 5, "auch": 5},
    "fr": {"de": 50, "la": 30, "le": 25, "et": 22, "les": 21, "des": 18, "en": 14, "un": 12, "du": 12, "une": 10, "que": 9, "est": 8, "pour": 8, "qui": 7, "dans": 7, "a": 7, "par": 6, "plus": 5, "sur": 5, "pas": 5},
    "es": {"de": 60, "la": 38, "que": 28, "el": 28, "en": 26, "y": 25, "a": 20, "los": 16, "del": 13, "se": 12, "las": 11, "por": 9, "un": 9, "con": 8, "una": 8, "no": 8, "para": 7, "es": 6, "al": 5, "su": 5},
}
#: A document goes when its classes are farther than MOST_CLASS from every language, or when both its classes and its
#: words are rather far (BOTH); asked from so many code points and words on.
MOST_CLASS, BOTH, LEAST_CHARS, LEAST_WORDS = 0.26, (0.18, 0.33), 200, 100
#: Texts with a larger share of code points beyond ASCII among their letters are in a script that no reference is in, and pass.
OWN_SCRIPTS = 0.3
SIGNS = np.zeros(256, bool)
SIGNS[list(b"#*$%&|<>")] = True

_CLASS = np.full(256, 5)
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A] = 0, 1, 2
_CLASS[T.SPACE] = 3
_CLASS[list(b".,;:!?'\"()-")] = 4
_CLASS[0xC0:] = 6
_CLASS[0x80:0xC0] = 7  # continuation bytes count with their lead byte
_STRIP = b".,;:!?'\"()-"
_LIST = sorted({w.encode() for ws in WORDS.values() for w in ws})
_COMMON = pa.array(_LIST, pa.large_binary())


def references() -> tuple[np.ndarray, np.ndarray]:
    """By language: shares of character classes, and of each common word of any language with the others last."""
    classes = np.array([CLASSES[k] for k in sorted(CLASSES)])
    words = np.array([[WORDS[k].get(w.decode(), 0) / 1000 for w in _LIST] for k in sorted(WORDS)])
    return classes / classes.sum(axis=1, keepdims=True), np.hstack([words, 1 - words.sum(axis=1, keepdims=True)])


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of p to each row of q; rows sum to 1."""
    m = (p[:, None] + q[None]) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p[:, None] > 0, p[:, None] * np.log2(p[:, None] / m), 0).sum(axis=2)
        right = np.where(q[None] > 0, q[None] * np.log2(q[None] / m), 0).sum(axis=2)
    return np.sqrt(np.maximum((left + right) / 2, 0))


def tally(row: np.ndarray, column: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    return np.bincount(row * shape[1] + column, minlength=shape[0] * shape[1]).reshape(shape)


def repeated(ids: np.ndarray, doc: np.ndarray, n_ids: int, n_docs: int) -> np.ndarray:
    """By document: words inside 3-word windows that occur twice or more in it."""
    n = len(ids)
    if n < 3:
        return np.zeros(n_docs, np.int64)
    at = np.flatnonzero(doc[:-2] == doc[2:])
    pair = ids[:-1] * n_ids + ids[1:]
    if n_ids < 2**20:
        code = pair[at] * n_ids + ids[at + 2]
    else:
        _, pair = np.unique(pair, return_inverse=True)
        code = pair[at] * n_ids + ids[at + 2]
    order = np.lexsort((code, doc[at]))
    same = (code[order][1:] == code[order][:-1]) & (doc[at][order][1:] == doc[at][order][:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[at[twice] + k] = True
    return np.bincount(doc[covered], minlength=n_docs)


def measures(s: T.Slice) -> dict[str, np.ndarray]:
    """Base counts and distances of a slice's documents."""
    n = len(s)
    starts, ends, first = T.word_spans(s)
    n_words = np.diff(first)
    doc = np.repeat(np.arange(n), n_words)
    lead = (s.buf & 0xC0) != 0x80
    blank = T.SPACE[s.buf]
    ids, words = T.intern(s.buf, starts, ends)
    lows, highs, first_line = T.line_spans(s)
    line, lines = T.intern(s.buf, lows, highs)
    full = T.span_sums(~blank, lows, highs) > 0
    line_doc = np.repeat(np.arange(n), np.diff(first_line))[full]
    key = line_doc * max(1, len(lines)) + line[full]
    distinct = np.unique(key) // max(1, len(lines))
    kinds = tally(np.repeat(np.arange(n), np.diff(s.offs)), _CLASS[s.buf], (n, 8))[:, :7]
    plain = pc.index_in(pc.ascii_lower(pc.ascii_trim(words.cast(pa.binary()).cast(pa.large_binary()).view(pa.large_string()), _STRIP.decode())).view(pa.large_binary()), value_set=_COMMON) if len(words) else pa.array([], pa.int32())
    common = pc.fill_null(plain, len(_LIST)).to_numpy().astype(np.int64)
    hist = tally(doc, common[ids], (n, len(_LIST) + 1))
    ref_class, ref_word = references()
    far_class, far_word = np.zeros((n, len(ref_class))), np.zeros((n, len(ref_word)))
    for lo in range(0, n, 256):  # bounds the (documents, languages, words) array
        cut = slice(lo, lo + 256)
        far_class[cut] = distance(kinds[cut] / np.maximum(1, kinds[cut].sum(axis=1, keepdims=True)), ref_class)
        far_word[cut] = distance(hist[cut] / np.maximum(1, n_words[cut, None]), ref_word)
    return {
        "n_words": n_words,
        "word_chars": s.per_doc(lead & ~blank),
        "n_symbols": s.per_doc(SIGNS[s.buf]),
        "n_dup_lines": np.bincount(line_doc, minlength=n) - np.bincount(distinct, minlength=n),
        "n_repeat_words": repeated(ids, doc, max(1, len(words)), n),
        "n_chars": s.per_doc(lead),
        "beyond": kinds[:, 6] / np.maximum(1, kinds[:, [0, 1, 6]].sum(axis=1)),
        "class_distance": far_class.min(axis=1),
        "word_distance": far_word.min(axis=1),
    }


def verdicts(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which documents fail the base rule, and which are kept."""
    n = m["n_words"]
    failed = (n < 50) | (100 * m["n_repeat_words"] > 50 * n)
    far = (m["n_chars"] >= LEAST_CHARS) & (m["class_distance"] > MOST_CLASS)
    far |= (m["n_chars"] >= LEAST_CHARS) & (n >= LEAST_WORDS) & (m["class_distance"] > BOTH[0]) & (m["word_distance"] > BOTH[1])
    return failed, ~failed & ~(far & (m["beyond"] <= OWN_SCRIPTS))


def rules(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance,
    word_distance) for each row of ``docs``.

    A narrow map over the scan. Null, empty and blank texts have no words and fail; a null doc_id stays null; repeated
    rows each give a row; other columns are ignored; an empty table gives no rows. The distances are asked from
    LEAST_CHARS code points and LEAST_WORDS words on; shorter texts, and those in other scripts, fail by the base rule or pass. Very
    long texts are counted whole, in arrays of a few times their size.
    """
    T.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in T.slices(batches):
            m = measures(s)
            failed, kept = verdicts(m)
            cols = [m[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            yield pa.RecordBatch.from_arrays(
                [s.ids, *(pa.array(c.astype(np.int64)) for c in cols), pa.array(failed), pa.array(kept), pa.array(m["class_distance"]), pa.array(m["word_distance"])],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"],
            )

    return T.id_text(docs).mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they are: each batch is judged where it lies."""
    T.bound_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = []
            for s in T.slices([pa.RecordBatch.from_arrays([pa.nulls(len(b), pa.int64()), b.column(at)], names=["doc_id", "text"])]):
                kept.append(verdicts(measures(s))[1])
            if kept:
                yield b.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(run, docs.schema)
