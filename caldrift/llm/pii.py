"""Personal data: fixed patterns for four kinds, and a linear-chain conditional random field that adds spans.

Base kinds (leftmost, non-overlapping per kind): email, ip, card, phone. The field labels words from features of
their shape and neighbours; it is trained on a small labelled table made by the rules below and decoded by Viterbi in
numpy batches. It adds kinds that patterns alone can't tell from other numbers: ``national`` (telephone numbers
without a country code) and ``secret`` (keys and tokens after a cue). Only words that hold a digit may get a label
other than ``O``, so the chain falls apart exactly at the others and only short runs around digits are decoded.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import textops as T

BASE = ("email", "ip", "card", "phone")
ADDED = ("national", "secret")
KINDS = (*BASE, *ADDED)
#: Digits run from their first on: a match can't begin inside a run whose beginning has failed.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
#: The same language as a digit followed by separated digits, without a repeated group for each digit.
CARD = re.compile(r"[0-9]+(?:[\x20-][0-9]+)*")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[^A-Za-z0-9._%+-]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Around each @ in turn: the local part is the run before it, which no earlier match may hold."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        nxt = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = nxt = m.end()
        elif start < at:
            free = max(free, start)
        at = text.find("@", nxt)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's rank, end) in code points, ascending."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        # a part may be thousands of zeros long, more than int() takes
        if all(len(d := p.lstrip("0")) <= 3 and int(d or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# ---------------------------------------------------------------- the field

LABELS = ("O", "B-national", "I-national", "B-secret")
#: Which label may follow which: an I only continues its own kind.
MAY_FOLLOW = np.array([[1, 1, 0, 1], [1, 1, 1, 1], [1, 1, 1, 1], [1, 1, 0, 1]], bool)
#: Words that announce a secret or a telephone number.
SECRET_CUES = frozenset("token key secret password passwd apikey api_key access_key auth bearer".split())
PHONE_CUES = frozenset("tel phone call telephone mobile fax cell".split())


def shape(word: str) -> str:
    """Runs of letters, digits and other signs, each shown once: ``(743)`` is ``(9)``."""
    out = []
    for c in word:
        k = "9" if "0" <= c <= "9" else "X" if c.isupper() else "x" if c.isalpha() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


def cue(word: str) -> str:
    w = word.lower().strip("\"'=:,.;()[]{}")
    return "secret" if w in SECRET_CUES else "phone" if w in PHONE_CUES else "sign" if not w else "word"


def features(words: list[str], k: int) -> list[str]:
    w = words[k]
    bare = w.strip("\"'=:,.;()[]{}#$%&*!|")
    digits = sum(c.isdigit() for c in w)
    hexes = len(bare) >= 16 and re.fullmatch(r"[0-9a-fA-F]+|[0-9A-Za-z_+/=-]+", bare) is not None and any(c.isalpha() for c in bare) and digits >= 3
    before = [words[j] if j >= 0 else "" for j in (k - 1, k - 2)]
    after = words[k + 1] if k + 1 < len(words) else ""
    cues = {cue(x) for x in before if x}
    out = ["bias", f"digits={min(digits, 12)}", f"size={min(len(bare), 24) // 4}", f"shape={shape(bare)[:8]}"]
    out += [f"cue={c}" for c in cues if c in ("secret", "phone")]
    out += [f"prev={shape(before[0])[:6]}:{sum(c.isdigit() for c in before[0])}" if any(c.isdigit() for c in before[0]) else "prev=none"]
    out += [f"next={shape(after)[:6]}:{sum(c.isdigit() for c in after)}" if any(c.isdigit() for c in after) else "next=none"]
    out += ["hex"] * hexes + (["hex&secret"] if hexes and "secret" in cues else [])
    out += [f"form={re.sub('[0-9]', '9', bare)}"] if digits >= 3 and len(bare) <= 14 else []
    return out


def labelled(n: int = 900, seed: int = 7) -> list[tuple[list[str], list[int]]]:
    """The small labelled table: sentences of made-up words with numbers of both kinds and look-alikes among them."""
    rng = random.Random(seed)
    say = lambda: "".join(rng.choices("aeioubcdfglmnprstvw", k=rng.randint(2, 8)))
    num = lambda k: "".join(rng.choices("0123456789", k=k))
    hexes = lambda k: "".join(rng.choices("0123456789abcdef", k=k))
    out = []
    for i in range(n):
        words = [say() for _ in range(rng.randint(2, 6))]
        tags = [0] * len(words)
        kind = i % 9
        if kind == 0:
            add, tag = rng.choice([([f"({num(3)})", f"{num(3)}-{num(4)}"], [1, 2]), ([f"{num(3)}-{num(3)}-{num(4)}"], [1]), ([f"{num(3)}.{num(3)}.{num(4)}"], [1])])
        elif kind == 1:
            lead = rng.choice(["tel", "phone:", "call", "mobile:"])
            add, tag = rng.choice([([lead, f"({num(3)})", f"{num(3)}-{num(4)}"], [0, 1, 2]), ([lead, f"{num(3)}-{num(3)}-{num(4)}"], [0, 1])])
        elif kind in (2, 3):
            lead = rng.choice([["token", "="], ["key:"], ["secret", "="], ["password", ":"], ["api_key", "="]])
            quote = rng.choice(['"', "'", ""])
            add, tag = [*lead, quote + rng.choice([hexes(32), hexes(40), hexes(64)]) + quote], [0] * len(lead) + [3]
        elif kind == 4:
            add, tag = rng.choice([([num(rng.randint(1, 6))], [0]), ([f"{num(4)}-{num(2)}-{num(2)}"], [0]), ([f"{num(2)}:{num(2)}"], [0])])
        elif kind == 5:
            add, tag = rng.choice([([f"({num(4)})"], [0]), ([f"{num(1)}.{num(2)}"], [0]), ([num(3), num(3)], [0, 0]), ([f"{num(3)}-{num(3)}"], [0]), ([f"({num(3)})"], [0])])
        elif kind == 6:
            add, tag = rng.choice([([num(16)], [0]), ([".".join(num(3) for _ in range(4))], [0]), ([f"{say()}{num(2)}@{say()}.com"], [0]), (["+1", f"({num(3)})", f"{num(3)}-{num(4)}"], [0, 1, 2])])
        elif kind == 7:
            add, tag = rng.choice([([rng.choice(["token", "key", "secret"]), say()], [0, 0]), ([f"{say()}{num(2)}"], [0]), ([hexes(12)], [0]), (["call", num(2)], [0, 0])])
        else:
            add, tag = [], []
        at = rng.randint(0, len(words))
        words[at:at], tags[at:at] = add, tag
        out.append((words, tags))
    return out


#: Words, padding included, that are decoded at once.
CELLS = 1 << 16


class Field:
    """Weights by feature and label, and by pair of neighbouring labels."""

    def __init__(self, vocabulary: dict[str, int], unary: np.ndarray, pair: np.ndarray):
        self.vocabulary, self.unary, self.pair = vocabulary, unary, pair

    def scores(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(LABELS)))
        for k, w in enumerate(words):
            if any("0" <= c <= "9" for c in w):
                seen = [self.vocabulary[f] for f in features(words, k) if f in self.vocabulary]
                out[k] = self.unary[seen].sum(axis=0)
            else:
                out[k, 1:] = -1e9  # no digit: always O
        return out

    def decode(self, runs: list[list[str]]) -> list[np.ndarray]:
        """Best labels of each run of words: Viterbi over many runs at once, padded to the longest of them.

        Runs go by length, so that padding is little, and as many at once as ``CELLS`` words hold, or one run that is longer: memory is linear in that.
        """
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(runs)
        order = sorted((i for i in range(len(runs)) if runs[i]), key=lambda i: len(runs[i]))
        while order:
            most = len(runs[order[-1]])
            some = order[-max(1, CELLS // most) :]
            del order[-len(some) :]
            for i, path in zip(some, self._decode([runs[i] for i in some], most), strict=True):
                out[i] = path
        return out

    def _decode(self, runs: list[list[str]], most: int) -> list[np.ndarray]:
        n = len(runs)
        u = np.zeros((n, most, len(LABELS)))
        for i, words in enumerate(runs):
            u[i, : len(words)] = self.scores(words)
            u[i, len(words) :, 1:] = -1e9
        step = np.where(MAY_FOLLOW, self.pair, -1e9)
        best = u[:, 0] + np.where(np.array(LABELS) == "I-national", -1e9, 0.0)
        back = np.zeros((n, most, len(LABELS)), np.int8)
        for t in range(1, most):
            reach = best[:, :, None] + step
            back[:, t] = reach.argmax(axis=1)
            best = reach.max(axis=1) + u[:, t]
        path = np.zeros((n, most), np.int64)
        path[:, -1] = best.argmax(axis=1)
        for t in range(most - 1, 0, -1):
            path[:, t - 1] = back[np.arange(n), t, path[:, t]]
        return [path[i, : len(words)] for i, words in enumerate(runs)]


def train(rows: list[tuple[list[str], list[int]]], rounds: int = 150, rate: float = 0.1, decay: float = 1e-3) -> Field:
    """Maximum likelihood by forward-backward in padded batches and Adam; the rows are few, so this is the driver's."""
    vocabulary: dict[str, int] = {}
    for words, _ in rows:
        for k in range(len(words)):
            for f in features(words, k):
                vocabulary.setdefault(f, len(vocabulary))
    n, most, m = len(rows), max(len(w) for w, _ in rows), len(LABELS)
    seen = [[[vocabulary[f] for f in features(w, k)] for k in range(len(w))] for w, _ in rows]
    row = np.array([i * most + k for i, s in enumerate(seen) for k, f in enumerate(s) for _ in f])
    col = np.array([x for s in seen for f in s for x in f])
    real = np.zeros((n, most), bool)
    gold = np.zeros((n, most), np.int64)
    free = np.zeros((n, most), bool)
    for i, (w, tags) in enumerate(rows):
        real[i, : len(w)], gold[i, : len(w)] = True, tags
        free[i, : len(w)] = [any("0" <= c <= "9" for c in x) for x in w]
    want = np.eye(m)[gold]
    blocked = np.where(free[:, :, None], 0.0, np.array([0.0] + [-1e9] * (m - 1)))
    params = np.zeros((len(vocabulary) + m, m))
    first, second = np.zeros_like(params), np.zeros_like(params)
    log_sum = lambda x, axis: (top := x.max(axis=axis)) + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis=axis))
    for it in range(1, rounds + 1):
        unary, pair = params[:-m], params[-m:]
        u = np.zeros((n * most, m))
        np.add.at(u, row, unary[col])
        u = u.reshape(n, most, m) + blocked
        step = np.where(MAY_FOLLOW, pair, -1e9)
        alpha, beta = np.zeros((n, most, m)), np.zeros((n, most, m))
        alpha[:, 0] = u[:, 0] + np.where(np.array(LABELS) == "I-national", -1e9, 0.0)
        for t in range(1, most):
            go = log_sum(alpha[:, t - 1, :, None] + step, 1) + u[:, t]
            alpha[:, t] = np.where(real[:, t, None], go, alpha[:, t - 1])
        for t in range(most - 2, -1, -1):
            go = log_sum(step + (u[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(real[:, t + 1, None], go, 0.0)
        whole = log_sum(alpha[:, -1], 1)
        at = np.exp(alpha + beta - whole[:, None, None]) * real[:, :, None]
        grad = np.zeros_like(params)
        np.add.at(grad, col, (want.reshape(-1, m) - at.reshape(-1, m))[row])
        for t in range(1, most):
            both = np.exp(np.minimum(alpha[:, t - 1, :, None] + step + (u[:, t] + beta[:, t])[:, None, :] - whole[:, None, None], 0.0))
            gone = (want[:, t - 1, :, None] * want[:, t, None, :] - both) * real[:, t, None, None]
            grad[-m:] += gone.sum(axis=0)
        grad = grad / n - decay * params
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        params = params + rate * (first / (1 - 0.9**it)) / (np.sqrt(second / (1 - 0.999**it)) + 1e-8)
    return Field(vocabulary, params[:-m], params[-m:])


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train(labelled())


def runs_of(s: T.Slice, reach: int = 2) -> Iterator[tuple[int, list[str], list[tuple[int, int]]]]:
    """Runs of words around digits: (document, words, their places in code points). Words on other lines stay out."""
    digit = (s.buf >= 0x30) & (s.buf <= 0x39)
    if not digit.any():
        return
    starts, ends, first = T.word_spans(s)
    hot = np.flatnonzero(T.span_sums(digit, starts, ends))
    breaks = np.concatenate([[0], np.cumsum(s.buf == 10)])
    point = np.concatenate([[0], np.cumsum((s.buf & 0xC0) != 0x80)])
    doc = s.doc_of(starts[hot])
    line = breaks[starts[hot]]
    new = np.ones(len(hot), bool)
    new[1:] = (hot[1:] - hot[:-1] > 2 * reach) | (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])
    heads = np.flatnonzero(new)
    for a, b in zip(heads, np.append(heads[1:], len(hot)), strict=True):
        d = int(doc[a])
        lo, hi = max(int(first[d]), int(hot[a]) - reach), min(int(first[d + 1]), int(hot[b - 1]) + reach + 1)
        own = [k for k in range(lo, hi) if breaks[starts[k]] == line[a]]
        base = point[s.offs[d]]
        yield d, [s.buf[starts[k] : ends[k]].tobytes().decode() for k in own], [(int(point[starts[k]] - base), int(point[ends[k]] - base)) for k in own]


def added_spans(s: T.Slice, field: Field) -> list[list[tuple[int, int, int]]]:
    """Spans that the field finds in each document."""
    runs, owner = [], []
    for k, words, places in runs_of(s):
        runs.append((words, places))
        owner.append(k)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(s))]
    order = sorted(range(len(runs)), key=lambda i: len(runs[i][0]))  # runs of like length share a batch
    for lo in range(0, len(order), 512):
        group = order[lo : lo + 512]
        for i, labels in zip(group, field.decode([runs[i][0] for i in group]), strict=True):
            words, places = runs[i]
            k = 0
            while k < len(words):
                if labels[k] in (1, 3):
                    kind, j = (4, k) if labels[k] == 1 else (5, k)
                    while kind == 4 and j + 1 < len(words) and labels[j + 1] == 2:
                        j += 1
                    a, b = places[k][0], places[j][1]
                    raw = "".join(words[k : j + 1])
                    lead = len(words[k]) - len(words[k].lstrip("\"'=:,.;[]{}#$%&*!|"))
                    tail = len(words[j]) - len(words[j].rstrip("\"'=:,.;[]{}#$%&*!|"))
                    if a + lead < b - tail and (kind == 5 or 9 <= sum(c.isdigit() for c in raw) <= 11):
                        out[owner[i]].append((a + lead, kind, b - tail))
                    k = j
                k += 1
    return out


def all_spans(s: T.Slice, field: Field) -> Iterator[tuple[list, list]]:
    """Base spans and all spans of each document; an added span that touches a base one gives way.

    Every kind needs a digit or an @, so only documents with one are looked at as text.
    """
    busy = s.per_doc(((s.buf >= 0x30) & (s.buf <= 0x39)) | (s.buf == 0x40)) > 0
    added = added_spans(s, field)
    for k, more in enumerate(added):
        own = base_spans(s.text(k).decode("utf-8")) if busy[k] else []
        yield own, sorted(own + [x for x in more if all(x[2] <= a or b <= x[0] for a, _, b in own)])


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for each row of ``docs``.

    The four counts and base_sha256 are of the base spans; ``spans`` has all, joined as kind:start:end. A narrow map
    over the scan; the field's weights are a few kilobytes. Null and empty texts have no spans (and the digest of
    the empty string); a null doc_id stays null; repeated rows each give a row; other columns are ignored.
    """
    T.bound_batches(docs.sparkSession)
    field = field or default_field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in T.slices(batches):
            rows = []
            for base, every in all_spans(s, field):
                kinds = [k for _, k, _ in base]
                rows.append((*(kinds.count(k) for k in range(4)), hashlib.sha256(shown(base).encode()).hexdigest(), shown(every), len(every) - len(base)))
            c = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [s.ids, *(pa.array(x, pa.int64()) for x in c[:4]), pa.array(c[4]), pa.array(c[5]), pa.array(c[6], pa.int64())],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
            )

    return T.id_text(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span (overlapping ones joined) replaced by its first kind in capitals and brackets."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with personal data in ``text`` masked; the other columns stay as they are. Null texts stay null."""
    T.bound_batches(docs.sparkSession)
    field = field or default_field()
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = []
            for s in T.slices([pa.RecordBatch.from_arrays([pa.nulls(len(b), pa.int64()), b.column(at)], names=["doc_id", "text"])]):
                new += [masked(s.text(k).decode("utf-8"), every) if every else None for k, (_, every) in enumerate(all_spans(s, field))]
            cols = list(b.columns)
            changed = pa.array([x is not None for x in new])
            cols[at] = pc.if_else(changed, pa.array(new, cols[at].type), cols[at])
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)
