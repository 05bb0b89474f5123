"""Each training-data operator against a brute-force version, an exact round trip or held-out accuracy; edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

public_tokenizers = pytest.importorskip("public_tokenizers")

from caldrift.llm import licenses, packing, pii, piece_codec, quality, simhash, suffix_dedup, token_counts, topk  # noqa: E402
from caldrift.llm import textops as T  # noqa: E402
from caldrift.llm.components import components  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, start string, fp string"


def frame(spark, rows):
    """Rows of (doc_id, text) with more columns, whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghé漢A", k=rng.randint(1, 9))) for _ in range(60)]
    base = [" ".join(rng.choices(words, k=rng.choice([5, 30, 90]))) for _ in range(8)]
    out = [(None, None), (None, "no id"), (7000, None), (7001, ""), (7002, " \n\t "), (7003, "word " * 40_000), (7004, "x" * 30_000)]
    for i in rng.sample(range(900), 60):
        text = rng.choice(base) if rng.random() < 0.5 else "\n".join(" ".join(rng.choices(words, k=rng.randint(0, 20))) for _ in range(rng.randint(1, 5)))
        out.append((i, text if rng.random() < 0.8 else text + " " + rng.choice(words)))
    return [*out, out[-1]]  # a repeated row


def slices(texts):
    return T.slices([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"])])


def test_token_counts(spark, rows):
    voc = set(token_counts.vocabulary(BPE)) | {bytes([b]) for b in range(256)}
    most = max(map(len, voc))

    def count(word):
        w, n, i = b" " + word.encode(), 0, 0
        while i < len(w):
            i += next(k for k in range(min(most, len(w) - i), 0, -1) if w[i : i + k] in voc)
            n += 1
        return n

    got = Counter((r.doc_id, r.n_words, r.n_tokens) for r in token_counts.token_counts(frame(spark, rows), BPE).collect())
    assert got == Counter((i, len(WORD.findall(t or "")), sum(map(count, WORD.findall(t or "")))) for i, t in rows)
    assert token_counts.token_counts(frame(spark, []), BPE).count() == 0


def test_codec_equals_full_viterbi_and_round_trips(spark, rows):
    own = piece_codec.codec(PIECES)

    def full(text):
        s = list(own._marked(" " + text)) if text else []
        best, back = [0.0] + [None] * len(s), [0] * (len(s) + 1)
        for i in range(len(s)):
            ends = [(i + 1, own.unknown)] * (s[i] not in own.score) + [(i + k, own.score[p]) for k in range(1, min(own.longest, len(s) - i) + 1) if (p := "".join(s[i : i + k])) in own.score]
            for e, v in ends:
                if best[e] is None or best[i] + v > best[e]:
                    best[e], back[e] = best[i] + v, i
        out, e = [], len(s)
        while e:
            p = "".join(s[back[e] : e])
            out = ([own.id[p]] if p in own.id else [own.byte_id[b] for b in (piece_codec.MARK if p == piece_codec.LITERAL[0] else p).encode()]) + out
            e = back[e]
        return out

    rng = random.Random(1)
    texts = ["".join(rng.choices(["a", "b", " ", "  ", "the", "ing", "\n", "é", "▁", "漢", "aaaa", "."], k=rng.randint(0, 50))) for _ in range(150)] + ["a" * 900 + "ab" * 200]
    for s in slices(texts):
        ids, first = own.encode_slice(s)
        for k, t in enumerate(texts):
            assert list(ids[first[k] : first[k + 1]]) == full(t) == own.encode(t)
            assert own.decode(own.encode(t)) == t
    assert all(r.same for r in piece_codec.round_trip(frame(spark, rows), PIECES).collect())
    back = piece_codec.decode(piece_codec.encode(frame(spark, rows), PIECES), PIECES)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((i, t or "") for i, t in rows)


def test_licenses(spark, rows):
    assert licenses.align(list("abcdxe"), list("abzcde")) == [(0, 0), (1, 1), (2, 3), (3, 4), (5, 5)]
    text = "some prose here.\nReleased under the MIT License.\nmore of it, Licensed under the Apache Licence, Version 2.0. the the the of"
    extra = [(5000, text), (5001, "under the sea the license of the"), (5002, "Released under the MIT License. " * 3)]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows + extra)).collect() if r.doc_id is not None}
    assert got[5000].licenses == "Apache-2.0,MIT" and got[5001].n_notices == 0 and got[5002].n_notices == 3 and got[7000].n_notices == 0
    first = got[5000].notices[0]
    assert (first.license, first.coverage, first.first_word, first.last_word) == ("MIT", 1.0, 3, 7)


def test_personal_data(spark, rows):
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def brute(t):
        out = []
        for k, p in enumerate(map(re.compile, patterns)):
            for m in p.finditer(t):
                d = re.sub("[^0-9]", "", m[0])
                if (k != 1 or all(int(x) <= 255 for x in m[0].split("."))) and (k != 2 or 12 <= len(d) <= 19 and pii.luhn(d)) and (k != 3 or 9 <= len(d) <= 15):
                    out.append((m.start(), k, m.end()))
        return sorted(out)

    rng = random.Random(3)
    for _ in range(8000):
        t = "".join(rng.choices(["a", "b.", "@", "@x.co", "1", "12", "255", "256", ".", ".1", "-", " ", "+", "+1", "(", "4111111111111111", "0", "é", "%"], k=rng.randint(0, 14)))
        assert brute(t) == pii.base_spans(t)
    zeros = "0" * 5000 + "1.2.3.4 and 0." + "0" * 6000 + ".255.0"
    assert [(k, b - a) for a, k, b in pii.base_spans(zeros) if k == 1] == [(1, 5007), (1, 6008)]
    field = pii.default_field()
    held_out = pii.labelled(400, seed=99)
    right = sum(list(d) == t for d, (_, t) in zip(field.decode([w for w, _ in held_out]), held_out, strict=True))
    assert right >= 0.97 * len(held_out)
    extra = [(6000, "é mail a.b@c.de or 10.0.0.1, card 4111 1111 1111 1111, +1 (743) 555-3824, token = \"" + "1f" * 20 + '" end'), (6001, "1" * 200_000)]
    got = {r.doc_id: r for r in pii.find(frame(spark, rows + extra)).collect() if r.doc_id is not None}
    base = pii.shown(brute(extra[0][1]))
    assert got[6000].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and got[6000].n_added == 1 and "secret:" in got[6000].spans
    assert got[7000].spans == "" and got[7000].base_sha256 == hashlib.sha256(b"").hexdigest()
    masked = {r.doc_id: r.text for r in pii.mask(frame(spark, rows + extra)).collect()}
    assert masked[6000].startswith("é mail [EMAIL] or [IP], card [CARD], [PHONE], token = \"[SECRET]\"") and masked[7000] is None


def test_quality(spark, rows):
    def brute(t):
        w, seen, dup, covered = WORD.findall(t), set(), 0, set()
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        for i in range(len(w) - 2):
            if c[tuple(w[i : i + 3])] >= 2:
                covered |= {i, i + 1, i + 2}
        return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), dup, len(covered)

    rng = random.Random(2)
    extra = [(3000 + k, "".join(rng.choices(["a", "b", "é ", " ", "\n", "a b c\n", "\t", "#", "x\x1cy"], k=rng.randint(0, 25)))) for k in range(300)]
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.rules(frame(spark, rows + extra)).collect())
    want = Counter((i, *(m := brute(t or "")), m[0] < 50 or 100 * m[4] > 50 * m[0]) for i, t in rows + extra)
    assert got == want
    prose = " ".join(rng.choice(["the", "of", "and", "to", "in", "is", "that", "a", "it", "for"]) if rng.random() < 0.4 else "".join(rng.choices("aeiourstlnmd", k=6)) + ("." if rng.random() < 0.1 else "") for _ in range(300))
    junk = " ".join("".join(rng.choices("abcde", k=4)) + "&&&###" for _ in range(200))
    assert {r.doc_id for r in quality.keep(frame(spark, [(1, prose), (2, junk), (3, None), (4, "short")])).collect()} == {1}


@pytest.mark.parametrize("seed", [1, 2])
def test_top_k(spark, seed):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(260, 6)) * 0.3
    v[100:130] = v[100]  # ties
    rows = [(i, [float(x) for x in r], 0) for i, r in enumerate(v)] + [(900, None, 0), (950, [1.0, None] * 3, 0), (951, [float("nan")] * 6, 0), (952, [float("inf")] * 6, 0), (1000, [0.0] * 6, 0), (1050, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = defaultdict(list)
    for r in topk.top_k(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    whole = {i: np.floor(256 * np.array(e, np.float32).astype(float)).astype(int) for i, e, _ in rows if e and None not in e and np.isfinite(e).all()}
    want = {q: sorted(((c, int(whole[q] @ w)) for c, w in whole.items() if c != q and len(w) == len(whole[q])), key=lambda x: (-x[1], x[0]))[:5] for q in whole if q % 50 == 0}
    assert dict(got) == {q: x for q, x in want.items() if x}


@pytest.mark.parametrize("size", [33.0, 3e5, 2e9, 1e200])
def test_top_k_of_large_components(spark, size):
    """Scores are exact beyond 32, 53 and 64 bits; what no long holds is shown as the nearest one."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(rng.normal(size=(120, 5)) * size)]
    rows += [(200, rows[3][1]), (200, rows[3][1]), (7, rows[4][1]), (None, rows[4][1])]  # repeated and null ids
    whole = [(i, [__import__("math").floor(256 * x) for x in e]) for i, e in rows if i is not None]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in topk.top_k(df, df.where("vec_id in (0, 50, 100)")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q in (0, 50, 100):
        own = next(e for i, e in whole if i == q)
        best = sorted(((i, sum(a * b for a, b in zip(own, e, strict=True))) for i, e in whole if i != q), key=lambda x: (-x[1], x[0]))[:5]
        assert got[q] == [(i, max(-topk.LONG, min(topk.LONG, x))) for i, x in best] or size > 1e6 and [x for _, x in got[q]] == [min(topk.LONG, x) for _, x in best]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def edits(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a):
        c = [i + 1]
        for j, y in enumerate(b):
            c.append(min(p[j] + (x != y), p[j + 1] + 1, c[j] + 1))
        p = c
    return p[-1]


class Union(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self[b] = a


def test_packing(spark, rows):
    fresh = Tokenizer.from_file(BPE)
    rng = random.Random(5)
    extra = [(2000 + k, "".join(rng.choices(["a", "é", " ", "  ", "\n", "\t", "12", "don't", "'ll", "!", "漢", " x", "...", "\r\n", "<|endoftext|>"], k=rng.randint(0, 30)))) for k in range(300)]
    got = packing.pack(frame(spark, rows[2:-1] + extra), BPE).collect()
    ids = {i: [*fresh.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows[2:-1] + extra}
    cover, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        cover[r.doc_id].append((r.start, r.length))
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts, total in [(cover[i], len(x)) for i, x in ids.items()] + [(s, sum(n for _, n in s)) for s in seqs.values()]:
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at == total
    assert max(sum(n for _, n in s) for s in seqs.values()) <= 1024
    sizes = [rng.randint(1, 512) for _ in range(300)]
    slots = packing.deal(sizes)
    assert sorted(k for s in slots for k in s) == list(range(300)) and len(slots) <= 1.03 * sum(sizes) / 1024 + 1


def test_simhash(spark, rows):
    def fingerprint(t):
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    whole = [(i, t) for i, t in rows if i is not None]
    fps = {i: fingerprint(t) for i, t in whole}
    groups = Union()
    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                groups.join(a, b)
    got = simhash.near_duplicates(frame(spark, whole)).collect()
    assert Counter((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got) == Counter((i, fps[i], groups.find(i)) for i, _ in whole)
    rng = random.Random(4)
    near = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(40):
            y = x
            for _ in range(rng.randint(0, 4)):
                y ^= 1 << rng.randint(0, 63)
            near.add(y)
    signed = [int(np.uint64(x).astype(np.int64)) for x in near]
    want = Union()
    for a in signed:
        for b in signed:
            if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                want.join(a, b)
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    assert {(r.node, r.root) for r in components(simhash.links(df)).collect()} == {(x, want.find(x)) for x in list(want)}


@pytest.mark.parametrize("contexts", [64, 2])
def test_suffix_dedup(spark, contexts):
    rng = random.Random(contexts)
    words = ["".join(rng.choices("abcdé\0", k=rng.randint(1, 6))) for _ in range(40)]
    parts = [" ".join(rng.choices(words, k=rng.randint(20, 80))) for _ in range(12)]

    def doc():
        pick = [lambda: " ".join(rng.choices(words, k=rng.randint(0, 50))), lambda: rng.choice(parts), lambda: rng.choice(parts)[rng.randint(0, 20) : -rng.randint(1, 30)], lambda: "ab" * rng.randint(0, 150)]
        return " ".join(rng.choice(pick)() for _ in range(rng.randint(0, 5)))

    docs = [(i, doc()) for i in rng.sample(range(1000), 120)] + [(2000, None), (2001, "")]
    # rows that share an id, or have none, are documents of their own, one after the other; which comes first shows in the texts' hashes
    docs += [docs[0], docs[1], docs[1], (None, "x" * 150), (None, "".join(rng.choices("abcdefgh", k=400))), (None, "y" * 130 + docs[2][1]), (2001, "y" * 120)]
    hashes = {r.t: r.h for r in spark.createDataFrame([(t,) for t in {t for _, t in docs}], "t string").selectExpr("t", "xxhash64(t) AS h").collect()}
    seen, want = set(), []
    for d, t in sorted(docs, key=lambda x: (x[0] is None, x[0] or 0, hashes[x[1]])):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want.append((d, len(b), sum(gone), sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    got = suffix_dedup.remove_repeats(frame(spark, docs), contexts=contexts).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter(want)
    single = suffix_dedup.remove_repeats(frame(spark, docs), contexts=contexts, crowd=1).collect()  # every open anchor's windows are dealt singly
    assert Counter((r.doc_id, r.n_removed) for r in single) == Counter((d, n) for d, _, n, _, _ in want)
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_longest_previous_factors():
    """Against every pair of places, over strings that end, with zero bytes and ties."""
    rng = np.random.default_rng(9)
    for most in (20, 100, 130):
        size = rng.integers(1, 200, 12)
        buf = rng.integers(0, 2, int(size.sum())).astype(np.uint8)
        buf[50:250] = buf[300:500]
        ends = np.cumsum(size)
        left = np.repeat(ends, size) - np.arange(len(buf))
        at = np.sort(rng.choice(len(buf), len(buf) // 2, replace=False))
        when = rng.permutation(len(at))

        def common(a, b):
            n = 0
            while n < min(left[a], left[b], most) and buf[a + n] == buf[b + n]:
                n += 1
            return n

        got = suffix_dedup.longest_previous_factors(buf, left, at, when, most)
        want = [max((common(a, b) for b, v in zip(at, when, strict=True) if v < w), default=0) for a, w in zip(at, when, strict=True)]
        assert got.tolist() == want


def test_long_runs_are_decoded_in_bounded_memory():
    """A line of a million numbers beside short runs: memory is that of the long run, and the labels are those of each run by itself."""
    import tracemalloc

    field = pii.default_field()
    short = [["call", "0171", "2345678", "now"], ["id", "12"], []]
    tracemalloc.start()
    got = field.decode([["12"] * 200_000, *short * 200])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got[0]) == 200_000 and peak < 200e6
    assert all((x == y).all() for x, y in zip(got[1:4], [field.decode([s])[0] for s in short], strict=True))
