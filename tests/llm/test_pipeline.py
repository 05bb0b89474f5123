"""Stages of the pipeline on the smallest tables, and their queries."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from caldrift.llm import queries  # noqa: E402
from caldrift.llm import quality  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k == 0:
            assert out.count() == quality.rules(docs).where("kept").count() < n
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            docs = out
    assert out.selectExpr("max(offset + length) AS m").first().m <= 1024
    assert out.select("doc_id").distinct().count() == docs.count()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def distance(p, q):
    m = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in {*p, *q}}
    part = lambda x: sum(v * math.log2(v / m[k]) for k, v in x.items() if v > 0)
    return math.sqrt(max(0, (part(p) + part(q)) / 2))


def keeps(text):
    """The quality rules in plain Python."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {i + k for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for k in range(3)}
    if len(words) < 50 or 100 * len(inside) > 50 * len(words):
        return False
    kind = lambda c: 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 if c in " \t\n\v\f\r" else 4 if c in ".,;:!?'\"()-" else 6 if ord(c) > 127 else 5
    kinds = Counter(map(kind, text))
    if len(text) < quality.LEAST_CHARS or kinds[6] > quality.OWN_SCRIPTS * max(1, kinds[0] + kinds[1] + kinds[6]):
        return True
    share = lambda c: {k: v / sum(c.values()) for k, v in c.items()}
    far = min(distance(share(kinds), share(Counter(dict(enumerate(ref))))) for ref in quality.CLASSES.values())
    listed = {w for ws in quality.WORDS.values() for w in ws}
    common = share(Counter(w if (w := x.strip(".,;:!?'\"()-").lower()) in listed else None for x in words))
    near = min(distance(common, {w: n / 1000 for w, n in ws.items()} | {None: 1 - sum(ws.values()) / 1000}) for ws in quality.WORDS.values())
    return far <= quality.MOST_CLASS and not (len(words) >= quality.LEAST_WORDS and far > quality.BOTH[0] and near > quality.BOTH[1])


def groups(items, linked):
    root = {k: k for k in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(items), 2):
        if linked(a, b):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: find(k) for k in items}


def like(a, b):
    a, b = a.lower().split(), b.lower().split()
    room = int(0.2 * max(len(a), len(b)) + 1e-9)
    p = list(range(len(b) + 1))
    for i, x in enumerate(a):
        c = [i + 1]
        for j, y in enumerate(b):
            c.append(min(p[j] + (x != y), p[j + 1] + 1, c[j] + 1))
        p = c
    return p[-1] <= room


def test_run_equals_brute_force(spark, tmp_path):
    """All five stages over planted junk, repeated and near lines, near documents and personal data; null and repeated rows among them."""
    rng = random.Random(19)
    word = lambda: "".join(rng.choices("aeiostnrldhumcp", k=rng.randint(6, 10)))
    prose = lambda n: " ".join(rng.choice(["the", "of", "and", "to", "in", "is", "that", "a"]) if rng.random() < 0.35 else word() for _ in range(n))
    footer, docs = prose(24), []
    for k in range(30):
        docs.append((10 * k, "\n".join(prose(26) for _ in range(4))))
    for k in range(6):
        changed = footer.split()
        changed[3 * k] = word()
        docs[k] = (docs[k][0], docs[k][1] + "\n" + " ".join(changed))
        copy = docs[10 + k][1].split(" ")
        copy[7] = word()
        docs.append((10 * (10 + k) + 5, " ".join(copy)))  # a near copy: its lines go, and it is nearly empty after that
    docs += [(1, "too short"), (2, None), (3, " ".join(word() + "&&&" for _ in range(120))), (4, "one two three " * 60), (None, prose(90)), (7, docs[20][1]), (7, docs[20][1])]
    docs += [(400, prose(70) + " mail me.too@some.site or 10.20.30.40, +49 (30) 1234567 " + prose(5)), (401, "\n".join(" ".join("словом" + chr(1072 + rng.randrange(32)) for _ in range(15)) for _ in range(5)))]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    left = [(i, t) for i, t in docs if t is not None and keeps(t)]
    assert {i for i, _ in docs} - {i for i, _ in left} == {1, 2, 3, 4}
    places = {(i, k): x for i, t in left if i is not None for k, x in enumerate(t.split("\n")) if x.strip()}
    first = groups(places, lambda a, b: like(places[a], places[b]))
    left = [(i, t if i is None else "\n".join(x for k, x in enumerate(t.split("\n")) if first.get((i, k), (i, k)) == (i, k))) for i, t in left]
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := t.lower().split()) else frozenset() for i, t in left if i is not None}
    stays = groups(sets, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    left = [(i, t) for i, t in left if i is None or stays[i] == i]
    for pattern, name in ((r"me\.too@some\.site", "[EMAIL]"), (r"10\.20\.30\.40", "[IP]"), (r"\+49 \(30\) 1234567", "[PHONE]")):
        left = [(i, re.sub(pattern, name, t)) for i, t in left]
    assert any("[PHONE]" in t for _, t in left)
    own = Tokenizer.from_file(queries.vocabulary_path("byte_bpe_50k.json"))
    want = Counter((i, len(ids := [*own.encode(t, add_special_tokens=False).ids, 0]), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t in left)
    rows = defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        rows[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
    assert Counter(k for k, v in rows.items() for _ in range(sum(x[0] == 0 for x in v))) == Counter((i, n) for i, n, _ in want.elements())
    whole = {(i, n): c for i, n, c in want}
    assert all(v[0][2] == whole[k] for k, v in rows.items() if len(v) == 1)
