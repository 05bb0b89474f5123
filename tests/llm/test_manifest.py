"""The manifest against a plain recomputation, with ties, nulls, repeated rows, runs over task borders and an empty table."""

import hashlib
import random
import zlib

import pytest

from caldrift.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp int, hash string, number int, path string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    doc_id, text, lang, source, n_chars = row
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, at):
    out = []
    for nodes in levels[:-1]:
        a = at // 16 * 16
        out.append(("".join(nodes[a:at]), "".join(nodes[at + 1 : a + 16])))
        at //= 16
    return out


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in groups[s]])
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for g, s in enumerate(order):
        for k, r in enumerate(groups[s]):
            path = siblings(trees[s], k) + siblings(top, g)
            folded = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                folded = leaf((r[0], r[1].translate({c: c + 32 for c in range(65, 91)}), *r[2:]))
            for left, right in path:
                folded = sha(left + folded + right)
            root = top[-1][0]
            out.append((r[0], leaf(r), trees[s][-1][0], root, sha("".join(a + b for a, b in path)), folded, folded == root))
    return sorted(out, key=str)


def result(spark, rows, partitions=3):
    df = spark.createDataFrame([(*r, 1, "h", 2, "p") for r in rows], SCHEMA).repartition(partitions)
    got = manifest.manifest(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    return sorted((tuple(r) for r in got), key=str)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 300])
def test_one_source(spark, n):
    rows = [(i, f"Text {i}", "en", "web", i) for i in range(n)]
    assert result(spark, rows) == brute(rows)


def test_many_sources_with_odd_rows(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(900), rng.choice([None, "", "É A b\n", "Plain Text", "x" * 20000]), rng.choice([None, "en", ""]), rng.choice(["hot"] * 30 + [None, "", "ü", "z", *map(str, range(20))]), rng.choice([None, 5])) for _ in range(1500)]
    rows += [(None, "A", "en", "hot", 1), (None, "B", "en", "hot", 1), *[(7, "Same", "en", "hot", 4)] * 40]
    got = result(spark, rows, 7)
    assert got == brute(rows)
    assert {r[-1] for r in got} == {True, False}


def test_empty(spark):
    assert manifest.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_stack_leaves_edges_and_carries():
    out = []
    stack = manifest.Range("g", out)
    for k in range(5, 16 * 16 * 2 + 3):
        stack.push(0, k, f"{k}")
    stack.close()
    edges = {(level, number) for _, level, number, _, _, edge in out if edge}
    assert {e for e in edges if e[0] == 0} == {(0, k) for k in range(5, 16)} | {(0, 512), (0, 513), (0, 514)}
    assert {e for e in edges if e[0] == 1} == {(1, k) for k in range(1, 16)} and {e for e in edges if e[0] > 1} == {(2, 1)}
    assert sum(is_node for *_, is_node, _ in out) == 31 + 1
