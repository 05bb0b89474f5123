"""The audit against a plain recomputation order by order, with nulls, copies, repeated ids and labels, many parts and an empty table."""

import random
import re
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest

from caldrift.llm import filter_audit
from caldrift.llm.textops import Slice

SCHEMA = "doc_id long, text string, source string, mask int, digest string, label int, part int"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    return {
        "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
    }


def brute(rows, labels):
    firsts, of, parts = {}, {}, defaultdict(list)
    for i, text, _ in rows:
        if i is not None:
            firsts[text or ""] = min(i, firsts.get(text or "", i))
    for i, quality, toxic in labels:
        good, bad = of.get(i, (False, False))
        of[i] = (good or quality == 1, bad or toxic == 1)
    for i, text, source in rows:
        own = fails(text or "") | {"E": i is not None and i > firsts[text or ""]}
        parts[source or ""].append((own, *(of.get(i, (False, False)) if i is not None else (False, False))))
    out = []
    for part, docs in parts.items():
        steps, shapley = [], defaultdict(int)
        for order in permutations("ABCDE"):
            for k, c in enumerate(order):
                here = [d for d in docs if not any(d[0][b] for b in order[:k])]
                removed = [d for d in here if d[0][c]]
                shapley[c] += len(removed)
                redundant = sum(d[0][c] for d in docs) - len(removed)
                steps.append(((part, "".join(order), k + 1, len(here) - len(removed), len(removed), redundant, sum(d[0][c] and sum(d[0].values()) == 1 for d in docs), sum(d[1] for d in removed), sum(d[2] for d in removed)), c))
        out += [(*row, shapley[c]) for row, c in steps]
    return sorted(out)


def result(spark, rows, labels, partitions=3):
    docs = spark.createDataFrame([(*r, 9, "d", 3, 4) for r in rows], SCHEMA).repartition(partitions)
    of = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return sorted(tuple(r) for r in filter_audit.audit(docs, of).select(*COLUMNS).collect())


def test_against_brute_force(spark):
    rng = random.Random(1)
    words = ["The", "a", "b", "c", "#x", "Éa", "10%", "z z", *(f"w{k}" for k in range(60))]
    texts = [" ".join(rng.choice(words if rng.random() < 0.5 else words[8:]) for _ in range(rng.choice([0, 3, 49, 50, 51, 80]))) for _ in range(25)] + [None, "", "\t\n ", "A" * 40000, "word " * 60000, " ".join(f"u{k}" for k in range(50))]
    rows = [(rng.choice([*range(90), None]), rng.choice(texts), rng.choice(["hot", "hot", "hot", "b", None, ""])) for _ in range(300)]
    rows += rows[:20]
    labels = [(rng.choice([*range(120), None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(120)]
    assert result(spark, rows, labels) == brute(rows, labels)


def test_more_parts_than_are_held(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "PARTS_AT_ONCE", 2)
    rows = [(k, f"text {k % 5}", f"part {k % 7}") for k in range(40)]
    batches = [filter_audit.pa.RecordBatch.from_pydict({"part": [f"{k % 7}" for k in range(40)], "mask": [k % 32 for k in range(40)], "label": [k % 4 for k in range(40)]})] * 2
    sums = defaultdict(int)
    for batch in filter_audit._partials(batches):
        for r in batch.to_pylist():
            sums[r["part"]] += r["kept"] + r["removed"] if r["step"] == 1 else 0
    assert sums == {f"{p}": 120 * 2 * sum(k % 7 == p for k in range(40)) for p in range(7)}
    assert result(spark, rows, [(1, 1, 1)]) == brute(rows, [(1, 1, 1)])


def test_table_of_first_failures():
    table = filter_audit.first_failures()
    assert table.shape == (32, 120) and (table[0] == 5).all() and (table[31] == 0).all()
    assert table[0b00101, filter_audit.ORDERS.index("BCAED")] == 1


@pytest.mark.parametrize("text", ["", "é" * 7 + "ABC", "x #"])
def test_masks_of_one_text(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    own = fails(text)
    assert filter_audit.text_masks(Slice(None, raw, np.array([0, len(raw)]))).tolist() == [sum(own[c] << k for k, c in enumerate("ABCD"))]


def test_empty(spark):
    assert result(spark, [], []) == []
