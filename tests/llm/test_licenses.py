"""Notices that share most words with another license's, and licenses beyond the short notices."""

import pyarrow as pa
import random

import pytest

pytest.importorskip("public_tokenizers")

from caldrift.llm import licenses  # noqa: E402
from caldrift.llm import textops as T  # noqa: E402

GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
CASES = {
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0-short",
    "Licensed under CC BY 4.0.": "CC-BY-4.0-short",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": "CC-BY-NC-SA-4.0",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "CC-BY-4.0",
    "Released under the GPL License": "",
    "Released under the MIT License.": "MIT",
    "Released under the ISC License.": "ISC",
    GPL.format("", 3): "GPL-3.0-header",
    GPL.format("", 2): "GPL-2.0-header",
    GPL.format("Lesser ", 2.1): "LGPL-2.1-header",
    GPL.format("Affero ", 3): "AGPL-3.0-header",
    "This work is licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "BSD-body",
    "nothing of the kind under the license of the sea": "",
}


def test_named_licenses():
    assert set(licenses.NAMED) == set(licenses.TEMPLATES)
    assert all(set(licenses.words_of(w)) <= set(licenses.words_of(licenses.TEMPLATES[k])) for k, w in licenses.NAMED.items())
    scanner = licenses.Scanner(licenses.TEMPLATES, named=licenses.NAMED, barred=licenses.BARRED)
    texts = ["some prose\n" + t + "\nmore prose" for t in [*CASES, *licenses.TEMPLATES.values()]]
    (s,) = T.slices([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])])
    found = [{scanner.names[t] for t, *_ in x} for x in scanner.scan(s)]
    assert [",".join(sorted(x)) for x in found[: len(CASES)]] == list(CASES.values())
    assert all(name in x for name, x in zip(licenses.TEMPLATES, found[len(CASES) :], strict=True))


def test_whole_texts(spark):
    """Long templates, with other words between and some words gone, wrapped in lines; and the alignment against the longest common run."""
    rng = random.Random(6)
    docs = []
    for k, name in enumerate(("MIT-text", "ISC-text", "BSD-2-Clause-text", "BSD-3-Clause-text")):
        words = licenses.TEMPLATES[name].split()
        for at in sorted(rng.sample(range(40, len(words)), 8), reverse=True):
            words[at : at + 1] = rng.choice([[], [words[at], "qqq", "zzz"]])
        docs.append((k, "some words before\n" + "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9)) + "\nand after", name))
    df = spark.createDataFrame(docs, "doc_id long, text string, want string")
    got = {r.doc_id: {n.license: n.coverage for n in r.notices} for r in licenses.scan(df).collect()}
    assert all(got[k].get(name, 0) > 0.9 for k, _, name in docs), got
    assert "BSD-2-Clause-text" not in got[3] and "BSD-3-Clause-text" not in got[2]
    for _ in range(300):
        a, b = (rng.choices(range(30), k=rng.randint(0, 14)) for _ in range(2))
        pairs = licenses.align(a, b)
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:])) and len(pairs) <= table[-1][-1]
        if len(set(a)) == len(a) and len(set(b)) == len(b):  # with no repeated word patience finds a longest one
            assert len(pairs) == table[-1][-1]
