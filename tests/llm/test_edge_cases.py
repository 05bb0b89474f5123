"""Every operator and stage over an empty table, and over rows with nulls, repeats, blank and very long texts and clashing columns."""

from collections import Counter

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from caldrift.llm import licenses, line_dedup, packing, pii, piece_codec, quality, shingle_dedup, simhash, suffix_dedup, token_counts  # noqa: E402

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
OPERATORS = {
    "token_counts": lambda d: token_counts.token_counts(d, BPE), "remove_repeats": suffix_dedup.remove_repeats, "round_trip": lambda d: piece_codec.round_trip(d, PIECES), "scan": licenses.scan, "find": pii.find, "mask": pii.mask,
    "rules": quality.rules, "line_report": line_dedup.line_report, "remove_lines": line_dedup.remove, "near_duplicates": simhash.near_duplicates, "shingles": shingle_dedup.near_duplicates,
}
ROWS = [(None, None), (None, "x y z"), (5, ""), (5, "one two three\n" * 3), (5, "one two three\n" * 3), (6, " \t\n"), (7, "word " * 3000), (8, "q" * 6000), (9, None)]
SCHEMA = "doc_id int, text string, row string, key int, fp double, start array<int>, words string, n_chars int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "r", 1, 0.5, [1], "w", 0) for i, t in rows], SCHEMA)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_a_row_for_each_row(spark, name):
    assert OPERATORS[name](frame(spark, [])).count() == 0
    got = OPERATORS[name](frame(spark, ROWS)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in ROWS if i is not None or name != "shingles")


def test_packing_covers_each_row(spark):
    assert packing.pack(frame(spark, []), BPE).count() == 0
    got = packing.pack(frame(spark, ROWS), BPE).collect()
    assert Counter(r.doc_id for r in got if r.start == 0) == Counter(i for i, _ in ROWS)
    for i in {i for i, _ in ROWS}:
        own = [r for r in got if r.doc_id == i]
        assert sum(r.length for r in own) == sum(r.doc_tokens for r in own if r.start == 0)
    assert [r.doc_tokens for r in got if r.doc_id in (9,)] == [1]


def test_near_duplicates_of_repeated_rows(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [(4, text), (4, text), (None, text), (2, text), (3, None), (8, " ")]
    for operator in (simhash.near_duplicates, shingle_dedup.near_duplicates):
        got = Counter((r.doc_id, r.component_id) for r in operator(frame(spark, rows)).where("doc_id is not null").collect())
        assert got == Counter([(4, 2), (4, 2), (2, 2), (3, 3), (8, 3)])


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_of_nothing(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, frame(spark, []), "")
    assert out.count() == 0 and (k == 4 or out.columns == frame(spark, []).columns)
    got = Counter(r.doc_id for r in stage(spark, frame(spark, ROWS), "").collect())
    every = Counter(i for i, _ in ROWS)
    # the rules keep no such text; lines and masks keep documents; 5's texts are two documents, of which the blank one is a copy of its like
    want = [Counter(), every, Counter({None: 2, 5: 3, 7: 1, 8: 1}), every]
    assert k == 4 or got == want[k]
