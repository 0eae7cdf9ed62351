"""Operators on documents: odd rows, empty tables, clashing columns."""

import pytest

from factloom.llm import cube_mixing, quality_qda, quality_rules, secret_scan, sentencepiece_scan, simhash_dedup, toxicity

NO_LABELS = [(1, None, None), (None, 1, 1), (99, 1, 0)]
RUNS = {
    "op1": lambda d, x: quality_rules.judge(d, x), "op2": lambda d, x: toxicity.score(d, x), "op3": lambda d, x: secret_scan.find(d),
    "op4": lambda d, x: simhash_dedup.near_duplicates(d), "op6": lambda d, x: sentencepiece_scan.encode(d), "op7": lambda d, x: quality_qda.classify(d, x),
    "op8": lambda d, x: cube_mixing.choose(d),
}
STAGES = {"op2": lambda d, x: toxicity.without_toxic(d, x), "op3": lambda d, x: secret_scan.without_secrets(d), "op4": lambda d, x: simhash_dedup.one_of_each(d), "op8": lambda d, x: cube_mixing.mix(d)}


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows_and_clashing_columns(name, documents, labels, clashing):
    plain = sorted(map(str, RUNS[name](documents(), labels(NO_LABELS)).collect()))
    assert len(plain) == 10
    assert sorted(map(str, RUNS[name](clashing(documents()).repartition(3), clashing(labels(NO_LABELS))).collect())) == plain


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(name, documents, labels):
    assert RUNS[name](documents([]), labels([])).collect() == []


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns(name, documents, labels, clashing):
    d = clashing(documents())
    out = STAGES[name](d, labels(NO_LABELS))
    assert out.columns == d.columns and out.count() > 0
    assert STAGES[name](documents([]), labels([])).collect() == []
