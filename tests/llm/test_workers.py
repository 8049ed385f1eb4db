"""Memory of Python workers: a task takes one of them, and none keeps what only another operator needs."""

import pytest

from lettermill.llm.bpe import tokenizer
from lettermill.llm.common import released
from lettermill.llm.decontaminate import BLOCK_BYTES, find_contamination
from lettermill.llm.queries import VOCAB


@pytest.mark.parametrize("block", [BLOCK_BYTES, 1])
def test_decontamination_takes_one_worker_for_a_task(spark, monkeypatch, block):
    monkeypatch.setattr("lettermill.llm.decontaminate.BLOCK_BYTES", block)
    docs = spark.createDataFrame([(1, "x a b c y"), (2, "d e"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([("i", "a b c"), ("j", "d e")], "item_id string, text string")
    found = find_contamination(docs, items)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {r.doc_id: (r.n_words, r.n_hit, r.items, r.contaminated, [tuple(s) for s in r.spans]) for r in found.collect()}
    assert got == {1: (5, 3, ["i"], True, [(1, 4)]), 2: (2, 2, ["j"], True, [(0, 2)]), 3: (0, 0, [], False, [])}


def test_tokenizers_go_when_another_operator_works():
    tokenizer(VOCAB)
    list(released(iter, keeps="bpe")([]))
    assert tokenizer.cache_info().currsize == 1
    list(released(iter)([]))
    assert tokenizer.cache_info().currsize == 0
