"""Benchmark items without an id."""

import pytest

from quillgauge.llm import decontaminate


@pytest.mark.parametrize("block_bytes", [8 << 20, 1])
def test_items_without_id_hit_but_have_no_name(spark, block_bytes):
    docs = spark.createDataFrame([(1, "red fox and blue bird"), (2, "a blue bird"), (3, "a tree")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "blue bird"), (5, "red fox"), (6, "blue bird and"), (None, "red fox")], "item_id long, text string")
    got = decontaminate.scan(docs, items, block_bytes=block_bytes)
    assert sorted((r["doc_id"], r["n_hit"], r["items"]) for r in got.collect()) == [(1, 4, ["5"]), (2, 2, []), (3, 0, [])]
    assert [r["doc_id"] for r in decontaminate.clean(docs, items).collect()] == [3]
