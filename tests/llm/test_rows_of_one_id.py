"""Rows that share an id keep verdicts of their own, however the benchmark is cut."""

from __future__ import annotations

import pytest

from stallwise.llm import decontamination

DOCS = "doc_id bigint, text string"


@pytest.mark.parametrize("block", [3, 10**6])
def test_contamination_judges_rows_of_one_id_by_their_own_text(spark, block):
    clean = " ".join(f"w{k}" for k in range(100))
    rows = [(None, "one two"), (None, clean), (7, "two x"), (7, clean + " one"), (7, clean + " one"), (7, None)]
    items = spark.createDataFrame([(1, "one"), (2, "two")], "item_id bigint, text string")
    found = decontamination.contamination(spark.createDataFrame(rows, DOCS), items, ["doc_id"], block_bytes=block)
    got = sorted(
        (r["doc_id"] or 0, r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontamination.judged(found).collect()
    )
    assert got == [
        (0, 2, 2, ["1", "2"], True),
        (0, 100, 0, [], False),
        (7, 0, 0, [], False),
        (7, 2, 1, ["2"], True),
        (7, 101, 1, ["1"], False),
        (7, 101, 1, ["1"], False),
    ]
