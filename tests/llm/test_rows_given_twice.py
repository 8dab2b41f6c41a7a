"""Rows with the same id and text are one document."""

from __future__ import annotations

import random

import pytest

from stallwise.llm import suffix

DOCS = "doc_id bigint, text string"


@pytest.mark.parametrize("other", [False, True])
def test_bytes_of_a_row_given_twice_stay(spark, other):
    chance = random.Random(3)
    words = [f"w{chance.randrange(10**6)}" for _ in range(80)]
    text = " ".join(words)
    rows = [(1, text), (1, text)]
    if other:
        rows.append((2, "other " + " ".join(words[:40]) + " words"))
    got = suffix.duplicate_bytes(spark.createDataFrame(rows, DOCS)).filter("doc_id = 1").collect()
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got] == [(len(text), 0, 0)] * 2


def test_a_later_copy_of_a_row_given_twice_goes(spark):
    chance = random.Random(4)
    text = " ".join(f"w{chance.randrange(10**6)}" for _ in range(80))
    rows = [(1, text), (1, text), (2, text), (3, text + text)]
    got = sorted((r["doc_id"], r["n_removed"]) for r in suffix.duplicate_bytes(spark.createDataFrame(rows, DOCS)).collect())
    assert got[:3] == [(1, 0), (1, 0), (2, len(text))] and got[3][1] == 2 * len(text)
