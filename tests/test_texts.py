"""Texts of groups that no task could hold as a list."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from stallwise.operators.texts import joined_text


def grouped(n: int, seed: int = 2) -> list[tuple]:
    """A third of the rows in one group, some without a group, some without a value, repeats and ties."""
    chance = random.Random(seed)
    return [
        (0 if i % 3 == 0 else None if i % 31 == 0 else chance.randrange(1, 40), chance.randrange(n // 4 + 1), chance.choice([None, "", "a", "bb", f"v{i}"]))
        for i in range(n)
    ]


@pytest.mark.parametrize("pieces", [1, 8])
@pytest.mark.parametrize("descending", [False, True])
def test_texts(spark, pieces, descending):
    rows = grouped(3000)
    expected = defaultdict(list)
    for k, o, v in sorted(rows, key=lambda r: (-r[1] if descending else r[1], r[2] or "")):
        expected[k] += [] if v is None else [v]
    expected[99] = []
    df = spark.createDataFrame([*rows, (99, 1, None)], "k int, o int, v string").repartition(5)
    order = F.col("o").desc() if descending else F.col("o").asc()
    found = joined_text(df, ["k"], F.col("v"), [order], "text", "; ", pieces=pieces)
    assert found.columns == ["k", "text"]
    assert {r["k"]: r["text"] for r in found.collect()} == {k: "; ".join(v) if v else None for k, v in expected.items()}


def test_a_huge_group_is_gathered_in_pieces(spark):
    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("o"))
    found = joined_text(df, ["k"], F.col("o"), [F.col("o").asc()], "text", pieces=16)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 2 and "_piece" in plan  # values by piece, then one part per piece
    assert found.filter("k = 0").first()["text"] == ",".join(str(i) for i in range(0, 60_000, 3))


def test_a_text_that_is_too_long(spark):
    df = spark.createDataFrame([(1, 1, "abc"), (1, 2, "def"), (2, 1, "x")], "k int, o int, v string")
    assert joined_text(df, ["k"], F.col("v"), [F.col("o")], "t", longest=7).count() == 2
    with pytest.raises(ValueError, match="more than 6 characters"):
        joined_text(df, ["k"], F.col("v"), [F.col("o")], "t", longest=6)


def test_no_rows(spark):
    df = spark.createDataFrame([], "k int, o int, v string")
    assert joined_text(df, ["k"], F.col("v"), [F.col("o")], "t").collect() == []
