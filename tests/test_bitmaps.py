"""Sets of ids against direct counts, for day, week and month from one stored table."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from stallwise.operators.bitmaps import id_sets, sizes, united


@pytest.mark.parametrize("seed", [1, 2])
def test_sets_add_up(spark, seed):
    chance = random.Random(seed)
    ids = [chance.choice([chance.randrange(50), chance.randrange(200_000), -chance.randrange(40_000), 2**40 + chance.randrange(9), None]) for _ in range(3000)]
    rows = [(chance.choice([None, *range(20)]), i, chance.random() < 0.3) for i in ids]
    df = spark.createDataFrame(rows, "day int, id bigint, good boolean").repartition(4)
    names = ["all_ids", "good_ids", "none"]
    sets = id_sets(df, ["day"], "id", {"all_ids": F.lit(True), "good_ids": F.col("good"), "none": F.lit(False)}).cache()

    def direct(group) -> dict:
        found = defaultdict(lambda: (set(), set()))
        for day, i, good in rows:
            if i is not None:
                found[group(day)][0].add(i)
                if good:
                    found[group(day)][1].add(i)
        return {k: (len(a), len(b), 0) for k, (a, b) in found.items()}

    days = {r["day"]: tuple(r)[1:] for r in sizes(sets, ["day"], names).collect()}
    assert days == direct(lambda d: d)
    weeks = united(sets, [F.floor(F.col("day") / 7).alias("week")], names)
    assert {r["week"]: tuple(r)[1:] for r in sizes(weeks, ["week"], names).collect()} == direct(lambda d: d if d is None else d // 7)
    whole = sizes(united(weeks, [], names), [], names).first()
    assert tuple(whole) == direct(lambda d: 0)[0]


def test_no_ids(spark):
    df = spark.createDataFrame([(1, None)], "day int, id bigint")
    assert id_sets(df, ["day"], "id", {"n": F.lit(True)}).count() == 0
