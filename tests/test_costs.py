"""The cost job: shared steps made once, both tables published, days of rates by brute force; work along pieces."""

from __future__ import annotations

import datetime as dt
import random
import statistics
from collections import Counter, defaultdict

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from stallwise import registry, session
from stallwise.operators.pieces import as_of, in_pieces, numbered_by_range
from stallwise.plans import costs
from stallwise.plans.job import Run
from stallwise.session import scratch_database
from stallwise.sources.tables import Tables


class Counted(Tables):
    """Counts how often a plan asks for each table."""

    def __init__(self, spark, folder):
        super().__init__(spark, folder)
        self.asked = Counter()

    def __getattr__(self, name):
        df = super().__getattr__(name)
        self.asked[name] += 1
        return df


def test_both_tables_from_one_read_of_the_facts(spark):
    t = Counted(spark, SMALL)
    tables = costs.cost_tables(t, registry.RUN_AT, scratch_database(spark))
    assert (t.asked["lineitem"], t.asked["orders"]) == (1, 1)
    for df in tables.values():
        assert df.count() > 0
        assert df.select("updated_at").distinct().collect() == [(registry.RUN_AT,)]


def test_a_section_reads_no_fact_of_its_own(spark):
    t = Counted(spark, SMALL)
    run = Run(spark, registry.RUN_AT)
    costs.facts(t, run)
    for section in costs.SECTIONS.values():
        plan = section(t, run)._jdf.queryExecution().optimizedPlan().toString()
        assert "l_orderkey" not in plan and "o_orderdate" not in plan


def test_steps_are_dropped_on_request(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    assert not session.drop_steps(spark)
    assert session.checkpointed(spark.range(3)).count() == 3
    assert list(tmp_path.glob("steps-*/*"))
    assert session.drop_steps(spark) and not list(tmp_path.glob("steps-*"))


def test_a_second_run_replaces_the_first(spark, tables):
    database = scratch_database(spark)
    later = registry.RUN_AT + dt.timedelta(hours=5)
    costs.cost_tables(tables, registry.RUN_AT, database, ["discounts"])
    costs.cost_tables(tables, later, database, ["discounts"])
    found = spark.table(f"{database}.discounts_cost")
    assert found.select("updated_at").distinct().collect() == [(later,)]


def test_a_step_is_made_once(spark):
    run, made = Run(spark, registry.RUN_AT), []
    make = lambda: made.append(1) or spark.range(3)
    assert run.once("a", make).count() == run.once("a", make).count() == 3
    assert made == [1]


@pytest.mark.parametrize("name", ["order_kpi_weekly", "order_kpi_zones"])
def test_order_kpis_read_lines_and_orders_once(spark, name):
    t = Counted(spark, SMALL)
    plan = registry.PLANS[name](t)._jdf.queryExecution().optimizedPlan().toString()
    assert (t.asked["lineitem"], t.asked["orders"], t.asked["customer"]) == (1, 1, 1)
    assert "l_orderkey" not in plan and "c_nationkey" not in plan


SKEWED = "k int, i int, v int"


def skewed(spark, n: int = 6000, seed: int = 1):
    """A third of the rows under one key, a few without a key, many ties."""
    chance = random.Random(seed)
    rows = [(None if i % 17 == 0 else 0 if i % 3 else chance.randrange(50), i, chance.randrange(1000)) for i in range(n)]
    return rows, spark.createDataFrame(rows, SKEWED).repartition(5)


@pytest.mark.parametrize("pieces", [1, 7, 32])
def test_numbers_of_a_huge_key(spark, pieces):
    rows, df = skewed(spark)
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    expected = {r[1]: n for own in groups.values() for n, r in enumerate(sorted(own, key=lambda r: (-r[2], r[1])), 1)}
    found = numbered_by_range(df, ["k"], [F.col("v").desc(), F.col("i").asc()], "n", pieces)
    assert found.columns == ["k", "i", "v", "n"]
    assert {r["i"]: r["n"] for r in found.collect()} == expected


def test_no_piece_holds_twice_the_median(spark):
    _, df = skewed(spark, 20_000)
    sizes = [r["count"] for r in in_pieces(df, ["k"], [F.col("v").asc(), F.col("i").asc()], 16).groupBy("_piece").count().collect()]
    assert len(sizes) == 16 and max(sizes) <= 2 * statistics.median(sizes)


@pytest.mark.parametrize("pieces", [1, 9])
def test_last_known_values(spark, pieces):
    rows, df = skewed(spark, 1500)
    chance = random.Random(3)
    values = [(chance.randrange(4), chance.randrange(1000), chance.randrange(9), None) for _ in range(30)]
    values += [(None, 1, 2, None), (1, None, 3, None), (2, 500, 4, "x"), (2, 500, 4, "x")]

    def last(k, at):
        known = [(since, rate) for key, since, rate, _ in values if k is not None and key == k and since is not None and since <= at]
        return max(known)[::-1] if known else (None, None)

    rates = spark.createDataFrame(values, "k int, since int, v int, i string")
    found = as_of(df, rates, ["k"], "v", "since", {"v": "rate", "since": "rate_from"}, pieces)
    assert found.columns == [*df.columns, "rate", "rate_from"]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(str((*r, *last(r[0], r[2]))) for r in rows)


def test_nothing_known_and_nothing_asked(spark):
    none = spark.createDataFrame([], "k int, since int, rate int")
    _, df = skewed(spark, 50)
    assert as_of(df, none, ["k"], "v", "since", {"rate": "rate"}).filter("rate is not null").count() == 0
    assert as_of(df.limit(0), none, ["k"], "v", "since", {"rate": "rate"}).count() == 0
    assert numbered_by_range(df.limit(0), ["k"], [F.col("v")], "n").count() == 0
