"""Tables that change in one step, under failing writes, readers in between, and many refreshes."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from stallwise.sources import sinks
from stallwise.session import scratch_database

DAY = dt.date(2024, 1, 1)


def on(k: int) -> dt.date:
    return DAY + dt.timedelta(days=k)


def days(spark, rows: list[tuple[int, int | None]]):
    return spark.createDataFrame([(n, None if k is None else on(k)) for n, k in rows], "n bigint, day date")


def content(spark, table: str) -> list[tuple]:
    return sorted(((r["n"], r["day"] and (r["day"] - DAY).days) for r in spark.table(table).collect()), key=str)


@pytest.fixture(scope="module")
def database(spark):
    return scratch_database(spark)


@pytest.fixture
def daily(spark, database, request):
    table = f"{database}.{request.node.name.split('[')[0]}"
    sinks.create_daily_table(spark, table, "n BIGINT", "day")
    assert content(spark, table) == [] and spark.table(table).columns == ["n", "day"]
    sinks.load_days(days(spark, [(1, 0), (2, 1), (3, 2), (9, None)]), table, "day")
    return table


def broken(df):
    """Fails when one of the later rows is computed."""
    fails = F.when(F.col("n") > 20, F.raise_error(F.lit("no more rows"))).otherwise(F.col("n"))
    return df.withColumn("n", fails.cast("bigint"))


def test_a_failed_refresh_changes_nothing(spark, daily):
    before = content(spark, daily)
    with pytest.raises(Exception, match="no more rows"):
        sinks.refresh_days(broken(days(spark, [(20, 1), (30, 2)])), daily, "day", on(1), on(2))
    assert content(spark, daily) == before
    sinks.refresh_days(days(spark, [(20, 1), (30, 2)]), daily, "day", on(1), on(2))
    assert content(spark, daily) == [(1, 0), (20, 1), (30, 2), (9, None)]


def test_a_failed_replacement_changes_nothing(spark, database):
    table = f"{database}.replaced"
    sinks.replace_table(days(spark, [(1, 0), (2, 1)]), table, ["day"])
    with pytest.raises(Exception, match="no more rows"):
        sinks.replace_table(broken(days(spark, [(5, 0), (50, 1)])), table)
    assert content(spark, table) == [(1, 0), (2, 1)]
    assert sinks.replace_table(days(spark, []), table).count() == 0


def test_readers_see_old_or_new_rows_and_nothing_else(spark, daily, monkeypatch):
    begun = spark.table(daily).select("n")
    seen = []
    plain = sinks._point

    def watched(*args, **kwargs):
        seen.append(content(spark, daily))  # everything is written, nothing has changed
        plain(*args, **kwargs)
        seen.append(content(spark, daily))

    monkeypatch.setattr(sinks, "_point", watched)
    sinks.refresh_days(days(spark, [(20, 1)]), daily, "day", on(1), on(2))
    assert seen == [[(1, 0), (2, 1), (3, 2), (9, None)], [(1, 0), (20, 1), (9, None)]]
    assert sorted(r["n"] for r in begun.collect()) == [1, 2, 3, 9]  # one that began before has its files


def test_many_refreshes(spark, daily, monkeypatch):
    monkeypatch.setattr(sinks, "MOST_FOLDERS", 4)
    expected = {0: 1, 1: 2, 2: 3}
    for k in range(1, 9):
        window = range(k - 1, k + 2)
        rows = [(100 * k + d, d) for d in window if d != k]  # the middle day disappears
        sinks.refresh_days(days(spark, rows), daily, "day", on(k - 1), on(k + 1))
        expected = {d: n for d, n in expected.items() if d not in window} | {d: n for n, d in rows}
        assert content(spark, daily) == sorted([*((n, d) for d, n in expected.items()), (9, None)], key=str)
        assert len(json.loads(sinks._property(spark, daily, sinks.LAYOUT))) <= 4


def test_emptied_and_filled_again(spark, daily):
    sinks.refresh_days(days(spark, []), daily, "day", on(-1000), on(1000))
    assert content(spark, daily) == [(9, None)]
    sinks.load_days(days(spark, []), daily, "day")
    assert content(spark, daily) == []
    for _ in range(2):
        sinks.refresh_days(days(spark, [(4, 4)]), daily, "day", on(4), on(4))
        assert content(spark, daily) == [(4, 4)]


def test_old_folders_are_deleted_on_request_only(spark, daily):
    sinks.refresh_days(days(spark, [(20, 1)]), daily, "day", on(0), on(2))
    sinks.load_days(days(spark, [(7, 1), (8, 5)]), daily, "day")
    assert sinks.forget_versions(spark, daily) == 2
    assert content(spark, daily) == [(7, 1), (8, 5)]
    assert sinks.forget_versions(spark, daily) == 0


def test_a_day_is_read_from_its_own_folder(spark, daily):
    sinks.refresh_days(days(spark, [(20, 1)]), daily, "day", on(1), on(1))
    plan = spark.table(daily).filter(F.col("day") == on(1))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan
    assert [tuple(r) for r in spark.table(daily).filter(F.col("day") == on(1)).select("n").collect()] == [(20,)]
