"""Column functions on hand-made edge rows."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from stallwise.functions import dates, flags, geo, numeric, promo
from stallwise.plans.couriers import hours_class
from stallwise.plans.customers import early_tenure, tenure
from stallwise.plans.orders import delivery_fee, listing_fee
from stallwise.plans.promotions import prorated


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def date(text):
    return F.lit(text).cast("date")


def test_boolean_tests_on_null(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "f boolean")
    f = F.col("f")
    assert values(df, flags.is_true(f), flags.is_false(f), flags.not_false(f), ~f) == [
        (True, False, True, False),
        (False, True, False, True),
        (False, False, True, None),
    ]


def test_extremes_are_null_when_an_input_is(spark):
    df = spark.createDataFrame([(1, 2), (None, 2), (1, None), (None, None)], "a int, b int")
    got = values(df, numeric.strict_greatest(F.col("a"), F.col("b")), numeric.strict_least(F.col("a"), F.col("b")))
    assert got == [(2, 1), (None, None), (None, None), (None, None)]


def test_ratio_with_zero_and_null(spark):
    df = spark.createDataFrame([(1, 2), (1, 0), (None, 2), (1, None), (0, 0)], "a int, b int")
    assert values(df, numeric.safe_ratio(F.col("a"), F.col("b"))) == [(0.5,), (None,), (None,), (None,), (None,)]


def test_exact_sum_of_large_and_negative_amounts(spark):
    near = 2**62
    df = spark.createDataFrame([(near,), (near,), (near,), (-5,), (None,)], "x bigint")
    assert df.agg(numeric.exact_sum(F.col("x")).alias("s")).first()["s"] == 3 * near - 5
    negative = spark.createDataFrame([(-near,), (-near,), (-near,), (7,)], "x bigint")
    assert negative.agg(numeric.exact_sum(F.col("x")).alias("s")).first()["s"] == -3 * near + 7
    assert df.filter("x is null").agg(numeric.exact_sum(F.col("x")).alias("s")).first()["s"] is None


def test_money_and_mean(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (None,), (-1.05,)], "x double")
    got = df.agg(numeric.total(numeric.money("x")).alias("t"), numeric.mean(numeric.money("x")).alias("m")).first()
    assert got["t"] == -0.75 and got["m"] == -0.25
    assert df.filter("x > 5").agg(numeric.mean(numeric.money("x")).alias("m")).first()["m"] is None


def test_round_half_away_from_zero_to_a_column_scale(spark):
    rows = [("1.2345", 0), ("1.2345", 2), ("1.2345", 3), ("-1.2350", 2), ("2.5000", 0), ("-2.5000", 0)]
    df = spark.createDataFrame(rows, "x string, n int").withColumn("x", F.col("x").cast("decimal(10,4)"))
    wide = df.sparkSession.createDataFrame([(1.2345678, 5), (1255.5, -2), (1.5, None), (None, 3)], "x double, n int")
    assert [r[0] for r in values(wide, numeric.round_to_scale(F.col("x"), F.col("n")))] == [1.23457, 1300.0, None, None]
    got = [r[0] for r in values(df, numeric.round_to_scale(F.col("x"), F.col("n")))]
    assert got == [1.0, 1.23, 1.235, -1.24, 3.0, -3.0]


@pytest.mark.parametrize(
    ("day", "week", "iso", "weekday"),
    [
        ("2021-01-03", "2021-01-03", "2020-53", "Sunday"),
        ("2021-01-02", "2020-12-27", "2020-53", "Saturday"),
        ("2018-12-31", "2018-12-30", "2019-01", "Monday"),
        ("2024-02-29", "2024-02-25", "2024-09", "Thursday"),
    ],
)
def test_weeks(spark, day, week, iso, weekday):
    d = date(day)
    assert str(one(spark, dates.sunday_week(d))) == week
    assert one(spark, dates.iso_week_label(d)) == iso
    assert one(spark, dates.weekday_label(d)) == weekday


def test_month_end_is_clamped_on_the_driver_as_in_spark(spark):
    for day, months in [(dt.date(2023, 5, 31), 3), (dt.date(2024, 2, 29), 12), (dt.date(2024, 1, 31), 2), (dt.date(2023, 3, 15), 27), (dt.date(2023, 12, 31), 1)]:
        assert dates.minus_months(day, months) == one(spark, F.add_months(F.lit(day), -months))


def test_day_series_is_empty_when_reversed_and_single_when_equal(spark):
    length = lambda a, b: one(spark, F.size(dates.day_series(date(a), date(b))))
    assert length("2024-01-02", "2024-01-01") == 0
    assert length("2024-01-01", "2024-01-01") == 1
    assert length("2024-02-28", "2024-03-01") == 3
    assert one(spark, dates.day_series(F.lit(None).cast("date"), date("2024-01-01"))) is None


def test_local_day_follows_the_zone_of_the_row(spark):
    df = spark.createDataFrame([("Asia/Phnom_Penh",), ("America/New_York",)], "zone string")
    moment = F.lit("2024-01-31 20:00:00").cast("timestamp_ntz")
    assert values(df, dates.local_day(moment, F.col("zone"))) == [(dt.date(2024, 2, 1),), (dt.date(2024, 1, 31),)]


AS_OF = dt.date(2024, 3, 11)  # ten days of March are seen


@pytest.mark.parametrize(
    ("start", "end", "first", "factor"),
    [
        ("2024-02-01", "2024-12-31", "2024-03-02", 31 / 10),  # runs through the month
        ("2024-03-06", "2024-03-20", "2024-03-07", 15 / 5),  # lies inside the month
        ("2024-03-01", "2024-03-10", "2024-03-02", 10 / 10),  # ends on the last day seen
        ("2024-02-01", "2024-03-09", "2024-03-02", 1.0),  # over
        ("2024-03-12", "2024-03-30", "2024-03-02", 1.0),  # not begun
        ("2024-02-01", "2024-12-31", "2024-02-27", 1.0),  # first order in an earlier month
    ],
)
def test_campaign_factor(spark, start, end, first, factor):
    assert one(spark, promo.campaign_factor(AS_OF, date(start), date(end), date(first))) == factor


def test_campaign_factor_without_dates_is_one(spark):
    none = F.lit(None).cast("date")
    assert one(spark, promo.campaign_factor(AS_OF, none, date("2024-12-31"), date("2024-03-02"))) == 1.0


def test_open_factor(spark):
    assert one(spark, promo.open_factor(AS_OF, date("2024-03-02"))) == 31 / 10
    assert one(spark, promo.open_factor(AS_OF, date("2024-02-02"))) == 1.0
    assert one(spark, promo.open_factor(dt.date(2024, 3, 1), date("2024-02-02"))) == 29 / 29


def test_redemption_projection(spark):
    value = lambda start, stop, on, as_of=AS_OF: one(
        spark, promo.redemption_projection(as_of, F.lit(100), date(start), date(stop), date(on))
    )
    assert value("2024-01-01", "2024-12-31", "2024-03-05") == 100 + 100 / 10 * 21
    assert value("2024-03-06", "2024-03-15", "2024-03-07") == 100 + 100 / 5 * 5
    assert value("2024-01-01", "2024-12-31", "2024-02-28") == 0
    assert value("2024-01-01", "2024-12-31", "2024-03-01", dt.date(2024, 3, 1)) is None
    assert value(None, None, "2024-03-05") == 0


def test_distance(spark):
    metre = lambda *p: one(spark, geo.distance_m(*[F.lit(float(c)) for c in p]))
    assert metre(0, 0, 0, 0) == 0
    assert math.isclose(metre(0, 0, 1, 0), geo.METRES_PER_DEGREE, rel_tol=1e-9)
    assert math.isclose(metre(0, 60, 1, 60), geo.METRES_PER_DEGREE / 2, rel_tol=1e-4)
    assert math.isclose(metre(0, 0, 180, 0), math.pi * geo.EARTH_RADIUS_M, rel_tol=1e-9)


def test_polygon_with_edges_and_a_notch(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    notched = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]

    def inside(x, y, corners):
        ring = F.array(*[F.struct(F.lit(a).alias("lon"), F.lit(b).alias("lat")) for a, b in corners])
        return one(spark, geo.in_polygon(F.lit(x), F.lit(y), ring))

    assert inside(1.0, 1.0, square) and not inside(3.0, 1.0, square)
    # A point on an edge shared by two squares belongs to exactly one of them.
    neighbour = [(x + 2, y) for x, y in square]
    above = [(x, y + 2) for x, y in square]
    assert inside(2.0, 1.0, square) + inside(2.0, 1.0, neighbour) == 1
    assert inside(1.0, 2.0, square) + inside(1.0, 2.0, above) == 1
    assert inside(1.0, 1.0, notched) and not inside(2.0, 2.0, notched)


def test_classes_and_fees(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (10.1,), (None,)], "h double")
    assert [r[0] for r in values(df, hours_class(F.col("h")))] == ["0-10", "0-10", "10-20", "over 40"]
    since = date("2024-01-01")
    labels = [one(spark, tenure(date(d), since)) for d in ["2024-01-30", "2024-01-31", "2024-03-01", "2024-03-31"]]
    assert labels == ["0-30 days", "31-60 days", "61-90 days", "90+ days"]
    assert [one(spark, early_tenure(date(d), since)) for d in ["2024-01-07", "2024-01-08", "2024-01-16"]] == ["0-7 days", "0-15 days", None]
    month = date("2024-02-01")
    fee = lambda value, closed: one(spark, listing_fee(F.lit(value), month, date(closed)))
    assert [fee(3.0, "2024-01-15"), fee(3.01, "2024-01-15"), fee(9.0, "2024-02-15")] == [0, 3, 0]
    device = lambda by, km: one(spark, delivery_fee(F.lit(by), F.lit(km), F.lit(4.2), F.lit(700)))
    assert [device(True, 2.1), device(True, 25.0), device(True, 26.0), device(False, 2.1)] == [8900, 35300, 11300, 700]


def test_prorating_keeps_the_whole_cost(spark):
    rows = [
        (1, dt.date(2024, 1, 30), dt.date(2024, 3, 2), 1000),
        (2, dt.date(2024, 2, 29), dt.date(2024, 2, 29), 70_000),
        (3, dt.date(2024, 2, 10), dt.date(2024, 2, 9), 500),
    ]
    df = spark.createDataFrame(rows, "id int, a date, b date, cost bigint")
    shares = prorated(df, "a", "b", F.col("cost"), ["id"]).collect()
    assert {(r["id"], str(r["month"]), r["days"]) for r in shares} == {
        (1, "2024-01-01", 2), (1, "2024-02-01", 29), (1, "2024-03-01", 2), (2, "2024-02-01", 1),
    }
    assert math.isclose(sum(float(r["month_cost"]) for r in shares if r["id"] == 1), 1000, abs_tol=1e-4)
