"""Operators on hand-made rows and against brute force."""

from __future__ import annotations

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from stallwise.functions.geo import distance_m, in_polygon
from stallwise.operators import aggregates, joins, ranking, spatial, unnest
from stallwise.plans.sessions import clamped
from stallwise.sources.scans import between_scalars, local_window, since_month_start
from stallwise.sources.sinks import create_daily_table, refresh_days, replace_table


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


ARRAYS = [(1, [1, 2]), (2, []), (3, None), (4, [9])]


def arrays(spark):
    return spark.createDataFrame(ARRAYS, "id int, a array<int>")


def test_unnest_keeps_or_loses_parents(spark):
    df = arrays(spark)
    ids = lambda out: sorted(r["id"] for r in out.collect())
    assert ids(unnest.unnest(df, "a", "x")) == [1, 1, 4]
    assert ids(unnest.unnest_outer(df, "a", "x")) == [1, 1, 2, 3, 4]
    kept = unnest.unnest_outer_where(df, "a", lambda x: x < 5, "x").select("id", "x")
    assert rows(kept) == sorted([(1, 1), (1, 2), (2, None), (3, None), (4, None)], key=repr)


def test_unnest_product(spark):
    df = spark.createDataFrame([(1, [1, 2], ["a", "b"]), (2, [], ["a"])], "id int, a array<int>, b array<string>")
    out = unnest.unnest_product(df, "a", "x", "b", "y").select("id", "x", "y")
    assert rows(out) == [(1, 1, "a"), (1, 1, "b"), (1, 2, "a"), (1, 2, "b")]


def test_left_join_conditions_do_not_lose_rows(spark):
    left = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    right = spark.createDataFrame([(1, 5), (1, 50), (2, 50)], "k int, v int")
    assert rows(joins.left_join_where(left, right, "k", F.col("v") < 10)) == [(1, 5), (2, None), (3, None)]


def test_semi_and_anti_split_the_rows(spark):
    left = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(1,), (1,), (7,), (None,)], "k int")
    kept, lost = joins.having(left, right, "k"), joins.without(left, right, "k")
    assert rows(kept) == [(1,), (1,)]
    assert rows(lost) == sorted([(2,), (None,)], key=repr)
    assert kept.count() + lost.count() == left.count()


def test_null_safe_join(spark):
    left = spark.createDataFrame([(1, None), (None, None), (2, "a")], "k int, m string")
    right = spark.createDataFrame([(1, None, "x"), (None, None, "y")], "k int, m string, v string")
    out = joins.spread_join(left, right, ["k", "m"], null_keys=True)
    assert out.columns == ["k", "m", "v"]
    assert rows(out) == sorted([(1, None, "x"), (None, None, "y"), (2, "a", None)], key=repr)


def test_spread_join_equals_a_plain_join(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, v string")
    right = spark.createDataFrame([(1, 10), (3, 30), (None, 40)], "k int, w int")
    for how in ("left", "inner", "left_semi", "left_anti"):
        assert rows(joins.spread_join(left, right, "k", how)) == rows(left.join(right, "k", how))


def test_band_join_equals_brute_force(spark):
    rng = random.Random(3)
    start = dt.date(2023, 11, 20)
    day = lambda: start + dt.timedelta(days=rng.randrange(200))
    spans = [(i, rng.randrange(3), a := day(), a + dt.timedelta(days=rng.randrange(-2, 70))) for i in range(60)]
    facts = [(j, rng.randrange(4), day()) for j in range(300)]
    intervals = spark.createDataFrame(spans, "i int, k int, a date, b date")
    events = spark.createDataFrame(facts, "j int, k int, d date")
    expected = {(i, j) for i, k, a, b in spans for j, key, d in facts if key == k and a <= d <= b}
    for band in (1, 7, 32, 1000):
        out = joins.band_join(intervals, events, ["k"], F.col("a"), F.col("b"), F.col("d"), band, how="inner")
        pairs = [(r["i"], r["j"]) for r in out.collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == expected


def test_band_join_keeps_intervals_without_events(spark):
    intervals = spark.createDataFrame([(1, 1, dt.date(2024, 1, 1), dt.date(2024, 1, 2)), (2, 1, dt.date(2024, 1, 2), dt.date(2024, 1, 1))], "i int, k int, a date, b date")
    events = spark.createDataFrame([(1, dt.date(2024, 5, 1))], "k int, d date")
    out = joins.band_join(intervals, events, ["k"], F.col("a"), F.col("b"), F.col("d"), 7)
    assert sorted((r["i"], r["d"]) for r in out.collect()) == [(1, None), (2, None)]


def test_left_band_join_over_several_bands(spark):
    spans = [(1, 1, dt.date(2024, 1, 1), dt.date(2024, 6, 30)), (2, 1, dt.date(2024, 7, 1), dt.date(2024, 12, 31)), (3, None, dt.date(2024, 1, 1), dt.date(2024, 2, 1))]
    spans.append(spans[1])
    intervals = spark.createDataFrame(spans, "i int, k int, a date, b date")
    events = spark.createDataFrame([(7, 1, dt.date(2024, 3, 1)), (8, None, dt.date(2024, 1, 5))], "j int, k int, d date")
    for band in (1, 32, 1000):
        out = joins.band_join(intervals, events, ["k"], F.col("a"), F.col("b"), F.col("d"), band)
        assert out.columns == ["i", "k", "a", "b", "j", "d"]
        assert sorted(((r["i"], r["j"]) for r in out.collect()), key=str) == [(1, 7), (2, None), (2, None), (3, None)]


def test_group_totals(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5), (None, 7), (None, 1)], "k string, v int")
    safe = aggregates.with_group_totals(df, ["k"], total=F.sum("v"))
    assert rows(safe) == sorted([("a", 1, 3), ("a", 2, 3), ("b", 5, 5), (None, 7, 8), (None, 1, 8)], key=repr)
    plain = aggregates.with_group_totals(df.filter("k is not null"), ["k"], total=F.sum("v"))
    assert rows(plain) == [("a", 1, 3), ("a", 2, 3), ("b", 5, 5)]


def test_flags_per_id_and_repeated_keys(spark):
    df = spark.createDataFrame([("g", 1, True), ("g", 1, None), ("g", 2, None), ("h", 1, False)], "g string, id int, f boolean")
    assert rows(aggregates.per_id_flags(df, ["g"], "id", {"any": F.col("f")})) == [("g", 1, True), ("g", 2, False), ("h", 1, False)]
    assert rows(aggregates.repeated_keys(df, ["g", "id"])) == [("g", 1, 2)]


def test_conditional_distinct_count(spark):
    df = spark.createDataFrame([("g", 1, True), ("g", 1, True), ("g", 2, False), ("g", None, True), ("h", 3, None)], "g string, v int, f boolean")
    assert rows(df.groupBy("g").agg(aggregates.count_distinct_where(F.col("f"), "v").alias("n"))) == [("g", 1), ("h", 0)]


def test_ordered_text(spark):
    df = spark.createDataFrame([(1, "b"), (1, "ccc"), (1, "a"), (1, "b"), (1, None), (2, None)], "k int, v string")
    text = aggregates.ordered_text(F.col("v"), [-F.length("v"), F.col("v")])
    assert rows(df.groupBy("k").agg(text.alias("t"))) == [(1, "ccc,a,b,b"), (2, None)]
    once = aggregates.ordered_text(F.col("v"), [-F.length("v"), F.col("v")], distinct=True)
    assert rows(df.groupBy("k").agg(once.alias("t"))) == [(1, "ccc,a,b"), (2, None)]


def test_first_and_top_break_ties(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (1, 6, "c"), (2, 1, "z")], "k int, v int, id string")
    order = [F.col("v"), F.col("id")]
    assert rows(ranking.first_per_key(df, ["k"], order)) == [(1, 5, "a"), (2, 1, "z")]
    assert rows(ranking.top_per_key(df, ["k"], order, 2, rank="place")) == [(1, 5, "a", 1), (1, 5, "b", 2), (2, 1, "z", 1)]


def test_running_sums_share_the_value_of_a_step(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 1, 5), ("a", 2, 1), ("b", 1, 7)], "k string, d int, v int")
    out = ranking.with_running(df, ["k"], "d", so_far=F.sum("v"))
    assert sorted((r["k"], r["d"], r["v"], r["so_far"]) for r in out.collect()) == [("a", 1, 5, 15), ("a", 1, 10, 15), ("a", 2, 1, 16), ("b", 1, 7, 7)]


def test_numbering_in_chunks_equals_a_plain_row_number(spark):
    rng = random.Random(5)
    data = [(rng.choice(["hot", "hot", "hot", "cold", None]), rng.randrange(100), i) for i in range(500)]
    df = spark.createDataFrame(data, "k string, d int, id int")
    for descending in (False, True):
        first = F.col("d").desc() if descending else F.col("d")
        out = ranking.numbered(df, ["k"], [first, F.col("id")], F.floor(F.col("d") / 10), "n", descending, null_keys=True)
        expected = {}
        for key in {k for k, _, _ in data}:
            group = sorted((r for r in data if r[0] == key), key=lambda r: (-r[1] if descending else r[1], r[2]))
            expected.update({r[2]: i + 1 for i, r in enumerate(group)})
        assert {r["id"]: r["n"] for r in out.collect()} == expected


def test_pairing_by_rank(spark):
    left = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "k int, n int, l string")
    right = spark.createDataFrame([(1, 1, "x"), (2, 1, "y")], "k int, n int, r string")
    assert rows(ranking.pair_by_rank(left, right, ["k"], "n")) == [(1, 1, "a", "x"), (1, 2, "b", None)]


def test_zone_join_equals_brute_force(spark):
    rng = random.Random(7)
    pts = [(i, rng.uniform(-1, 1), rng.uniform(-1, 1)) for i in range(500)]
    points = spark.createDataFrame(pts, "id int, lon double, lat double")
    rings = []
    for z in range(6):
        x, y, r = rng.uniform(-1, 1), rng.uniform(-1, 1), rng.uniform(0.1, 0.7)
        rings.append((f"z{z}", [(x - r, y - r), (x + r, y - r / 2), (x + r / 3, y), (x, y + r)]))
    zones = spark.createDataFrame(rings, "zone string, ring array<struct<lon:double,lat:double>>")
    exact = points.crossJoin(zones).filter(in_polygon(F.col("lon"), F.col("lat"), F.col("ring"))).select("id", "zone")
    for cuts in (0, 3, 6):
        got = spatial.points_in_zones(points, zones, "zone", "lon", "lat", "ring", cuts).select("id", "zone")
        assert rows(got) == rows(exact)
        outside = spatial.points_outside_zones(points, zones, "id", "zone", "lon", "lat", "ring")
        assert {r["id"] for r in outside.collect()} == {p[0] for p in pts} - {r["id"] for r in exact.collect()}


def star_shape(chance: random.Random, x: float, y: float, wide: float, high: float, n: int, least: float = 0.3) -> list[tuple[float, float]]:
    angles = sorted(chance.uniform(0, 2 * math.pi) for _ in range(n))
    return [(x + wide * f * math.cos(a), y + high * f * math.sin(a)) for a in angles for f in [chance.uniform(least, 1)]]


def test_a_country_and_a_street(spark):
    chance = random.Random(11)
    street = [(10.0, 20.0), (10.9, 20.7), (10.9001, 20.7001), (10.0001, 20.0001)]
    house = star_shape(chance, 10.5, 20.5, 0.0005, 0.0003, 9)
    rings = [("country", star_shape(chance, 10, 20, 9, 7, 40, 0.8)), ("street", street), ("house", house), ("line", [(10.0, 20.0), (11.0, 20.0)])]
    rings += [("grid", [(8.0, 16.0), (12.0, 16.0), (12.0, 24.0), (8.0, 24.0)])]  # sides along borders of cells
    zones = spark.createDataFrame([(z, r, 1) for z, r in rings], "zone string, ring array<struct<lon:double,lat:double>>, other int")
    pts = [(chance.uniform(0, 20), chance.uniform(12, 28)) for _ in range(400)] + [(8.0, 16.0), (12.0, 20.0), (8.0, 20.0), (10.0, 20.0)]
    for _ in range(150):  # near the street and the house
        s = chance.random()
        pts.append((10 + 0.9 * s + chance.uniform(-2e-4, 2e-4), 20 + 0.7 * s + chance.uniform(-2e-4, 2e-4)))
        pts.append((10.5 + chance.uniform(-6e-4, 6e-4), 20.5 + chance.uniform(-6e-4, 6e-4)))
    points = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pts)], "id int, lon double, lat double")
    exact = points.crossJoin(zones).filter(in_polygon(F.col("lon"), F.col("lat"), F.col("ring"))).select("id", "zone")
    found = spatial.points_in_zones(points, zones, "zone", "lon", "lat", "ring")
    assert sorted(found.columns) == ["id", "lat", "lon", "other", "zone"]
    assert rows(found.select("id", "zone")) == rows(exact)
    per_zone = {z for _, z in rows(exact)}
    assert {"country", "street", "house", "grid"} <= per_zone
    cells = {r["zone"]: r["n"] for r in spatial.cover(zones, "zone", "ring").groupBy("zone").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert max(cells.values()) <= 2 * spatial.MOST_CELLS
    few = {r["zone"]: r["n"] for r in spatial.cover(zones, "zone", "ring", 8, 64).groupBy("zone").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert max(few.values()) <= 4 * 64
    # Most points of the country need no test.
    inside = spatial.cover(zones.filter("zone = 'country'"), "zone", "ring").withColumn("area", F.pow(F.lit(0.25), F.col("level")))
    share = inside.groupBy().agg(F.sum(F.when(F.col("inside"), F.col("area"))) / F.sum("area")).first()[0]
    assert share > 0.6


def test_no_zones_and_no_points(spark):
    zones = spark.createDataFrame([("a", [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)])], "zone string, ring array<struct<lon:double,lat:double>>")
    points = spark.createDataFrame([(1, 0.1, 0.1), (2, None, 0.1), (3, 5.0, 5.0)], "id int, lon double, lat double")
    assert rows(spatial.points_in_zones(points, zones.limit(0), "zone", "lon", "lat", "ring")) == []
    assert rows(spatial.points_in_zones(points.limit(0), zones, "zone", "lon", "lat", "ring")) == []
    assert rows(spatial.points_in_zones(points, zones, "zone", "lon", "lat", "ring").select("id", "zone")) == [(1, "a")]
    assert {r["id"] for r in spatial.points_outside_zones(points, zones, "id", "zone", "lon", "lat", "ring").collect()} == {2, 3}


def test_distance_join_equals_brute_force(spark):
    rng = random.Random(9)
    for latitude in (0.0, 55.0):
        place = lambda n: [(i, rng.uniform(-0.3, 0.3), latitude + rng.uniform(-0.3, 0.3)) for i in range(n)]
        points = spark.createDataFrame(place(500), "p int, lon double, lat double")
        centres = spark.createDataFrame(place(40), "c int, x double, y double")
        exact = points.crossJoin(centres).filter(
            distance_m(F.col("lon"), F.col("lat"), F.col("x"), F.col("y")) <= 9000
        ).select("p", "c")
        got = spatial.within_distance(points, centres, ("lon", "lat"), ("x", "y"), 9000.0, "m").select("p", "c")
        assert rows(got) == rows(exact) and exact.count() > 100


def test_clamp_is_monotone_after_enough_passes(spark):
    steps = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(1, 5, 9, 3), (4, None, 2, 3), (0, 0, 0, 1)], "a int, b int, c int, d int")
    once = rows(clamped(df, steps))
    assert once == sorted([(1, 1, 5, 3), (4, None, 2, 2), (0, 0, 0, 0)], key=repr)
    thrice = clamped(clamped(clamped(df, steps), steps), steps).filter("b is not null").collect()
    assert all(r["a"] >= r["b"] >= r["c"] >= r["d"] for r in thrice)


def test_local_window_reads_across_the_utc_border(spark):
    moments = ["2024-01-09 18:00:00", "2024-01-10 16:59:00", "2024-01-10 17:00:00", "2024-01-11 23:00:00"]
    df = spark.createDataFrame([(m,) for m in moments], "m string").select(F.col("m").cast("timestamp_ntz").alias("ts"))
    local = F.to_date(F.col("ts") + F.expr("INTERVAL 7 HOURS"))
    day = dt.date(2024, 1, 10)
    out = local_window(df, "ts", local, day, day)
    assert [str(r["ts"]) for r in out.orderBy("ts").collect()] == moments[:2]


def test_lookback_starts_at_the_month(spark):
    df = spark.createDataFrame([("2024-01-31",), ("2024-02-01",), ("2024-05-31",), ("2024-06-01",)], "d string").select(
        F.col("d").cast("timestamp_ntz").alias("ts")
    )
    out = since_month_start(df, "ts", dt.date(2024, 5, 31), 3)
    assert [str(r["ts"])[:10] for r in out.orderBy("ts").collect()] == ["2024-02-01", "2024-05-31"]


def test_scalar_bounds(spark):
    bound = lambda x: spark.range(1).select(F.lit(x).cast("bigint").alias("b"))
    assert [r["id"] for r in between_scalars(spark.range(9), "id", bound(3), bound(5)).collect()] == [3, 4, 5]


def daily(spark, data):
    return spark.createDataFrame([(n, dt.date(2024, 1, d)) for n, d in data], "n bigint, day date")


def test_refresh_replaces_the_window_only_and_is_idempotent(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS refresh_test")
    table = "refresh_test.daily"
    create_daily_table(spark, table, "n BIGINT", "day")
    content = lambda: sorted((r["n"], r["day"].day) for r in spark.table(table).collect())
    refresh_days(daily(spark, [(1, 1), (2, 2), (3, 3), (4, 4)]), table, "day", dt.date(2024, 1, 1), dt.date(2024, 1, 4))
    assert content() == [(1, 1), (2, 2), (3, 3), (4, 4)]
    # Day 3 has no rows any more, day 4 has others, day 1 is outside the window.
    for _ in range(2):
        refresh_days(daily(spark, [(9, 1), (20, 2), (40, 4), (50, 5)]), table, "day", dt.date(2024, 1, 2), dt.date(2024, 1, 5))
        assert content() == [(1, 1), (20, 2), (40, 4), (50, 5)]


def test_replace_table(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS refresh_test")
    replace_table(spark.range(5), "refresh_test.whole")
    again = replace_table(spark.range(2), "refresh_test.whole")
    assert again.count() == 2
