"""Cost tables of promotions: what vouchers and discounts cost, and what the month will.

Lines with a high discount are redemptions of their brand's voucher, lines with a
lower one are discounts of their seller.  Both tables start from the same facts:
lines are read once, summed per order, brand and seller, and joined with the order,
its customer and the exchange rate of its day.  Which budget pays, and with what
share, is told by a sheet of rules.
"""

from __future__ import annotations

import datetime as dt
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallwise.functions.dates import day, first_of_month, minus_months, month_start, within_days
from stallwise.functions.numeric import amount, exact_sum, money, safe_ratio, strict_greatest, strict_least, total
from stallwise.functions.promo import campaign_factor, open_factor
from stallwise.operators.aggregates import count_where, sum_where
from stallwise.operators.joins import spread_join
from stallwise.operators.pieces import as_of
from stallwise.operators.rules import Tested, first_match
from stallwise.plans.job import Run
from stallwise.plans.orders import PERCENT_TICKS
from stallwise.plans.promotions import brand_number, promotions
from stallwise.session import scratch_database
from stallwise.sources.mappings import packaged_sheet
from stallwise.sources.tables import Tables, discount_amount, gross, is_promo_line, is_valid, tax_amount

TESTED = Tested(equal=("channel", "purpose", "refunded", "home"), text="product", items="types", day="order_day")
RATE_UNIT = 10_000
CAMPAIGN_KEYS = ["p_brand", "city", "home"]


def budget_rules(t: Tables) -> DataFrame:
    return packaged_sheet(t.spark, "budget_rules", TESTED.schema())


# --- exchange rates --------------------------------------------------------------


def published_rates(placed: DataFrame) -> DataFrame:
    """Rates per city, on the days they were published: a rule stands in for the published numbers.

    A city's rate is published on days with an urgent order of one of its
    customers, so there are gaps of days and weeks.
    """
    days = placed.filter(F.col("channel") == "1-URGENT").select("nation", F.col("order_day").alias("rate_day")).distinct()
    rate = 9000 + F.col("nation") * 350 + F.dayofyear("rate_day") * 7 % 400
    return days.withColumn("rate", rate.cast("long"))


def converted(ticks: Column, rate: Column) -> Column:
    """Ticks in the common currency, rounded to whole ticks half up, so that sums stay exact."""
    twice = ticks * (2 * RATE_UNIT) + rate
    return F.when(rate.isNotNull() & ticks.isNotNull(), F.call_function("div", twice, rate * 2))


def sales_at_daily_rate(t: Tables) -> DataFrame:
    """Value per city and day at the rate last published, with the day it is from."""
    orders = t.orders.select(
        "o_custkey", day("o_orderdate").alias("order_day"), F.col("o_orderpriority").alias("channel"), money("o_totalprice").alias("value")
    )
    homes = t.customer.select("c_custkey", F.col("c_nationkey").alias("nation"))
    placed = orders.join(homes, F.col("o_custkey") == F.col("c_custkey"))
    # Summed per day before the rate is looked up, which is the same for all of it.
    daily = placed.groupBy("nation", "order_day").agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("orders"))
    rated = as_of(daily, published_rates(placed), ["nation"], "order_day", "rate_day", {"rate": "rate", "rate_day": "rate_day"})
    return rated.select(
        "nation", "order_day", "orders", amount(F.col("value")).alias("value"), "rate_day", "rate",
        amount(converted(F.col("value"), F.col("rate"))).alias("value_common"),
    )


# --- facts -----------------------------------------------------------------------


def order_facts(t: Tables, run: Run) -> DataFrame:
    """Orders since the first of January two years before the run, with place, segment and the rate of the day.

    ``is_first`` marks the first completed order of a customer.
    """
    orders = run.once("orders", lambda: t.orders.filter(within_days("o_orderdate", None, run.as_of - dt.timedelta(days=1))).select(
        "o_orderkey", "o_custkey", day("o_orderdate").alias("order_day"), F.col("o_orderpriority").alias("channel"),
        is_valid().alias("valid"),
    ))
    first = orders.filter("valid").groupBy("o_custkey").agg(F.min(F.struct("order_day", "o_orderkey")).alias("_first"))
    recent = orders.filter(F.col("order_day") >= minus_months(run.as_of.replace(month=1, day=1), 24))
    marked = spread_join(recent, first, "o_custkey").withColumn(
        "is_first", F.coalesce(F.col("_first.o_orderkey") == F.col("o_orderkey"), F.lit(False))
    )
    cities = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", F.col("n_name").alias("city"), F.col("r_name").alias("home")
    )
    homes = t.customer.join(cities, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("purpose"), F.col("c_nationkey").alias("nation"), "city", "home"
    )
    placed = marked.drop("_first").join(homes, "o_custkey")
    rates = published_rates(orders.join(homes, "o_custkey"))
    # A rate per city and day is a small table; the facts themselves meet it by key.
    days = as_of(placed.select("nation", "order_day").distinct(), rates, ["nation"], "order_day", "rate_day", {"rate": "rate"})
    return placed.join(days, ["nation", "order_day"], "left")


def priced_lines(t: Tables) -> DataFrame:
    """Amounts per order, brand and seller of voucher lines (``v_``) and discount lines (``d_``); one pass over the lines."""
    voucher = is_promo_line()
    discount = ~voucher & (F.col("l_discount") > 0)
    refunded = voucher & (F.col("l_returnflag") == "R")
    parts = t.part.select("p_partkey", "p_brand", "p_type", "p_name")
    lines = t.lineitem.filter(F.col("l_discount") > 0).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"
    )
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy(
        F.col("l_orderkey").alias("o_orderkey"), "p_brand", "l_suppkey"
    ).agg(
        F.bool_or(voucher).alias("v_any"),
        sum_where(voucher, discount_amount()).alias("v_cost"),
        sum_where(voucher, gross()).alias("v_gmv"),
        F.bool_or(refunded).alias("v_refunded"),
        sum_where(refunded, discount_amount()).alias("v_refund"),
        sum_where(refunded, tax_amount()).alias("v_compensation"),
        F.collect_set(F.when(voucher, F.col("p_type"))).alias("v_types"),
        F.min(F.when(voucher, F.col("p_name"))).alias("v_product"),
        F.bool_or(discount).alias("d_any"),
        sum_where(discount, discount_amount()).alias("d_cost"),
        F.min(F.when(discount, F.col("p_name"))).alias("d_product"),
    )


def facts(t: Tables, run: Run) -> DataFrame:
    """Both kinds of promotion with their order, written once per run."""
    return run.once("facts", lambda: priced_lines(t).join(order_facts(t, run), "o_orderkey"))


def ruled(t: Tables, rows: DataFrame) -> DataFrame:
    """The rows with the budget, its channel and the share of marketing, by the rules of the sheet."""
    sheet = budget_rules(t)
    part = safe_ratio(
        F.call_function("div", F.col("compensation") * 100, F.nullif(F.col("refund") + F.col("compensation"), F.lit(0))), F.lit(100)
    )
    rows = first_match(rows, sheet, "vertical", TESTED, "vertical_per_budget", F.lit("Other"))
    rows = first_match(rows, sheet, "share", TESTED, "marketing_share", F.lit(1.0), {"refund_share": part})
    return first_match(rows, sheet, "channel", TESTED, "budget_channel", F.lit("Others"))


def redemptions(t: Tables, run: Run) -> DataFrame:
    """One row per order and brand whose voucher was used; a refund counts with its own amounts."""
    order = ["o_orderkey", "o_custkey", "order_day", "channel", "purpose", "city", "home", "is_first", "rate"]
    used = facts(t, run).filter("v_any").groupBy("p_brand", *order).agg(
        F.sum("v_cost").alias("cost"),
        F.sum("v_gmv").alias("gmv"),
        F.bool_or("v_refunded").alias("refunded"),
        F.sum("v_refund").alias("refund"),
        F.sum("v_compensation").alias("compensation"),
        F.array_distinct(F.flatten(F.collect_list("v_types"))).alias("types"),  # of one order
        F.min("v_product").alias("product"),
    )
    value = F.when(F.col("refunded"), F.col("refund") + F.col("compensation")).otherwise(F.col("cost"))
    ratio = F.when(F.col("refunded"), 100).otherwise(40 + brand_number() % 50)
    valued = used.withColumns({"value": value, "ratio": ratio.cast("long")}).withColumns(
        {"value_common": converted(F.col("value"), F.col("rate")), "gmv_common": converted(F.col("gmv"), F.col("rate"))}
    )
    return ruled(t, valued)


def redeemed_orders_by_rule(t: Tables, run_at: dt.datetime) -> DataFrame:
    """What the three cascades say about all redemptions, by month."""
    rows = redemptions(t, Run(t.spark, run_at))
    return rows.groupBy(month_start("order_day").alias("month"), "vertical_per_budget", "budget_channel", "marketing_share").agg(
        F.count(F.lit(1)).alias("redemptions"), total(F.col("value")).alias("value")
    )


# --- vouchers --------------------------------------------------------------------


def split(value: Column, ratio: Column) -> tuple[Column, Column]:
    """Parts of the platform and of the seller, for a ratio in percent."""
    share = ratio.cast("double") / 100
    return value * share, value * (1 - share)


def voucher_costs(t: Tables, run: Run) -> DataFrame:
    """Cost of vouchers per place, budget and month, beside its projection to the end of the month.

    What a limited voucher can still cost is its remaining quantity times the mean
    value of this month's redemptions, shared over places by their orders.  The
    projection of the running month stays under that, but not under the cost so far.
    """
    seen = run.as_of - dt.timedelta(days=1)
    month0 = F.lit(first_of_month(seen))
    month1 = F.add_months(month0, 1)
    budget = ["channel", "purpose", "vertical_per_budget", "budget_channel", "marketing_share", "ratio"]
    monthly = run.once("vouchers", lambda: redemptions(t, run).groupBy(*CAMPAIGN_KEYS, *budget, month_start("order_day").alias("month")).agg(
        exact_sum(F.col("value")).alias("cost"),
        exact_sum(F.col("value_common")).alias("cost_common"),
        F.count("value_common").alias("rated"),
        exact_sum(F.col("gmv")).alias("gmv"),
        exact_sum(F.col("gmv_common")).alias("gmv_common"),
        F.count(F.lit(1)).alias("orders"),
        count_where(F.col("is_first")).alias("new_customers"),
        F.min("order_day").alias("first_order"),
    ))
    # The monthly rows of a voucher are few: places, budgets and months.
    voucher, place = Window.partitionBy("p_brand"), Window.partitionBy(*CAMPAIGN_KEYS)
    now = F.col("month") == month0
    of_voucher = lambda c: F.sum(c).over(voucher)
    limited = ~F.col("is_unlimited")
    left = F.col("quantity") - F.coalesce(of_voucher(F.when(F.col("month") < month0, F.col("orders"))), F.lit(0))
    mean_common = safe_ratio(amount(of_voucher(F.when(now, F.col("cost_common")))), of_voucher(F.when(now, F.col("rated"))))
    mean_local = safe_ratio(amount(of_voucher(F.when(now, F.col("cost")))), of_voucher(F.when(now, F.col("orders"))))
    running = (F.col("start_day") < month1) & (F.col("end_day") >= month0)
    free = (F.col("quantity") <= 1) | F.col("attribution").isin("global", "other") | F.col("is_unlimited")
    first = F.min(F.when(now, F.col("first_order"))).over(place)
    factor = F.when(free, open_factor(run.as_of, F.col("_first"))).otherwise(
        campaign_factor(run.as_of, F.col("start_day"), F.col("end_day"), F.col("_first"))
    )
    joined = monthly.join(promotions(t, run.as_of), "p_brand").withColumns(
        {
            "_first": first,
            "quantity_left": F.when(running & limited, F.col("quantity") - of_voucher("orders")),
            "_share": F.when(running, safe_ratio(F.sum("orders").over(place), of_voucher("orders"))),
            "_cap_common": F.when(running & limited, left.cast("double") * mean_common),
            "_cap_local": F.when(running & limited, left.cast("double") * mean_local),
        }
    ).withColumn("_factor", factor)

    def projected(cost: Column, cap: str) -> Column:
        scaled = cost * F.col("_factor")
        held = strict_least(scaled, strict_greatest(F.col("_share") * F.col(cap), cost))
        return F.when(now, F.when(free, scaled).otherwise(held)).otherwise(cost)

    cost = {"common": F.coalesce(amount(F.col("cost_common")), F.lit(0.0)), "local": F.coalesce(amount(F.col("cost")), F.lit(0.0))}
    money_columns = []
    for unit, value in cost.items():
        for what, whole in (("costs", value), ("runrate", projected(value, f"_cap_{unit}"))):
            ours, theirs = split(whole, F.col("ratio"))
            money_columns += [ours.alias(f"{what}_platform_{unit}"), theirs.alias(f"{what}_seller_{unit}")]
    return joined.select(
        "city", "home", "p_brand", *[c for c in budget if c != "ratio"], "month", "start_day", "end_day", "quantity", "quantity_left",
        *money_columns, "orders", "new_customers", amount(F.col("gmv_common")).alias("gmv_common"), amount(F.col("gmv")).alias("gmv_local"),
    )


# --- discounts -------------------------------------------------------------------


def discount_terms(t: Tables, run: Run) -> DataFrame:
    return promotions(t, run.as_of).select("p_brand", "start_day", "end_day")


def discount_costs(t: Tables, run: Run) -> DataFrame:
    """Cost of discounts per place, seller and month, projected while the campaign runs.

    Sellers are named for the last three months only.  Members' and corporate
    discounts, and those on rings, are none of marketing's.
    """
    seen = run.as_of - dt.timedelta(days=1)
    named_since = first_of_month(minus_months(run.as_of, 3))
    rows = facts(t, run).filter("d_any").withColumn("value_common", converted(F.col("d_cost"), F.col("rate")))
    sellers = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    rows = rows.join(sellers, "l_suppkey").withColumns(
        {
            "seller": F.when(F.col("order_day") >= named_since, F.col("s_name")).otherwise("NA"),
            "vertical_per_budget": F.when(F.col("channel") == "5-LOW", "Members")
            .when(F.col("d_product").like("hot %"), "Corporate")
            .otherwise(F.col("home")),
            "marketing_share": F.when(F.col("d_product").like("hot %") | (F.col("channel") == "5-LOW"), 0.0)
            .when((F.col("home") == "ASIA") & F.col("d_product").like("%ring") & (F.col("order_day") >= F.lit(dt.date(2000, 7, 1))), 0.0)
            .otherwise(1.0),
            "ratio": 40 + brand_number() % 50,
        }
    )
    keys = [*CAMPAIGN_KEYS, "vertical_per_budget", "marketing_share", "seller", "ratio"]
    # A seller has several lines of a brand in an order only as one row, but "NA" joins sellers: orders are counted apart.
    per_order = rows.groupBy(*keys, month_start("order_day").alias("month"), "o_orderkey", "order_day", "is_first").agg(
        F.sum("d_cost").alias("cost"), F.sum("value_common").alias("cost_common")
    )
    monthly = per_order.groupBy(*keys, "month").agg(
        total(F.col("cost")).alias("_local"),
        F.coalesce(total(F.col("cost_common")), F.lit(0.0)).alias("_common"),
        F.count(F.lit(1)).alias("orders"),
        count_where(F.col("is_first")).alias("new_customers"),
        F.min("order_day").alias("first_order"),
    )
    joined = monthly.join(discount_terms(t, run), "p_brand")
    factor = campaign_factor(run.as_of, F.col("start_day"), F.col("end_day"), F.col("first_order"))
    money_columns = []
    for unit in ("common", "local"):
        value = F.col(f"_{unit}")
        for what, whole in (("costs", value), ("runrate", factor * value)):
            ours, theirs = split(whole, F.col("ratio"))
            money_columns += [ours.alias(f"{what}_platform_{unit}"), theirs.alias(f"{what}_seller_{unit}")]
    return joined.select(
        "city", "home", "p_brand", "vertical_per_budget", "marketing_share", "seller", "month", "start_day", "end_day",
        *money_columns, "orders", "new_customers",
    ).filter(F.col("month") <= F.lit(seen))


# --- the job ---------------------------------------------------------------------

SECTIONS = {"vouchers": voucher_costs, "discounts": discount_costs}


def cost_tables(t: Tables, run_at: dt.datetime, database: str, sections: list[str] | None = None) -> dict[str, DataFrame]:
    """Make the cost tables of a run and publish them; the tables as read back."""
    run = Run(t.spark, run_at)
    makes = {name: partial(SECTIONS[name], t, run) for name in sections or SECTIONS}
    return {name: run.publish(make(), f"{database}.{name}_cost", ["month"]) for name, make in makes.items()}


def cost_table(t: Tables, run_at: dt.datetime, section: str) -> DataFrame:
    """One of the tables, written by a run that makes both."""
    return cost_tables(t, run_at, scratch_database(t.spark))[section]
