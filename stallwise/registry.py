"""Every registered query: a name and a function of (session, data folder)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stallwise.plans import (
    accounts,
    aggregation,
    catalogue,
    costs,
    couriers,
    customers,
    geography,
    joining,
    nested,
    orders,
    promotions,
    ranking,
    scalars,
    scanning,
    sessions,
    unnesting,
)
from stallwise.session import tune
from stallwise.sources.tables import Tables

AS_OF = dt.date(2001, 8, 2)  # run date for the order tables
HITS_AS_OF = dt.date(2024, 1, 31)  # run date for the web hits

Query = Callable[[SparkSession, str], DataFrame]
Plan = Callable[[Tables], DataFrame]


def portable(df: DataFrame) -> DataFrame:
    """Render dates as ISO text and decimals as doubles, for comparison across engines."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DateType):
            column = column.cast("string")
        elif isinstance(field.dataType, T.TimestampNTZType):
            # A day where there is no time of day, else the full text.
            day = F.date_trunc("DAY", column).cast("timestamp_ntz")
            column = F.when(column == day, F.to_date(column).cast("string")).otherwise(column.cast("string"))
        elif isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        columns.append(column.alias(field.name))
    return df.select(*columns)


SCANNING: dict[str, Plan] = {
    "scan_partition_window": lambda t: scanning.orders_by_local_day(
        t, dt.date(1998, 3, 1), dt.date(1998, 5, 31), offset_hours=-7
    ),
    "scan_lookback": lambda t: scanning.orders_by_recent_month(t, AS_OF, months=3),
    "project_except": scanning.lines_with_products,
    "three_valued_flags": scanning.flag_counts,
    "membership_filters": lambda t: scanning.membership(
        t, ["Brand#3", "Brand#7", "Brand#12", "Brand#20"], ["PROMO", "ECONOMY"], min_balance=5000
    ),
    "like_patterns": lambda t: scanning.pattern_counts(t, keyword="Ring"),
    "classify_cascade": scanning.classified_lines,
    "scalar_subquery_bounds": scanning.orders_between_scalars,
    "distinct_rows": scanning.distinct_offers,
}

UNNESTING: dict[str, Plan] = {
    "explode_inner": unnesting.charges_by_product_type,
    "explode_outer": unnesting.adjustments_by_flag,
    "explode_outer_filtered": lambda t: unnesting.large_adjustments_by_year(t, least=3000),
    "explode_nested": unnesting.word_popularity,
    "explode_sibling_product": unnesting.term_and_attribute_pairs,
}

JOINING: dict[str, Plan] = {
    "join_inner": joining.local_sales,
    "join_left_star": joining.star,
    "join_left_on_predicate": lambda t: joining.recent_sales_of_all_products(t, AS_OF, days=90),
    "join_interval_rows": joining.urgent_orders_in_opening_spans,
    "join_left_semi": lambda t: joining.orders_of_segment_customers(t, "BUILDING", min_balance=2500),
    "join_expr_key": joining.channel_budget,
    "join_fx_date": joining.sales_in_common_currency,
}

AGGREGATION: dict[str, Plan] = {
    "agg_basic": aggregation.line_summary,
    "agg_cond_distinct": aggregation.distinct_counts_by_month,
    "agg_distinct_rollup": aggregation.customer_counts_rolled_up,
    "agg_cond_sum": aggregation.conditional_amounts,
    "agg_countif": aggregation.conditional_counts,
    "agg_sum_distinct": aggregation.distinct_amounts,
    "agg_concat_distinct": aggregation.sessions_by_key,
    "agg_string_agg": aggregation.priorities_of_customers,
    "agg_string_repeats": aggregation.urgent_order_states,
    "agg_string_formatted": aggregation.counted_priorities_of_customers,
    "agg_having_dups": aggregation.repeated_lines,
    "agg_ratio_safe": aggregation.ratios_by_product,
    "agg_pivot_cond": aggregation.value_by_flag_columns,
    "agg_count_bool": aggregation.counted_tests,
}

RANKING: dict[str, Plan] = {
    "win_first_per_key": ranking.first_orders,
    "win_rank_flag": ranking.orders_marked_first,
    "win_latest_per_key": ranking.latest_turns,
    "win_rank_pairing": ranking.paired_orders,
    "win_qualify_topn": lambda t: ranking.top_sellers_per_city(t, n=10),
    "win_partition_total": ranking.lines_with_order_total,
    "win_running_sum": ranking.running_value_per_segment,
    "win_running_count": ranking.running_count_in_month,
    "win_partition_avg": ranking.orders_against_customer_mean,
    "topk_limit": lambda t: ranking.most_delayed_lines(t, k=1000),
    "union_all_padded": ranking.customers_and_sellers,
    "union_complementary": ranking.ordered_and_shipped,
}

SCALARS: dict[str, Plan] = {
    "fn_string": scalars.string_functions,
    "fn_date": scalars.date_functions,
    "fn_time": scalars.time_functions,
    "fn_math_null": scalars.number_functions,
    "fn_array": scalars.array_functions,
}

ORDERS: dict[str, Plan] = {
    "order_kpi_weekly": orders.weekly_kpis,
    "order_kpi_zones": lambda t: orders.weekly_kpis(t, ("country", "city", "zone")),
    "failure_rates": lambda t: orders.failure_rates(t, AS_OF, days=90),
    "ctas_daily_overview": orders.daily_overview_table,
    "basket_size": orders.basket_sizes,
    "fee_rules": orders.monthly_fees,
    "subsidy_split": orders.subsidy_split,
}

RUN_DATE = dt.date(2001, 7, 20)  # inside a month, for the month-end projections
FIRST_CAMPAIGN = dt.date(1998, 1, 1)

PROMOTIONS: dict[str, Plan] = {
    "proration_by_month": promotions.cost_by_month,
    "proration_offline": promotions.offline_cost_by_month,
    "date_spine": promotions.campaigns_per_day,
    "run_rate_projection": lambda t: promotions.run_rates(t, RUN_DATE),
    "run_rate_redemptions": lambda t: promotions.redemption_run_rates(t, RUN_DATE),
    "cap_allocation": lambda t: promotions.capped_allocation(t, RUN_DATE),
    "campaign_before_during": lambda t: promotions.before_and_during(t, AS_OF, FIRST_CAMPAIGN),
    "campaign_single_pass": lambda t: promotions.before_and_during_single_pass(t, AS_OF, FIRST_CAMPAIGN),
    "promo_performance": promotions.performance,
}

RUN_AT = dt.datetime(2001, 7, 20, 8, 30)

COSTS: dict[str, Plan] = {
    "join_rate_asof": costs.sales_at_daily_rate,
    "rules_cascades": lambda t: costs.redeemed_orders_by_rule(t, RUN_AT),
    "cost_table_vouchers": lambda t: costs.cost_table(t, RUN_AT, "vouchers"),
    "cost_table_discounts": lambda t: costs.cost_table(t, RUN_AT, "discounts"),
}

CUSTOMERS: dict[str, Plan] = {
    "recency_churn": lambda t: customers.churn_features(t, AS_OF, months=6),
    "lapsed_customers": lambda t: customers.lapsed(
        t, (dt.date(2000, 1, 1), dt.date(2000, 12, 31)), (dt.date(2001, 1, 1), AS_OF), k=600
    ),
    "migration_report": lambda t: customers.migration(
        t, "#00000001", (dt.date(1997, 1, 1), dt.date(1999, 6, 30)), (dt.date(1999, 7, 1), AS_OF), k=20
    ),
    "customer_base_growth": customers.base_growth,
    "new_customer_flags": customers.first_order_flags,
    "tenure_buckets": customers.sales_by_tenure,
    "tenure_running": customers.early_sales,
}

SESSIONS: dict[str, Plan] = {
    "funnel_rates": sessions.open_funnel,
    "closed_funnel_sessions": lambda t: sessions.closed_funnel(t, zone="Asia/Phnom_Penh"),
    "closed_funnel_sellers": lambda t: sessions.closed_funnel_by_seller(t, zone="Asia/Phnom_Penh"),
    "funnel_clamp": sessions.clamped_funnel,
    "error_messages_daily": lambda t: sessions.error_messages(t, wanted=": [1-7]", unwanted="0}|5}"),
    "lane_sessions": lambda t: sessions.lane_sessions(
        t, ["shelf: fresh 🧺", "shelf: ផ្លែឈើ", "shelf: 水果"], HITS_AS_OF, days=21
    ),
    "rolling_session_refresh": lambda t: sessions.refreshed_sessions(t, HITS_AS_OF, days=5, lag=3),
}

COURIERS: dict[str, Plan] = {
    "earnings_consolidation": couriers.earnings,
    "earnings_streams": lambda t: couriers.earnings_of_streams(t, dt.date(2001, 1, 1), dt.date(2001, 1, 31)),
    "earnings_buckets": couriers.couriers_by_hours,
    "latest_contract_max": couriers.latest_contracts,
    "rider_activity_daily": couriers.daily_activity,
    "delivery_fee_by_weekday": lambda t: couriers.fees_by_weekday(t, AS_OF, months=12),
    "courier_monthly_work": couriers.monthly_work,
    "shift_creation": couriers.shift_creation,
    "availability_ratio": lambda t: couriers.availability(t, AS_OF, days=60),
}

CATALOGUE: dict[str, Plan] = {
    "translation_pivot": catalogue.latest_texts,
    "join_full_outer": lambda t: catalogue.sellers_of_two_periods(
        t, (dt.date(2000, 1, 1), dt.date(2000, 1, 31)), (dt.date(2001, 1, 1), dt.date(2001, 1, 31))
    ),
    "catalog_completeness": lambda t: catalogue.completeness(t, least=520),
    "rating_average": catalogue.ratings,
    "source_crosscheck": lambda t: catalogue.active_without_orders(t, AS_OF, days=180),
}

GEOGRAPHY: dict[str, Plan] = {
    "join_geofence": geography.assigned,
    "join_geofence_anti": geography.unassigned,
    "geofence_resolution": geography.resolved,
    "radius_audience": lambda t: geography.audience(t, "00013", metres=15000.0, as_of=AS_OF),
}

NESTED: dict[str, Plan] = {
    "nested_zones": nested.zone_list,
    "nested_sellers_by_zone": nested.sellers_by_zone,
}

ACCOUNTS: dict[str, Plan] = {
    "order_billing": lambda t: accounts.billing(t, dt.date(2000, 1, 1), dt.date(2000, 12, 31)),
    "seller_compliance": lambda t: accounts.compliance(t, AS_OF, weeks=4),
    "seller_contracts": accounts.contracts,
    "deals_by_category": accounts.deals_by_category,
    "idle_products": lambda t: accounts.idle_products(t, AS_OF, days=90),
    "ticket_periods": lambda t: accounts.ticket_periods(t, AS_OF, months=24),
    "purchase_orders": lambda t: accounts.purchase_orders(t, dt.date(2001, 5, 1)),
    "platform_failures": lambda t: accounts.platform_failures(t, dt.date(2000, 12, 1), dt.date(2001, 1, 31)),
    "promo_keyword_usage": lambda t: accounts.keyword_usage(t, "Blue"),
    "orders_with_products": lambda t: accounts.orders_with_products(t, ["red bolt", "hot gear", "small ring"]),
}

PLANS: dict[str, Plan] = {
    **SCANNING,
    **UNNESTING,
    **JOINING,
    **AGGREGATION,
    **RANKING,
    **SCALARS,
    **ORDERS,
    **PROMOTIONS,
    **COSTS,
    **CUSTOMERS,
    **SESSIONS,
    **COURIERS,
    **CATALOGUE,
    **GEOGRAPHY,
    **NESTED,
    **ACCOUNTS,
}


def _query(plan: Plan) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        tune(spark)
        return portable(plan(Tables(spark, folder)))

    return run


def queries() -> dict[str, Query]:
    return {name: _query(plan) for name, plan in PLANS.items()}
