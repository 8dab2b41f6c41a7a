-- key: join_rate_asof
WITH placed AS (
  SELECT CAST(o_orderdate AS DATE) AS order_day, o_orderpriority AS channel, c_nationkey AS nation,
         CAST(round(o_totalprice * 100) AS BIGINT) * 100 AS value
  FROM orders JOIN customer ON c_custkey = o_custkey
), rates AS (
  SELECT DISTINCT nation, order_day AS rate_day, CAST(9000 + nation * 350 + (dayofyear(order_day) * 7) % 400 AS BIGINT) AS rate
  FROM placed WHERE channel = '1-URGENT'
), daily AS (
  SELECT nation, order_day, COUNT(*) AS orders, SUM(value) AS value FROM placed GROUP BY nation, order_day
)
SELECT daily.nation, CAST(order_day AS VARCHAR) AS order_day, orders, CAST(value AS DOUBLE) / 10000 AS value,
       CAST(rate_day AS VARCHAR) AS rate_day, rate, CAST((value * 20000 + rate) // (2 * rate) AS DOUBLE) / 10000 AS value_common
FROM daily ASOF LEFT JOIN rates ON rates.nation = daily.nation AND daily.order_day >= rates.rate_day

-- key: rules_cascades
WITH placed AS (
  SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS order_day, o_orderpriority AS channel, o_orderstatus <> 'P' AS valid,
         c_mktsegment AS purpose, c_nationkey AS nation, n_name AS city, r_name AS home
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
  WHERE CAST(o_orderdate AS DATE) < DATE '2001-07-20'
), rates AS (
  SELECT DISTINCT nation, order_day AS rate_day, 9000 + nation * 350 + (dayofyear(order_day) * 7) % 400 AS rate
  FROM placed WHERE channel = '1-URGENT'
), first_valid AS (
  SELECT o_custkey, o_orderkey AS first_key
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY order_day, o_orderkey) AS r FROM placed WHERE valid) WHERE r = 1
), recent AS (
  SELECT placed.*, coalesce(first_key = o_orderkey, FALSE) AS is_first, rate
  FROM placed LEFT JOIN first_valid USING (o_custkey)
  ASOF LEFT JOIN rates ON rates.nation = placed.nation AND placed.order_day >= rates.rate_day
  WHERE order_day >= DATE '1999-01-01'
), line AS (
  SELECT l_orderkey, l_suppkey, p_brand, p_type, p_name, l_discount > 0.05 AS voucher, l_returnflag = 'R' AS refund,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(round(l_discount * 100) AS BIGINT) AS pct, CAST(round(l_tax * 100) AS BIGINT) AS tax
  FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_discount > 0
), terms AS (
  SELECT p_brand, n, CASE WHEN n = 1 THEN 1 ELSE products * 15 END AS quantity, DATE '2001-07-20' - n * 9 AS start_day,
         DATE '2001-07-20' + (n - 6) * 2 AS end_day, n % 5 = 0 AS is_unlimited, n % 7 = 0 AS is_global
  FROM (SELECT p_brand, CAST(p_brand[7:10] AS INTEGER) AS n, COUNT(*) AS products FROM part GROUP BY p_brand)
), used AS (
  SELECT l_orderkey, p_brand, SUM(cents * pct) AS cost, SUM(cents * 100) AS gmv, bool_or(refund) AS refunded,
         SUM(cents * pct) FILTER (refund) AS refund, SUM(cents * tax) FILTER (refund) AS compensation,
         list_sort(list(DISTINCT p_type)) AS types, MIN(p_name) AS product
  FROM line WHERE voucher GROUP BY l_orderkey, p_brand
), redeemed AS (
  SELECT used.*, recent.*, CASE WHEN refunded THEN refund + compensation ELSE cost END AS value,
    CASE WHEN refunded THEN 100 ELSE 40 + CAST(p_brand[7:10] AS INTEGER) % 50 END AS ratio,
    CASE
      WHEN product LIKE 'hot %' THEN 'Seasonal'
      WHEN channel = '1-URGENT' AND purpose = 'BUILDING' THEN 'Corporate'
      WHEN channel = '5-LOW' THEN 'Members'
      WHEN purpose = 'HOUSEHOLD' AND product LIKE '%ring' THEN 'Members'
      WHEN types = ['PROMO'] THEN 'Promotion'
      WHEN types = ['SMALL'] THEN 'Compact'
      WHEN types = ['ECONOMY', 'LARGE'] THEN
        CASE home WHEN 'AFRICA' THEN 'Economy abroad' WHEN 'ASIA' THEN 'Large abroad' ELSE 'Economy and large unclear' END
      WHEN list_contains(types, 'STANDARD') THEN 'Regular'
      WHEN list_contains(types, 'MEDIUM') AND NOT list_has_any(types, ['STANDARD', 'LARGE', 'ECONOMY']) THEN
        CASE WHEN home <> 'EUROPE' THEN 'Medium' ELSE 'Medium at home' END
      ELSE 'Other'
    END AS vertical_per_budget,
    CASE
      WHEN refunded THEN ((compensation * 100) // NULLIF(refund + compensation, 0)) / 100
      WHEN purpose = 'MACHINERY' THEN 0
      WHEN channel = '1-URGENT' AND purpose = 'BUILDING' THEN 0
      WHEN order_day <= DATE '1998-06-30' AND channel = '2-HIGH'
        AND NOT (product LIKE 'red %' OR product LIKE '% rod' OR product LIKE 'small ring') THEN 0
      WHEN order_day >= DATE '1998-07-01' AND channel = '2-HIGH' AND NOT purpose = 'FURNITURE' THEN 0
      WHEN product LIKE 'old %' THEN 0
      WHEN channel <> '3-MEDIUM' AND product LIKE '%widget%' THEN 0
      WHEN order_day >= DATE '1999-01-01' AND home = 'ASIA' AND list_contains(types, 'PROMO') THEN 0
      ELSE 1
    END AS marketing_share,
    CASE
      WHEN refunded THEN 'Compensation'
      WHEN product IN ('hot ring', 'hot plate') THEN 'Demand'
      WHEN channel = '5-LOW' THEN 'Members'
      WHEN purpose = 'BUILDING' THEN 'Builders'
      WHEN order_day >= DATE '2000-01-01' AND purpose = 'AUTOMOBILE' THEN 'Partners'
      WHEN channel = '3-MEDIUM' AND purpose = 'HOUSEHOLD' THEN 'Retail'
      ELSE 'Others'
    END AS budget_channel
  FROM used JOIN recent ON o_orderkey = l_orderkey
)
SELECT CAST(date_trunc('month', order_day) AS VARCHAR)[1:10] AS month, vertical_per_budget, budget_channel, CAST(marketing_share AS DOUBLE) AS marketing_share,
       COUNT(*) AS redemptions, CAST(SUM(value) AS DOUBLE) / 10000 AS value
FROM redeemed GROUP BY ALL

-- key: cost_table_vouchers
WITH placed AS (
  SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS order_day, o_orderpriority AS channel, o_orderstatus <> 'P' AS valid,
         c_mktsegment AS purpose, c_nationkey AS nation, n_name AS city, r_name AS home
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
  WHERE CAST(o_orderdate AS DATE) < DATE '2001-07-20'
), rates AS (
  SELECT DISTINCT nation, order_day AS rate_day, 9000 + nation * 350 + (dayofyear(order_day) * 7) % 400 AS rate
  FROM placed WHERE channel = '1-URGENT'
), first_valid AS (
  SELECT o_custkey, o_orderkey AS first_key
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY order_day, o_orderkey) AS r FROM placed WHERE valid) WHERE r = 1
), recent AS (
  SELECT placed.*, coalesce(first_key = o_orderkey, FALSE) AS is_first, rate
  FROM placed LEFT JOIN first_valid USING (o_custkey)
  ASOF LEFT JOIN rates ON rates.nation = placed.nation AND placed.order_day >= rates.rate_day
  WHERE order_day >= DATE '1999-01-01'
), line AS (
  SELECT l_orderkey, l_suppkey, p_brand, p_type, p_name, l_discount > 0.05 AS voucher, l_returnflag = 'R' AS refund,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(round(l_discount * 100) AS BIGINT) AS pct, CAST(round(l_tax * 100) AS BIGINT) AS tax
  FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_discount > 0
), terms AS (
  SELECT p_brand, n, CASE WHEN n = 1 THEN 1 ELSE products * 15 END AS quantity, DATE '2001-07-20' - n * 9 AS start_day,
         DATE '2001-07-20' + (n - 6) * 2 AS end_day, n % 5 = 0 AS is_unlimited, n % 7 = 0 AS is_global
  FROM (SELECT p_brand, CAST(p_brand[7:10] AS INTEGER) AS n, COUNT(*) AS products FROM part GROUP BY p_brand)
), used AS (
  SELECT l_orderkey, p_brand, SUM(cents * pct) AS cost, SUM(cents * 100) AS gmv, bool_or(refund) AS refunded,
         SUM(cents * pct) FILTER (refund) AS refund, SUM(cents * tax) FILTER (refund) AS compensation,
         list_sort(list(DISTINCT p_type)) AS types, MIN(p_name) AS product
  FROM line WHERE voucher GROUP BY l_orderkey, p_brand
), redeemed AS (
  SELECT used.*, recent.*, CASE WHEN refunded THEN refund + compensation ELSE cost END AS value,
    CASE WHEN refunded THEN 100 ELSE 40 + CAST(p_brand[7:10] AS INTEGER) % 50 END AS ratio,
    CASE
      WHEN product LIKE 'hot %' THEN 'Seasonal'
      WHEN channel = '1-URGENT' AND purpose = 'BUILDING' THEN 'Corporate'
      WHEN channel = '5-LOW' THEN 'Members'
      WHEN purpose = 'HOUSEHOLD' AND product LIKE '%ring' THEN 'Members'
      WHEN types = ['PROMO'] THEN 'Promotion'
      WHEN types = ['SMALL'] THEN 'Compact'
      WHEN types = ['ECONOMY', 'LARGE'] THEN
        CASE home WHEN 'AFRICA' THEN 'Economy abroad' WHEN 'ASIA' THEN 'Large abroad' ELSE 'Economy and large unclear' END
      WHEN list_contains(types, 'STANDARD') THEN 'Regular'
      WHEN list_contains(types, 'MEDIUM') AND NOT list_has_any(types, ['STANDARD', 'LARGE', 'ECONOMY']) THEN
        CASE WHEN home <> 'EUROPE' THEN 'Medium' ELSE 'Medium at home' END
      ELSE 'Other'
    END AS vertical_per_budget,
    CASE
      WHEN refunded THEN ((compensation * 100) // NULLIF(refund + compensation, 0)) / 100
      WHEN purpose = 'MACHINERY' THEN 0
      WHEN channel = '1-URGENT' AND purpose = 'BUILDING' THEN 0
      WHEN order_day <= DATE '1998-06-30' AND channel = '2-HIGH'
        AND NOT (product LIKE 'red %' OR product LIKE '% rod' OR product LIKE 'small ring') THEN 0
      WHEN order_day >= DATE '1998-07-01' AND channel = '2-HIGH' AND NOT purpose = 'FURNITURE' THEN 0
      WHEN product LIKE 'old %' THEN 0
      WHEN channel <> '3-MEDIUM' AND product LIKE '%widget%' THEN 0
      WHEN order_day >= DATE '1999-01-01' AND home = 'ASIA' AND list_contains(types, 'PROMO') THEN 0
      ELSE 1
    END AS marketing_share,
    CASE
      WHEN refunded THEN 'Compensation'
      WHEN product IN ('hot ring', 'hot plate') THEN 'Demand'
      WHEN channel = '5-LOW' THEN 'Members'
      WHEN purpose = 'BUILDING' THEN 'Builders'
      WHEN order_day >= DATE '2000-01-01' AND purpose = 'AUTOMOBILE' THEN 'Partners'
      WHEN channel = '3-MEDIUM' AND purpose = 'HOUSEHOLD' THEN 'Retail'
      ELSE 'Others'
    END AS budget_channel
  FROM used JOIN recent ON o_orderkey = l_orderkey
), valued AS (
  SELECT *, date_trunc('month', order_day)::DATE AS month, (value * 20000 + rate) // (2 * rate) AS value_common,
         (gmv * 20000 + rate) // (2 * rate) AS gmv_common
  FROM redeemed
), monthly AS (
  SELECT city, home, p_brand, channel, purpose, vertical_per_budget, budget_channel, CAST(marketing_share AS DOUBLE) AS marketing_share, ratio, month,
         SUM(value) AS cost, SUM(value_common) AS cost_common, SUM(gmv) AS gmv, SUM(gmv_common) AS gmv_common,
         COUNT(*) AS orders, COUNT(*) FILTER (is_first) AS new_customers
  FROM valued GROUP BY ALL
), cap AS (
  SELECT p_brand, COUNT(*) AS all_orders, COUNT(*) FILTER (month < DATE '2001-07-01') AS orders_before,
         CAST(SUM(value_common) FILTER (month = DATE '2001-07-01') AS DOUBLE) / 10000 / NULLIF(COUNT(value_common) FILTER (month = DATE '2001-07-01'), 0) AS mean_common,
         CAST(SUM(value) FILTER (month = DATE '2001-07-01') AS DOUBLE) / 10000 / NULLIF(COUNT(*) FILTER (month = DATE '2001-07-01'), 0) AS mean_local
  FROM valued GROUP BY p_brand
), place AS (
  SELECT p_brand, city, home, COUNT(*) AS place_orders, MIN(order_day) FILTER (month = DATE '2001-07-01') AS first_order
  FROM valued GROUP BY p_brand, city, home
), projected AS (
  SELECT monthly.*, start_day, end_day, quantity, month = DATE '2001-07-01' AS now,
    quantity <= 1 OR is_global OR is_unlimited AS free,
    CASE WHEN start_day < DATE '2001-08-01' AND end_day >= DATE '2001-07-01' AND NOT is_unlimited THEN quantity - all_orders END AS quantity_left,
    CASE WHEN start_day < DATE '2001-08-01' AND end_day >= DATE '2001-07-01' THEN CAST(place_orders AS DOUBLE) / all_orders END AS share,
    CASE WHEN start_day < DATE '2001-08-01' AND end_day >= DATE '2001-07-01' AND NOT is_unlimited THEN CAST(quantity - orders_before AS DOUBLE) * mean_common END AS cap_common,
    CASE WHEN start_day < DATE '2001-08-01' AND end_day >= DATE '2001-07-01' AND NOT is_unlimited THEN CAST(quantity - orders_before AS DOUBLE) * mean_local END AS cap_local,
    CASE
      WHEN quantity <= 1 OR is_global OR is_unlimited THEN CASE WHEN first_order IS NOT NULL THEN CAST(31 AS DOUBLE) / 19 ELSE 1 END
      WHEN start_day <= DATE '2001-07-19' AND end_day >= DATE '2001-07-19' AND first_order IS NOT NULL THEN
        CAST(greatest(least(end_day, DATE '2001-07-31'), DATE '2001-07-19') - greatest(start_day, DATE '2001-07-01') + 1 AS DOUBLE)
        / (DATE '2001-07-19' - greatest(start_day, DATE '2001-07-01') + 1)
      ELSE 1 END AS factor,
    coalesce(CAST(cost_common AS DOUBLE) / 10000, 0) AS c, coalesce(CAST(cost AS DOUBLE) / 10000, 0) AS l
  FROM monthly JOIN terms USING (p_brand) JOIN cap USING (p_brand) JOIN place USING (p_brand, city, home)
), held AS (
  SELECT *,
    CASE WHEN NOT now THEN c WHEN free THEN c * factor
         WHEN cap_common IS NOT NULL AND share IS NOT NULL THEN least(c * factor, greatest(share * cap_common, c)) END AS rc,
    CASE WHEN NOT now THEN l WHEN free THEN l * factor
         WHEN cap_local IS NOT NULL AND share IS NOT NULL THEN least(l * factor, greatest(share * cap_local, l)) END AS rl,
    CAST(ratio AS DOUBLE) / 100 AS r
  FROM projected
)
SELECT city, home, p_brand, channel, purpose, vertical_per_budget, budget_channel, marketing_share, CAST(month AS VARCHAR) AS month,
       CAST(start_day AS VARCHAR) AS start_day, CAST(end_day AS VARCHAR) AS end_day, quantity, quantity_left,
       c * r AS costs_platform_common, c * (1 - r) AS costs_seller_common, rc * r AS runrate_platform_common, rc * (1 - r) AS runrate_seller_common,
       l * r AS costs_platform_local, l * (1 - r) AS costs_seller_local, rl * r AS runrate_platform_local, rl * (1 - r) AS runrate_seller_local,
       orders, new_customers, CAST(gmv_common AS DOUBLE) / 10000 AS gmv_common, CAST(gmv AS DOUBLE) / 10000 AS gmv_local,
       '2001-07-20 08:30:00' AS updated_at
FROM held

-- key: cost_table_discounts
WITH placed AS (
  SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS order_day, o_orderpriority AS channel, o_orderstatus <> 'P' AS valid,
         c_mktsegment AS purpose, c_nationkey AS nation, n_name AS city, r_name AS home
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
  WHERE CAST(o_orderdate AS DATE) < DATE '2001-07-20'
), rates AS (
  SELECT DISTINCT nation, order_day AS rate_day, 9000 + nation * 350 + (dayofyear(order_day) * 7) % 400 AS rate
  FROM placed WHERE channel = '1-URGENT'
), first_valid AS (
  SELECT o_custkey, o_orderkey AS first_key
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY order_day, o_orderkey) AS r FROM placed WHERE valid) WHERE r = 1
), recent AS (
  SELECT placed.*, coalesce(first_key = o_orderkey, FALSE) AS is_first, rate
  FROM placed LEFT JOIN first_valid USING (o_custkey)
  ASOF LEFT JOIN rates ON rates.nation = placed.nation AND placed.order_day >= rates.rate_day
  WHERE order_day >= DATE '1999-01-01'
), line AS (
  SELECT l_orderkey, l_suppkey, p_brand, p_type, p_name, l_discount > 0.05 AS voucher, l_returnflag = 'R' AS refund,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(round(l_discount * 100) AS BIGINT) AS pct, CAST(round(l_tax * 100) AS BIGINT) AS tax
  FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_discount > 0
), terms AS (
  SELECT p_brand, n, CASE WHEN n = 1 THEN 1 ELSE products * 15 END AS quantity, DATE '2001-07-20' - n * 9 AS start_day,
         DATE '2001-07-20' + (n - 6) * 2 AS end_day, n % 5 = 0 AS is_unlimited, n % 7 = 0 AS is_global
  FROM (SELECT p_brand, CAST(p_brand[7:10] AS INTEGER) AS n, COUNT(*) AS products FROM part GROUP BY p_brand)
), per_seller AS (
  SELECT l_orderkey, p_brand, l_suppkey, SUM(cents * pct) AS cost, MIN(p_name) AS product
  FROM line WHERE NOT voucher GROUP BY l_orderkey, p_brand, l_suppkey
), priced AS (
  SELECT per_seller.*, recent.*, (cost * 20000 + rate) // (2 * rate) AS cost_common, date_trunc('month', order_day)::DATE AS month,
    CASE WHEN order_day >= DATE '2001-04-01' THEN s_name ELSE 'NA' END AS seller,
    CASE WHEN channel = '5-LOW' THEN 'Members' WHEN product LIKE 'hot %' THEN 'Corporate' ELSE home END AS vertical_per_budget,
    CASE WHEN channel = '5-LOW' OR product LIKE 'hot %' THEN 0
         WHEN home = 'ASIA' AND product LIKE '%ring' AND order_day >= DATE '2000-07-01' THEN 0 ELSE 1 END::DOUBLE AS marketing_share
  FROM per_seller JOIN recent ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey
), monthly AS (
  SELECT city, home, p_brand, vertical_per_budget, marketing_share, seller, month, coalesce(CAST(SUM(cost_common) AS DOUBLE) / 10000, 0) AS c,
         CAST(SUM(cost) AS DOUBLE) / 10000 AS l, COUNT(DISTINCT o_orderkey) AS orders,
         COUNT(DISTINCT CASE WHEN is_first THEN o_custkey END) AS new_customers, MIN(order_day) AS first_order
  FROM priced GROUP BY ALL
), projected AS (
  SELECT *, CAST(40 + n % 50 AS DOUBLE) / 100 AS r,
    CASE WHEN start_day <= DATE '2001-07-19' AND end_day >= DATE '2001-07-19' AND month = DATE '2001-07-01' THEN
      CAST(greatest(least(end_day, DATE '2001-07-31'), DATE '2001-07-19') - greatest(start_day, DATE '2001-07-01') + 1 AS DOUBLE)
      / (DATE '2001-07-19' - greatest(start_day, DATE '2001-07-01') + 1)
    ELSE 1 END AS factor
  FROM monthly JOIN terms USING (p_brand)
)
SELECT city, home, p_brand, vertical_per_budget, marketing_share, seller, CAST(month AS VARCHAR) AS month, CAST(start_day AS VARCHAR) AS start_day,
       CAST(end_day AS VARCHAR) AS end_day, c * r AS costs_platform_common, c * (1 - r) AS costs_seller_common,
       factor * c * r AS runrate_platform_common, factor * c * (1 - r) AS runrate_seller_common,
       l * r AS costs_platform_local, l * (1 - r) AS costs_seller_local, factor * l * r AS runrate_platform_local,
       factor * l * (1 - r) AS runrate_seller_local, orders, new_customers, '2001-07-20 08:30:00' AS updated_at
FROM projected
