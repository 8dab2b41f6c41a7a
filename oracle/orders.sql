-- key: order_kpi_weekly
WITH line AS (
  SELECT l_orderkey, l_suppkey, s_name LIKE '%5' AS is_chain, s_acctbal >= 5000 AS is_shop,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS p, CAST(l_discount AS DECIMAL(4,2)) AS d, CAST(l_tax AS DECIMAL(4,2)) AS x
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
), value AS (
  SELECT l_orderkey, SUM(p) AS gmv, SUM(p * (1 - d)) AS gfv, SUM(p * d) AS discount, SUM(p * x) AS voucher,
         bool_or(is_chain) AS has_chain, bool_or(is_shop) AS has_shop
  FROM line GROUP BY l_orderkey
), first_valid AS (
  SELECT o_custkey, MIN(CAST(o_orderdate AS DATE)) AS first_day FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey
), o AS (
  SELECT CAST(o_orderdate AS DATE) - CAST(dayofweek(o_orderdate) AS INTEGER) AS week, r_name AS country, n_name AS city,
         CAST(o_orderdate AS DATE) AS day, o_orderkey, orders.o_custkey, o_orderpriority AS pr, o_totalprice,
         o_orderstatus <> 'P' AS valid, o_orderstatus = 'P' AS failed, first_day, value.*
  FROM orders
  JOIN customer ON c_custkey = orders.o_custkey
  JOIN nation ON n_nationkey = c_nationkey
  JOIN region ON r_regionkey = n_regionkey
  LEFT JOIN value ON l_orderkey = o_orderkey
  LEFT JOIN first_valid ON first_valid.o_custkey = orders.o_custkey
), main AS (
  SELECT week, country, city, COUNT(DISTINCT day) AS day_count,
         COUNT(DISTINCT CASE WHEN valid THEN o_custkey END) AS customer_count,
         COUNT(DISTINCT CASE WHEN valid AND day = first_day THEN o_custkey END) AS new_customer_count,
         COUNT(DISTINCT CASE WHEN valid THEN o_orderkey END) AS order_count,
         COUNT(DISTINCT o_orderkey) AS gross_orders,
         COUNT(DISTINCT CASE WHEN failed THEN o_orderkey END) AS failed_orders,
         COUNT(DISTINCT CASE WHEN failed AND pr IN ('1-URGENT', '2-HIGH') THEN o_orderkey END) AS failed_by_seller,
         COUNT(DISTINCT CASE WHEN failed AND pr = '3-MEDIUM' THEN o_orderkey END) AS failed_by_customer,
         COUNT(DISTINCT CASE WHEN failed AND pr IN ('4-NOT SPECIFIED', '5-LOW') THEN o_orderkey END) AS failed_by_platform,
         COUNT(DISTINCT CASE WHEN voucher = 0 THEN o_orderkey END) AS orders_without_voucher,
         COUNT(DISTINCT CASE WHEN valid AND has_chain THEN o_orderkey END) AS chain_orders,
         COUNT(DISTINCT CASE WHEN valid AND has_shop THEN o_orderkey END) AS shop_orders,
         COUNT(DISTINCT CASE WHEN valid AND date_trunc('month', day) = date_trunc('month', first_day) THEN o_orderkey END) AS orders_in_first_month,
         CAST(SUM(CASE WHEN valid THEN gmv END) AS DOUBLE) AS total_gmv,
         CAST(SUM(CASE WHEN valid THEN gfv END) AS DOUBLE) AS total_gfv,
         CAST(SUM(CASE WHEN valid THEN discount * CAST(0.40 AS DECIMAL(4,2)) + voucher * CAST(0.20 AS DECIMAL(4,2)) END) AS DOUBLE) AS seller_paid,
         CAST(SUM(CASE WHEN valid THEN voucher * CAST(0.80 AS DECIMAL(4,2)) END) AS DOUBLE) AS platform_paid,
         CAST(SUM(CASE WHEN valid THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) AS basket,
         CAST(SUM(CASE WHEN valid AND NOT has_chain THEN gfv * CAST(0.15 AS DECIMAL(4,2)) END) AS DOUBLE) AS longtail
  FROM o GROUP BY week, country, city
), seller AS (
  SELECT week, country, city, COUNT(DISTINCT l_suppkey) AS sellers,
         COUNT(DISTINCT CASE WHEN is_chain THEN l_suppkey END) AS chain_sellers,
         COUNT(DISTINCT CASE WHEN is_shop THEN l_suppkey END) AS shop_sellers
  FROM o JOIN line ON line.l_orderkey = o.o_orderkey WHERE valid GROUP BY week, country, city
)
SELECT CAST(main.week AS VARCHAR) AS week, main.country, main.city, day_count, customer_count, new_customer_count, order_count,
       gross_orders, failed_orders, failed_by_seller, failed_by_customer, failed_by_platform, orders_without_voucher,
       chain_orders, shop_orders, orders_in_first_month,
       COALESCE(sellers, 0) AS sellers, COALESCE(chain_sellers, 0) AS chain_sellers, COALESCE(shop_sellers, 0) AS shop_sellers,
       total_gmv, total_gfv, total_gfv / NULLIF(order_count, 0) AS average_food_value,
       basket / NULLIF(order_count, 0) AS average_basket, seller_paid,
       seller_paid / NULLIF(total_gmv, 0) AS seller_paid_share,
       platform_paid / NULLIF(total_gmv, 0) AS platform_paid_share,
       longtail / NULLIF(order_count, 0) AS longtail_commission,
       failed_orders / NULLIF(gross_orders, 0) AS fail_rate,
       failed_by_seller / NULLIF(gross_orders, 0) AS seller_fail_rate,
       (failed_by_customer + failed_by_platform) / NULLIF(gross_orders, 0) AS other_fail_rate
FROM main LEFT JOIN seller USING (week, country, city)

-- key: order_kpi_zones
WITH line AS (
  SELECT l_orderkey, l_suppkey, s_name LIKE '%5' AS is_chain, s_acctbal >= 5000 AS is_shop,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS p, CAST(l_discount AS DECIMAL(4,2)) AS d, CAST(l_tax AS DECIMAL(4,2)) AS x
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
), value AS (
  SELECT l_orderkey, SUM(p) AS gmv, SUM(p * (1 - d)) AS gfv, SUM(p * d) AS discount, SUM(p * x) AS voucher,
         bool_or(is_chain) AS has_chain, bool_or(is_shop) AS has_shop, MIN(l_suppkey) AS first_seller
  FROM line GROUP BY l_orderkey
), first_valid AS (
  SELECT o_custkey, MIN(CAST(o_orderdate AS DATE)) AS first_day FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey
), o AS (
  SELECT CAST(o_orderdate AS DATE) - CAST(dayofweek(o_orderdate) AS INTEGER) AS week, r_name AS country, n_name AS city,
         'zone ' || CAST(CASE WHEN c_custkey % 5 < 4 THEN c_custkey % 5 ELSE first_seller % 4 END AS VARCHAR) AS zone,
         CAST(o_orderdate AS DATE) AS day, o_orderkey, orders.o_custkey, o_orderpriority AS pr, o_totalprice,
         o_orderstatus <> 'P' AS valid, o_orderstatus = 'P' AS failed, first_day, value.*
  FROM orders
  JOIN customer ON c_custkey = orders.o_custkey
  JOIN nation ON n_nationkey = c_nationkey
  JOIN region ON r_regionkey = n_regionkey
  LEFT JOIN value ON l_orderkey = o_orderkey
  LEFT JOIN first_valid ON first_valid.o_custkey = orders.o_custkey
), main AS (
  SELECT week, country, city, zone, COUNT(DISTINCT day) AS day_count,
         COUNT(DISTINCT CASE WHEN valid THEN o_custkey END) AS customer_count,
         COUNT(DISTINCT CASE WHEN valid AND day = first_day THEN o_custkey END) AS new_customer_count,
         COUNT(DISTINCT CASE WHEN valid THEN o_orderkey END) AS order_count,
         COUNT(DISTINCT o_orderkey) AS gross_orders,
         COUNT(DISTINCT CASE WHEN failed THEN o_orderkey END) AS failed_orders,
         COUNT(DISTINCT CASE WHEN failed AND pr IN ('1-URGENT', '2-HIGH') THEN o_orderkey END) AS failed_by_seller,
         COUNT(DISTINCT CASE WHEN failed AND pr = '3-MEDIUM' THEN o_orderkey END) AS failed_by_customer,
         COUNT(DISTINCT CASE WHEN failed AND pr IN ('4-NOT SPECIFIED', '5-LOW') THEN o_orderkey END) AS failed_by_platform,
         COUNT(DISTINCT CASE WHEN voucher = 0 THEN o_orderkey END) AS orders_without_voucher,
         COUNT(DISTINCT CASE WHEN valid AND has_chain THEN o_orderkey END) AS chain_orders,
         COUNT(DISTINCT CASE WHEN valid AND has_shop THEN o_orderkey END) AS shop_orders,
         COUNT(DISTINCT CASE WHEN valid AND date_trunc('month', day) = date_trunc('month', first_day) THEN o_orderkey END) AS orders_in_first_month,
         CAST(SUM(CASE WHEN valid THEN gmv END) AS DOUBLE) AS total_gmv,
         CAST(SUM(CASE WHEN valid THEN gfv END) AS DOUBLE) AS total_gfv,
         CAST(SUM(CASE WHEN valid THEN discount * CAST(0.40 AS DECIMAL(4,2)) + voucher * CAST(0.20 AS DECIMAL(4,2)) END) AS DOUBLE) AS seller_paid,
         CAST(SUM(CASE WHEN valid THEN voucher * CAST(0.80 AS DECIMAL(4,2)) END) AS DOUBLE) AS platform_paid,
         CAST(SUM(CASE WHEN valid THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) AS basket,
         CAST(SUM(CASE WHEN valid AND NOT has_chain THEN gfv * CAST(0.15 AS DECIMAL(4,2)) END) AS DOUBLE) AS longtail
  FROM o GROUP BY week, country, city, zone
), seller AS (
  SELECT week, country, city, zone, COUNT(DISTINCT l_suppkey) AS sellers,
         COUNT(DISTINCT CASE WHEN is_chain THEN l_suppkey END) AS chain_sellers,
         COUNT(DISTINCT CASE WHEN is_shop THEN l_suppkey END) AS shop_sellers
  FROM o JOIN line ON line.l_orderkey = o.o_orderkey WHERE valid GROUP BY week, country, city, zone
)
SELECT CAST(main.week AS VARCHAR) AS week, main.country, main.city, main.zone, day_count, customer_count, new_customer_count, order_count,
       gross_orders, failed_orders, failed_by_seller, failed_by_customer, failed_by_platform, orders_without_voucher,
       chain_orders, shop_orders, orders_in_first_month,
       COALESCE(sellers, 0) AS sellers, COALESCE(chain_sellers, 0) AS chain_sellers, COALESCE(shop_sellers, 0) AS shop_sellers,
       total_gmv, total_gfv, total_gfv / NULLIF(order_count, 0) AS average_food_value,
       basket / NULLIF(order_count, 0) AS average_basket, seller_paid,
       seller_paid / NULLIF(total_gmv, 0) AS seller_paid_share,
       platform_paid / NULLIF(total_gmv, 0) AS platform_paid_share,
       longtail / NULLIF(order_count, 0) AS longtail_commission,
       failed_orders / NULLIF(gross_orders, 0) AS fail_rate,
       failed_by_seller / NULLIF(gross_orders, 0) AS seller_fail_rate,
       (failed_by_customer + failed_by_platform) / NULLIF(gross_orders, 0) AS other_fail_rate
FROM main LEFT JOIN seller USING (week, country, city, zone)

-- key: failure_rates
WITH sold AS (
  SELECT l_partkey, o_orderkey, o_orderstatus, o_orderpriority
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '2001-08-02' - INTERVAL 90 DAY AND DATE '2001-08-02'
), counted AS (
  SELECT p_partkey, p_brand, COUNT(DISTINCT o_orderkey) AS gross_orders,
         COUNT(DISTINCT CASE WHEN o_orderstatus = 'P' THEN o_orderkey END) AS failed,
         COUNT(DISTINCT CASE WHEN o_orderstatus = 'P' AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderkey END) AS by_seller,
         COUNT(DISTINCT CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '3-MEDIUM' THEN o_orderkey END) AS by_customer,
         COUNT(DISTINCT CASE WHEN o_orderstatus = 'P' AND o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN o_orderkey END) AS by_platform
  FROM part LEFT JOIN sold ON l_partkey = p_partkey
  GROUP BY p_partkey, p_brand
)
SELECT *, failed / NULLIF(gross_orders, 0) AS failed_rate, by_seller / NULLIF(gross_orders, 0) AS by_seller_rate,
       by_customer / NULLIF(gross_orders, 0) AS by_customer_rate, by_platform / NULLIF(gross_orders, 0) AS by_platform_rate
FROM counted

-- key: ctas_daily_overview
WITH value AS (
  SELECT l_orderkey, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS gmv,
         SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS gfv,
         SUM(CASE WHEN l_discount > 0.05 THEN CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) END) AS cost,
         COUNT(*) FILTER (WHERE l_discount > 0.05) > 0 AS deal, COUNT(*) FILTER (WHERE l_tax = 0) > 0 AS voucher
  FROM lineitem GROUP BY l_orderkey
), first_valid AS (
  SELECT o_custkey, MIN(CAST(o_orderdate AS DATE)) AS first_day FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey
), o AS (
  SELECT CAST(o_orderdate AS DATE) AS day, o_orderpriority, o_orderstatus <> 'P' AS valid, first_day, gmv, gfv, cost,
         COALESCE(deal, FALSE) AS deal, COALESCE(voucher, FALSE) AS voucher
  FROM orders LEFT JOIN value ON l_orderkey = o_orderkey LEFT JOIN first_valid USING (o_custkey)
)
SELECT CAST(day AS VARCHAR) AS order_day, o_orderpriority, COUNT(*) AS orders,
       COUNT(*) FILTER (WHERE valid) AS valid_orders,
       COUNT(*) FILTER (WHERE valid AND day = first_day) AS first_day_orders,
       COUNT(*) FILTER (WHERE valid AND NOT deal AND NOT voucher) AS organic_orders,
       COUNT(*) FILTER (WHERE valid AND deal AND NOT voucher) AS deal_orders,
       COUNT(*) FILTER (WHERE valid AND NOT deal AND voucher) AS voucher_orders,
       COUNT(*) FILTER (WHERE valid AND deal AND voucher) AS deal_and_voucher_orders,
       CAST(SUM(gmv) FILTER (WHERE valid) AS DOUBLE) AS gmv,
       CAST(SUM(gfv) FILTER (WHERE valid) AS DOUBLE) AS gfv,
       CAST(SUM(cost) FILTER (WHERE valid) AS DOUBLE) AS promo_cost
FROM o GROUP BY day, o_orderpriority

-- key: basket_size
WITH s AS (
  SELECT l_suppkey, COUNT(DISTINCT l_orderkey) AS orders, COUNT(*) AS lines,
         CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS items,
         CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS value
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  WHERE o_orderstatus <> 'P' GROUP BY l_suppkey
)
SELECT *, items / orders AS items_per_order, value / orders AS value_per_order, value / items AS value_per_item FROM s

-- key: fee_rules
WITH line AS (
  SELECT l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
         CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS food,
         CASE WHEN l_returnflag <> 'A' THEN CAST(l_tax AS DECIMAL(4,2))
              WHEN l_quantity > 25 THEN CAST(CEIL(CAST(l_quantity AS DECIMAL(18,2)) * CAST(0.8 AS DECIMAL(4,2))) AS DECIMAL(9,0)) * CAST(0.12 AS DECIMAL(4,2)) + CAST(0.53 AS DECIMAL(4,2))
              ELSE CAST(CEIL(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(9,0)) * CAST(0.12 AS DECIMAL(4,2)) + CAST(0.53 AS DECIMAL(4,2)) END AS fee
  FROM lineitem
), closed AS (
  SELECT l_suppkey, date_trunc('month', MIN(l_shipdate)) AS closed FROM lineitem GROUP BY l_suppkey
)
SELECT l_suppkey, CAST(month AS VARCHAR) AS month, COUNT(*) AS deliveries, CAST(SUM(food) AS DOUBLE) AS food_value,
       CAST(SUM(fee) AS DOUBLE) AS delivery_fees,
       CASE WHEN SUM(food) > 3 AND month <> closed THEN 3 ELSE 0 END AS listing_fee
FROM line JOIN closed USING (l_suppkey)
GROUP BY l_suppkey, month, closed

-- key: subsidy_split
WITH line AS (
  SELECT p_brand, CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS cost,
         CAST(p_size AS DECIMAL(5,2)) * CAST(0.01 AS DECIMAL(3,2)) AS r
  FROM lineitem JOIN part ON p_partkey = l_partkey
), s AS (
  SELECT p_brand, CAST(SUM(cost) AS DOUBLE) AS cost, CAST(SUM(cost * r) AS DOUBLE) AS platform_current,
         CAST(SUM(cost * (1 - r)) AS DOUBLE) AS seller_current,
         CAST(SUM(cost * CAST(0.5 AS DECIMAL(3,2))) AS DOUBLE) AS platform_attributed,
         CAST(SUM(cost * CAST(0.5 AS DECIMAL(3,2))) AS DOUBLE) AS seller_attributed
  FROM line GROUP BY p_brand
)
SELECT *, platform_current / NULLIF(cost, 0) AS platform_share FROM s
