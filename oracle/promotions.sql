-- key: proration_by_month
WITH campaign AS (
  SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(MAX(l_quantity) - 5 AS INTEGER) AS e,
         CAST(10000 * SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS HUGEINT) AS cost
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate
), spine AS (
  SELECT o_orderkey, cost, e - s + 1 AS length, unnest(generate_series(s, e, INTERVAL 1 DAY)) AS day FROM campaign
), per_month AS (
  SELECT o_orderkey, CAST(date_trunc('month', day) AS DATE) AS month, COUNT(*) AS days,
         (2 * cost * COUNT(*) + 100 * length) // (200 * length) AS cents
  FROM spine GROUP BY o_orderkey, cost, length, 2
)
SELECT CAST(month AS VARCHAR) AS month, COUNT(*) AS campaigns, CAST(SUM(days) AS BIGINT) AS days,
       CAST(SUM(cents) AS DOUBLE) / 100 AS cost
FROM per_month GROUP BY month

-- key: proration_offline
WITH latest AS (
  SELECT l_returnflag, CAST(l_shipdate AS DATE) AS s, CAST(l_shipdate AS DATE) + CAST(l_quantity - 5 AS INTEGER) AS e,
         CASE WHEN l_discount > 0.05 THEN CAST(10000 * CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS HUGEINT) ELSE 0 END AS cost,
         ROW_NUMBER() OVER () AS ticket
  FROM (SELECT * FROM lineitem
        QUALIFY ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_returnflag
                ORDER BY l_shipdate DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) = 1)
), spine AS (
  SELECT ticket, l_returnflag, cost, e - s + 1 AS length, unnest(generate_series(s, e, INTERVAL 1 DAY)) AS day FROM latest
), per_month AS (
  SELECT ticket, l_returnflag, CAST(date_trunc('month', day) AS DATE) AS month,
         (2 * cost * COUNT(*) * 1000000 + length) // (2 * length) AS cost
  FROM spine GROUP BY ticket, l_returnflag, cost, length, 3
)
SELECT l_returnflag, CAST(month AS VARCHAR) AS month, COUNT(*) AS tickets,
       CAST(CAST(SUM(cost) // 10000000000 AS VARCHAR) || '.' || lpad(CAST(SUM(cost) % 10000000000 AS VARCHAR), 10, '0') AS DOUBLE) AS cost
FROM per_month GROUP BY l_returnflag, month

-- key: date_spine
WITH campaign AS (
  SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(MAX(l_quantity) - 5 AS INTEGER) AS e
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate
), spine AS (
  SELECT unnest(generate_series(s, e, INTERVAL 1 DAY)) AS day FROM campaign
)
SELECT CAST(CAST(day AS DATE) AS VARCHAR) AS day, COUNT(*) AS campaigns FROM spine GROUP BY 1

-- key: run_rate_projection
WITH term AS (
  SELECT p_brand, CAST(substring(p_brand, 7) AS INTEGER) AS k, COUNT(*) AS parts,
         DATE '2001-07-20' - 9 * CAST(substring(p_brand, 7) AS INTEGER) AS s,
         DATE '2001-07-20' + 2 * (CAST(substring(p_brand, 7) AS INTEGER) - 6) AS e
  FROM part GROUP BY p_brand
), first_valid AS (
  SELECT o_custkey, MIN(CAST(o_orderdate AS DATE)) AS first_day FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey
), monthly AS (
  SELECT p_brand, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, MIN(CAST(o_orderdate AS DATE)) AS first_order,
         COUNT(DISTINCT o_orderkey) AS orders,
         COUNT(DISTINCT CASE WHEN o_orderstatus <> 'P' AND CAST(o_orderdate AS DATE) = first_day THEN orders.o_custkey END) AS new_customers,
         CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS cost
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey
  LEFT JOIN first_valid ON first_valid.o_custkey = orders.o_custkey
  WHERE l_discount > 0.05 AND CAST(o_orderdate AS DATE) < DATE '2001-07-20' AND CAST(o_orderdate AS DATE) >= DATE '1999-01-01'
  GROUP BY 1, 2
), rated AS (
  SELECT *, CASE WHEN s <= DATE '2001-07-19' AND e >= DATE '2001-07-19' AND date_trunc('month', first_order) = DATE '2001-07-01'
            THEN CAST(GREATEST(LEAST(e, DATE '2001-07-31'), DATE '2001-07-19') - GREATEST(s, DATE '2001-07-01') + 1 AS DOUBLE)
                 / CAST(DATE '2001-07-19' - GREATEST(s, DATE '2001-07-01') + 1 AS DOUBLE)
            ELSE 1.0 END * cost AS run_rate
  FROM monthly JOIN term USING (p_brand)
)
SELECT p_brand, CAST(month AS VARCHAR) AS month, CAST(s AS VARCHAR) AS start_day, CAST(e AS VARCHAR) AS end_day, orders, new_customers,
       cost, run_rate, run_rate * CAST(0.6 AS DOUBLE) AS run_rate_platform,
       run_rate * (1 - CAST(0.6 AS DOUBLE)) AS run_rate_seller, '2001-07-20' AS run_date
FROM rated

-- key: run_rate_redemptions
WITH daily AS (
  SELECT p_brand, CAST(substring(p_brand, 7) AS INTEGER) AS k, CAST(o_orderdate AS DATE) AS day, COUNT(DISTINCT o_orderkey) AS redemptions,
         CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS cost
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey
  WHERE l_discount > 0.05 AND CAST(o_orderdate AS DATE) < DATE '2001-07-20'
  GROUP BY 1, 2, 3
), coded AS (
  SELECT CASE WHEN k = 1 THEN 'single use' ELSE p_brand END AS code, day, redemptions, cost,
         CASE WHEN k <> 1 THEN DATE '2001-07-20' - 9 * k END AS s, CASE WHEN k <> 1 THEN DATE '2001-07-20' + 2 * (k - 6) END AS e
  FROM daily
), valued AS (
  SELECT *, CASE WHEN e IS NOT NULL AND day >= DATE '2001-07-01' AND day <= LEAST(e, DATE '2001-07-31')
            THEN cost + cost / CAST(DATE '2001-07-20' - GREATEST(s, DATE '2001-07-01') AS DOUBLE)
                        * (LEAST(e, DATE '2001-07-31') - DATE '2001-07-19')
            ELSE 0 END AS projection
  FROM coded
)
SELECT code, CAST(day AS VARCHAR) AS order_day, redemptions, cost,
       CAST(SUM(CAST(projection AS DECIMAL(18,6))) OVER (PARTITION BY code) AS DOUBLE) AS code_projection
FROM valued

-- key: cap_allocation
WITH term AS (
  SELECT p_brand, k, CASE WHEN k = 1 THEN 1 ELSE parts * 15 END AS quantity, k % 5 = 0 AS unlimited, k % 7 = 0 AS global,
         DATE '2001-07-20' - 9 * k AS s, DATE '2001-07-20' + 2 * (k - 6) AS e
  FROM (SELECT p_brand, CAST(substring(p_brand, 7) AS INTEGER) AS k, COUNT(*) AS parts FROM part GROUP BY p_brand)
), o AS (
  SELECT o_orderkey, p_brand, c_mktsegment, CAST(o_orderdate AS DATE) AS day, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
         SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2))) AS cost
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
  WHERE l_discount > 0.05 AND CAST(o_orderdate AS DATE) < DATE '2001-07-20'
  GROUP BY ALL
), cap AS (
  SELECT p_brand, COUNT(DISTINCT o_orderkey) AS all_orders, any_value(quantity) AS quantity, any_value(unlimited) AS unlimited,
         COUNT(DISTINCT CASE WHEN month < DATE '2001-07-01' THEN o_orderkey END) AS before,
         CAST(SUM(CASE WHEN month = DATE '2001-07-01' THEN cost END) AS DOUBLE) / COUNT(CASE WHEN month = DATE '2001-07-01' THEN 1 END) AS mean_value
  FROM o JOIN term USING (p_brand)
  WHERE s < DATE '2001-08-01' AND e >= DATE '2001-07-01'
  GROUP BY p_brand
), shared AS (
  SELECT p_brand, c_mktsegment, CASE WHEN NOT any_value(unlimited) THEN any_value(quantity) - any_value(all_orders) END AS quantity_left,
         COUNT(DISTINCT o_orderkey) / any_value(all_orders) AS share,
         COUNT(DISTINCT o_orderkey) / any_value(all_orders)
           * CASE WHEN NOT any_value(unlimited) THEN (any_value(quantity) - any_value(before)) * any_value(mean_value) END AS segment_cap
  FROM o JOIN cap USING (p_brand) GROUP BY p_brand, c_mktsegment
), monthly AS (
  SELECT p_brand, c_mktsegment, month, COUNT(DISTINCT o_orderkey) AS orders, CAST(SUM(cost) AS DOUBLE) AS cost
  FROM o GROUP BY ALL
), rated AS (
  SELECT monthly.*, quantity, quantity_left, share, segment_cap, (quantity <= 1 OR global OR unlimited) AS free,
         CASE WHEN quantity <= 1 OR global OR unlimited THEN CAST(31 AS DOUBLE) / CAST(19 AS DOUBLE)
              WHEN s <= DATE '2001-07-19' AND e >= DATE '2001-07-19'
              THEN CAST(GREATEST(LEAST(e, DATE '2001-07-31'), DATE '2001-07-19') - GREATEST(s, DATE '2001-07-01') + 1 AS DOUBLE)
                   / CAST(DATE '2001-07-19' - GREATEST(s, DATE '2001-07-01') + 1 AS DOUBLE)
              ELSE 1.0 END AS factor
  FROM monthly JOIN term USING (p_brand) LEFT JOIN shared USING (p_brand, c_mktsegment)
)
SELECT p_brand, c_mktsegment, CAST(month AS VARCHAR) AS month, orders, quantity, quantity_left, share, segment_cap, cost,
       CASE WHEN month <> DATE '2001-07-01' THEN cost
            WHEN free THEN cost * factor
            WHEN segment_cap IS NULL THEN NULL
            ELSE LEAST(cost * factor, GREATEST(segment_cap, cost)) END AS run_rate
FROM rated

-- key: campaign_before_during
WITH campaign AS (
  SELECT p_brand, DATE '1998-01-01' + 10 * k AS s, DATE '1998-01-01' + 10 * k + 20 + k AS e, 20 + k AS n
  FROM (SELECT DISTINCT p_brand, CAST(substring(p_brand, 7) AS INTEGER) AS k FROM part)
), o AS (
  SELECT o_orderkey, p_brand, o_orderpriority, o_orderstatus, CAST(o_orderdate AS DATE) AS day, l_discount > 0.05 AS promo,
         SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS gmv
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey
  WHERE CAST(o_orderdate AS DATE) < DATE '2001-08-02'
  GROUP BY ALL
), during AS (
  SELECT p_brand, s, e, n, COUNT(DISTINCT CASE WHEN day BETWEEN s AND e THEN o_orderkey END) AS orders_during,
         COUNT(DISTINCT CASE WHEN day BETWEEN s AND e AND o_orderstatus = 'P' THEN o_orderkey END) AS failed_during,
         CAST(SUM(CASE WHEN day BETWEEN s AND e THEN gmv END) AS DOUBLE) AS gmv_during
  FROM o JOIN campaign USING (p_brand) WHERE promo GROUP BY ALL
), before AS (
  SELECT p_brand, COUNT(DISTINCT o_orderkey) AS orders_before,
         COUNT(DISTINCT CASE WHEN o_orderstatus = 'P' THEN o_orderkey END) AS failed_before, CAST(SUM(gmv) AS DOUBLE) AS gmv_before
  FROM o JOIN campaign USING (p_brand)
  WHERE NOT promo AND day >= s - n AND day <= s
    AND (p_brand, o_orderpriority) IN (SELECT (p_brand, o_orderpriority) FROM o WHERE promo)
  GROUP BY p_brand
), named AS (
  SELECT p_brand, string_agg(o_orderpriority, ',' ORDER BY length(o_orderpriority) DESC, o_orderpriority) AS priorities
  FROM (SELECT DISTINCT p_brand, o_orderpriority FROM o WHERE promo) GROUP BY p_brand
)
SELECT p_brand, CAST(s AS VARCHAR) AS start_day, CAST(e AS VARCHAR) AS end_day, n AS days, orders_during, failed_during, gmv_during,
       COALESCE(orders_before, 0) AS orders_before, COALESCE(failed_before, 0) AS failed_before, COALESCE(gmv_before, 0) AS gmv_before, priorities
FROM during LEFT JOIN before USING (p_brand) JOIN named USING (p_brand)

-- key: campaign_single_pass
WITH campaign AS (
  SELECT p_brand, DATE '1998-01-01' + 10 * k AS s, DATE '1998-01-01' + 10 * k + 20 + k AS e, 20 + k AS n
  FROM (SELECT DISTINCT p_brand, CAST(substring(p_brand, 7) AS INTEGER) AS k FROM part)
), o AS (
  SELECT o_orderkey, p_brand, s, e, n, o_orderstatus, CAST(o_orderdate AS DATE) AS day, CAST(l_extendedprice AS DECIMAL(18,2)) AS gmv
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN campaign USING (p_brand)
  WHERE CAST(o_orderdate AS DATE) < DATE '2001-08-02' AND l_discount > 0.05
)
SELECT p_brand, CAST(s AS VARCHAR) AS start_day, CAST(e AS VARCHAR) AS end_day, n AS days,
       COUNT(DISTINCT CASE WHEN day BETWEEN s AND e THEN o_orderkey END) AS orders_during,
       COUNT(DISTINCT CASE WHEN day BETWEEN s AND e AND o_orderstatus = 'P' THEN o_orderkey END) AS failed_during,
       CAST(SUM(CASE WHEN day BETWEEN s AND e THEN gmv END) AS DOUBLE) AS gmv_during,
       COUNT(DISTINCT CASE WHEN day BETWEEN s - n AND s THEN o_orderkey END) AS orders_before,
       COUNT(DISTINCT CASE WHEN day BETWEEN s - n AND s AND o_orderstatus = 'P' THEN o_orderkey END) AS failed_before,
       CAST(SUM(CASE WHEN day BETWEEN s - n AND s THEN gmv END) AS DOUBLE) AS gmv_before
FROM o GROUP BY p_brand, s, e, n

-- key: promo_performance
WITH first_valid AS (
  SELECT o_custkey, MIN(CAST(o_orderdate AS DATE)) AS first_day FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey
), o AS (
  SELECT p_brand, l_suppkey, o_orderkey, o_orderstatus <> 'P' AS valid, CAST(o_orderdate AS DATE) AS day, first_day,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS gmv, CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS cost
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey LEFT JOIN first_valid USING (o_custkey)
  WHERE l_discount > 0.05
)
SELECT p_brand, l_suppkey, COUNT(DISTINCT o_orderkey) AS orders,
       COUNT(DISTINCT CASE WHEN valid THEN o_orderkey END) AS valid_orders,
       COUNT(DISTINCT CASE WHEN NOT valid THEN o_orderkey END) AS wasted_orders,
       COUNT(DISTINCT CASE WHEN valid AND day = first_day THEN o_orderkey END) AS first_day_orders,
       CAST(SUM(CASE WHEN valid THEN gmv END) AS DOUBLE) AS gmv,
       CAST(SUM(CASE WHEN valid THEN cost * CAST(0.6 AS DECIMAL(4,2)) END) AS DOUBLE) AS platform_subsidy,
       CAST(SUM(CASE WHEN valid THEN cost * CAST(0.4 AS DECIMAL(4,2)) END) AS DOUBLE) AS seller_subsidy
FROM o GROUP BY p_brand, l_suppkey
