-- key: order_billing
WITH l AS (
  SELECT l_orderkey, SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS food,
         SUM(CASE WHEN l_discount > 0.05 THEN CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) END) AS d,
         SUM(CASE WHEN l_tax > 0.06 THEN CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)) END) AS v
  FROM lineitem GROUP BY l_orderkey
), s AS (
  SELECT orders.*, COALESCE(food, 0) AS food, ROUND(COALESCE(v, 0), 2) AS v, ROUND(COALESCE(v * CAST(0.8 AS DECIMAL(4,2)), 0), 2) AS pv,
         ROUND(COALESCE(v * CAST(0.2 AS DECIMAL(4,2)), 0), 2) AS sv, ROUND(COALESCE(d, 0), 2) AS d,
         ROUND(COALESCE(d * CAST(0.6 AS DECIMAL(4,2)), 0), 2) AS pd, ROUND(COALESCE(d * CAST(0.4 AS DECIMAL(4,2)), 0), 2) AS sd
  FROM orders LEFT JOIN l ON l_orderkey = o_orderkey
  WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'
)
SELECT o_orderkey, o_custkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS order_day, o_orderpriority, o_orderstatus <> 'P' AS is_valid, o_totalprice,
       CAST(food AS DOUBLE) AS food_value, CAST(v AS DOUBLE) AS voucher, CAST(pv AS DOUBLE) AS platform_voucher, CAST(sv AS DOUBLE) AS seller_voucher,
       CAST(d AS DOUBLE) AS discount, CAST(pd AS DOUBLE) AS platform_discount, CAST(sd AS DOUBLE) AS seller_discount, CAST(pv + pd AS DOUBLE) AS platform_total
FROM s

-- key: seller_compliance
WITH product AS (
  SELECT l_suppkey, COUNT(DISTINCT l_partkey) AS products, COUNT(DISTINCT CASE WHEN p_size > 10 THEN l_partkey END) AS with_picture
  FROM lineitem JOIN part ON p_partkey = l_partkey WHERE lower(p_name) NOT LIKE '%widget%' GROUP BY l_suppkey
), trade AS (
  SELECT l_suppkey, MIN(CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END) AS first_valid_day,
         COUNT(DISTINCT CASE WHEN o_orderdate >= DATE '2001-07-05' THEN o_orderkey END) AS gross_orders,
         COUNT(DISTINCT CASE WHEN o_orderdate >= DATE '2001-07-05' AND o_orderstatus <> 'P' THEN o_orderkey END) AS valid_orders,
         COUNT(DISTINCT CASE WHEN o_orderdate >= DATE '2001-07-05' AND o_orderstatus = 'P' THEN o_orderkey END) AS failed_orders,
         CAST(SUM(CASE WHEN o_orderdate >= DATE '2001-07-05' AND o_orderstatus <> 'P' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS gmv,
         CAST(SUM(CASE WHEN o_orderdate >= DATE '2001-07-05' AND o_orderstatus <> 'P' THEN CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) ELSE 0 END) AS DOUBLE) AS gfv
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_suppkey
)
SELECT s_suppkey AS l_suppkey, s_name, products, with_picture, CAST(first_valid_day AS VARCHAR) AS first_valid_day, gross_orders, valid_orders, failed_orders,
       gmv, gfv, failed_orders / NULLIF(gross_orders, 0) AS fail_rate, gfv / NULLIF(valid_orders, 0) AS mean_food_value
FROM supplier LEFT JOIN product ON product.l_suppkey = s_suppkey LEFT JOIN trade ON trade.l_suppkey = s_suppkey
WHERE lower(s_name) NOT LIKE '%test%'

-- key: seller_contracts
WITH trial AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS place
  FROM lineitem WHERE l_returnflag = 'R'
), standing AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS place
  FROM lineitem WHERE l_returnflag = 'N'
), product AS (
  SELECT l_suppkey, COUNT(DISTINCT l_partkey) AS products FROM lineitem GROUP BY l_suppkey
)
SELECT s.l_suppkey, CAST(CAST(s.l_shipdate AS DATE) AS VARCHAR) AS since, products, s.l_discount AS standing, COALESCE(t.l_discount, s.l_discount) AS with_trial
FROM standing s LEFT JOIN trial t ON t.l_suppkey = s.l_suppkey AND t.place = s.place JOIN product p ON p.l_suppkey = s.l_suppkey
WHERE s.place = 1

-- key: deals_by_category
WITH deal AS (
  SELECT DISTINCT p_brand, p_type, unnest([p_size, p_size + 1]) AS category FROM part
), title AS (
  SELECT p_brand, p_size, MIN(p_name) AS title FROM part GROUP BY 1, 2
)
SELECT deal.p_brand, p_type, CAST(category AS VARCHAR) AS category, title
FROM deal LEFT JOIN title ON title.p_brand = deal.p_brand AND title.p_size = category

-- key: idle_products
WITH sold AS (
  SELECT l_partkey, COUNT(DISTINCT o_orderkey) AS orders, COUNT(DISTINCT CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END) AS valid_orders
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '2001-08-02' - INTERVAL 90 DAY AND DATE '2001-08-02' GROUP BY l_partkey
), sales AS (
  SELECT l_partkey, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS value FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey
)
SELECT p_partkey AS l_partkey, p_brand,
       COALESCE(CASE WHEN value > 500000 THEN 'A' WHEN value IS NOT NULL THEN 'B' END, CASE WHEN p_retailprice > 1000 THEN 'C' ELSE 'D' END) AS value_class,
       COALESCE(orders, 0) AS orders, COALESCE(valid_orders, 0) AS valid_orders, COALESCE(orders, 0) - COALESCE(valid_orders, 0) AS failed_orders,
       (orders - valid_orders) / NULLIF(orders, 0) AS fail_rate, orders IS NULL AS is_idle
FROM part LEFT JOIN sold ON sold.l_partkey = p_partkey LEFT JOIN sales ON sales.l_partkey = p_partkey

-- key: ticket_periods
SELECT l_orderkey, l_returnflag, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS cost, strftime(l_shipdate, '%Y-%m') AS month,
       CASE WHEN l_quantity * 2 <= 30 THEN '1 month' WHEN l_quantity * 2 <= 60 THEN '2 months' WHEN l_quantity * 2 <= 90 THEN '3 months' END AS period
FROM lineitem WHERE l_shipdate >= DATE '2001-08-02' - INTERVAL 24 MONTH
QUALIFY ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_returnflag, CAST(l_quantity AS INTEGER)
                           ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_linenumber, l_extendedprice) = 1

-- key: purchase_orders
WITH l AS (
  SELECT l_orderkey, SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS gfv FROM lineitem GROUP BY l_orderkey
)
SELECT o_orderkey, c_nationkey, CASE WHEN c_nationkey < 5 THEN CAST(ROUND(COALESCE(gfv, 0), 0) AS DOUBLE) ELSE CAST(ROUND(COALESCE(gfv, 0), 2) AS DOUBLE) END AS value,
       CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS created, o_orderstatus
FROM orders LEFT JOIN l ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey
WHERE date_trunc('month', o_orderdate) = DATE '2001-05-01' AND o_orderpriority NOT LIKE '%NOT%'

-- key: platform_failures
WITH stop AS (
  SELECT DISTINCT l_suppkey, o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS value
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '2000-12-01' AND DATE '2001-01-31' AND o_orderstatus = 'P' AND o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW')
)
SELECT l_suppkey, COUNT(*) AS failed_orders, CAST(SUM(DISTINCT value) AS DOUBLE) AS distinct_value, CAST(SUM(value) AS DOUBLE) AS value
FROM stop GROUP BY l_suppkey

-- key: promo_keyword_usage
WITH first_valid AS (
  SELECT o_custkey, MIN(CAST(o_orderdate AS DATE)) AS first_day FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey
), o AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_orderdate AS DATE) AS day, first_day,
         SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2))) AS cost
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey LEFT JOIN first_valid USING (o_custkey)
  WHERE lower(p_name) LIKE '%blue%' AND l_discount > 0.05
  GROUP BY ALL
)
SELECT CAST(CAST(date_trunc('month', day) AS DATE) AS VARCHAR) AS month, COUNT(DISTINCT o_custkey) AS customers,
       COUNT(DISTINCT CASE WHEN o_orderstatus <> 'P' AND day = first_day THEN o_custkey END) AS new_customers,
       COUNT(*) AS orders, COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS failed_orders, CAST(SUM(cost) AS DOUBLE) AS cost
FROM o GROUP BY 1

-- key: orders_with_products
SELECT o_orderkey, o_custkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS order_day, COUNT(*) AS lines, COUNT(DISTINCT p_name) AS names
FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
WHERE o_orderstatus <> 'P' AND p_name IN ('red bolt', 'hot gear', 'small ring')
GROUP BY 1, 2, 3
