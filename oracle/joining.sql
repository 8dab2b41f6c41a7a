-- key: join_inner
SELECT s_nationkey, COUNT(*) AS lines,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value
FROM lineitem
JOIN orders ON o_orderkey = l_orderkey
JOIN customer ON c_custkey = o_custkey
JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey
GROUP BY s_nationkey

-- key: join_left_star
SELECT r_name, c_mktsegment, p_type, COUNT(*) AS lines,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS gmv,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS gfv
FROM lineitem
LEFT JOIN orders ON o_orderkey = l_orderkey
LEFT JOIN customer ON c_custkey = o_custkey
LEFT JOIN part ON p_partkey = l_partkey
LEFT JOIN supplier ON s_suppkey = l_suppkey
LEFT JOIN nation ON n_nationkey = s_nationkey
LEFT JOIN region ON r_regionkey = n_regionkey
GROUP BY r_name, c_mktsegment, p_type

-- key: join_left_on_predicate
SELECT p_partkey, p_brand, COALESCE(lines, 0) AS lines, quantity
FROM part
LEFT JOIN (
  SELECT l_partkey, COUNT(*) AS lines, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey
   AND CAST(o_orderdate AS DATE) BETWEEN DATE '2001-08-02' - INTERVAL 90 DAY AND DATE '2001-08-02'
  GROUP BY l_partkey
) ON l_partkey = p_partkey AND lines > 1

-- key: join_interval_rows
WITH seller AS (
  SELECT s_suppkey, s_nationkey, DATE '1998-01-01' + CAST(s_suppkey AS INTEGER) % 400 AS opens FROM supplier
), span AS (
  SELECT s_suppkey, s_nationkey, opens, opens + CAST(s_suppkey AS INTEGER) % 90 AS closes FROM seller
), sold AS (
  SELECT c_nationkey, CAST(o_orderdate AS DATE) AS day, COUNT(*) AS orders
  FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2
)
SELECT s_suppkey, CAST(opens AS VARCHAR) AS opens, CAST(closes AS VARCHAR) AS closes, CAST(day AS VARCHAR) AS order_day, orders
FROM span LEFT JOIN sold ON c_nationkey = s_nationkey AND day BETWEEN opens AND closes

-- key: join_left_semi
SELECT o_orderstatus, o_orderpriority, COUNT(*) AS orders,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value
FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 2500)
GROUP BY o_orderstatus, o_orderpriority

-- key: join_expr_key
WITH mapping(segment, channel, share) AS (
  VALUES ('automobile', 'Partners', '20'), ('building', 'Corporate', '35'),
         ('furniture', 'Retail', '50'), ('household', 'Retail', '60')
)
SELECT COALESCE(channel, 'Others') AS channel, replace(o_orderpriority, '-', '_') AS priority,
       COUNT(*) AS orders,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(COALESCE(CAST(share AS INTEGER), 100) / 100 AS DECIMAL(5,2))) AS DOUBLE) AS budgeted
FROM orders
JOIN customer ON c_custkey = o_custkey
LEFT JOIN mapping ON segment = lower(c_mktsegment)
GROUP BY 1, 2

-- key: join_fx_date
WITH line AS (
  SELECT s_nationkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, l_returnflag = 'R' AS refunded,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS goods,
         CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS discount
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
), summed AS (
  SELECT s_nationkey, month, refunded, CAST(SUM(goods) AS DOUBLE) AS goods, CAST(SUM(discount) AS DOUBLE) AS discount
  FROM line GROUP BY ALL
)
SELECT s_nationkey, CAST(month AS VARCHAR) AS month, refunded,
       CASE WHEN refunded THEN goods ELSE -discount END
       / CAST(CAST((100 + s_nationkey * 3 + month(month)) / 100.0 AS DECIMAL(9,4)) AS DOUBLE) AS cost
FROM summed
