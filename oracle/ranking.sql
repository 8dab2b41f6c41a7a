-- key: win_first_per_key
SELECT o_custkey, o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS first_day, o_orderstatus <> 'P' AS was_valid
FROM orders
QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1

-- key: win_latest_per_key
SELECT conv_id, role, turn, CAST(length(text) AS INTEGER) AS length
FROM conversations
QUALIFY ROW_NUMBER() OVER (PARTITION BY conv_id, role ORDER BY turn DESC, length(text) DESC, text) = 1

-- key: win_rank_pairing
WITH ranked AS (
  SELECT o_custkey, o_orderkey, o_orderpriority,
         ROW_NUMBER() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS place
  FROM orders
)
SELECT u.o_custkey, u.place, u.o_orderkey AS urgent_order, l.o_orderkey AS low_order
FROM ranked u LEFT JOIN ranked l
  ON l.o_custkey = u.o_custkey AND l.place = u.place AND l.o_orderpriority = '5-LOW'
WHERE u.o_orderpriority = '1-URGENT'

-- key: win_qualify_topn
WITH value AS (
  SELECT s_nationkey, s_suppkey, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS value
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY s_nationkey, s_suppkey
)
SELECT s_nationkey, CAST(ROW_NUMBER() OVER w AS INTEGER) AS place, s_suppkey, CAST(value AS DOUBLE) AS value
FROM value
WINDOW w AS (PARTITION BY s_nationkey ORDER BY value DESC, s_suppkey)
QUALIFY ROW_NUMBER() OVER w <= 10

-- key: win_partition_total
SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS value,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) OVER (PARTITION BY l_orderkey) AS DOUBLE) AS order_value,
       COUNT(*) OVER (PARTITION BY l_orderkey) AS order_lines
FROM lineitem

-- key: win_running_sum
SELECT DISTINCT c_mktsegment, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY c_mktsegment ORDER BY CAST(o_orderdate AS DATE)) AS DOUBLE) AS so_far
FROM orders JOIN customer ON c_custkey = o_custkey

-- key: win_running_count
SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day,
       CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS month,
       COUNT(o_orderkey) OVER (PARTITION BY date_trunc('month', o_orderdate) ORDER BY CAST(o_orderdate AS DATE)) AS orders_so_far
FROM orders

-- key: win_partition_avg
SELECT o_orderkey, o_custkey, o_totalprice,
       CAST(SUM(CASE WHEN o_orderstatus <> 'P' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) OVER (PARTITION BY o_custkey) AS DOUBLE)
         / NULLIF(COUNT(CASE WHEN o_orderstatus <> 'P' THEN 1 END) OVER (PARTITION BY o_custkey), 0) AS mean_valid,
       COUNT(CASE WHEN o_orderstatus <> 'P' THEN 1 END) OVER (PARTITION BY o_custkey) AS valid_orders
FROM orders

-- key: topk_limit
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
       CAST(CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) AS INTEGER) AS delay_days
FROM lineitem JOIN orders ON o_orderkey = l_orderkey
ORDER BY delay_days DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
LIMIT 1000

-- key: union_all_padded
SELECT 'customers' AS section, c_nationkey AS city, COUNT(*) AS members,
       CAST(SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS customer_balance, CAST(NULL AS DOUBLE) AS seller_balance
FROM customer GROUP BY c_nationkey
UNION ALL
SELECT 'sellers', s_nationkey, COUNT(*), NULL, CAST(SUM(CAST(s_acctbal AS DECIMAL(18,2))) AS DOUBLE)
FROM supplier GROUP BY s_nationkey

-- key: union_complementary
SELECT CAST(COALESCE(o.month, s.month) AS VARCHAR) AS month, COALESCE(orders, 0) AS orders, COALESCE(shipments, 0) AS shipments
FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, COUNT(*) AS orders FROM orders GROUP BY 1) o
FULL JOIN (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, COUNT(*) AS shipments FROM lineitem GROUP BY 1) s ON s.month = o.month

-- key: win_rank_flag
SELECT o_orderkey, o_custkey, o_orderpriority,
       ROW_NUMBER() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) = 1 AS is_first
FROM orders
