-- key: agg_basic
SELECT l_returnflag, l_linestatus,
       CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_gmv,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS sum_gfv,
       CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / COUNT(l_quantity) AS avg_qty,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(l_extendedprice) AS avg_price,
       MIN(l_extendedprice) AS min_price, MAX(l_extendedprice) AS max_price,
       COUNT(*) AS lines, COUNT(CASE WHEN l_discount > 0.05 THEN 1 END) AS promo_lines
FROM lineitem GROUP BY l_returnflag, l_linestatus

-- key: agg_cond_distinct
SELECT CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS month,
       COUNT(DISTINCT o_custkey) AS customers,
       COUNT(DISTINCT l_suppkey) AS sellers,
       COUNT(DISTINCT CASE WHEN o_orderstatus <> 'P' THEN o_custkey END) AS valid_customers,
       COUNT(DISTINCT CASE WHEN o_orderstatus = 'P' THEN l_suppkey END) AS failing_sellers,
       COUNT(DISTINCT CASE WHEN l_discount > 0.05 THEN l_partkey END) AS promo_products
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
GROUP BY 1

-- key: agg_cond_sum
SELECT o_orderpriority,
       CAST(SUM(CASE WHEN o_orderstatus <> 'P' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS valid_value,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus = 'P') AS DOUBLE) AS failed_value,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus <> 'P') AS DOUBLE)
         / COUNT(*) FILTER (WHERE o_orderstatus <> 'P') AS mean_of_valid,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus <> 'P') AS DOUBLE) / COUNT(*) AS mean_with_zeros
FROM orders GROUP BY o_orderpriority

-- key: agg_countif
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day,
       COUNT(*) FILTER (WHERE event_type = 'view') AS views,
       COUNT(*) FILTER (WHERE event_type = 'purchase') AS purchases,
       COUNT(*) FILTER (WHERE value > 100) AS large
FROM events GROUP BY 1

-- key: agg_sum_distinct
SELECT l_returnflag,
       CAST(SUM(DISTINCT CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS distinct_quantity,
       CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity
FROM lineitem GROUP BY l_returnflag

-- key: agg_concat_distinct
SELECT event_type,
       COUNT(DISTINCT CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR)) AS sessions,
       COUNT(DISTINCT user_id) AS users
FROM events GROUP BY event_type

-- key: agg_string_agg
SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY length(o_orderpriority) DESC, o_orderpriority) AS priorities
FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders)
GROUP BY o_custkey

-- key: agg_string_repeats
SELECT c_custkey, string_agg(o_orderstatus, '' ORDER BY o_orderdate, o_orderstatus) AS states
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT'
GROUP BY c_custkey

-- key: agg_having_dups
SELECT l_orderkey, l_linenumber, COUNT(*) AS copies
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1

-- key: agg_ratio_safe
SELECT l_partkey,
       CAST(SUM(CASE WHEN l_discount > 0.05 THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE)
         / NULLIF(CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE), 0) AS promo_share,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE)
         / NULLIF(COUNT(*) FILTER (WHERE l_discount = 0), 0) AS value_per_undiscounted_line
FROM lineitem GROUP BY l_partkey

-- key: agg_pivot_cond
SELECT l_suppkey,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (WHERE l_returnflag = 'A') AS DOUBLE) AS value_a,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (WHERE l_returnflag = 'N') AS DOUBLE) AS value_n,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) AS value_r,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value
FROM lineitem GROUP BY l_suppkey

-- key: agg_count_bool
SELECT source, COUNT(toxic) AS tested, COUNT(*) FILTER (WHERE toxic = 1) AS toxic, COUNT(*) AS documents
FROM documents LEFT JOIN labels USING (doc_id)
GROUP BY source

-- key: agg_string_formatted
SELECT o_custkey, string_agg(o_orderpriority || ' (' || orders || ', ' || CASE WHEN failed > 0 THEN 'some failed' ELSE 'all fine' END || ')',
                             '; ' ORDER BY o_orderpriority) AS priorities
FROM (SELECT o_custkey, o_orderpriority, COUNT(*) AS orders, COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS failed
      FROM orders GROUP BY 1, 2)
GROUP BY o_custkey

-- key: agg_distinct_rollup
WITH placed AS (
  SELECT CAST(o_orderdate AS DATE) AS day, n_name AS city, o_custkey, o_orderstatus = 'P' AS failed
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
), grains AS (
  SELECT 'day' AS grain, day AS start_day, city, o_custkey, failed FROM placed
  UNION ALL SELECT 'week', day - CAST(dayofweek(day) AS INTEGER), city, o_custkey, failed FROM placed
  UNION ALL SELECT 'month', CAST(date_trunc('month', day) AS DATE), city, o_custkey, failed FROM placed
  UNION ALL SELECT 'month, all cities', CAST(date_trunc('month', day) AS DATE), NULL, o_custkey, failed FROM placed
)
SELECT grain, CAST(start_day AS VARCHAR) AS start_day, city, COUNT(DISTINCT o_custkey) AS customers,
       COUNT(DISTINCT CASE WHEN NOT failed THEN o_custkey END) AS valid_customers, COUNT(DISTINCT CASE WHEN failed THEN o_custkey END) AS failing_customers
FROM grains GROUP BY grain, start_day, city
