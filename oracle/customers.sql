-- key: recency_churn
WITH value AS (
  SELECT l_orderkey, SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS gfv,
         MAX(l_discount) > 0.05 AS promo, MIN(l_tax) = 0 AS voucher
  FROM lineitem GROUP BY l_orderkey
), last AS (
  SELECT o_custkey, MAX(CAST(o_orderdate AS DATE)) AS last_day FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey
), feature AS (
  SELECT o_custkey, COUNT(CASE WHEN o_orderstatus <> 'P' THEN 1 END) AS valid_orders, COUNT(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS failed_orders,
         COUNT(CASE WHEN promo THEN 1 END) AS promo_orders, COUNT(CASE WHEN voucher THEN 1 END) AS voucher_orders,
         CAST(SUM(CASE WHEN o_orderstatus <> 'P' THEN gfv END) AS DOUBLE) AS spend
  FROM orders LEFT JOIN value ON l_orderkey = o_orderkey
  WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '2001-02-02' AND DATE '2001-08-02'
  GROUP BY o_custkey
)
SELECT last.o_custkey, c_mktsegment, CAST(last_day AS VARCHAR) AS last_day, CAST(DATE '2001-08-02' - last_day AS INTEGER) AS days_idle,
       COALESCE(valid_orders, 0) AS valid_orders, COALESCE(failed_orders, 0) AS failed_orders,
       COALESCE(promo_orders, 0) AS promo_orders, COALESCE(voucher_orders, 0) AS voucher_orders,
       spend, spend / NULLIF(valid_orders, 0) AS mean_spend, DATE '2001-08-02' - last_day > 28 AS is_churned
FROM last JOIN customer ON c_custkey = last.o_custkey LEFT JOIN feature ON feature.o_custkey = last.o_custkey

-- key: lapsed_customers
SELECT o_custkey, c_name, COUNT(*) AS orders, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value,
       CAST(MAX(CAST(o_orderdate AS DATE)) AS VARCHAR) AS last_day
FROM orders JOIN customer ON c_custkey = o_custkey
WHERE o_orderstatus <> 'P' AND CAST(o_orderdate AS DATE) BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'
  AND NOT EXISTS (SELECT 1 FROM orders n WHERE n.o_custkey = orders.o_custkey AND n.o_orderstatus <> 'P'
                  AND CAST(n.o_orderdate AS DATE) BETWEEN DATE '2001-01-01' AND DATE '2001-08-02')
GROUP BY o_custkey, c_name
ORDER BY SUM(CAST(o_totalprice AS DECIMAL(18,2))) DESC, o_custkey
LIMIT 600

-- key: migration_report
WITH sold AS (
  SELECT o_orderkey, o_custkey, o_orderstatus <> 'P' AS valid, s_name, CAST(l_extendedprice AS DECIMAL(18,2)) AS gmv,
         CASE WHEN CAST(o_orderdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1999-06-30' THEN 'Before'
              WHEN CAST(o_orderdate AS DATE) BETWEEN DATE '1999-07-01' AND DATE '2001-08-02' THEN 'After' END AS period,
         lower(s_name) LIKE '%' || lower('#00000001') || '%' AS matching
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey
), lost AS (
  SELECT o_custkey FROM sold WHERE valid AND matching AND period = 'Before'
  EXCEPT SELECT o_custkey FROM sold WHERE valid AND matching AND period = 'After'
), theirs AS (
  SELECT * FROM sold WHERE o_custkey IN (SELECT o_custkey FROM lost)
), section AS (
  SELECT period AS section, CAST(NULL AS VARCHAR) AS seller, COUNT(DISTINCT CASE WHEN valid THEN o_custkey END) AS customers,
         COUNT(DISTINCT CASE WHEN valid THEN o_orderkey END) AS orders, COUNT(DISTINCT CASE WHEN NOT valid THEN o_orderkey END) AS failed,
         CAST(SUM(CASE WHEN valid THEN gmv END) AS DOUBLE) AS gmv
  FROM theirs WHERE period IS NOT NULL GROUP BY period
  UNION ALL
  (SELECT 'Sellers after', s_name, COUNT(DISTINCT o_custkey), COUNT(DISTINCT o_orderkey), NULL, CAST(SUM(gmv) AS DOUBLE)
   FROM theirs WHERE period = 'After' AND valid GROUP BY s_name
   ORDER BY COUNT(DISTINCT o_orderkey) DESC, s_name LIMIT 20)
)
SELECT section, seller, customers, orders, failed, gmv, gmv / NULLIF(orders, 0) AS mean_value FROM section

-- key: customer_base_growth
WITH o AS (
  SELECT o_orderkey, o_custkey, o_orderdate, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, MIN(s_nationkey) AS city
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey
  WHERE o_orderstatus <> 'P' GROUP BY o_orderkey, o_custkey, o_orderdate
), first AS (
  SELECT o_custkey, city, month FROM o QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1
), cell AS (
  SELECT o.month, first.city, COUNT(DISTINCT o_custkey) AS active_customers,
         COUNT(DISTINCT CASE WHEN o.month = first.month THEN o_custkey END) AS new_customers
  FROM o JOIN first USING (o_custkey) GROUP BY o.month, first.city
)
SELECT CAST(month AS VARCHAR) AS month, city, new_customers, active_customers,
       CAST(SUM(new_customers) OVER (PARTITION BY city ORDER BY month) AS BIGINT) AS customers_so_far
FROM cell

-- key: new_customer_flags
WITH sold AS (
  SELECT DISTINCT o_orderkey, o_custkey, l_suppkey, CAST(o_orderdate AS DATE) AS day
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'
), first AS (
  SELECT o_custkey, MIN(CAST(o_orderdate AS DATE)) AS first_day FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey
), flagged AS (
  SELECT sold.*, first_day, MIN(day) OVER (PARTITION BY o_custkey, l_suppkey) AS seller_day FROM sold JOIN first USING (o_custkey)
)
SELECT CAST(day AS VARCHAR) AS order_day, COUNT(DISTINCT o_orderkey) AS orders,
       COUNT(DISTINCT CASE WHEN day <= first_day THEN o_orderkey END) AS new_to_platform,
       COUNT(DISTINCT CASE WHEN day <= seller_day THEN o_orderkey END) AS new_to_seller
FROM flagged GROUP BY day

-- key: tenure_buckets
WITH l AS (
  SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, MIN(CAST(l_shipdate AS DATE)) OVER (PARTITION BY l_suppkey) AS first_day,
         CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS value
  FROM lineitem
)
SELECT l_suppkey, CASE WHEN day - first_day < 30 THEN '0-30 days' WHEN day - first_day < 60 THEN '31-60 days'
                       WHEN day - first_day < 90 THEN '61-90 days' ELSE '90+ days' END AS tenure,
       COUNT(DISTINCT day) AS days, COUNT(*) AS lines, CAST(SUM(value) AS DOUBLE) AS value
FROM l GROUP BY 1, 2

-- key: tenure_running
WITH first AS (
  SELECT o_custkey, MIN(CAST(o_orderdate AS DATE)) AS first_day FROM orders GROUP BY o_custkey
), l AS (
  SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, CAST(l_quantity AS DECIMAL(18,2)) AS hours,
         CASE WHEN CAST(o_orderdate AS DATE) - first_day < 7 THEN '0-7 days' ELSE '0-15 days' END AS tenure
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN first USING (o_custkey)
  WHERE CAST(o_orderdate AS DATE) - first_day < 15
)
SELECT DISTINCT o_custkey, tenure, CAST(day AS VARCHAR) AS day,
       COUNT(*) OVER w AS lines, CAST(SUM(hours) OVER w AS DOUBLE) AS hours
FROM l WINDOW w AS (PARTITION BY o_custkey, tenure ORDER BY day)
