-- key: earnings_consolidation
WITH l AS (
  SELECT *, CAST(l_shipdate AS DATE) AS day, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount FROM lineitem
), base AS (
  SELECT l_suppkey AS courier, day, SUM(CASE WHEN l_discount <> 0 AND l_linestatus = 'O' THEN amount END) AS per_hour,
         SUM(CASE WHEN l_discount <> 0 AND l_linestatus <> 'O' THEN amount END) AS per_delivery,
         SUM(CASE WHEN l_discount = 0 THEN amount END) AS fallback, SUM(CAST(l_quantity AS DECIMAL(18,2))) AS hours
  FROM l WHERE l_returnflag = 'N' GROUP BY 1, 2
), adjustment AS (
  SELECT l_suppkey AS courier, day, SUM(amount) AS adjustment FROM l WHERE l_returnflag = 'R' GROUP BY 1, 2
), bonus AS (
  SELECT l_suppkey AS courier, day, SUM(amount) AS bonus FROM l WHERE l_returnflag = 'A' GROUP BY 1, 2
), delivery AS (
  SELECT l_suppkey AS courier, day, COUNT(DISTINCT l_orderkey) AS deliveries FROM l GROUP BY 1, 2
)
SELECT courier, CAST(day AS VARCHAR) AS work_day, CAST(per_hour AS DOUBLE) AS per_hour, CAST(per_delivery AS DOUBLE) AS per_delivery,
       CAST(fallback AS DOUBLE) AS fallback, CAST(adjustment AS DOUBLE) AS adjustment, CAST(bonus AS DOUBLE) AS bonus,
       CAST(hours AS DOUBLE) AS hours, deliveries,
       CAST(COALESCE(per_hour, 0) + COALESCE(per_delivery, 0) + COALESCE(fallback, 0) + COALESCE(adjustment, 0) + COALESCE(bonus, 0) AS DOUBLE) AS total
FROM base LEFT JOIN adjustment USING (courier, day) LEFT JOIN bonus USING (courier, day) LEFT JOIN delivery USING (courier, day)

-- key: earnings_buckets
WITH m AS (
  SELECT l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, COUNT(DISTINCT CAST(l_shipdate AS DATE)) AS days,
         SUM(CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS DECIMAL(18,2)) END) AS hours
  FROM lineitem GROUP BY 1, 2
), r AS (SELECT *, CAST(hours AS DOUBLE) / days AS x FROM m)
SELECT CAST(month AS VARCHAR) AS month,
       CASE WHEN x IS NULL OR x > 40 THEN 'over 40' WHEN x > 30 THEN '30-40' WHEN x > 20 THEN '20-30' WHEN x > 10 THEN '10-20' ELSE '0-10' END AS hours_per_day,
       COUNT(*) AS couriers, CAST(SUM(hours) AS DOUBLE) AS hours
FROM r GROUP BY 1, 2

-- key: latest_contract_max
SELECT l_suppkey, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity
FROM lineitem
QUALIFY RANK() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC) = 1

-- key: rider_activity_daily
WITH stop AS (
  SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, l_orderkey, COUNT(*) > 1 AS stacked, MAX(l_tax) > 0.05 AS late
  FROM lineitem GROUP BY 1, 2, 3
), city AS (
  SELECT s_suppkey AS l_suppkey, n_name AS city FROM supplier JOIN nation ON n_nationkey = s_nationkey
), delivered AS (
  SELECT city, day, COUNT(*) AS deliveries, COUNT(DISTINCT l_suppkey) AS active_couriers, COUNT(*) FILTER (WHERE stacked) AS stacked,
         COUNT(*) FILTER (WHERE stacked AND late) AS stacked_late, COUNT(*) FILTER (WHERE NOT stacked AND late) AS single_late
  FROM stop JOIN city USING (l_suppkey) GROUP BY city, day
), booked AS (
  SELECT city, CAST(l_shipdate AS DATE) AS day, COUNT(DISTINCT l_suppkey) AS booked_couriers,
         CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS booked_hours
  FROM lineitem JOIN city USING (l_suppkey) WHERE l_returnflag = 'N' GROUP BY 1, 2
)
SELECT city, CAST(day AS VARCHAR) AS work_day, deliveries, active_couriers, stacked, stacked_late, single_late,
       COALESCE(booked_couriers, 0) AS booked_couriers, booked_hours, deliveries / NULLIF(booked_hours, 0) AS deliveries_per_hour
FROM delivered LEFT JOIN booked USING (city, day)

-- key: availability_ratio
WITH s AS (
  SELECT l_suppkey, SUM(CAST(l_quantity AS DECIMAL(18,2)) * 3600) AS open,
         SUM(CAST(l_quantity AS DECIMAL(18,2)) * 3600 * CAST(l_tax AS DECIMAL(4,2)))
         + SUM(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS DECIMAL(18,2)) * 60 ELSE 0 END) AS closed
  FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '2001-08-02' - INTERVAL 60 DAY AND DATE '2001-08-02'
  GROUP BY l_suppkey
)
SELECT s_suppkey, s_name, CAST(open AS DOUBLE) AS open_seconds, CAST(closed AS DOUBLE) AS closed_seconds,
       CAST(closed AS DOUBLE) / NULLIF(CAST(open AS DOUBLE), 0) AS closed_share
FROM supplier LEFT JOIN s ON l_suppkey = s_suppkey

-- key: delivery_fee_by_weekday
WITH stop AS (
  SELECT l_suppkey, o_orderkey, o_orderpriority, CAST(o_orderdate AS DATE) AS date,
         CAST(SUM(CASE WHEN l_quantity > 25 THEN CAST(l_quantity * 4 / 5 AS DECIMAL(18,2)) ELSE CAST(l_quantity AS DECIMAL(18,2)) END) AS DOUBLE) / COUNT(*) AS km,
         MAX(CAST(l_tax AS DECIMAL(4,2))) AS booked
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  WHERE o_orderdate >= DATE '2001-08-02' - INTERVAL 12 MONTH
  GROUP BY ALL
), fee AS (
  SELECT l_suppkey, date, CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(CEIL(km) AS INTEGER) * CAST(0.12 AS DECIMAL(4,2)) + CAST(0.53 AS DECIMAL(4,2)) ELSE booked END AS fee
  FROM stop
)
SELECT strftime(date, '%Y-%m') AS month, strftime(date, '%G-%V') AS week, isodow(date) || ' - ' || strftime(date, '%a') AS weekday, l_suppkey,
       CAST(SUM(fee) AS DOUBLE) AS fees, COUNT(*) AS orders, CAST(SUM(fee) AS DOUBLE) / COUNT(*) AS mean_fee
FROM fee GROUP BY 1, 2, 3, 4

-- key: courier_monthly_work
SELECT l_suppkey AS courier, year(l_shipdate) AS year, month(l_shipdate) AS month,
       CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) * 36 AS DOUBLE) / 3600 AS hours,
       COUNT(DISTINCT CAST(l_shipdate AS DATE)) AS shifts, COUNT(*) FILTER (WHERE l_returnflag <> 'R') AS completed,
       CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) * 100 AS DOUBLE) AS pickup_metres,
       CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) * 200 AS DOUBLE) AS dropoff_metres,
       CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) * 300 AS DOUBLE) / 1000 AS total_km
FROM lineitem GROUP BY 1, 2, 3

-- key: shift_creation
SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS work_day, l_suppkey AS courier, n_name AS city, COUNT(DISTINCT l_orderkey) AS shifts,
       COUNT(*) FILTER (WHERE l_linestatus <> 'O') AS own, COUNT(*) FILTER (WHERE l_linestatus = 'O') AS automation
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey
GROUP BY 1, 2, 3

-- key: earnings_streams
WITH basic AS (
  SELECT l_suppkey AS courier, CAST(l_shipdate AS DATE) AS d,
    SUM(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (l_discount <> 0 AND l_linestatus = 'O') AS per_hour,
    SUM(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (l_discount <> 0 AND l_linestatus <> 'O') AS per_delivery,
    SUM(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (l_discount = 0) AS fallback
  FROM lineitem WHERE l_returnflag = 'N' AND CAST(l_shipdate AS DATE) BETWEEN DATE '2001-01-01' AND DATE '2001-01-31' GROUP BY ALL
), scoring AS (
  SELECT o_custkey % 100 AS courier, CAST(o_orderdate AS DATE) AS d, 
         SUM(CAST(round(o_totalprice * 100) AS BIGINT)) AS scoring
  FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL
), special AS (
  SELECT user_id AS courier, CAST(ts - INTERVAL 23 YEAR AS DATE) AS d, COUNT(*) * 2500 AS special FROM events WHERE event_type = 'signup' GROUP BY ALL
), tips AS (
  SELECT user_id AS courier, CAST(ts - INTERVAL 23 YEAR AS DATE) AS d, SUM(CAST(round(value * 100) AS BIGINT)) AS tips FROM events WHERE event_type = 'purchase' GROUP BY ALL
), work AS (
  SELECT o_custkey % 100 AS courier, CAST(o_orderdate AS DATE) AS d, COUNT(*) FILTER (o_orderstatus <> 'P') AS deliveries, COUNT(*) AS orders,
         SUM(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (o_orderstatus <> 'P') AS metres
  FROM orders GROUP BY ALL
), days AS (
  SELECT * FROM basic LEFT JOIN scoring USING (courier, d) LEFT JOIN special USING (courier, d) LEFT JOIN tips USING (courier, d) LEFT JOIN work USING (courier, d)
), summed AS (
  SELECT courier, coalesce(SUM(per_hour), 0) AS per_hour, coalesce(SUM(per_delivery), 0) AS per_delivery, coalesce(SUM(fallback), 0) AS fallback,
         coalesce(SUM(scoring), 0) AS scoring, coalesce(SUM(special), 0) AS special, coalesce(SUM(tips), 0) AS tips, COUNT(*) AS days,
         coalesce(SUM(deliveries), 0) AS deliveries, coalesce(SUM(orders), 0) AS orders, coalesce(SUM(metres), 0) AS metres
  FROM days GROUP BY courier
)
SELECT courier, n_name AS city,
       CAST(CAST((per_hour + per_delivery + fallback) * 10000 AS HUGEINT) + scoring + special + tips * 100 AS DOUBLE) / 10000 AS total,
       CAST(per_hour AS DOUBLE) AS per_hour, CAST(per_delivery AS DOUBLE) AS per_delivery, CAST(fallback AS DOUBLE) AS fallback,
       CAST(scoring AS DOUBLE) / 10000 AS scoring, CAST(special AS DOUBLE) / 10000 AS special, CAST(tips AS DOUBLE) / 100 AS tips,
       days, CAST(deliveries AS BIGINT) AS deliveries, CAST(orders AS DOUBLE) / 2 AS hours, CAST(metres AS DOUBLE) / 10000 AS km
FROM summed LEFT JOIN supplier ON s_suppkey = courier LEFT JOIN nation ON n_nationkey = s_nationkey
