-- key: scan_partition_window
SELECT CAST(CAST(o_orderdate - INTERVAL 7 HOUR AS DATE) AS VARCHAR) AS local_day,
       COUNT(*) AS orders,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value
FROM orders
WHERE CAST(o_orderdate - INTERVAL 7 HOUR AS DATE) BETWEEN DATE '1998-03-01' AND DATE '1998-05-31'
GROUP BY 1

-- key: scan_lookback
SELECT CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS month,
       COUNT(*) AS orders,
       COUNT(CASE WHEN o_orderstatus <> 'P' THEN 1 END) AS valid_orders
FROM orders
WHERE CAST(o_orderdate AS DATE) >= date_trunc('month', DATE '2001-08-02' - INTERVAL 3 MONTH)
  AND CAST(o_orderdate AS DATE) <= DATE '2001-08-02'
GROUP BY 1

-- key: project_except
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
       l_returnflag, l_linestatus, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS l_shipdate,
       p_name, p_brand, p_type, p_size
FROM lineitem JOIN part ON l_partkey = p_partkey

-- key: three_valued_flags
SELECT lang,
       COUNT(*) FILTER (WHERE quality = 1 AND quality IS NOT NULL) AS is_true,
       COUNT(*) FILTER (WHERE quality <> 1 AND quality IS NOT NULL) AS is_false,
       COUNT(*) FILTER (WHERE NOT (quality = 1)) AS negated,
       COUNT(*) FILTER (WHERE quality = 1 OR quality IS NULL) AS not_false,
       COUNT(*) FILTER (WHERE quality IS NULL) AS missing,
       COUNT(*) AS documents
FROM documents LEFT JOIN labels USING (doc_id)
GROUP BY lang

-- key: membership_filters
SELECT p_brand, p_type, COUNT(*) AS lines,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value
FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE p_brand IN ('Brand#3', 'Brand#7', 'Brand#12', 'Brand#20')
  AND p_type NOT IN ('PROMO', 'ECONOMY')
  AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 5000)
GROUP BY p_brand, p_type

-- key: like_patterns
SELECT 'products' AS source,
       COUNT(*) FILTER (WHERE lower(p_name) LIKE '%bolt%') AS substring,
       COUNT(*) FILTER (WHERE lower(p_name) LIKE 'red%') AS prefix,
       COUNT(*) FILTER (WHERE lower(p_name) LIKE 's%l%gear') AS wildcards,
       COUNT(*) FILTER (WHERE lower(p_name) NOT LIKE '%widget%') AS negated,
       COUNT(*) FILTER (WHERE lower(p_name) LIKE '%' || lower('Ring') || '%') AS keyword,
       COUNT(*) AS total
FROM part
UNION ALL
SELECT 'documents',
       COUNT(*) FILTER (WHERE lower(text) LIKE '%tion%'),
       COUNT(*) FILTER (WHERE lower(text) LIKE 'the%'),
       COUNT(*) FILTER (WHERE lower(text) LIKE '%the%and%'),
       COUNT(*) FILTER (WHERE lower(text) NOT LIKE '%ü%'),
       COUNT(*) FILTER (WHERE lower(text) LIKE '%' || lower('Ring') || '%'),
       COUNT(*)
FROM documents

-- key: classify_cascade
SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'Pickup'
            WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'Concepts'
            WHEN p_type = 'PROMO' AND o_orderpriority = '1-URGENT' THEN 'Express promo'
            WHEN p_type = 'PROMO' THEN 'Promo'
            WHEN p_type IN ('SMALL', 'MEDIUM') THEN 'Shops'
            WHEN p_brand IN ('Brand#20', 'Brand#21', 'Brand#22', 'Brand#23', 'Brand#24', 'Brand#25') THEN 'Kitchens'
            ELSE 'Food' END AS vertical,
       CASE WHEN n_name = 'NATION_5' OR n_name = 'NATION_10' THEN 'NATION_0' ELSE n_name END AS city,
       COUNT(*) AS lines,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN part ON l_partkey = p_partkey
JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey
GROUP BY 1, 2

-- key: scalar_subquery_bounds
SELECT o_orderstatus, COUNT(*) AS orders,
       CAST(MAX(CAST(o_orderdate AS DATE)) AS VARCHAR) AS last_day
FROM orders
WHERE o_orderdate >= (SELECT MIN(l_shipdate) FROM lineitem)
  AND o_orderdate <= (SELECT MAX(l_shipdate) - INTERVAL 180 DAY FROM lineitem)
GROUP BY o_orderstatus

-- key: distinct_rows
SELECT DISTINCT l_suppkey, p_brand, p_type
FROM lineitem JOIN part ON l_partkey = p_partkey
