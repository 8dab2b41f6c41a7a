-- key: translation_pivot
WITH latest AS (
  SELECT conv_id, role, text FROM conversations
  QUALIFY ROW_NUMBER() OVER (PARTITION BY conv_id, role ORDER BY turn DESC, length(text) DESC, encode(text) DESC) = 1
), s AS (SELECT conv_id, text FROM latest WHERE role = 'system'),
   u AS (SELECT conv_id, text FROM latest WHERE role = 'user'),
   a AS (SELECT conv_id, text FROM latest WHERE role = 'assistant')
SELECT COALESCE(s.conv_id, u.conv_id, a.conv_id) AS conv_id, s.text AS system_text, u.text AS user_text, a.text AS assistant_text,
       CAST((s.conv_id IS NOT NULL)::INT + (u.conv_id IS NOT NULL)::INT + (a.conv_id IS NOT NULL)::INT AS BIGINT) AS roles
FROM s FULL JOIN u ON u.conv_id = s.conv_id FULL JOIN a ON a.conv_id = COALESCE(s.conv_id, u.conv_id)

-- key: join_full_outer
WITH l AS (
  SELECT l_suppkey, p_type, CAST(l_shipdate AS DATE) AS day, CAST(l_extendedprice AS DECIMAL(18,2)) AS value
  FROM lineitem JOIN part ON p_partkey = l_partkey
), b AS (
  SELECT l_suppkey, p_type, CAST(SUM(value) AS DOUBLE) AS value_before FROM l
  WHERE day BETWEEN DATE '2000-01-01' AND DATE '2000-01-31' GROUP BY 1, 2
), a AS (
  SELECT l_suppkey, p_type, CAST(SUM(value) AS DOUBLE) AS value_after FROM l
  WHERE day BETWEEN DATE '2001-01-01' AND DATE '2001-01-31' GROUP BY 1, 2
)
SELECT COALESCE(b.l_suppkey, a.l_suppkey) AS l_suppkey, COALESCE(b.p_type, a.p_type) AS p_type, value_before, value_after
FROM b FULL OUTER JOIN a ON a.l_suppkey = b.l_suppkey AND a.p_type = b.p_type

-- key: catalog_completeness
WITH s AS (
  SELECT l_suppkey, COUNT(DISTINCT l_partkey) AS products, COUNT(DISTINCT CASE WHEN p_size > 10 THEN l_partkey END) AS with_picture,
         COUNT(DISTINCT p_type) AS types
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_suppkey
)
SELECT *, with_picture / NULLIF(products, 0) AS picture_share,
       CASE WHEN products < 520 THEN 'too few' WHEN with_picture / products < 0.8 THEN 'pictures missing' ELSE 'complete' END AS label
FROM s

-- key: rating_average
WITH first AS (
  SELECT source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)
  QUALIFY ROW_NUMBER() OVER (PARTITION BY source, n_chars ORDER BY doc_id) = 1
)
SELECT source, COUNT(*) AS orders, COUNT(quality) AS reviewed,
       CAST(SUM(quality) AS DOUBLE) / NULLIF(COUNT(quality), 0) AS mean_quality,
       CAST(SUM(toxic) AS DOUBLE) / NULLIF(COUNT(toxic), 0) AS mean_toxic
FROM first GROUP BY source

-- key: source_crosscheck
SELECT c_custkey, c_name, c_mktsegment, CAST(MAX(CAST(o_orderdate AS DATE)) AS VARCHAR) AS last_day, COUNT(*) AS orders
FROM customer JOIN orders ON o_custkey = c_custkey
WHERE c_acctbal > 0 AND o_orderstatus <> 'P'
GROUP BY 1, 2, 3
HAVING MAX(CAST(o_orderdate AS DATE)) < DATE '2001-08-02' - INTERVAL 180 DAY
