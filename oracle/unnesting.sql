-- key: explode_inner
WITH line AS (
  SELECT p_type, CAST(l_extendedprice AS DECIMAL(18,2)) AS goods,
         CAST(l_discount AS DECIMAL(4,2)) AS d, CAST(l_tax AS DECIMAL(4,2)) AS x
  FROM lineitem JOIN part ON l_partkey = p_partkey
), entry AS (
  SELECT p_type, 'goods' AS kind, CAST(goods AS DECIMAL(18,4)) AS amount FROM line WHERE goods <> 0
  UNION ALL SELECT p_type, 'discount', -(goods * d) FROM line WHERE goods * d <> 0
  UNION ALL SELECT p_type, 'tax', goods * x FROM line WHERE goods * x <> 0
)
SELECT p_type, kind, COUNT(*) AS entries, CAST(SUM(amount) AS DOUBLE) AS amount
FROM entry GROUP BY p_type, kind

-- key: explode_outer
WITH line AS (
  SELECT l_returnflag, CAST(l_extendedprice AS DECIMAL(18,2)) AS goods,
         CAST(l_discount AS DECIMAL(4,2)) AS d, CAST(l_tax AS DECIMAL(4,2)) AS x
  FROM lineitem
), entry AS (
  SELECT l_returnflag, 'discount' AS kind, -(goods * d) AS amount FROM line WHERE goods * d <> 0 AND l_returnflag <> 'N'
  UNION ALL SELECT l_returnflag, 'tax', goods * x FROM line WHERE goods * x <> 0 AND l_returnflag <> 'N'
  UNION ALL SELECT l_returnflag, NULL, NULL FROM line
  WHERE l_returnflag = 'N' OR (goods * d = 0 AND goods * x = 0)
)
SELECT l_returnflag, kind, COUNT(*) AS rows_kept, COUNT(amount) AS entries, CAST(SUM(amount) AS DOUBLE) AS amount
FROM entry GROUP BY l_returnflag, kind

-- key: explode_outer_filtered
WITH line AS (
  SELECT CAST(date_trunc('year', l_shipdate) AS DATE) AS ship_year, l_returnflag,
         -(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2))) AS d,
         CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)) AS x
  FROM lineitem
), test AS (
  SELECT ship_year, d, x,
         l_returnflag <> 'N' AND abs(d) >= 3000 AS has_d,
         l_returnflag <> 'N' AND abs(x) >= 3000 AS has_x
  FROM line
)
SELECT CAST(ship_year AS VARCHAR) AS ship_year,
       CAST(SUM(CASE WHEN has_d AND has_x THEN 2 ELSE 1 END) AS BIGINT) AS rows_kept,
       CAST(SUM(CASE WHEN has_d THEN 1 ELSE 0 END + CASE WHEN has_x THEN 1 ELSE 0 END) AS BIGINT) AS entries,
       CAST(SUM(CASE WHEN has_d THEN d ELSE 0 END + CASE WHEN has_x THEN x ELSE 0 END) AS DOUBLE) AS amount
FROM test GROUP BY 1

-- key: explode_nested
WITH line AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents
), word AS (
  SELECT doc_id, unnest(string_split(line, ' ')) AS word FROM line
)
SELECT word, COUNT(*) AS appearances, COUNT(DISTINCT doc_id) AS documents
FROM word WHERE word <> '' GROUP BY word

-- key: explode_sibling_product
WITH term AS (
  SELECT p_partkey, unnest(string_split(p_name, ' ')) AS term FROM part
), attribute AS (
  SELECT p_partkey, 'brand:' || p_brand AS attribute FROM part
  UNION ALL SELECT p_partkey, 'type:' || p_type FROM part
  UNION ALL SELECT p_partkey, 'size:' || CASE WHEN p_size < 25 THEN 'small' ELSE 'large' END FROM part
)
SELECT term, attribute, COUNT(*) AS products
FROM term JOIN attribute USING (p_partkey)
GROUP BY term, attribute
