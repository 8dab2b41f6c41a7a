-- key: join_geofence
WITH p AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS lon, CAST(embedding[2] AS DOUBLE) AS lat FROM embeddings),
z AS (
  SELECT 'zone ' || label AS zone, (MIN(lon) + MAX(lon)) / 2 AS x, (MIN(lat) + MAX(lat)) / 2 AS y,
         (MAX(lon) - MIN(lon)) / 4 AS a, (MAX(lat) - MIN(lat)) / 4 AS b FROM p GROUP BY label
), e AS (
  SELECT (MIN(lon) + MAX(lon)) / 2 AS x, (MIN(lat) + MAX(lat)) / 2 AS y, (MAX(lon) - MIN(lon)) / 4 AS a, (MAX(lat) - MIN(lat)) / 4 AS b FROM p
)
SELECT vec_id, zone, lon, lat FROM p JOIN z ON abs(lon - x) / a + abs(lat - y) / b < 1
UNION ALL
SELECT vec_id, 'everywhere', lon, lat FROM p JOIN e ON abs(lon - x) < a AND abs(lat - y) < b

-- key: join_geofence_anti
WITH p AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS lon, CAST(embedding[2] AS DOUBLE) AS lat FROM embeddings),
z AS (
  SELECT (MIN(lon) + MAX(lon)) / 2 AS x, (MIN(lat) + MAX(lat)) / 2 AS y,
         (MAX(lon) - MIN(lon)) / 4 AS a, (MAX(lat) - MIN(lat)) / 4 AS b FROM p GROUP BY label
), e AS (
  SELECT (MIN(lon) + MAX(lon)) / 2 AS x, (MIN(lat) + MAX(lat)) / 2 AS y, (MAX(lon) - MIN(lon)) / 4 AS a, (MAX(lat) - MIN(lat)) / 4 AS b FROM p
)
SELECT vec_id, label FROM p
WHERE NOT EXISTS (SELECT 1 FROM z WHERE abs(lon - x) / a + abs(lat - y) / b < 1)
  AND NOT EXISTS (SELECT 1 FROM e WHERE abs(lon - x) < a AND abs(lat - y) < b)

-- key: geofence_resolution
WITH p AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS lon, CAST(embedding[2] AS DOUBLE) AS lat FROM embeddings),
z AS (
  SELECT 'zone ' || label AS zone, (MIN(lon) + MAX(lon)) / 2 AS x, (MIN(lat) + MAX(lat)) / 2 AS y,
         (MAX(lon) - MIN(lon)) / 4 AS a, (MAX(lat) - MIN(lat)) / 4 AS b FROM p GROUP BY label
), e AS (
  SELECT (MIN(lon) + MAX(lon)) / 2 AS x, (MIN(lat) + MAX(lat)) / 2 AS y, (MAX(lon) - MIN(lon)) / 4 AS a, (MAX(lat) - MIN(lat)) / 4 AS b FROM p
), pair AS (
  SELECT vec_id, zone FROM p JOIN z ON abs(lon - x) / a + abs(lat - y) / b < 1
  UNION ALL SELECT vec_id, 'everywhere' FROM p JOIN e ON abs(lon - x) < a AND abs(lat - y) < b
), single AS (
  SELECT vec_id, MIN(zone) AS zone, 1 AS zones FROM pair GROUP BY vec_id HAVING COUNT(*) = 1
), several AS (
  SELECT vec_id, COUNT(*) AS zones FROM pair GROUP BY vec_id HAVING COUNT(*) > 1
)
SELECT vec_id, zone, CAST(zones AS BIGINT) AS zones FROM single
UNION ALL SELECT vec_id, zone, zones FROM several JOIN pair USING (vec_id) WHERE zone <> 'everywhere'
UNION ALL SELECT vec_id, 'label ' || label, 0 FROM p WHERE vec_id NOT IN (SELECT vec_id FROM pair)

-- key: radius_audience
WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS lon, CAST(embedding[2] AS DOUBLE) AS lat FROM embeddings),
seller AS (
  SELECT s_suppkey, s_name, lon, lat FROM supplier JOIN p ON vec_id = s_suppkey % (SELECT count(*) FROM embeddings)
  WHERE lower(s_name) LIKE '%' || lower('00013') || '%'
), present AS (
  SELECT DISTINCT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey
  WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE lower(s_name) LIKE '%' || lower('00013') || '%')
), first_order AS (
  SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders
  WHERE o_orderdate >= DATE '2001-08-02' - INTERVAL 3 MONTH AND o_orderdate < DATE '2001-08-03' GROUP BY o_custkey
), person AS (
  SELECT c_custkey, lon, lat
  FROM customer LEFT JOIN first_order f ON f.o_custkey = c_custkey
  JOIN p ON vec_id = coalesce(f.o_orderkey, c_custkey) % (SELECT count(*) FROM embeddings)
  WHERE c_custkey NOT IN (SELECT o_custkey FROM present)
), pair AS (
  SELECT s_suppkey, s_name, c_custkey,
         2 * 6371010 * asin(sqrt(pow(sin(radians(seller.lat - person.lat) / 2), 2)
           + cos(radians(person.lat)) * cos(radians(seller.lat)) * pow(sin(radians(seller.lon - person.lon) / 2), 2))) AS distance
  FROM seller, person
)
SELECT s_suppkey, s_name, c_custkey, CAST(round(distance) AS BIGINT) AS distance FROM pair WHERE distance <= 15000
