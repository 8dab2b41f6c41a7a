-- key: nested_zones
SELECT r_name AS country, n_nationkey AS city_id, n_name AS city, CAST(n_nationkey * 3 + k AS INTEGER) AS zone_id, n_name || ' zone ' || k AS zone,
       (n_nationkey + k) % 4 <> 0 AS is_active
FROM region JOIN nation ON n_regionkey = r_regionkey CROSS JOIN (SELECT unnest(range(3)) AS k)

-- key: nested_sellers_by_zone
WITH zones AS (
  SELECT CAST(n_nationkey * 3 + k AS INTEGER) AS zone_id, n_name AS city, n_name || ' zone ' || k AS zone,
         CAST(n_nationkey * 13 % 100 AS DOUBLE) / 10 + k * 0.7::DOUBLE + 0.05::DOUBLE AS x, CAST(n_nationkey * 29 % 100 AS DOUBLE) / 10 + 0.05::DOUBLE AS y,
         k * 0.2::DOUBLE + 0.4::DOUBLE AS half
  FROM nation JOIN region ON n_regionkey = r_regionkey CROSS JOIN (SELECT unnest(range(3)) AS k) WHERE (n_nationkey + k) % 4 <> 0
), sellers AS (
  SELECT s_suppkey, s_name, CAST(s_suppkey * 37 % 130 AS DOUBLE) / 10 AS lon, CAST(s_suppkey * 53 % 110 AS DOUBLE) / 10 AS lat FROM supplier WHERE s_acctbal > 0
)
SELECT s_suppkey, s_name, lon, lat, zone_id, city, zone
FROM sellers LEFT JOIN zones ON lon > x - half AND lon < x + half AND lat > y - half AND lat < y + half
