WITH RECURSIVE sized AS (
  SELECT doc_id, source,
         CAST(len([w FOR w IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF w <> '']) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS ord
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM sized GROUP BY source
), ranked AS (
  SELECT *, 3 * source_size AS cap,
         row_number() OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS place,
         count(*) OVER () AS n, sum(source_size) OVER () AS total
  FROM sources
), filled AS (
  -- one source after the other, by size per weight: clamp while the level is above its clamp
  SELECT 0::BIGINT AS place, 0::HUGEINT AS clamped, CAST(NULL AS DOUBLE) AS level
  UNION ALL
  SELECT f.place + 1,
         CASE WHEN l.level >= r.cap / r.weight THEN f.clamped + r.cap ELSE f.clamped END,
         CASE WHEN l.level >= r.cap / r.weight THEN NULL ELSE l.level END
  FROM filled f
  JOIN ranked r ON r.place = f.place + 1,
  LATERAL (SELECT (r.total - f.clamped) / (SELECT sum(x.weight) FROM ranked x WHERE x.place >= r.place) AS level) l
  WHERE f.level IS NULL
), level AS (
  SELECT max(place) AS place, max(level) AS level FROM filled WHERE level IS NOT NULL
), targets AS (
  SELECT r.source, r.source_size,
         CASE WHEN level.level IS NULL OR r.place < level.place THEN CAST(r.cap AS DOUBLE) ELSE level.level * r.weight END AS target
  FROM ranked r, level
), parts AS (
  SELECT *, coalesce(least(floor(target / nullif(source_size, 0)), 3), 0) AS whole FROM targets
), placed AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole,
         CAST(round(p.target - p.whole * p.source_size) AS BIGINT) AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord, d.doc_id NULLS FIRST, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far
  FROM sized d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, rest - so_far)) AS BIGINT) AS taken
FROM placed
