WITH RECURSIVE vectors AS (
  SELECT vec_id, label, [CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v,
    row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS place
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), parts AS (
  SELECT place, part, v[part * (len(v) // 8) + 1 : (part + 1) * (len(v) // 8)] AS p
  FROM vectors CROSS JOIN (SELECT unnest(range(8)) AS part)
), books AS (
  SELECT 0 AS round, part, place - 1 AS entry, p AS center FROM parts WHERE place <= 16
  UNION ALL
  SELECT b.round + 1, b.part, b.entry, coalesce(n.center, b.center)
  FROM books b LEFT JOIN (
    SELECT part, entry, list(c ORDER BY i) AS center
    FROM (
      SELECT a.part, a.entry, i, CAST(floor(CAST(sum(a.p[i]) AS DOUBLE) / count(*)) AS BIGINT) AS c
      FROM (
        SELECT q.part, q.p, arg_min(c.entry, list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(q.p, c.center)]) * 16 + c.entry) AS entry
        FROM parts q JOIN books c ON q.part = c.part GROUP BY q.place, q.part, q.p
      ) a, unnest(range(1, len(a.p) + 1)) AS s(i) GROUP BY a.part, a.entry, i
    ) GROUP BY part, entry
  ) n ON n.part = b.part AND n.entry = b.entry
  WHERE b.round < 6
), final AS (
  SELECT part, entry, center FROM books WHERE round = 6
), coded AS (
  SELECT place, part, min(d * 16 + entry) % 16 AS entry, min(d * 16 + entry) // 16 AS d
  FROM (
    SELECT q.place, q.part, c.entry, list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(q.p, c.center)]) AS d
    FROM parts q JOIN final c ON q.part = c.part
  ) GROUP BY place, part
), whole AS (
  SELECT place, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM coded GROUP BY place
), digest AS (
  SELECT sha256(string_agg(array_to_string(center, ','), ',' ORDER BY part, entry)) AS h FROM final
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM whole JOIN vectors USING (place) CROSS JOIN digest
