WITH d AS (
  SELECT doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), starts AS (
  SELECT item, w, least(13, len(w)) AS m, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM items WHERE len(w) > 0
), patterns AS (
  SELECT DISTINCT item, m, array_to_string(w[k : k + m - 1], ' ') AS pattern FROM starts
), lengths AS (
  SELECT DISTINCT m FROM patterns
), places AS (
  SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, lengths WHERE len(w) >= m
), found AS (
  SELECT p.doc_id, p.k, p.m, q.item
  FROM (SELECT doc_id, k, m, array_to_string(w[k : k + m - 1], ' ') AS pattern FROM places) p
  JOIN patterns q ON p.pattern = q.pattern AND p.m = q.m
), hits AS (
  SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(k, k + m)) AS word FROM found) GROUP BY doc_id
), by_item AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256,
       coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hits h USING (doc_id) LEFT JOIN by_item i USING (doc_id)
