WITH d AS (
  SELECT doc_id, [w FOR w IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF w <> ''] AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS k FROM d WHERE len(w) >= 35
), windows AS (
  SELECT doc_id, k, md5(array_to_string(w[k : k + 34], ' ')) AS win FROM starts
), repeated AS (
  SELECT win FROM windows GROUP BY win HAVING count(*) > 1
), hit AS (
  SELECT doc_id, list(DISTINCT word) AS words
  FROM (SELECT doc_id, unnest(range(k, k + 35)) AS word FROM windows SEMI JOIN repeated USING (win))
  GROUP BY doc_id
), numbered AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d
), left_over AS (
  SELECT n.doc_id, count(*) AS n, string_agg(n.word, ' ' ORDER BY n.i) AS kept
  FROM numbered n
  ANTI JOIN (SELECT doc_id, unnest(words) AS i FROM hit) h ON h.doc_id = n.doc_id AND h.i = n.i
  GROUP BY n.doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(l.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(l.kept, '')) AS kept_sha256
FROM d LEFT JOIN left_over l USING (doc_id)
