-- key: funnel_rates
WITH s AS (
  SELECT user_id, CAST(ts AS DATE) AS day, COUNT(*) AS hits,
         bool_or(event_type = 'view') AS v, bool_or(event_type = 'click') AS c, bool_or(event_type = 'signup') AS u,
         bool_or(event_type = 'purchase') AS p, bool_or(event_type = 'error') AS e
  FROM events GROUP BY 1, 2
)
SELECT CAST(day AS VARCHAR) AS day, COUNT(*) AS sessions,
       COUNT(*) FILTER (WHERE v) AS view_sessions, COUNT(*) FILTER (WHERE c) AS click_sessions,
       COUNT(*) FILTER (WHERE u) AS signup_sessions, COUNT(*) FILTER (WHERE p) AS purchase_sessions,
       COUNT(*) FILTER (WHERE e) AS error_sessions,
       COUNT(*) FILTER (WHERE v AND c) / NULLIF(COUNT(*) FILTER (WHERE v), 0) AS view_to_click,
       COUNT(*) FILTER (WHERE c AND u) / NULLIF(COUNT(*) FILTER (WHERE c), 0) AS click_to_signup,
       COUNT(*) FILTER (WHERE u AND p) / NULLIF(COUNT(*) FILTER (WHERE u), 0) AS signup_to_purchase,
       COUNT(*) FILTER (WHERE p) / COUNT(*) AS conversion,
       CAST(SUM(hits) AS DOUBLE) / COUNT(*) AS mean_hits
FROM s GROUP BY day

-- key: closed_funnel_sessions
WITH h AS (
  SELECT user_id, event_type, CAST(ts + INTERVAL 7 HOUR AS DATE) AS day, hour(ts + INTERVAL 7 HOUR) >= 12 AS afternoon FROM events
), s AS (
  SELECT day, user_id, afternoon, bool_or(event_type = 'view') AS v, bool_or(event_type = 'click') AS c,
         bool_or(event_type = 'signup') AS u, bool_or(event_type = 'purchase') AS p
  FROM h GROUP BY ALL
)
SELECT CAST(day AS VARCHAR) AS day, COUNT(*) AS sessions,
       COUNT(*) FILTER (WHERE v) AS view_sessions, COUNT(*) FILTER (WHERE c) AS click_sessions,
       COUNT(*) FILTER (WHERE u) AS signup_sessions, COUNT(*) FILTER (WHERE p) AS purchase_sessions,
       COUNT(*) FILTER (WHERE v AND c) AS view_and_click_sessions, COUNT(*) FILTER (WHERE c AND u) AS click_and_signup_sessions,
       COUNT(*) FILTER (WHERE u AND p) AS signup_and_purchase_sessions, COUNT(*) FILTER (WHERE v AND p) AS view_and_purchase_sessions,
       COUNT(DISTINCT CASE WHEN v THEN user_id END) AS view_users, COUNT(DISTINCT CASE WHEN c THEN user_id END) AS click_users,
       COUNT(DISTINCT CASE WHEN u THEN user_id END) AS signup_users, COUNT(DISTINCT CASE WHEN p THEN user_id END) AS purchase_users
FROM s GROUP BY day

-- key: funnel_clamp
WITH raw AS (
  SELECT CAST(ts AS DATE) AS day, COUNT(*) FILTER (WHERE event_type = 'view') AS view, COUNT(*) FILTER (WHERE event_type = 'click') AS click,
         COUNT(*) FILTER (WHERE event_type = 'signup') AS signup, COUNT(*) FILTER (WHERE event_type = 'purchase') AS purchase
  FROM events GROUP BY 1
), once AS (
  SELECT day, 1 AS passes, view, LEAST(click, view) AS click, LEAST(signup, click) AS signup, LEAST(purchase, signup) AS purchase FROM raw
), twice AS (
  SELECT day, 2 AS passes, view, LEAST(click, view) AS click, LEAST(signup, click) AS signup, LEAST(purchase, signup) AS purchase FROM once
)
SELECT CAST(day AS VARCHAR) AS day, passes, view, click, signup, purchase,
       COALESCE(ROUND(click / NULLIF(view, 0), 2), 0) AS click_rate,
       COALESCE(ROUND(signup / NULLIF(click, 0), 2), 0) AS signup_rate,
       COALESCE(ROUND(purchase / NULLIF(signup, 0), 2), 0) AS purchase_rate,
       COALESCE(ROUND(purchase / NULLIF(view, 0), 2), 0) AS conversion
FROM (SELECT * FROM once UNION ALL SELECT * FROM twice)

-- key: error_messages_daily
WITH m AS (
  SELECT CAST(ts + INTERVAL 7 HOUR AS DATE) AS day, props AS message, COUNT(*) AS errors, COUNT(DISTINCT user_id) AS users
  FROM events WHERE event_type = 'error' AND regexp_matches(props, ': [1-7]') AND NOT regexp_matches(props, '0}|5}')
  GROUP BY 1, 2
)
SELECT CAST(day AS VARCHAR) AS day, message, errors, users, CAST(SUM(errors) OVER (PARTITION BY day) AS BIGINT) AS day_errors FROM m

-- key: rolling_session_refresh
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, COUNT(DISTINCT user_id) AS users, COUNT(DISTINCT (user_id, event_type)) AS sessions,
       COUNT(*) AS hits, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value
FROM events WHERE CAST(ts AS DATE) <= DATE '2024-01-31'
GROUP BY 1

-- key: lane_sessions
WITH h AS (
  SELECT user_id, CAST(ts AS DATE) AS day,
         CASE event_type WHEN 'view' THEN 'shelf: fresh 🧺' WHEN 'click' THEN 'shelf: again' WHEN 'purchase' THEN 'shelf: ផ្លែឈើ'
                         WHEN 'signup' THEN 'shelf: 水果' ELSE 'list' END AS lane
  FROM events
)
SELECT CAST(day AS VARCHAR) AS day, lane, COUNT(*) AS hits, COUNT(DISTINCT user_id) AS users
FROM h
WHERE lane IN ('shelf: fresh 🧺', 'shelf: ផ្លែឈើ', 'shelf: 水果') AND day BETWEEN DATE '2024-01-31' - 21 AND DATE '2024-01-31' - 2
GROUP BY 1, 2

-- key: closed_funnel_sellers
WITH hit AS (
  SELECT DISTINCT event_id, user_id, event_type, CAST(ts AS DATE) AS day, CAST(timezone('Asia/Phnom_Penh', timezone('UTC', ts)) AS DATE) AS local_day,
         hour(timezone('Asia/Phnom_Penh', timezone('UTC', ts))) >= 12 AS afternoon, 'supplier#' || lpad(json_extract_string(props, '$.k'), 9, '0') AS seller_code
  FROM events WHERE event_type IN ('view', 'click', 'signup', 'purchase')
), session AS (
  SELECT day, local_day, user_id, afternoon, seller_code,
    COUNT(*) FILTER (event_type = 'view') AS view_n,
    COUNT(*) FILTER (event_type = 'click') AS click_n,
    COUNT(*) FILTER (event_type = 'signup') AS signup_n,
    COUNT(*) FILTER (event_type = 'purchase') AS purchase_n
  FROM hit GROUP BY ALL
), counted AS (
  SELECT day, local_day, seller_code,
    CAST(SUM(view_n) AS BIGINT) AS view_hits,
    CAST(SUM(click_n) AS BIGINT) AS click_hits,
    CAST(SUM(signup_n) AS BIGINT) AS signup_hits,
    CAST(SUM(purchase_n) AS BIGINT) AS purchase_hits,
    COUNT(*) FILTER (view_n > 0) AS view_sessions,
    COUNT(*) FILTER (click_n > 0) AS click_sessions,
    COUNT(*) FILTER (signup_n > 0) AS signup_sessions,
    COUNT(*) FILTER (purchase_n > 0) AS purchase_sessions,
    COUNT(*) FILTER (view_n > 0 AND click_n > 0) AS view_and_click_sessions,
    COUNT(*) FILTER (click_n > 0 AND signup_n > 0) AS click_and_signup_sessions,
    COUNT(*) FILTER (signup_n > 0 AND purchase_n > 0) AS signup_and_purchase_sessions,
    COUNT(*) FILTER (view_n > 0 AND purchase_n > 0) AS view_and_purchase_sessions,
    COUNT(DISTINCT CASE WHEN view_n > 0 THEN user_id END) AS view_users,
    COUNT(DISTINCT CASE WHEN click_n > 0 THEN user_id END) AS click_users,
    COUNT(DISTINCT CASE WHEN signup_n > 0 THEN user_id END) AS signup_users,
    COUNT(DISTINCT CASE WHEN purchase_n > 0 THEN user_id END) AS purchase_users
  FROM session GROUP BY ALL
), named AS (
  SELECT counted.*, s_name AS seller, CASE WHEN s_acctbal >= 8000 THEN 'dmart' WHEN s_acctbal >= 6000 THEN 'shops' WHEN s_acctbal >= 4000 THEN 'concepts'
         WHEN s_acctbal >= 1000 THEN 'restaurants' END AS seller_type
  FROM counted LEFT JOIN supplier ON lower(s_name) = seller_code
)
SELECT * REPLACE (CAST(day AS VARCHAR) AS day, CAST(local_day AS VARCHAR) AS local_day),
       CASE WHEN seller_type = 'dmart' THEN 'darkstores' WHEN seller_type = 'shops' THEN 'shops' WHEN seller_type IN ('concepts', 'restaurants') THEN 'restaurants' ELSE 'other' END AS parent_type
FROM named
