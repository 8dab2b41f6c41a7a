-- key: fn_string
SELECT c_custkey, lower(c_mktsegment) AS lowered, upper(c_name || 'é') AS uppered,
       c_name || ' (' || c_mktsegment || ')' AS joined,
       c_name || '/' || CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS joined_or_null,
       substring(c_name, 1, 7) AS first_seven, left(c_name, 3) AS first_three,
       CAST(length(c_mktsegment) AS INTEGER) AS length, replace(c_name, '#', '') AS replaced,
       CAST(c_custkey AS VARCHAR) AS key_text,
       CAST(right(c_name, 9) AS BIGINT) AS number,
       CAST(replace(right(c_name, 9), '00', '0') AS DOUBLE) AS float_number
FROM customer

-- key: fn_date
WITH d AS (SELECT o_orderkey, o_orderpriority, CAST(o_orderdate AS DATE) AS date FROM orders)
SELECT o_orderkey, CAST(date AS VARCHAR) AS date,
       CAST(CAST(date - INTERVAL 10 DAY AS DATE) AS VARCHAR) AS minus_10_days,
       CAST(CAST(date + INTERVAL 3 WEEK AS DATE) AS VARCHAR) AS plus_3_weeks,
       CAST(CAST(date - INTERVAL 3 MONTH AS DATE) AS VARCHAR) AS minus_3_months,
       CAST(CAST(date + INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS plus_1_month,
       CAST(CAST(date - INTERVAL 2 YEAR AS DATE) AS VARCHAR) AS minus_2_years,
       CAST(date + CAST(length(o_orderpriority) AS INTEGER) AS VARCHAR) AS plus_column_days,
       CAST(date_diff('day', date, DATE '2001-08-02') AS INTEGER) AS age_days,
       CAST(CAST(date_trunc('month', date) AS DATE) AS VARCHAR) AS month_start,
       CAST(CAST(date_trunc('year', date) AS DATE) AS VARCHAR) AS year_start,
       CAST(date - CAST(dayofweek(date) AS INTEGER) AS VARCHAR) AS week_start,
       strftime(date, '%G-%V') AS iso_week,
       strftime(date, '%A') AS weekday,
       year(date) AS year, month(date) AS month, dayofweek(date) + 1 AS day_of_week,
       CAST(last_day(date) AS VARCHAR) AS month_end,
       strftime(date, '%Y-%m-%d') AS text,
       CAST(date_diff('day', date, CAST(date + INTERVAL 1 MONTH AS DATE)) + 1 AS INTEGER) AS days_in_series,
       0 AS days_in_reversed
FROM d

-- key: fn_time
SELECT event_id, hour(ts) AS hour, CAST(CAST(ts AS DATE) AS VARCHAR) AS utc_day,
       CAST(CAST(ts + INTERVAL 7 HOUR AS DATE) AS VARCHAR) AS day_plus_7h,
       CAST(CAST(ts + CASE event_type WHEN 'view' THEN INTERVAL 7 HOUR WHEN 'click' THEN -INTERVAL 5 HOUR
                      ELSE INTERVAL 1 HOUR END AS DATE) AS VARCHAR) AS local_day
FROM events

-- key: fn_math_null
WITH l AS (
  SELECT *, CAST(l_extendedprice AS DECIMAL(18,2)) AS p, CAST(l_discount AS DECIMAL(4,2)) AS d, CAST(l_tax AS DECIMAL(4,2)) AS x,
         CASE WHEN l_returnflag <> 'R' THEN CAST(l_discount AS DECIMAL(4,2)) END AS shown,
         CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS net
  FROM lineitem
)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
       CAST(p AS DOUBLE) / NULLIF(CAST(d AS DOUBLE), 0) AS guarded_ratio,
       l_extendedprice / l_quantity AS ratio,
       CAST(ROUND(net, 2) AS DOUBLE) AS rounded,
       CAST(ROUND(-net, 1) AS DOUBLE) AS rounded_negative,
       CASE l_linenumber % 4 WHEN 0 THEN CAST(ROUND(net, 0) AS DOUBLE) WHEN 1 THEN CAST(ROUND(net, 1) AS DOUBLE)
            WHEN 2 THEN CAST(ROUND(net, 2) AS DOUBLE) ELSE CAST(ROUND(net, 3) AS DOUBLE) END AS rounded_to_column,
       CAST(CEIL(net) AS BIGINT) AS ceiling,
       CAST(CASE WHEN shown IS NOT NULL THEN GREATEST(shown, x) END AS DOUBLE) AS greater,
       CAST(CASE WHEN shown IS NOT NULL THEN LEAST(shown, x) END AS DOUBLE) AS lesser,
       CAST(COALESCE(shown, 0) AS DOUBLE) AS or_zero,
       CAST(CASE WHEN shown IS NOT NULL THEN shown WHEN x > 0 THEN x ELSE -1 END AS DOUBLE) AS first_known,
       CAST(-p * d * CAST(0.01 AS DECIMAL(3,2)) AS DOUBLE) AS scaled
FROM l

-- key: fn_array
SELECT doc_id, lang || ',' || source AS tags, lang IN ('en', 'fr') AS listed, lang NOT IN ('en', 'fr') AS not_listed,
       list_contains(string_split(text, ' '), 'the') AS has_the,
       CAST(len(string_split(text, ' ')) AS INTEGER) AS words,
       array_to_string(string_split(text, ' ')[1:5], ' ') AS first_five,
       2 AS list_length
FROM documents
