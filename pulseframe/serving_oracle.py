"""DuckDB SQL for the queries over result tables and profiles."""

from __future__ import annotations

_METRICS = ("activity.steps", "strain.load", "recovery.score", "rhr.z", "sleep.sri_7d")
_SERIES = (
    "recovery.score", "rhr.z", "phys.rhr", "sleep.tst_min", "sleep.sri_7d", "strain.load", "strain.strain", "acwr.ewma", "activity.steps",
    "rhr.base28", "rhr.spread28", "tst.base28", "tst.spread28",
)
_IN = ", ".join(f"'{m}'" for m in _METRICS)
_WIDE = f"SELECT person, date, {', '.join(f'max({p}) FILTER (metric = {chr(39)}{m}{chr(39)}) AS {m.replace(chr(46), chr(95))}_{p}' for m in _METRICS for p in ('value', 'status', 'reason'))} FROM (@B(long)) WHERE metric IN ({_IN}) GROUP BY person, date"
_PERIOD = "FROM (@B(workout_metrics)) WHERE date BETWEEN '2024-01-05' AND '2024-01-20'"

DATES: dict[str, list[str]] = {"device_timeline": ["first", "last"], "regularity_report": ["date"], "night_table": ["date"], "missing_nights": ["date"], "covered_minutes": ["date"], "baseline_band": ["date"]}
SQL: dict[str, str] = {
    "serve_range": """SELECT person, min(date) AS first, max(date) AS last, coalesce(max(date) FILTER (metric = 'recovery.score' AND status = 'ok'), max(date)) AS shown FROM (@B(long)) WHERE date <= '2024-01-28' GROUP BY person""",
    "serve_day": "SELECT person, metric, value, status, reason FROM (@B(long)) WHERE date = '2024-01-15'",
    "serve_series": f"""
WITH m AS (SELECT unnest([{", ".join(f"'{m}'" for m in _SERIES)}]) AS metric), d AS (SELECT (DATE '2024-02-03' - i::INTEGER)::VARCHAR AS date FROM range(28) r(i))
SELECT person, date, metric, value, status FROM (SELECT DISTINCT person FROM (@B(long))) CROSS JOIN d CROSS JOIN m LEFT JOIN (@B(long)) USING (person, date, metric)""",
    "workout_totals": f"""
SELECT count(*) AS sessions, count(*) FILTER (method <> 'detected') AS recorded, count(*) FILTER (method = 'detected') AS detected, count(*) FILTER (load IS NULL) AS unknown_load,
       round(coalesce(sum(duration_min), 0) / 60, 6) AS hours, round(sum(avg_hr * duration_min) / nullif(sum(duration_min) FILTER (avg_hr IS NOT NULL), 0), 6) AS avg_hr, max(peak_hr) AS peak_hr,
       {", ".join(f"coalesce(sum(z{i}_min), 0) AS z{i}_min" for i in range(1, 6))} {_PERIOD}""",
    "by_sport": f"SELECT sport, count(*) AS n, round(sum(duration_min) / 60, 6) AS hours, round(sum(load), 6) AS load {_PERIOD} GROUP BY sport",
    "daily_totals": """
SELECT person, metric, count(*) AS known_days, round(sum(value), 6) AS total, round(sum(value) / count(*), 6) AS per_day, round(sum(value) / count(*) * 7, 6) AS per_week, max(value) AS max,
       (array_agg(date ORDER BY value DESC, date))[1] AS max_date
FROM (@B(long)) WHERE status = 'ok' AND metric IN ('activity.steps', 'strain.load') AND date BETWEEN '2024-01-05' AND '2024-01-28' GROUP BY person, metric""",
    "period_change": """
WITH w AS (SELECT *, date > '2024-01-18' AS cur FROM (@B(workout_metrics)) WHERE date > '2024-01-11' AND date <= '2024-01-25'),
s AS (SELECT count(*) FILTER (cur)::DOUBLE AS a, count(*) FILTER (NOT cur)::DOUBLE AS b, coalesce(sum(duration_min) FILTER (cur), 0) AS c, coalesce(sum(duration_min) FILTER (NOT cur), 0) AS d,
      coalesce(sum(load) FILTER (cur), 0) AS e, coalesce(sum(load) FILTER (NOT cur), 0) AS f FROM w)
SELECT a AS sessions, b AS sessions_before, a - b AS sessions_change, c AS minutes, d AS minutes_before, c - d AS minutes_change, e AS load, f AS load_before, e - f AS load_change FROM s""",
    "latest_sessions": """
SELECT start_ts, sport, end_ts, method, load FROM (@B(workout_metrics)) WHERE date BETWEEN '2024-01-01' AND '2024-01-28' ORDER BY start_ts DESC, sport, end_ts LIMIT 500""",
    "gap_notes": "SELECT person, reason, count(*) AS days FROM (@B(long)) WHERE metric = 'activity.steps' AND status <> 'ok' GROUP BY person, reason",
    "pivot_wide": _WIDE,
    "last_days": f"SELECT * FROM ({_WIDE}) WHERE date <= '2024-01-25' QUALIFY row_number() OVER (PARTITION BY person ORDER BY date DESC) <= 8",
    "table_view": f"""
SELECT person, date, {", ".join(f"max(value) FILTER (metric = '{m}' AND status = 'ok') AS {m.replace('.', '_')}" for m in _METRICS)},
       coalesce(string_agg(DISTINCT reason, '; ' ORDER BY reason) FILTER (status <> 'ok'), '') AS reasons FROM (@B(long)) WHERE metric IN ({_IN}) GROUP BY person, date""",
    "trailing_week": """
SELECT person, date, value, CASE WHEN count(value) OVER w >= 4 THEN round(avg(value) OVER w, 6) END AS mean7 FROM (@B(long)) WHERE metric = 'strain.load'
WINDOW w AS (PARTITION BY person ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
    "durations": """
SELECT start_ts, sport, (duration_min::INTEGER // 60)::VARCHAR || 'h' || lpad((duration_min::INTEGER % 60)::VARCHAR, 2, '0') AS duration FROM (@B(workout_metrics))""",
    "column_profile": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{t}' AS type, count(*) AS rows, count(*) FILTER ({c} IS NULL) AS nulls, {z} AS zeros, {lo} AS least, {hi} AS most, {ml} AS mean_length, count(DISTINCT {c}) AS \"distinct\" FROM customer"
        for c, t, z, lo, hi, ml in (
            ("c_custkey", "bigint", "count(*) FILTER (c_custkey = 0)", "min(c_custkey)::VARCHAR", "max(c_custkey)::VARCHAR", "round(avg(length(c_custkey::VARCHAR)), 6)"),
            ("c_name", "string", "0::BIGINT", "min(c_name)", "max(c_name)", "round(avg(length(c_name)), 6)"),
            ("c_nationkey", "int", "count(*) FILTER (c_nationkey = 0)", "min(c_nationkey)::VARCHAR", "max(c_nationkey)::VARCHAR", "round(avg(length(c_nationkey::VARCHAR)), 6)"),
            ("c_acctbal", "double", "count(*) FILTER (c_acctbal = 0)", "min(c_acctbal)::VARCHAR", "max(c_acctbal)::VARCHAR", "round(avg(length(c_acctbal::VARCHAR)), 6)"),
            ("c_mktsegment", "string", "0::BIGINT", "min(c_mktsegment)", "max(c_mktsegment)", "round(avg(length(c_mktsegment)), 6)"),
        )
    ),
    "value_counts": "SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, value LIMIT 30",
    "cadence_profile": """
WITH t AS (SELECT person, ts, count(*) AS n FROM (@B(hr)) GROUP BY ALL), s AS (SELECT *, ts - lag(ts) OVER (PARTITION BY person ORDER BY ts) AS step FROM t)
SELECT person, count(step) AS steps, median(step) AS median_step, sum(n - 1)::BIGINT AS repeated FROM s GROUP BY person""",
    "covered_minutes": """
SELECT person, (to_timestamp(ts) AT TIME ZONE 'Europe/Berlin')::DATE AS date, count(DISTINCT date_trunc('minute', to_timestamp(ts) AT TIME ZONE 'Europe/Berlin')) AS minutes
FROM (@B(spring_hr)) GROUP BY ALL""",
    "quantiles_exclusive": f"""
WITH s AS (SELECT c_mktsegment, c_acctbal FROM customer UNION ALL SELECT 'all lines', l_extendedprice FROM lineitem),
v AS (SELECT c_mktsegment, list(c_acctbal ORDER BY c_acctbal) AS v, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT *, {", ".join(f"greatest(1, least(n - 1, floor((n + 1) * {q}::DOUBLE)))::INTEGER AS k{round(q * 100)}" for q in (0.01, 0.25, 0.5, 0.75, 0.99))} FROM v)
SELECT c_mktsegment, {", ".join(f"round(v[k{k}] + (v[k{k} + 1] - v[k{k}]) * ((n + 1) * {q}::DOUBLE - k{k}), 6) AS q{k}" for q, k in ((0.01, 1), (0.25, 25), (0.5, 50), (0.75, 75), (0.99, 99)))} FROM p""",
    "quartiles": """
SELECT c_mktsegment, round(quantile_cont(c_acctbal, 0.25), 6) AS q25, round(quantile_cont(c_acctbal, 0.75), 6) AS q75, round(stddev_pop(c_acctbal) / avg(c_acctbal), 6) AS cv FROM customer GROUP BY 1""",
    "rank_correlation": """
WITH part AS (SELECT p_brand, p_size, p_retailprice FROM part UNION ALL SELECT 'all lines', l_quantity, l_extendedprice FROM lineitem), r AS (
  SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0::DOUBLE AS x,
         rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2.0::DOUBLE AS y FROM part
) SELECT p_brand, round(corr(x, y), 6) AS rho, count(*) AS n FROM r GROUP BY p_brand""",
    "epoch_units": """
SELECT o_orderkey, CASE WHEN v >= 3e17 THEN 'ns' WHEN v >= 3e14 THEN 'us' WHEN v >= 3e11 THEN 'ms' WHEN v >= 3e8 THEN 's' END AS unit
FROM (SELECT o_orderkey, o_orderkey * pow(10.0::DOUBLE, o_orderkey % 16) AS v FROM orders)""",
    "redacted": """
SELECT c_custkey, regexp_replace(c_name, '\\b\\d{8,}\\b', '<number>', 'g') || ' <mac> <geo> <number>' AS text, 'id:' || substr(sha256(c_name), 1, 8) AS id FROM customer""",
    "keyed_json": """
SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k, nullif((props::JSON ->> 'k')::DOUBLE, 0) AS known_k FROM events""",
    "two_level_max": """
SELECT person, day, max(s)::BIGINT AS steps FROM (SELECT person, ts // 86400 AS day, device_id, sum(steps) AS s FROM (@B(steps)) GROUP BY ALL) GROUP BY ALL""",
    "methods_by_year": """
SELECT year(to_timestamp(start_ts))::INTEGER AS year, count(*) FILTER (method = 'hr_ours') AS hr_ours, count(*) FILTER (method = 'device_zones') AS device_zones,
       count(*) FILTER (method = 'low_resolution') AS low_resolution, count(*) FILTER (method = 'detected') AS detected FROM (@B(workout_metrics)) GROUP BY 1""",
}
SQL["baseline_band"] = """
WITH b AS (
  SELECT person, date, n AS v, count(n) OVER l AS k, median(n) OVER l AS c, list(n) OVER l AS a FROM (@B(nightly))
  WINDOW l AS (PARTITION BY person, era ORDER BY date RANGE BETWEEN INTERVAL 28 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)
), s AS (SELECT *, greatest(1.4826::DOUBLE * list_median(list_transform(a, lambda x: abs(x - c))), 0.5) AS sp FROM b)
SELECT person, date, CASE WHEN k >= 14 THEN round(c - sp, 6) END AS low, CASE WHEN k >= 14 THEN round(c + sp, 6) END AS high,
       CASE WHEN k >= 14 AND (v - c) / sp >= 1.5 THEN v END AS marker FROM s"""
_SUN = "(last_day(make_date(y, {m}, 1)) - CAST(dayofweek(last_day(make_date(y, {m}, 1))) AS INTEGER))"
_RECORDS = f"""
o AS (SELECT (o_custkey % 4)::VARCHAR AS device_id, epoch(o_orderdate)::BIGINT + 43200 AS start_ts, o_orderkey AS n, year(o_orderdate) AS y FROM orders),
s AS (SELECT *, epoch({_SUN.format(m=3)})::BIGINT + 3600 AS a, epoch({_SUN.format(m=10)})::BIGINT + 3600 AS b FROM o),
r AS (SELECT device_id, start_ts, n, start_ts >= a AND start_ts < b AS summer, CASE WHEN device_id NOT IN ('0', '1') AND start_ts >= a AND start_ts < b THEN 120 ELSE 60 END AS tz_offset_min FROM s),
sw AS (
  SELECT device_id, epoch({_SUN.format(m="m")})::BIGINT + 3600 AS t
  FROM (SELECT device_id, unnest(generate_series(min(y), max(y))) AS y FROM s GROUP BY device_id), (SELECT unnest([3, 10]) AS m)
), sides AS (
  SELECT sw.device_id, t, count(*) FILTER (start_ts >= t - 864000 AND start_ts < t) AS nb, count(*) FILTER (start_ts > t AND start_ts <= t + 864000) AS na,
         median(tz_offset_min) FILTER (start_ts >= t - 864000 AND start_ts < t) AS mb, median(tz_offset_min) FILTER (start_ts > t AND start_ts <= t + 864000) AS ma
  FROM sw JOIN r ON r.device_id = sw.device_id AND start_ts BETWEEN t - 864000 AND t + 864000 GROUP BY ALL
), v AS (
  SELECT d.device_id, count(t) FILTER (nb >= 3 AND na >= 3) AS switches, count(t) FILTER (nb >= 3 AND na >= 3 AND mb <> ma) AS changed
  FROM (SELECT DISTINCT device_id FROM r) d LEFT JOIN sides USING (device_id) GROUP BY 1
), verdict AS (SELECT *, switches >= 3 AND changed / switches < 0.2 AS naive FROM v)"""
SQL["dst_naive_devices"] = f"WITH {_RECORDS} SELECT device_id, naive, changed, switches FROM verdict"
SQL["dst_corrected"] = f"""
WITH {_RECORDS} SELECT device_id, start_ts, n, (tz_offset_min + CASE WHEN naive AND summer AND tz_offset_min IN (0, 60) THEN 60 ELSE 0 END)::INTEGER AS tz_offset_min FROM r JOIN verdict USING (device_id)"""

SQL["key_profile"] = """
WITH e AS (SELECT event_type, floor(epoch(ts))::BIGINT AS t, user_id % 3 AS device, props FROM events),
s AS (SELECT *, t - lag(t) OVER (PARTITION BY event_type, device ORDER BY t) AS step FROM e),
y AS (SELECT event_type, string_agg(y || ':' || n, ',' ORDER BY y) AS by_year FROM (SELECT event_type, year(to_timestamp(t)) AS y, count(*) AS n FROM e GROUP BY ALL) GROUP BY 1)
SELECT event_type AS key, count(*) AS rows, count(*) FILTER (NOT json_valid(props)) AS bad_json, count(DISTINCT device) AS devices, min(t) AS first_ts, max(t) AS last_ts,
       median(step) FILTER (step > 0) AS median_step, count(*) FILTER (step = 0) AS repeated, any_value(by_year) AS by_year FROM s JOIN y USING (event_type) GROUP BY 1"""
SQL["top_steps"] = """
WITH t AS (SELECT DISTINCT ts FROM (@B(hr))), s AS (SELECT ts - lag(ts) OVER (ORDER BY ts) AS step FROM t)
SELECT step::VARCHAR AS value, count(*) AS n FROM s WHERE step IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 5"""
_PS = ((0.01, 1), (0.05, 5), (0.5, 50), (0.95, 95), (0.99, 99))
SQL["hr_sanity"] = f"""
WITH v AS (
  SELECT person, count(*) AS rows, count(*) FILTER (bpm BETWEEN 30 AND 230) AS valid, min(bpm) FILTER (bpm BETWEEN 30 AND 230) AS least, max(bpm) FILTER (bpm BETWEEN 30 AND 230) AS most,
         list(bpm::DOUBLE ORDER BY bpm) FILTER (bpm BETWEEN 30 AND 230) AS v FROM (@B(hr)) GROUP BY person
), p AS (SELECT *, {", ".join(f"greatest(1, least(valid - 1, floor((valid + 1) * {q}::DOUBLE)))::INTEGER AS k{k}" for q, k in _PS)} FROM v)
SELECT person, rows, valid, least, most, {", ".join(f"round(v[k{k}] + (v[k{k} + 1] - v[k{k}]) * ((valid + 1) * {q}::DOUBLE - k{k}), 6) AS q{k}" for q, k in _PS)} FROM p"""
SQL["first_and_last"] = """
SELECT * FROM (SELECT o_orderkey, o_orderstatus, 'first' AS "end" FROM orders ORDER BY o_orderkey LIMIT 4)
UNION ALL SELECT * FROM (SELECT o_orderkey, o_orderstatus, 'last' AS "end" FROM orders ORDER BY o_orderkey DESC LIMIT 4)"""
SQL["implied_hr_max"] = """
WITH w AS (SELECT *, (end_ts - start_ts)::DOUBLE AS z1 FROM (@B(workouts))), t AS (SELECT *, z1 + zone2_s + zone3_s + zone4_s + zone5_s AS total FROM w),
m AS (SELECT avg_hr / ((z1 * 0.55::DOUBLE + zone2_s * 0.65::DOUBLE + zone3_s * 0.75::DOUBLE + zone4_s * 0.85::DOUBLE + zone5_s * 0.95::DOUBLE) / total) AS x FROM t
      WHERE total > 0 AND total >= 0.9 * (end_ts - start_ts) AND avg_hr IS NOT NULL)
SELECT count(*) AS n, round(median(x), 6) AS hr_max, round(stddev_pop(x) / avg(x), 6) AS cv, count(*) >= 5 AND stddev_pop(x) / avg(x) < 0.05 AS consistent FROM m"""
_RECONCILED = """
s AS (
  SELECT person, source, start_ts, max(end_ts) AS end_ts, floor((max(end_ts) - start_ts) / 60.0)::DOUBLE AS dev_duration_min, (40 + start_ts % 30)::DOUBLE AS dev_min_hr
  FROM (@B(sessions)) GROUP BY person, source, start_ts
), nights AS (
  SELECT person, source, DATE '1970-01-01' + ((end_ts + 3600) // 86400)::INTEGER AS date, start_ts AS onset_ts, end_ts AS wake_ts, (end_ts - start_ts) / 60.0::DOUBLE AS tst_min,
         (45 + end_ts % 20)::DOUBLE AS rhr FROM s WHERE end_ts - start_ts >= 18000
  QUALIFY row_number() OVER (PARTITION BY person, (end_ts + 3600) // 86400 ORDER BY start_ts) = 1
)"""
SQL["night_table"] = f"""
WITH {_RECONCILED}, dev AS (
  SELECT n.person, n.source, n.date, sum(dev_duration_min) AS device_tst, min(dev_min_hr) AS device_sleep_min_hr
  FROM nights n JOIN s ON s.person = n.person AND s.source = n.source AND s.start_ts >= n.onset_ts AND s.end_ts <= n.wake_ts GROUP BY ALL
)
SELECT person, source, date, round(tst_min, 6) AS tst_min, rhr, device_tst, device_sleep_min_hr, rhr + 3 AS device_rhr, round(tst_min - device_tst, 6) AS tst_difference
FROM nights LEFT JOIN dev USING (person, source, date)"""
SQL["missing_nights"] = f"""
WITH {_RECONCILED}, span AS (SELECT person, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date FROM nights GROUP BY person),
ends AS (SELECT person, (to_timestamp(end_ts) AT TIME ZONE 'Europe/Berlin')::DATE AS date, count(*) AS n FROM s GROUP BY ALL)
SELECT person, date, coalesce(n, 0) AS records FROM span LEFT JOIN ends USING (person, date) WHERE NOT EXISTS (SELECT 1 FROM nights x WHERE x.person = span.person AND x.date = span.date)"""

_NODES = """
w AS (
  SELECT d.*, j.type AS t, j.value AS v, j.fullkey AS f FROM (@D) d, json_tree(doc::JSON) j
  WHERE length(regexp_replace(j.fullkey, '[^.\\[]', '', 'g')) <= 8
), p AS (SELECT *, ltrim(regexp_replace(substr(f, 2), '\\[[0-9]+\\]', '[]', 'g'), '.') AS path FROM w),
n AS (
  SELECT key, path, CASE t WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'NULL' THEN 'VOID' WHEN 'DOUBLE' THEN CASE WHEN path LIKE '%.lat' THEN 'DECIMAL' ELSE t END ELSE t END AS t, CASE WHEN t <> 'NULL' THEN v ->> '$' END AS value FROM p WHERE t NOT IN ('OBJECT', 'ARRAY')
  UNION ALL SELECT key, path || '[].#len', 'BIGINT', json_array_length(v)::VARCHAR FROM p WHERE t = 'ARRAY'
), x AS (SELECT key, path, value, CASE WHEN t = 'VARCHAR' THEN CASE WHEN regexp_full_match(value, '[+-]?[0-9]+([.][0-9]*)?') THEN 'NUMSTR' ELSE 'STRING' END ELSE t END AS type FROM n)"""
SQL["json_paths"] = f"WITH {_NODES.replace('@D', 'SELECT 0 AS key, props AS doc FROM events UNION ALL SELECT 0, doc FROM (@B(nested))')} SELECT path, type, count(*) AS n FROM x GROUP BY ALL"
SQL["json_value_stats"] = f"""
WITH {_NODES.replace("@D", "SELECT key, doc FROM (@B(nested))")},
t AS (SELECT key, path, type, count(*) AS n FROM x WHERE value <> '' GROUP BY ALL),
v AS (SELECT key, path, value, count(*) AS n FROM x WHERE value <> '' GROUP BY ALL),
s AS (
  SELECT key, path, count(*) AS n, count(*) FILTER (coalesce(value, '') = '') AS empty, min(CASE WHEN type NOT IN ('STRING', 'BOOLEAN') THEN try_cast(value AS DOUBLE) END) AS least,
         max(CASE WHEN type NOT IN ('STRING', 'BOOLEAN') THEN try_cast(value AS DOUBLE) END) AS most FROM x GROUP BY ALL
)
SELECT s.key, s.path, s.n, empty, coalesce((SELECT string_agg(type || ':' || t.n, ',' ORDER BY t.n DESC, type) FROM t WHERE t.key = s.key AND t.path = s.path), '') AS types, round(least, 6) AS least, round(most, 6) AS most,
       CASE WHEN d.n <= 30 THEN d.n END AS distinct, CASE WHEN d.n <= 30 THEN d.vals END AS values
FROM s LEFT JOIN (SELECT key, path, count(*) AS n, string_agg(value || ':' || n, ', ' ORDER BY n DESC, value) AS vals FROM v GROUP BY ALL) d USING (key, path)"""
SQL["scrubbed_json"] = """
SELECT l_orderkey, l_linenumber,
  replace(regexp_replace(replace(doc, '"user_id":"u' || l_partkey || '"', '"user_id":"id:' || substr(sha256('u' || l_partkey), 1, 8) || '"'),
    '"Location":[{]"lat":52[.][0-9]+,"path":[[][[]1,2[]],[{]"x":"}"}[]]}', '"Location":"<redacted>"'),
    '"mac": "aa:bb"', '"mac": "id:' || substr(sha256('aa:bb'), 1, 8) || '"') AS doc,
  '20240131_<account>_MiFitness_1234_x.csv' AS file
FROM (SELECT *, regexp_extract(doc, '"user_id":"u([0-9]+)"', 1) AS l_partkey FROM (@B(nested)))"""

_AT = "timezone('Europe/Berlin', to_timestamp({}))"
SQL["device_timeline"] = f"""
SELECT 'band ' || user_id % 17 AS device, min({_AT.format("floor(epoch(ts))")})::DATE AS first, max({_AT.format("floor(epoch(ts))")})::DATE AS last, count(*) AS rows,
       string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS keys FROM events GROUP BY 1"""
SQL["code_counts"] = """
WITH c AS (
  SELECT 'STATE' AS "column", o_orderstatus AS value FROM orders UNION ALL SELECT 'RAW_KIND', (o_custkey % 45)::VARCHAR FROM orders
  UNION ALL SELECT 'sleep_stage', CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 7)::VARCHAR END FROM orders
)
SELECT "column", value, count(*) AS n, row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, value NULLS FIRST)::INTEGER AS rank FROM c GROUP BY "column", value
QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, value NULLS FIRST) <= 30"""
SQL["sleep_tail"] = f"""
SELECT person, row_number() OVER w::INTEGER AS rank, source, device_id, strftime({_AT.format("start_ts")}, '%Y-%m-%d %H:%M') AS start, strftime({_AT.format("end_ts")}, '%Y-%m-%d %H:%M') AS "end",
       ((end_ts - start_ts) // 3600)::VARCHAR || 'h' || lpad(((end_ts - start_ts) // 60 % 60)::VARCHAR, 2, '0') AS length
FROM (@B(sessions)) WINDOW w AS (PARTITION BY person ORDER BY start_ts DESC, end_ts DESC, source, device_id) QUALIFY row_number() OVER w <= 5"""
SQL["load_reconciliation"] = """
WITH w AS (SELECT *, load AS o, z1_min + 2 * z2_min + 3 * z3_min + 4 * z4_min + 5 * z5_min AS d, year(to_timestamp(start_ts))::INTEGER AS year FROM (@B(workout_metrics))),
b AS (SELECT *, o / d AS r FROM w WHERE o > 0 AND d > 0),
k AS (
  SELECT *, rank() OVER (PARTITION BY year, method ORDER BY o) + (count(*) OVER (PARTITION BY year, method, o) - 1) / 2.0::DOUBLE AS x,
         rank() OVER (PARTITION BY year, method ORDER BY d) + (count(*) OVER (PARTITION BY year, method, d) - 1) / 2.0::DOUBLE AS y FROM b
)
SELECT year, method, count(*) AS n, round(quantile_cont(r, 0.25), 6) AS q25, round(quantile_cont(r, 0.5), 6) AS q50, round(quantile_cont(r, 0.75), 6) AS q75,
       round(stddev_pop(r) / avg(r), 6) AS cv, round(corr(x, y), 6) AS rho FROM k GROUP BY year, method"""
SQL["regularity_report"] = """
SELECT person, date, round(steps / 1000, 6) AS day_wear, n_workouts AS reg_n, n_workouts AS sri_pairs, sri, sri_reason FROM (@B(wide)) WHERE date <= '2001-06-30'
QUALIFY row_number() OVER (PARTITION BY person ORDER BY date DESC) <= 6"""
SQL["signed_numbers"] = """
SELECT c_custkey, CASE WHEN c_custkey % 9 > 0 THEN printf('%+.0f', c_acctbal * 8 + 0.03125) END AS whole, CASE WHEN c_custkey % 9 > 0 THEN printf('%+.1f', c_acctbal * 8 + 0.03125) END AS tenths FROM customer"""

_SCRUBBED = SQL["scrubbed_json"].replace("SELECT l_orderkey, l_linenumber,", "SELECT key, l_orderkey, l_linenumber, doc AS raw,", 1).replace("AS doc,\n  '20240131", "AS scrubbed,\n  '20240131")
SQL["redacted_samples"] = f"""
WITH s AS ({_SCRUBBED}),
o AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, raw) AS a, row_number() OVER (ORDER BY l_orderkey DESC, l_linenumber DESC, raw DESC) AS b FROM s)
SELECT "end", key, l_orderkey, l_linenumber, scrubbed AS doc, 'id:' || substr(sha256(l_orderkey::VARCHAR), 1, 8) AS user_id, '<redacted>' AS "LATITUDE", 'call <number>' AS note
FROM (SELECT 'first' AS "end", * FROM o WHERE a <= 4 UNION ALL SELECT 'last', * FROM o WHERE b <= 4)"""
