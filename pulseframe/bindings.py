"""The test tables seen as canonical tables, in SQL that Spark and DuckDB both read.

``@E(x)`` stands for the epoch seconds of a timestamp. Five persons share the events. The dense
binding runs time twenty times as fast, so that samples lie about a minute apart.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_T0 = 1704067200

def _wide() -> str:
    """Columns of the daily row from the number of a day's orders and their total."""
    numbers = (
        "load strain n_workouts banister hr_max steps acwr acwr_rolling recovery recovery_z_rhr recovery_z_sleep recovery_pts_rhr recovery_pts_sleep readiness_rule tst_min spt_min waso_min sme "
        "onset_clock wake_clock nap_min deep_min light_min rem_min rhr sleep_hr_mean sri onset_csd wake_csd hr_coverage"
    ).split()
    numbers += [f"{p}_{c}" for p in ("rhr", "tst", "sleep_hr") for c in ("z", "base_center", "base_spread", "mean7", "base_n")]
    flags = ["unrecorded_hint", "stages_available", *(f"{p}_flag" for p in ("rhr", "tst", "sleep_hr"))]
    statuses = ["load", "steps", "acwr", "recovery", "phys", "reg"]
    cells = [
        f"CAST(t % {i + 3} AS INT) AS {c}" if c.endswith("_n") else f"CASE WHEN (t + {i}) % 7 = 0 THEN NULL ELSE CAST((t * {i + 3}) % 1000 AS DOUBLE) END AS {c}" for i, c in enumerate(numbers)
    ]
    cells += [f"(t + {i}) % 3 = 0 AS {c}" for i, c in enumerate(flags)]
    for i, c in enumerate(statuses):
        cells += [f"CASE WHEN (t + {i}) % 4 = 0 THEN 'insufficient_data' ELSE 'ok' END AS {c}_status", f"CASE WHEN (t + {i}) % 4 = 0 THEN concat('because ', CAST(t % 5 AS VARCHAR(20))) ELSE NULL END AS {c}_reason"]
    cells += [f"CASE WHEN (t + {i}) % 5 = 0 THEN 'warming_up' ELSE 'ok' END AS {p}_base_status" for i, p in enumerate(("rhr", "tst", "sleep_hr"))]
    cells += ["CASE WHEN t % 6 = 0 THEN NULL ELSE CAST(t AS BIGINT) END AS episode", "'text' AS load_method", "'age' AS hr_max_basis", "'say' AS readiness"]
    cells += ["CASE WHEN t % 7 = 3 THEN 'few pairs' ELSE NULL END AS sri_reason"]
    days = "SELECT o_orderstatus AS person, CAST(o_orderdate AS DATE) AS date, CAST(sum(floor(o_totalprice)) AS BIGINT) AS t FROM orders GROUP BY o_orderstatus, CAST(o_orderdate AS DATE)"
    return f"SELECT person, date, {', '.join(cells)} FROM ({days}) o"


BINDINGS = {
    "hr": """
      SELECT user_id % 5 AS person, 's' AS source, CAST(user_id % 3 AS VARCHAR(9)) AS device_id, @E(ts) AS ts,
             CAST(20 + CAST(floor(value) AS BIGINT) % 150 AS INT) AS bpm,
             CASE event_type WHEN 'click' THEN 'background' WHEN 'view' THEN 'background' WHEN 'purchase' THEN 'workout'
                  WHEN 'signup' THEN 'spot' ELSE 'unknown' END AS context
      FROM events""",
    # samples of a year: twelve times as slow, so that both changes of summer time are among them
    "spring_hr": f"""
      SELECT user_id % 5 AS person, {_T0} + (@E(ts) - {_T0}) * 12 AS ts FROM events""",
    "dense_hr": f"""
      SELECT user_id % 5 AS person, {_T0} + (@E(ts) - {_T0}) DIV 20 AS ts, CAST(max(80 + CAST(floor(value) AS BIGINT) % 110) AS DOUBLE) AS bpm
      FROM events GROUP BY user_id % 5, {_T0} + (@E(ts) - {_T0}) DIV 20""",
    "steps": """
      SELECT user_id % 5 AS person, 's' AS source, CAST(user_id % 4 AS VARCHAR(9)) AS device_id, @E(ts) AS ts, CAST(floor(value) AS INT) AS steps
      FROM events WHERE event_type = 'click'""",
    "workouts": f"""
      SELECT user_id % 5 AS person, 's' AS source, CAST(user_id % 3 AS VARCHAR(9)) AS device_id, {_T0} + (@E(ts) - {_T0}) DIV 20 AS start_ts,
             {_T0} + (@E(ts) - {_T0}) DIV 20 + (20 + CAST(floor(value) AS BIGINT) % 70) * 60 AS end_ts, concat('sport_', CAST(user_id % 7 AS VARCHAR(9)), '_', CAST(event_id AS VARCHAR(20))) AS sport,
             CAST(CASE WHEN event_id % 3 = 0 THEN 60 ELSE NULL END AS INT) AS tz_offset_min,
             CAST(90 + event_id % 60 AS DOUBLE) AS avg_hr, CAST(CASE WHEN event_id % 4 = 0 THEN NULL ELSE 140 + event_id % 70 END AS DOUBLE) AS max_hr,
             CAST(60 AS DOUBLE) AS min_hr,
             CAST(CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id % 7) * 60 END AS DOUBLE) AS zone1_s, CAST((event_id % 11) * 60 AS DOUBLE) AS zone2_s,
             CAST((event_id % 13) * 30 AS DOUBLE) AS zone3_s, CAST((event_id % 3) * 60 AS DOUBLE) AS zone4_s, CAST((event_id % 2) * 60 AS DOUBLE) AS zone5_s,
             CAST(NULL AS DOUBLE) AS dev_train_load
      FROM events WHERE event_type = 'purchase'""",
    # all workouts, those of six hours begun within the first of them, so that there is time left in which to detect others
    "bunched_workouts": f"""
      SELECT person, {_T0} + (start_ts - {_T0}) DIV 21600 * 21600 + (start_ts - {_T0}) % 21600 DIV 6 AS start_ts,
             {_T0} + (start_ts - {_T0}) DIV 21600 * 21600 + (start_ts - {_T0}) % 21600 DIV 6 + (end_ts - start_ts) AS end_ts
      FROM (@B(workouts)) w""",
    "sessions": """
      SELECT user_id % 25 AS person, CASE user_id % 4 WHEN 0 THEN 'gadgetbridge' WHEN 1 THEN 'mifitness' ELSE 'other' END AS source,
             CAST(user_id % 3 AS VARCHAR(9)) AS device_id, @E(ts) AS start_ts, @E(ts) + (30 + CAST(floor(value * 7) AS BIGINT) % 500) * 60 AS end_ts,
             CAST(CASE WHEN event_id % 9 = 0 THEN 1 ELSE NULL END AS INT) AS is_nap, CAST(CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 480 ELSE 60 END AS INT) AS tz_offset_min,
             CAST(event_id % 20 AS DOUBLE) AS dev_awake_min
      FROM events WHERE event_type = 'signup'""",
    "segments": """
      SELECT person, source, device_id, start_ts AS session_start_ts, start_ts + k * 1500 AS start_ts, start_ts + k * 1500 + 1200 AS end_ts,
             CASE (start_ts + k) % 5 WHEN 0 THEN 'awake' WHEN 1 THEN 'light' WHEN 2 THEN 'deep' WHEN 3 THEN 'rem' ELSE 'asleep' END AS stage
      FROM (@B(sessions)) s CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) k""",
    # five persons, who are those of the samples
    "plan_sessions": """
      SELECT person % 5 AS person, source, device_id, start_ts, end_ts, is_nap, tz_offset_min, dev_awake_min FROM (@B(sessions)) p""",
    "plan_segments": """
      SELECT DISTINCT person % 5 AS person, source, device_id, session_start_ts, start_ts, end_ts, stage FROM (@B(segments)) p""",
    "long": """
      SELECT user_id AS person, CAST(CAST(ts AS DATE) AS VARCHAR(20)) AS date,
             CASE event_type WHEN 'click' THEN 'activity.steps' WHEN 'purchase' THEN 'strain.load' WHEN 'view' THEN 'recovery.score' WHEN 'signup' THEN 'rhr.z' ELSE 'sleep.sri_7d' END AS metric,
             CAST(CASE WHEN sum(CAST(floor(value) AS BIGINT)) % 7 = 0 THEN NULL ELSE sum(CAST(floor(value) AS BIGINT)) END AS DOUBLE) AS value,
             CASE WHEN sum(CAST(floor(value) AS BIGINT)) % 7 = 0 THEN 'insufficient_data' ELSE 'ok' END AS status,
             CASE WHEN sum(CAST(floor(value) AS BIGINT)) % 7 = 0 THEN concat('gap ', CAST(count(*) % 2 AS VARCHAR(20))) ELSE NULL END AS reason
      FROM events GROUP BY user_id, CAST(ts AS DATE), event_type""",
    "workout_metrics": """
      SELECT CAST(CAST(ts AS DATE) AS VARCHAR(20)) AS date, @E(ts) AS start_ts, @E(ts) + (20 + event_id % 70) * 60 AS end_ts, concat('sport_', CAST(user_id % 7 AS VARCHAR(20))) AS sport,
             CASE event_id % 3 WHEN 0 THEN 'hr_ours' WHEN 1 THEN 'device_zones' ELSE 'detected' END AS method, CAST(20 + event_id % 70 AS DOUBLE) AS duration_min,
             CAST(CASE WHEN event_id % 5 = 0 THEN NULL ELSE 90 + event_id % 60 END AS DOUBLE) AS avg_hr, CAST(120 + event_id % 70 AS DOUBLE) AS peak_hr,
             CAST(CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 300 END AS DOUBLE) AS load,
             CAST(event_id % 7 AS DOUBLE) AS z1_min, CAST(event_id % 5 AS DOUBLE) AS z2_min, CAST(event_id % 11 AS DOUBLE) AS z3_min, CAST(event_id % 4 AS DOUBLE) AS z4_min, CAST(event_id % 2 AS DOUBLE) AS z5_min
      FROM events WHERE event_type = 'purchase'""",
    "daily": """
      SELECT CAST(l_returnflag AS VARCHAR(9)) AS person, CAST(l_shipdate AS DATE) AS date,
             CASE WHEN CAST(sum(l_quantity) AS BIGINT) % 11 = 0 THEN NULL WHEN CAST(sum(l_quantity) AS BIGINT) % 3 = 0 THEN 0.0E0 ELSE CAST(sum(l_quantity) AS DOUBLE) END AS load
      FROM lineitem GROUP BY l_returnflag, CAST(l_shipdate AS DATE)""",
    "nightly": """
      SELECT o_orderstatus AS person, CAST(o_orderdate AS DATE) AS date, CAST(year(CAST(o_orderdate AS DATE)) AS VARCHAR(9)) AS era,
             max(o_totalprice) AS price, CAST(count(*) AS DOUBLE) AS n
      FROM orders GROUP BY o_orderstatus, CAST(o_orderdate AS DATE)""",
    # --- records of unknown layout: nested to the ninth level, with lists, nulls, numbers in texts, places and identifiers
    "nested": """
      SELECT l_returnflag AS key, l_orderkey, l_linenumber,
             concat('{"id": ', CAST(l_orderkey AS VARCHAR(20)), ', "qty":"', CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR(20)), '", "part":{"user_id":"u', CAST(l_partkey AS VARCHAR(20)),
               '","supplier":{"no":', CAST(l_suppkey AS VARCHAR(20)), ',"tags":["', l_linestatus, '","', l_returnflag, '",""]}},"Location":{"lat":52.', CAST(10 + l_suppkey AS VARCHAR(20)), ',"path":[[1,2],{"x":"}"}]},',
               '"flags":[true,null,', CASE WHEN l_linenumber % 3 = 0 THEN '' WHEN l_linenumber % 3 = 1 THEN '"x y",' ELSE concat('{"mac": "aa:bb", "note":"', chr(92), '"lat', chr(92), '":1"},') END, CAST(l_linenumber AS VARCHAR(20)), '],"rate":0.', CAST(1 + l_linenumber AS VARCHAR(20)), 'e0',
               CASE WHEN l_linenumber = 7 THEN ',"none":[],"empty":{}' ELSE '' END, ',"a":{"b":{"c":{"d":{"e":{"f":{"g":{"h":', CAST(l_linenumber AS VARCHAR(20)), ',"i":{"j":1},"k":[1,2]}}}}}}}}') AS doc
      FROM lineitem""",
    # --- as one source, for exports and the store
    "x_hr": """
      SELECT 'mifitness' AS source, CAST(user_id % 5 AS VARCHAR(9)) AS device_id, @E(ts) AS ts, CAST(max(20 + CAST(floor(value) AS BIGINT) % 150) AS INT) AS bpm,
             CASE WHEN @E(ts) % 3 = 0 THEN 'spot' ELSE 'background' END AS context
      FROM events GROUP BY CAST(user_id % 5 AS VARCHAR(9)), @E(ts)""",
    "x_steps": """
      SELECT 'mifitness' AS source, CAST(user_id % 4 AS VARCHAR(9)) AS device_id, @E(ts) AS ts, CAST(sum(CAST(floor(value) AS BIGINT)) AS INT) AS steps
      FROM events WHERE event_type = 'click' GROUP BY CAST(user_id % 4 AS VARCHAR(9)), @E(ts)""",
    "x_sessions": """
      SELECT 'mifitness' AS source, CAST(user_id % 25 AS VARCHAR(9)) AS device_id, @E(ts) AS start_ts, max(@E(ts) + (120 + CAST(floor(value * 7) AS BIGINT) % 400) * 60) AS end_ts,
             CAST(CASE WHEN @E(ts) % 9 = 0 THEN 1 ELSE NULL END AS INT) AS is_nap, CAST(CASE WHEN @E(ts) % 4 = 0 THEN 120 ELSE 60 END AS INT) AS tz_offset_min
      FROM events WHERE event_type = 'signup' GROUP BY CAST(user_id % 25 AS VARCHAR(9)), @E(ts)""",
    "x_segments": """
      SELECT source, device_id, start_ts AS session_start_ts, start_ts + k * 1500 AS start_ts, start_ts + k * 1500 + 1200 AS end_ts,
             CASE (start_ts + k) % 5 WHEN 0 THEN 'awake' WHEN 1 THEN 'light' WHEN 2 THEN 'deep' WHEN 3 THEN 'rem' ELSE 'asleep' END AS stage
      FROM (@B(x_sessions)) s CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) k""",
    "x_workouts": """
      SELECT 'mifitness' AS source, CAST(user_id % 3 AS VARCHAR(9)) AS device_id, @E(ts) AS start_ts, max(@E(ts) + (20 + CAST(floor(value) AS BIGINT) % 70) * 60) AS end_ts,
             concat('sport_', CAST(max(user_id % 7) AS VARCHAR(9))) AS sport, CAST(60 AS INT) AS tz_offset_min, CAST(max(90 + event_id % 60) AS DOUBLE) AS avg_hr,
             CAST(max(event_id % 11) * 60 AS DOUBLE) AS zone2_s, CAST(max(event_id % 2) * 60 AS DOUBLE) AS zone5_s
      FROM events WHERE event_type = 'purchase' GROUP BY CAST(user_id % 3 AS VARCHAR(9)), @E(ts)""",
    # --- a day's row as the daily plan makes it; values and gaps come from the orders
    "wide": _wide(),
}


def duck(sql: str) -> str:
    """SQL with the bindings of ``@B(name)`` put in, for DuckDB."""
    while m := re.search(r"@B\((\w+)\)", sql):
        sql = sql[: m.start()] + BINDINGS[m[1]] + sql[m.end() :]
    sql = re.sub(r"@E\((\w+)\)", r"CAST(floor(epoch(\1)) AS BIGINT)", sql)
    return sql.replace(" DIV ", " // ").replace("VARCHAR(9)", "VARCHAR").replace("VARCHAR(20)", "VARCHAR")


def bind(spark: SparkSession, folder: str, name: str, dealt: int | None = None) -> DataFrame:
    """A binding as a table; ``dealt`` deals the rows of the tables it reads over so many partitions first."""
    sql = BINDINGS[name]
    while m := re.search(r"@B\((\w+)\)", sql):
        sql = sql[: m.start()] + BINDINGS[m[1]] + sql[m.end() :]
    sql = re.sub(r"@E\((\w+)\)", r"unix_timestamp(CAST(\1 AS TIMESTAMP))", sql)
    sql = sql.replace("{", "{{").replace("}", "}}")
    tables = [t for t in ("events", "lineitem", "orders") if re.search(rf"\bFROM {t}\b", sql)]
    for t in tables:
        sql = re.sub(rf"\bFROM {t}\b", f"FROM {{{t}}}", sql)
    sql = sql.replace("VARCHAR(9)", "STRING").replace("VARCHAR(20)", "STRING")
    read = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in tables}
    return spark.sql(sql, **{t: df.repartition(dealt) if dealt else df for t, df in read.items()})
