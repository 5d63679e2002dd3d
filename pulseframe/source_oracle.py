"""DuckDB SQL for the queries over sources, the store and the long table."""

from __future__ import annotations

from .plans.daily import metrics

DATES: dict[str, list[str]] = {}
_HOURS = "s AS (SELECT source, device_id, ts // 3600 * 3600 AS ts, max(steps)::INTEGER AS steps FROM (@B(x_steps)) GROUP BY ALL)"
_SECOND = "(ts // 3600 % 2 = 1 OR ts // 3600 % 3 = 0)"
SQL: dict[str, str] = {
    "export_hr": "SELECT source, device_id, ts, bpm, context FROM (@B(x_hr))",
    "export_steps": "SELECT source, device_id, ts, steps FROM (@B(x_steps)) WHERE steps <> 0",
    "export_sessions": """
SELECT source, device_id, start_ts, end_ts, is_nap, tz_offset_min, nullif(floor((end_ts - start_ts) / 60.0), 0)::DOUBLE AS dev_duration_min, coalesce(r, 0.0)::DOUBLE AS dev_rem_min
FROM (@B(x_sessions)) LEFT JOIN (
  SELECT device_id, session_start_ts AS start_ts, sum((end_ts - start_ts) / 60.0) FILTER (stage = 'rem') AS r FROM (@B(x_segments)) GROUP BY ALL
) USING (device_id, start_ts)""",
    "export_segments": "SELECT source, device_id, session_start_ts, start_ts, end_ts, stage FROM (@B(x_segments))",
    "export_workouts": "SELECT source, device_id, start_ts, end_ts, sport, tz_offset_min, avg_hr, zone2_s, zone5_s FROM (@B(x_workouts))",
    "export_resting": """
SELECT 'mifitness' AS source, (user_id % 5)::VARCHAR AS device_id, ts::DATE::VARCHAR AS date, 'rhr' AS metric, floor(value)::DOUBLE AS value FROM events WHERE floor(value) <> 0
QUALIFY row_number() OVER (PARTITION BY user_id % 5, ts::DATE ORDER BY event_id DESC) = 1""",
    "table_violations": """
WITH h AS (SELECT * REPLACE (CASE WHEN bpm % 17 = 0 THEN 'odd' ELSE context END AS context, CASE WHEN ts % 13 > 0 THEN ts END AS ts) FROM (@B(hr)))
SELECT count(*) FILTER (ts IS NULL) AS null_key, count(*) FILTER (source <> 's') AS foreign_source, count(*) FILTER (context NOT IN ('background', 'workout', 'spot', 'unknown')) AS bad_context,
       (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT person, source, device_id, ts FROM h)) FROM h) AS duplicate_key FROM h""",
    "ingested_points": f"WITH {_HOURS} SELECT source, device_id, ts, (steps + CASE WHEN {_SECOND} THEN 1000 ELSE 0 END)::INTEGER AS steps FROM s",
    "ingest_log": f"""
WITH {_HOURS} SELECT 'mifitness' AS source, 'first' AS file_sha256, 'step_samples' AS tbl, count(*) AS rows, min(ts) AS min_ts, max(ts) AS max_ts FROM s WHERE ts // 3600 % 3 > 0
UNION ALL SELECT 'mifitness', 'second', 'step_samples', count(*), min(ts), max(ts) FROM s WHERE {_SECOND}""",
    "local_iso": """
SELECT o_orderkey, strftime(timezone('Europe/Berlin', to_timestamp(epoch(o_orderdate)::BIGINT + o_orderkey % 86400)), '%Y-%m-%d %H:%M') AS iso FROM orders""",
}


def _one(name: str, value: str, status: str, reason: str, where: str) -> str:
    return (
        f"SELECT person, date::VARCHAR AS date, '{name}' AS metric, CASE WHEN {status} = 'ok' THEN round(CAST({value} AS DOUBLE), 6) END AS value, "
        f"{status} AS status, CAST({reason} AS VARCHAR) AS reason FROM w WHERE {where}"
    )


_COLUMNS = [f"recovery_{k}_{p}" for k in ("z", "pts") for p in ("rhr", "sleep")]
SQL["daily_long"] = "WITH w AS (@B(wide)) " + " UNION ALL ".join(_one(m.name, m.value, m.status, m.reason, m.where) for m in metrics(_COLUMNS))
