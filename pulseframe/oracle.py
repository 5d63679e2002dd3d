"""DuckDB SQL for the registered queries: the same results by other means."""

from __future__ import annotations

from .bindings import duck
from .config import default_rules

_ZONE = "Europe/Berlin"
SQL: dict[str, str] = {}


def _offset(ts: str) -> str:
    """Minutes that Berlin is ahead of UTC at an instant."""
    at = f"to_timestamp({ts})"
    return f"CAST(floor((epoch(timezone('{_ZONE}', {at})) - ({ts})) / 60) AS INTEGER)"


def _date(seconds: str) -> str:
    return f"(DATE '1970-01-01' + CAST(floor(({seconds}) / 86400.0) AS INTEGER))"


_VALID = """
valid AS (
  SELECT person, source, device_id, ts, bpm::DOUBLE AS bpm, context FROM (@B(hr))
  WHERE context IN ('background', 'workout') AND bpm BETWEEN 25 AND 230
  QUALIFY row_number() OVER (PARTITION BY person, ts ORDER BY source, device_id, bpm) = 1
)"""
_CADENCE = """
gaps AS (
  SELECT person, ts, coalesce(lead(ts) OVER w - ts, ts - lag(ts) OVER w)::DOUBLE AS gap FROM @SAMPLES WINDOW w AS (PARTITION BY person ORDER BY ts)
), medians AS (
  SELECT person, ts, median(CASE WHEN gap <= 3600 THEN gap END) OVER (PARTITION BY person ORDER BY ts ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS m FROM gaps
), cadences AS (
  SELECT person, ts, coalesce(first_value(m IGNORE NULLS) OVER (PARTITION BY person ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
         last_value(m IGNORE NULLS) OVER (PARTITION BY person ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 60.0) AS cadence FROM medians
)"""
_WORN = """
marked AS (
  SELECT *, ts - lag(ts) OVER w > lag(greatest(3 * cadence, 600)) OVER w AS brk FROM cadences WINDOW w AS (PARTITION BY person ORDER BY ts)
), numbered AS (
  SELECT *, sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY person ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM marked
), worn AS (
  SELECT person, arg_min(ts - floor(cadence / 2)::BIGINT, ts) AS start_ts, arg_max(ts + floor(cadence / 2)::BIGINT, ts) AS end_ts FROM numbered GROUP BY person, island
)"""
_valid_worn = f"WITH {_VALID}, {_CADENCE.replace('@SAMPLES', 'valid')}, {_WORN}"
_WEAR = (
    _valid_worn
    + f""", span AS (SELECT person, min({_date("ts")}) AS a, max({_date("ts")}) AS b FROM valid GROUP BY person),
days AS (SELECT person, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS date FROM span),
windows AS (
  SELECT person, date, epoch(date)::BIGINT + 8 * 3600 - 60 * o AS lo, epoch(date)::BIGINT + 22 * 3600 - 60 * o AS hi
  FROM (SELECT *, {_offset("epoch(date)::BIGINT + 43200")} AS o FROM days)
), wear AS (
  SELECT w.person, w.date, coalesce(sum(greatest(least(hi, end_ts) - greatest(lo, start_ts), 0)) FILTER (x.person IS NOT NULL), 0) / (any_value(hi) - any_value(lo))::DOUBLE AS day_wear
  FROM windows w LEFT JOIN worn x ON x.person = w.person AND x.start_ts < hi AND x.end_ts > lo GROUP BY w.person, w.date
)"""
)
SQL["valid_hr"] = f"WITH {_VALID} SELECT * FROM valid"
SQL["local_cadence"] = f"WITH {_VALID}, {_CADENCE.replace('@SAMPLES', 'valid')} SELECT * FROM cadences"
SQL["worn_intervals"] = _valid_worn + " SELECT * FROM worn"
SQL["wear_daily"] = _WEAR + " SELECT person, date, round(day_wear, 6) AS day_wear FROM wear"
SQL["daily_steps"] = (
    _WEAR
    + f""", per_day AS (
  SELECT person, date, max(s) AS s FROM (SELECT person, {_date("ts + 60 * " + _offset("ts"))} AS date, device_id, sum(steps)::DOUBLE AS s FROM (@B(steps)) GROUP BY ALL) GROUP BY ALL
)
SELECT person, date, CASE WHEN s IS NOT NULL THEN s WHEN day_wear >= 0.7 THEN 0.0 END AS steps,
       CASE WHEN s IS NOT NULL OR day_wear >= 0.7 THEN 'ok' ELSE 'insufficient_data' END AS steps_status,
       CASE WHEN s IS NOT NULL AND day_wear < 0.7 THEN 'band off for part of 08-22: steps may be undercounted'
            WHEN s IS NULL AND day_wear < 0.7 THEN 'band not worn: steps unknown' END AS steps_reason
FROM wear LEFT JOIN per_day USING (person, date)"""
)

# --- time ------------------------------------------------------------------------------------------

_TIMELINE = """
anchors AS (
  SELECT person, start_ts AS ts, tz_offset_min AS o, 0 AS r FROM (@B(@T)) WHERE tz_offset_min IS NOT NULL
  UNION ALL SELECT person, end_ts, tz_offset_min, 1 FROM (@B(@T)) WHERE tz_offset_min IS NOT NULL
), timeline AS (SELECT person, ts, o AS offset_min FROM anchors QUALIFY row_number() OVER (PARTITION BY person, ts ORDER BY r, o) = 1)"""


def _local(source: str, column: str, name: str, extra: str = "*") -> str:
    """SELECT from ``source`` with the offset in force at a column."""
    return f"""
SELECT {extra}, coalesce(CASE WHEN b.ts IS NOT NULL AND (a.ts IS NULL OR x.{column} - b.ts <= a.ts - x.{column}) THEN CASE WHEN x.{column} - b.ts <= 129600 THEN b.offset_min END
       ELSE CASE WHEN a.ts - x.{column} <= 129600 THEN a.offset_min END END, {_offset("x." + column)})::INTEGER AS {name}
FROM {source} x ASOF LEFT JOIN timeline b ON b.person = x.person AND b.ts <= x.{column} ASOF LEFT JOIN timeline a ON a.person = x.person AND a.ts >= x.{column}"""


_sessions_tl = f"WITH {_TIMELINE.replace('@T', 'sessions')}"
SQL["offset_timeline"] = _sessions_tl + " SELECT person, ts, offset_min FROM timeline"
SQL["nearest_offsets"] = (
    _sessions_tl + ", s AS (SELECT DISTINCT person * 5 AS person, device_id, ts, bpm, context FROM (@B(hr)))" + _local("s", "ts", "offset_min", "x.person, x.device_id, x.ts, x.bpm, x.context")
)
SQL["zone_clock"] = f"""
WITH o AS (SELECT o_orderkey, epoch(o_orderdate)::BIGINT + o_orderkey % 86400 AS ts FROM orders), z AS (SELECT *, {_offset("ts")} AS off FROM o),
m AS (SELECT *, ((ts + off * 60) % 86400) // 60 AS minute FROM z)
SELECT o_orderkey, off AS offset_min, {_date("ts + off * 60")} AS day, minute::INTEGER AS minute,
       (minute // 60)::VARCHAR || ':' || lpad((minute % 60)::VARCHAR, 2, '0') AS clock FROM m"""
_SUNDAY = "(last_day(make_date(year(day), {m}, 1)) - CAST(dayofweek(last_day(make_date(year(day), {m}, 1))) AS INTEGER))"
SQL["eu_switches"] = f"""
WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS day, epoch(o_orderdate) AS ts FROM orders),
s AS (SELECT *, {_SUNDAY.format(m=3)} AS spring, {_SUNDAY.format(m=10)} AS autumn FROM o)
SELECT o_orderkey, spring, autumn, ts >= epoch(spring) + 3600 AND ts < epoch(autumn) + 3600 AS summer,
       abs(day - spring) <= 1 OR abs(day - autumn) <= 1 AS near_switch FROM s"""


def _record(source: str, column: str, name: str, columns: str) -> str:
    """SELECT from ``source`` with the offset at one end of each record."""
    at_home = f"(tz_offset_min = {_offset('start_ts')} OR tz_offset_min = {_offset('end_ts')})"
    return f"""SELECT {columns}, (CASE WHEN tz_offset_min IS NULL THEN near WHEN {at_home} THEN {_offset(column)} ELSE tz_offset_min END)::INTEGER AS {name}
FROM ({_local(source, column, "near", "x.*")})"""


SQL["record_offsets"] = (
    _sessions_tl
    + ", s AS (SELECT DISTINCT person, source, device_id, start_ts, end_ts, tz_offset_min FROM (@B(sessions))) "
    + _record("s", "end_ts", "offset_end", "person, source, device_id, start_ts, end_ts, tz_offset_min")
)

# --- nights ----------------------------------------------------------------------------------------

_RANK = "CASE source WHEN 'gadgetbridge' THEN 0 WHEN 'mifitness' THEN 1 WHEN 'synthetic' THEN 2 ELSE 3 END"
_ONE = "one AS (SELECT * FROM (@B(sessions)) QUALIFY row_number() OVER (PARTITION BY person, source, device_id, start_ts ORDER BY end_ts DESC NULLS LAST, is_nap DESC NULLS LAST, tz_offset_min DESC NULLS LAST, dev_awake_min DESC NULLS LAST) = 1)"
SQL["resolve_sources"] = f"""
WITH {_ONE}, d AS (SELECT person, source, device_id, start_ts, end_ts, {_date("end_ts + 60 * coalesce(tz_offset_min, 60)")} AS wake_date FROM one)
SELECT * FROM d QUALIFY {_RANK} = min({_RANK}) OVER (PARTITION BY person, wake_date)"""


def _overlap_fold(source: str, columns: str) -> str:
    """Recursive: walk each source's sessions in order, the longer of overlapping ones stays at hand."""
    return f"""
ordered AS (SELECT *, row_number() OVER (PARTITION BY person, source ORDER BY start_ts, end_ts, device_id) AS n FROM {source}),
walk AS (
  SELECT person, source, n, n AS cur, start_ts AS s, end_ts AS e FROM ordered WHERE n = 1
  UNION ALL
  SELECT o.person, o.source, o.n, CASE WHEN o.start_ts < w.e AND o.end_ts - o.start_ts <= w.e - w.s THEN w.cur ELSE o.n END,
         CASE WHEN o.start_ts < w.e AND o.end_ts - o.start_ts <= w.e - w.s THEN w.s ELSE o.start_ts END,
         CASE WHEN o.start_ts < w.e AND o.end_ts - o.start_ts <= w.e - w.s THEN w.e ELSE o.end_ts END
  FROM walk w JOIN ordered o ON o.person = w.person AND o.source = w.source AND o.n = w.n + 1
),
-- kept: at hand when a later session begins at or after its end, or at the end of the list
kept AS (
  SELECT w.person, w.source, w.cur FROM walk w LEFT JOIN ordered o ON o.person = w.person AND o.source = w.source AND o.n = w.n + 1 WHERE o.n IS NULL OR o.start_ts >= w.e
), alone AS (SELECT {columns} FROM ordered o JOIN kept k ON k.person = o.person AND k.source = o.source AND k.cur = o.n)"""


SQL["drop_overlaps"] = (
    "WITH RECURSIVE s AS (SELECT DISTINCT person, source, device_id, start_ts, end_ts FROM (@B(sessions))), "
    + _overlap_fold("s", "o.person, o.source, o.device_id, o.start_ts, o.end_ts")
    + " SELECT * FROM alone"
)
_EPISODES = f"""WITH RECURSIVE {_ONE}, {_TIMELINE.replace("@B(@T)", "SELECT * FROM one")},
dated AS ({_record("one", "end_ts", "off", "person, source, device_id, start_ts, end_ts, tz_offset_min, is_nap")}),
chosen AS (SELECT * FROM dated QUALIFY {_RANK} = min({_RANK}) OVER (PARTITION BY person, {_date("end_ts + 60 * off")})),
{_overlap_fold("chosen", "o.person, o.source, o.device_id, o.start_ts, o.end_ts, o.tz_offset_min, o.is_nap")},
p1 AS ({_record("alone", "start_ts", "off_start", "person, source, device_id, start_ts, end_ts, tz_offset_min, is_nap")}),
p2 AS ({_record("p1", "end_ts", "off_end", "person, source, device_id, start_ts, end_ts, is_nap, off_start")}),
line AS (SELECT *, coalesce(is_nap = 1, false) AS nap, row_number() OVER (PARTITION BY person ORDER BY start_ts, end_ts, source, device_id) AS i FROM p2),
fold AS (
  SELECT person, i, 0::BIGINT AS episode, start_ts, end_ts, source, device_id, nap, off_start, off_end, end_ts - start_ts AS longest FROM line WHERE i = 1
  UNION ALL
  SELECT l.person, l.i, CASE WHEN j THEN f.episode ELSE f.episode + 1 END, CASE WHEN j THEN f.start_ts ELSE l.start_ts END,
         CASE WHEN j THEN greatest(f.end_ts, l.end_ts) ELSE l.end_ts END, l.source,
         CASE WHEN j AND l.end_ts - l.start_ts <= f.longest THEN f.device_id ELSE l.device_id END, l.nap,
         CASE WHEN j THEN f.off_start ELSE l.off_start END, CASE WHEN j AND l.end_ts <= f.end_ts THEN f.off_end ELSE l.off_end END,
         CASE WHEN j THEN greatest(f.longest, l.end_ts - l.start_ts) ELSE l.end_ts - l.start_ts END
  FROM (SELECT f.*, l.source = f.source AND l.nap = f.nap AND l.start_ts - f.end_ts < 3600 AS j FROM fold f JOIN line l ON l.person = f.person AND l.i = f.i + 1) f
  JOIN line l ON l.person = f.person AND l.i = f.i + 1
), ep0 AS (
  SELECT person, episode, max(i) AS i, count(*) AS n_members FROM fold GROUP BY person, episode
), ep1 AS (
  SELECT f.person, f.episode, f.source, f.device_id, f.start_ts, f.end_ts, f.off_start AS offset_start, f.off_end AS offset_end, f.nap AS is_nap, n_members,
         {_date("f.end_ts + 60 * f.off_end")} AS wake_date, (f.end_ts - f.start_ts) / 3600.0::DOUBLE AS duration_h
  FROM fold f JOIN ep0 USING (person, episode, i)
), ep AS (
  SELECT *, CASE WHEN NOT is_nap AND duration_h >= 3 AND row_number() OVER (PARTITION BY person, wake_date ORDER BY (NOT is_nap AND duration_h >= 3) DESC, duration_h DESC, start_ts, episode) = 1
            THEN 'main' ELSE 'nap' END AS role FROM ep1
)"""
SQL["episodes"] = _EPISODES + " SELECT * REPLACE (n_members::INTEGER AS n_members) FROM ep"
_SWITCH = " OR ".join(f"abs(date - {_SUNDAY.format(m=m).replace('day)', 'date)')}) <= 1" for m in (3, 10))
_NIGHTS = f"""{_EPISODES}, link AS (
  SELECT f.person, f.episode, l.source, l.device_id, l.start_ts AS session_start_ts, l.end_ts FROM fold f JOIN line l USING (person, i)
), seg AS (
  SELECT g.*, k.episode, ep.start_ts AS a, ep.end_ts AS b FROM (SELECT DISTINCT * FROM (@B(segments))) g
  JOIN link k USING (person, source, device_id, session_start_ts) JOIN ep USING (person, episode)
), stages AS (
  SELECT person, episode, sum(m) FILTER (stage <> 'awake') AS tst, coalesce(sum(m) FILTER (stage = 'deep'), 0) AS deep, coalesce(sum(m) FILTER (stage = 'light'), 0) AS light,
         coalesce(sum(m) FILTER (stage = 'rem'), 0) AS rem
  FROM (SELECT *, (least(greatest(end_ts, a), b) - least(greatest(start_ts, a), b)) / 60.0::DOUBLE AS m FROM seg) GROUP BY person, episode
), envelope AS (
  SELECT k.person, k.episode, sum((k.end_ts - k.session_start_ts) / 60.0::DOUBLE - coalesce(o.dev_awake_min, 0)) AS env
  FROM link k JOIN one o ON o.person = k.person AND o.source = k.source AND o.device_id = k.device_id AND o.start_ts = k.session_start_ts GROUP BY k.person, k.episode
), naps AS (SELECT person, wake_date, sum((end_ts - start_ts) / 60.0::DOUBLE) AS nap FROM ep WHERE role = 'nap' GROUP BY ALL),
n1 AS (
  SELECT person, wake_date AS date, episode, source, device_id, start_ts AS onset_ts, end_ts AS wake_ts, offset_start, offset_end,
         (((start_ts + 60 * offset_start) % 86400) // 60)::INTEGER AS onset_clock, (((end_ts + 60 * offset_end) % 86400) // 60)::INTEGER AS wake_clock,
         (end_ts - start_ts) / 60.0::DOUBLE AS spt_min, CASE WHEN rem IS NOT NULL THEN coalesce(tst, 0) ELSE env END AS tst_min,
         CASE WHEN rem IS NOT NULL THEN 'segments' ELSE 'envelope' END AS tst_basis, coalesce(rem > 0, false) AS stages_available, deep, light, rem, coalesce(nap, 0.0) AS nap_min,
         abs(offset_end - lag(offset_end) OVER (PARTITION BY person ORDER BY episode)) AS moved
  FROM ep LEFT JOIN stages USING (person, episode) LEFT JOIN envelope USING (person, episode) LEFT JOIN naps USING (person, wake_date) WHERE role = 'main'
), nights AS (
  SELECT person, date, episode, source, device_id, onset_ts, wake_ts, offset_start, offset_end, onset_clock, wake_clock, spt_min, tst_min, greatest(spt_min - tst_min, 0) AS waso_min,
         CASE WHEN spt_min > 0 THEN tst_min / spt_min END AS sme, tst_basis, CASE WHEN stages_available THEN deep END AS deep_min,
         CASE WHEN stages_available THEN light END AS light_min, CASE WHEN stages_available THEN rem END AS rem_min, stages_available, nap_min,
         coalesce(moved > 0 AND NOT (moved = 60 AND ({_SWITCH})), false) AS tz_change
  FROM n1
)"""
SQL["nightly_sleep"] = (
    _NIGHTS
    + " SELECT * REPLACE (round(spt_min, 6) AS spt_min, round(tst_min, 6) AS tst_min, round(waso_min, 6) AS waso_min, round(sme, 6) AS sme, round(deep_min, 6) AS deep_min, "
    "round(light_min, 6) AS light_min, round(rem_min, 6) AS rem_min, round(nap_min, 6) AS nap_min) FROM nights"
)
_GRID = f"""{_NIGHTS}, spans AS (
  SELECT person, start_ts - 7200 AS start_ts, end_ts + 36000 AS end_ts, 0 AS mark FROM ep
  UNION ALL SELECT person, start_ts, end_ts, 3 FROM ep UNION ALL SELECT person, start_ts, end_ts, 4 FROM seg WHERE stage = 'awake'
), g1 AS ({_local("spans", "start_ts", "o1", "x.*")}), g2 AS ({_local("g1", "end_ts", "o2", "x.*")}),
minutes AS (
  SELECT person, m, max(mark) AS mark FROM (
    SELECT person, mark, unnest(generate_series(floor((start_ts + 60 * o1) / 60.0)::BIGINT, ceil((end_ts + 60 * o2) / 60.0)::BIGINT - 1)) AS m FROM g2
  ) GROUP BY person, m
), grid AS (SELECT person, DATE '1970-01-01' + (m // 1440)::INTEGER AS day, (m % 1440)::INTEGER AS minute, (mark % 2)::INTEGER AS asleep FROM minutes),
pairs AS (
  SELECT a.person, a.day, count(*) AS known, count(*) FILTER (a.asleep = b.asleep) AS agree
  FROM grid a JOIN grid b ON b.person = a.person AND b.day = a.day - 1 AND b.minute = a.minute GROUP BY a.person, a.day
)"""
SQL["sleep_wake_grid"] = _GRID + " SELECT person, day, count(*) AS known, sum(asleep)::BIGINT AS asleep, sum(minute * asleep)::BIGINT AS weighted FROM grid GROUP BY person, day"
SQL["day_pairs"] = _GRID + " SELECT * FROM pairs"


def _csd(column: str, over: str = "") -> str:
    angle = f"({column} / 1440.0::DOUBLE * 2 * pi())"
    c, s = f"avg(cos({angle})){over}", f"avg(sin({angle})){over}"
    return f"sqrt(-2 * ln(greatest(1e-12, least(1.0, sqrt({c} * {c} + {s} * {s}))))) * 1440 / (2 * pi())"


_W7 = " OVER (PARTITION BY person ORDER BY date RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)"
SQL["regularity"] = f"""{_GRID}, x AS (
  SELECT *, bool_or(tz_change) OVER (PARTITION BY person ORDER BY date ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS gone FROM nights
), u AS (SELECT person, date, gone, CASE WHEN NOT gone THEN onset_clock END AS o, CASE WHEN NOT gone THEN wake_clock END AS w FROM x),
c AS (SELECT person, date, count(o){_W7} AS reg_n, {_csd("o", _W7)} AS oc, {_csd("w", _W7)} AS wc FROM u),
good AS (SELECT * FROM pairs p WHERE known >= 720 AND NOT EXISTS (SELECT 1 FROM u WHERE u.gone AND u.person = p.person AND (u.date = p.day OR u.date + 1 = p.day))),
s AS (SELECT c.person, c.date, count(g.day) AS n, sum(known) AS k, sum(agree) AS a FROM c LEFT JOIN good g ON g.person = c.person AND g.day BETWEEN c.date - 6 AND c.date GROUP BY ALL),
r AS (SELECT *, CASE WHEN reg_n >= 5 THEN n ELSE 0 END AS np FROM c JOIN s USING (person, date))
SELECT person, date, reg_n, CASE WHEN np >= 5 THEN round(200.0::DOUBLE * a / k - 100, 6) END AS sri, CASE WHEN reg_n >= 5 THEN round(oc, 6) END AS onset_csd,
       CASE WHEN reg_n >= 5 THEN round(wc, 6) END AS wake_csd, CASE WHEN reg_n >= 5 THEN 'ok' ELSE 'insufficient_data' END AS reg_status, np::BIGINT AS sri_pairs,
       CASE WHEN reg_n < 5 THEN 'only ' || reg_n || ' usable nights in the 7-day window (need 5)'
            WHEN np < 5 THEN 'only ' || np || ' day pairs with >= 50% of minutes known on both days (need 5): band off for long stretches' END AS sri_reason
FROM r"""
SQL["nightly_rhr"] = f"""
WITH hr AS (@B(dense_hr)), {_CADENCE.replace("@SAMPLES", "hr")}, {_WORN},
span AS (SELECT person, min(ts) AS a, max(ts) AS b FROM hr GROUP BY person),
nights AS (SELECT person, {_date("s * 12")} AS date, s AS onset, s + 12000 AS wake FROM (SELECT person, unnest(generate_series(a, b, 14400)) AS s FROM span)),
cov AS (
  SELECT n.person, n.date, any_value(onset) AS onset, any_value(wake) AS wake, coalesce(sum(greatest(least(wake, end_ts) - greatest(onset, start_ts), 0)) FILTER (w.person IS NOT NULL), 0) / 12000.0::DOUBLE AS hr_coverage
  FROM nights n LEFT JOIN worn w ON w.person = n.person AND w.start_ts < wake AND w.end_ts > onset GROUP BY n.person, n.date
), inside AS (
  SELECT c.person, c.date, onset + 1800 AS lo, ts, bpm, ts - lag(ts) OVER (PARTITION BY c.person, c.date ORDER BY ts) AS step
  FROM cov c JOIN hr h ON h.person = c.person AND h.ts >= onset + 1800 AND h.ts < wake
), cad AS (SELECT person, date, median(step) AS c, count(*) AS n, avg(bpm) AS mean_hr, greatest(600, 3 * median(step)) AS w FROM inside GROUP BY ALL),
wins AS (
  SELECT a.person, a.date, a.ts, any_value(a.lo) AS lo, avg(b.bpm) AS m, count(*) AS held
  FROM inside a JOIN cad USING (person, date) JOIN inside b ON b.person = a.person AND b.date = a.date AND b.ts <= a.ts AND b.ts > a.ts - floor(w) GROUP BY ALL
), best AS (
  SELECT person, date, min(m) FILTER (held >= greatest(2, ceil(0.7 * w / c)) AND ts >= lo + w - c) AS rhr FROM wins JOIN cad USING (person, date) GROUP BY ALL
), r AS (SELECT *, hr_coverage >= 0.8 AND coalesce(n >= 3, false) AS usable FROM cov LEFT JOIN cad USING (person, date) LEFT JOIN best USING (person, date))
SELECT person, date, round(hr_coverage, 6) AS hr_coverage, CASE WHEN usable THEN round(rhr, 6) END AS rhr, CASE WHEN usable THEN round(mean_hr, 6) END AS sleep_hr_mean,
       CASE WHEN usable THEN round(w / 60, 6) END AS rhr_window_min, CASE WHEN usable THEN c END AS hr_cadence_s,
       CASE WHEN usable AND rhr IS NOT NULL THEN 'ok' ELSE 'insufficient_data' END AS phys_status,
       CASE WHEN usable AND rhr IS NOT NULL THEN NULL WHEN usable THEN 'no window with enough samples'
            WHEN hr_coverage > 0 THEN 'HR covers ' || round_even(hr_coverage * 100, 0)::INTEGER || '% of the sleep period'
            ELSE 'no HR samples during this night (band off, or not in this export yet)' END AS phys_reason
FROM r"""

# --- training load ---------------------------------------------------------------------------------

SQL["interval_slice"] = """
SELECT w.person, w.start_ts, w.sport, count(*) AS n, round(avg(bpm), 6) AS avg_bpm, round(max(bpm), 6) AS max_bpm
FROM (@B(workouts)) w JOIN (@B(dense_hr)) h ON h.person = w.person AND h.ts >= w.start_ts AND h.ts < w.end_ts GROUP BY ALL"""
_HRMAX = f"""
wk AS (@B(workouts)), span AS (SELECT person, min({_date("start_ts")}) AS a, max({_date("start_ts")}) AS b FROM wk GROUP BY person),
days AS (SELECT person, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS date FROM span),
pred AS (SELECT *, 220 - (30.0::DOUBLE - (DATE '2026-01-01' - date) / 365.25::DOUBLE) AS p FROM days),
peaks AS (
  SELECT d.person, d.date, max_hr FROM pred d JOIN wk w ON w.person = d.person AND {_date("w.start_ts")} <= d.date AND {_date("w.start_ts")} > d.date - 730 AND max_hr <= p + 15
  QUALIFY row_number() OVER (PARTITION BY d.person, d.date ORDER BY max_hr DESC) <= 3
), mid AS (SELECT person, date, median(max_hr) AS m FROM peaks GROUP BY ALL HAVING count(*) = 3),
hrmax AS (SELECT person, date, CASE WHEN m > p THEN m ELSE p END AS hr_max, CASE WHEN m > p THEN 'observed' ELSE 'age' END AS hr_max_basis FROM pred LEFT JOIN mid USING (person, date))"""
SQL["hrmax_by_date"] = f"WITH {_HRMAX} SELECT person, date, round(hr_max, 6) AS hr_max, hr_max_basis FROM hrmax"
_ZONE_OF = "CASE WHEN f < 0.5 THEN 0 WHEN f < 0.6 THEN 1 WHEN f < 0.7 THEN 2 WHEN f < 0.8 THEN 3 WHEN f < 0.9 THEN 4 WHEN f IS NOT NULL THEN 5 END"
_INSIDE = """
hr AS (@B(dense_hr)), own AS (
  SELECT w.person, w.start_ts, w.end_ts, w.sport, h.ts, h.bpm, h.ts - lag(h.ts) OVER x AS step, lead(h.ts) OVER x AS nxt,
         CASE WHEN count(h.bpm) OVER y = 3 THEN median(h.bpm) OVER y END AS median3
  FROM wk w JOIN hr h ON h.person = w.person AND h.ts >= w.start_ts AND h.ts < w.end_ts
  WINDOW x AS (PARTITION BY w.person, w.start_ts, w.end_ts, w.sport ORDER BY h.ts), y AS (PARTITION BY w.person, w.start_ts, w.end_ts, w.sport ORDER BY h.ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
), seen AS (SELECT person, start_ts, end_ts, sport, count(*) AS n, median(step) AS c, max(median3) AS peak FROM own GROUP BY ALL)"""
_sums = ", ".join(f"coalesce(sum(m) FILTER (z = {i}), 0.0) AS z{i}" for i in range(1, 6))
_LOADS = f"""
WITH {_TIMELINE.replace("@T", "workouts")}, {_HRMAX}, {_INSIDE},
dated AS (SELECT *, {_date("start_ts + 60 * off")} AS date FROM ({_record("wk", "start_ts", "off", "*")})),
rated AS (SELECT d.*, hr_max, n, c, peak FROM dated d LEFT JOIN hrmax USING (person, date) LEFT JOIN seen USING (person, start_ts, end_ts, sport)),
mins AS (
  SELECT person, start_ts, end_ts, sport, {_sums} FROM (
    SELECT o.*, least(coalesce(o.nxt, greatest(o.end_ts, o.ts)) - o.ts, 2 * r.c) / 60.0::DOUBLE AS m, (SELECT {_ZONE_OF} FROM (SELECT o.bpm / r.hr_max AS f)) AS z
    FROM own o JOIN rated r USING (person, start_ts, end_ts, sport) WHERE r.hr_max IS NOT NULL
  ) GROUP BY ALL
), q AS (
  SELECT *, CASE WHEN n > 2 THEN c END AS cadence_s, CASE WHEN n > 2 AND end_ts > start_ts THEN least(1.0, n * c / (end_ts - start_ts)) ELSE 0.0 END AS coverage,
         zone1_s + zone2_s + zone3_s + zone4_s + zone5_s AS zs
  FROM rated LEFT JOIN mins USING (person, start_ts, end_ts, sport)
), l AS (
  SELECT *, CASE WHEN cadence_s <= 120 AND coverage >= 0.8 AND hr_max IS NOT NULL THEN z1 + 2 * z2 + 3 * z3 + 4 * z4 + 5 * z5 END AS load_ours,
         CASE WHEN zs > 0 THEN (zone1_s + 2 * zone2_s + 3 * zone3_s + 4 * zone4_s + 5 * zone5_s) / 60 END AS load_device FROM q
), loads AS (
  SELECT person, start_ts, end_ts, sport, date, coalesce(load_ours, load_device) AS load,
         CASE WHEN load_ours IS NOT NULL THEN 'hr_ours' WHEN load_device IS NOT NULL THEN 'device_zones' ELSE 'low_resolution' END AS method,
         load_ours, load_device, hr_max, cadence_s, coverage, avg_hr, CASE WHEN cadence_s <= 120 AND n >= 5 THEN peak ELSE max_hr END AS peak_hr,
         {", ".join(f"CASE WHEN load_ours IS NOT NULL THEN z{i} WHEN load_device IS NOT NULL THEN zone{i}_s / 60 END AS z{i}_min" for i in range(1, 6))}
  FROM l
)"""
_round = lambda *cs: ", ".join(f"round({c}, 6) AS {c}" for c in cs)
_LOAD_DOUBLES = ("load", "load_ours", "load_device", "hr_max", "cadence_s", "coverage", "avg_hr", "peak_hr", *(f"z{i}_min" for i in range(1, 6)))
SQL["workout_loads"] = _LOADS + f" SELECT * REPLACE ({_round(*_LOAD_DOUBLES)}) FROM loads"
SQL["sustained_peaks"] = f"""
WITH wk AS (@B(workouts)), {_INSIDE}
SELECT w.person, w.start_ts, w.end_ts, w.sport, CASE WHEN n >= 5 AND c <= 120 THEN peak END AS max_hr FROM wk w LEFT JOIN seen USING (person, start_ts, end_ts, sport)"""


def _detect(mask: str) -> str:
    return f"""
wide_max AS (SELECT person, date, max(hr_max) AS hr_max FROM (SELECT person, date, hr_max FROM hrmax UNION ALL SELECT person, date + 1, hr_max FROM hrmax) GROUP BY ALL),
hd AS (SELECT *, {_date("ts + 60 * off")} AS date FROM ({_local("hr", "ts", "off", "x.*")})),
h1 AS (SELECT person, ts, bpm, date, hr_max, coalesce(ts - lag(ts) OVER (PARTITION BY person ORDER BY ts), 60) AS gap FROM hd LEFT JOIN wide_max USING (person, date)),
h2 AS (SELECT *, sum(CASE WHEN gap > 120 THEN 1 ELSE 0 END) OVER (PARTITION BY person ORDER BY ts ROWS UNBOUNDED PRECEDING) AS part FROM h1),
h3 AS (
  SELECT *, CASE WHEN count(bpm / hr_max) OVER w >= 3 THEN median(bpm / hr_max) OVER w END AS smooth FROM h2
  WINDOW w AS (PARTITION BY person, part ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)
), hot AS (
  SELECT person, ts, ts - lag(ts) OVER (PARTITION BY person ORDER BY ts) AS since FROM h3 WHERE smooth >= 0.6 AND gap <= 120 AND {mask}
), runs AS (
  SELECT person, min(ts) AS a, max(ts) AS b FROM (SELECT *, sum(CASE WHEN since > 600 THEN 1 ELSE 0 END) OVER (PARTITION BY person ORDER BY ts ROWS UNBOUNDED PRECEDING) AS r FROM hot)
  GROUP BY person, r HAVING max(ts) - min(ts) >= 1200
), rs AS (
  SELECT r.person, r.a, r.b, h.ts, h.bpm, h.date, h.hr_max, h.ts - lag(h.ts) OVER x AS step, lead(h.ts) OVER x AS nxt, CASE WHEN count(h.bpm) OVER y = 3 THEN median(h.bpm) OVER y END AS m3
  FROM runs r JOIN h3 h ON h.person = r.person AND h.ts BETWEEN r.a AND r.b
  WINDOW x AS (PARTITION BY r.person, r.a ORDER BY h.ts), y AS (PARTITION BY r.person, r.a ORDER BY h.ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
), rg AS (
  SELECT person, a, any_value(b) AS b, median(step) AS c, arg_min(date, ts) AS date, arg_min(hr_max, ts) AS hr_max, avg(bpm) AS avg_hr, max(m3) AS peak_hr FROM rs GROUP BY person, a
), rz AS (
  SELECT person, a, {_sums} FROM (
    SELECT s.person, s.a, least(coalesce(s.nxt, floor(g.b + g.c)) - s.ts, 2 * g.c) / 60.0::DOUBLE AS m, (SELECT {_ZONE_OF} FROM (SELECT s.bpm / g.hr_max AS f)) AS z FROM rs s JOIN rg g USING (person, a)
  ) GROUP BY ALL
), detected AS (
  SELECT person, a AS start_ts, floor(b + c)::BIGINT AS end_ts, 'detected' AS sport, date, z1 + 2 * z2 + 3 * z3 + 4 * z4 + 5 * z5 AS load, 'detected' AS method,
         z1 + 2 * z2 + 3 * z3 + 4 * z4 + 5 * z5 AS load_ours, NULL::DOUBLE AS load_device, hr_max, c AS cadence_s, 1.0::DOUBLE AS coverage, avg_hr, peak_hr,
         z1 AS z1_min, z2 AS z2_min, z3 AS z3_min, z4 AS z4_min, z5 AS z5_min
  FROM rg JOIN rz USING (person, a)
)"""


_MASK = "NOT EXISTS (SELECT 1 FROM (@B(bunched_workouts)) l WHERE l.person = h3.person AND h3.ts >= l.start_ts - 300 AND h3.ts < l.end_ts + 300)"
SQL["detect_sessions"] = _LOADS + "," + _detect(_MASK) + f" SELECT * REPLACE ({_round(*_LOAD_DOUBLES)}) FROM detected"
SQL["detector_recall"] = (
    _LOADS
    + ","
    + _detect("true")
    + """, dense AS (SELECT DISTINCT person, start_ts, end_ts, sport FROM loads WHERE method = 'hr_ours'), shares AS (
  SELECT d.person, d.start_ts, d.end_ts, d.sport, coalesce(sum(greatest(least(d.end_ts, x.end_ts) - greatest(d.start_ts, x.start_ts), 0)) FILTER (x.person IS NOT NULL), 0) / (d.end_ts - d.start_ts)::DOUBLE AS s
  FROM dense d LEFT JOIN detected x ON x.person = d.person AND x.start_ts < d.end_ts AND x.end_ts > d.start_ts GROUP BY d.person, d.start_ts, d.end_ts, d.sport
) SELECT count(*) AS n, count(*) FILTER (s >= 0.5) AS found FROM shares"""
)
SQL["banister_daily"] = f"""
WITH {_TIMELINE.replace("@T", "workouts")}, {_HRMAX}, hr AS (@B(dense_hr)),
hd AS (SELECT *, {_date("ts + 60 * off")} AS date FROM ({_local("hr", "ts", "off", "x.*")})),
st AS (SELECT person, ts, bpm, date, coalesce(lead(ts) OVER (PARTITION BY person ORDER BY ts) - ts, 60)::DOUBLE AS step FROM hd),
r AS (
  SELECT s.*, least(step, 240.0) / 60 AS m, CASE WHEN x.hr_max IS NOT NULL THEN greatest(0.0, least(1.0, (bpm - 65.0) / (hr_max - 65.0))) END AS f FROM st s LEFT JOIN hrmax x USING (person, date)
)
SELECT person, date, CASE WHEN median(step) <= 120 THEN round(sum(CASE WHEN f >= 0.3 THEN m * f * 0.64::DOUBLE * exp(1.92::DOUBLE * f) ELSE 0.0 END), 6) END AS banister FROM r GROUP BY person, date"""

# --- the plan: nights, maximal rates and loads of one set of tables, put together from their parts ---

_BOTH = """
anchors AS (
  SELECT person, start_ts AS ts, tz_offset_min AS o, 0 AS r FROM one WHERE tz_offset_min IS NOT NULL UNION ALL SELECT person, end_ts, tz_offset_min, 1 FROM one WHERE tz_offset_min IS NOT NULL
  UNION ALL SELECT person, start_ts, tz_offset_min, 2 FROM (@B(workouts)) WHERE tz_offset_min IS NOT NULL UNION ALL SELECT person, end_ts, tz_offset_min, 3 FROM (@B(workouts)) WHERE tz_offset_min IS NOT NULL
), timeline AS (SELECT person, ts, o AS offset_min FROM anchors QUALIFY row_number() OVER (PARTITION BY person, ts ORDER BY r, o) = 1)"""
_DETECT = _detect("NOT EXISTS (SELECT 1 FROM wk l WHERE l.person = h3.person AND h3.ts >= l.start_ts - 300 AND h3.ts < l.end_ts + 300)")
_PLAN = (
    _NIGHTS.replace(_TIMELINE.replace("@B(@T)", "SELECT * FROM one"), _BOTH).replace("@B(sessions)", "@B(plan_sessions)").replace("@B(segments)", "@B(plan_segments)")
    + f""", {_VALID}, wk AS (@B(workouts)), {_INSIDE.replace("@B(dense_hr)", "SELECT person, ts, bpm FROM valid")},
pk AS (SELECT w.* REPLACE (CASE WHEN n >= 5 AND c <= 120 THEN peak END AS max_hr) FROM wk w LEFT JOIN seen USING (person, start_ts, end_ts, sport)),
dates AS (SELECT person, date FROM nights UNION SELECT person, {_date("start_ts")} FROM wk UNION SELECT person, {_date("ts")} FROM valid),
days AS (SELECT person, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date FROM dates GROUP BY person),
"""
    + _HRMAX[_HRMAX.index("pred AS") :].replace("JOIN wk w", "JOIN pk w")
    + ", "
    + _LOADS[_LOADS.index("dated AS") :].replace("dated AS", "dated_wk AS", 1).replace("FROM dated d", "FROM dated_wk d")
    + ", wide_max AS (SELECT person, date, hr_max FROM hrmax),"
    + _DETECT[_DETECT.index("hd AS") :]
    + ", every AS (SELECT * FROM loads UNION ALL SELECT * FROM detected)"
)
SQL["plan_workouts"] = _PLAN + f" SELECT * REPLACE ({_round(*_LOAD_DOUBLES)}) FROM every"
SQL["plan_nights"] = (
    _PLAN
    + f""", per_day AS (SELECT person, date, count(*) AS n, string_agg(DISTINCT method, ',' ORDER BY method) AS load_method FROM every GROUP BY ALL)
SELECT person, date, source, onset_clock, wake_clock, {_round("spt_min", "tst_min", "waso_min", "sme")}, tst_basis, {_round("deep_min", "light_min", "rem_min", "nap_min")}, tz_change,
       round(hr_max, 6) AS hr_max, hr_max_basis, coalesce(n, 0) AS n_workouts, load_method
FROM days LEFT JOIN nights USING (person, date) LEFT JOIN hrmax USING (person, date) LEFT JOIN per_day USING (person, date)"""
)

# --- series ----------------------------------------------------------------------------------------

_CAL = """
span AS (SELECT person, min(date) AS a, max(date) AS b FROM src GROUP BY person),
cal AS (SELECT person, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS date FROM span)"""
SQL["calendar_fill"] = f"""
WITH src AS (SELECT * REPLACE (CASE WHEN day(date) % 4 > 0 THEN load END AS load) FROM (@B(daily))), {_CAL}, f AS (SELECT person, date, load FROM cal LEFT JOIN src USING (person, date))
SELECT person, date, load, last_value(load IGNORE NULLS) OVER (PARTITION BY person ORDER BY date ROWS UNBOUNDED PRECEDING) AS filled,
       CASE WHEN count(load) OVER w >= 4 THEN round(avg(load) OVER w, 6) END AS mean7
FROM f WINDOW w AS (PARTITION BY person ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"""
_ACWR = """
ew AS (
  SELECT *, list_filter(list(load) OVER (PARTITION BY person ORDER BY date ROWS UNBOUNDED PRECEDING), lambda x: x IS NOT NULL) AS ks,
         count(*) FILTER (load IS NULL) OVER w7 AS missing_7, count(*) FILTER (load IS NULL) OVER w28 AS missing_28, avg(load) OVER w7 / avg(load) OVER w28 AS roll,
         date - min(CASE WHEN load IS NOT NULL THEN date END) OVER (PARTITION BY person ORDER BY date ROWS UNBOUNDED PRECEDING) + 1 AS age
  FROM @F WINDOW w7 AS (PARTITION BY person ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), w28 AS (PARTITION BY person ORDER BY date ROWS BETWEEN 27 PRECEDING AND CURRENT ROW)
), ac AS (
  SELECT *, CASE WHEN len(ks) > 0 THEN list_reduce(list_prepend(0.0::DOUBLE, ks), lambda a, x: 0.25::DOUBLE * x + (1 - 0.25::DOUBLE) * a) END AS acute,
         CASE WHEN len(ks) > 0 THEN list_reduce(list_prepend(0.0::DOUBLE, ks), lambda a, x: (2.0::DOUBLE / 29) * x + (1 - 2.0::DOUBLE / 29) * a) END AS chronic FROM ew
), acwr AS (
  SELECT *, coalesce(age < 28, true) AS young, missing_7 > 1 OR missing_28 > 4 AS holes, chronic < 10 AS small FROM ac
)"""
_ACWR_COLUMNS = """missing_7, missing_28, round(acute, 6) AS acute, round(chronic, 6) AS chronic,
       CASE WHEN NOT young AND NOT holes AND NOT small THEN round(acute / chronic, 6) END AS acwr, CASE WHEN NOT young AND NOT holes AND NOT small THEN round(roll, 6) END AS acwr_rolling,
       CASE WHEN young THEN 'warming_up' WHEN holes OR small THEN 'insufficient_data' ELSE 'ok' END AS acwr_status,
       CASE WHEN young THEN 'needs 28 days of load history' WHEN holes THEN missing_7 || ' unknown days in last 7, ' || missing_28 || ' in last 28'
            WHEN small THEN 'chronic load too small for a stable ratio' END AS acwr_reason"""
SQL["acute_chronic"] = f"""
WITH src AS (@B(daily)), {_CAL}, f AS (SELECT person, date, load FROM cal LEFT JOIN src USING (person, date)), {_ACWR.replace("@F", "f")}
SELECT person, date, round(load, 6) AS load, {_ACWR_COLUMNS} FROM acwr"""
_TAU = """
recent AS (SELECT person, CASE WHEN load > 0 THEN load END AS x FROM @F QUALIFY row_number() OVER (PARTITION BY person ORDER BY date DESC) <= 365),
taus AS (SELECT person, coalesce(median(x) / -ln(1 - 12 / 21.0::DOUBLE), 150.0) AS tau FROM recent GROUP BY person)"""
SQL["tau_strain"] = f"""
WITH src AS (@B(daily)), {_TAU.replace("@F", "src")}
SELECT person, date, round(load, 6) AS load, round(tau, 6) AS tau, round(21 * (1 - exp(-load / tau)), 6) AS strain FROM src JOIN taus USING (person)"""
SQL["daily_load"] = f"""
WITH src AS (SELECT person, date, CASE WHEN load > 0 THEN load END AS load FROM (@B(daily))), {_CAL},
g AS (SELECT person, date, count(*) AS n, bool_or(load IS NULL) AS unk, sum(load) AS l FROM src GROUP BY ALL),
w AS (
  SELECT c.person, c.date, (day(c.date) % 10) / 10.0::DOUBLE AS day_wear, CASE WHEN day(c.date) % 3 > 0 THEN (day(c.date) * 3)::DOUBLE END AS banister,
         coalesce(n, 0) AS n_workouts, coalesce(unk, false) AS bad, l, CASE WHEN n > 0 THEN 'hr_ours' END AS load_method FROM cal c LEFT JOIN g USING (person, date)
), f AS (SELECT *, CASE WHEN bad THEN NULL WHEN n_workouts = 0 AND day_wear >= 0.7 THEN 0.0 ELSE l END AS load FROM w),
{_ACWR.replace("@F", "f")}, {_TAU.replace("@F", "f")}
SELECT person, date, round(day_wear, 6) AS day_wear, round(banister, 6) AS banister, n_workouts, round(load, 6) AS load, load_method,
       CASE WHEN bad OR (n_workouts = 0 AND day_wear < 0.7) THEN 'insufficient_data' ELSE 'ok' END AS load_status,
       CASE WHEN n_workouts = 0 AND day_wear >= 0.7 AND banister IS NULL THEN 'no workout recorded; HR too sparse to rule out an unrecorded session'
            WHEN bad THEN 'a workout has neither dense HR nor band zone data' WHEN n_workouts = 0 AND day_wear < 0.7 THEN 'no workout recorded and band worn < 70 % of 08-22' END AS load_reason,
       n_workouts = 0 AND coalesce(banister >= 40, false) AS unrecorded_hint, round(tau, 6) AS tau, round(21 * (1 - exp(-load / tau)), 6) AS strain, {_ACWR_COLUMNS}
FROM acwr JOIN taus USING (person)"""


def _base(value: str, prefix: str, floor: float, bad: int) -> str:
    """Columns of a trailing baseline; medians of deviations by list."""
    return f"""
  {prefix}0 AS (
    SELECT *, count({value}) OVER l AS n_, median({value}) OVER l AS c_, list({value}) OVER l AS a_, count({value}) OVER s AS sn_, avg({value}) OVER s AS sa_ FROM @SRC
    WINDOW l AS (PARTITION BY person, era ORDER BY date RANGE BETWEEN INTERVAL 28 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING),
           s AS (PARTITION BY person, era ORDER BY date RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)
  ), {prefix}1 AS (
    SELECT * EXCLUDE (n_, c_, a_, sn_, sa_), n_ AS {prefix}_base_n, CASE WHEN n_ >= 14 THEN c_ END AS {prefix}_base_center,
           CASE WHEN n_ >= 14 THEN greatest(1.4826::DOUBLE * list_median(list_transform(a_, lambda x: abs(x - c_))), {floor}) END AS {prefix}_base_spread,
           CASE WHEN n_ >= 14 THEN 'ok' ELSE 'warming_up' END AS {prefix}_base_status, CASE WHEN sn_ >= 4 THEN sa_ END AS {prefix}_mean7 FROM {prefix}0
  ), {prefix}2 AS (SELECT *, ({value} - {prefix}_base_center) / {prefix}_base_spread AS {prefix}_z FROM {prefix}1),
  {prefix}3 AS (SELECT *, coalesce({prefix}_z * {bad} >= 1.5, false) AS {prefix}_flag FROM {prefix}2)"""


_BASELINE = f"WITH src AS (@B(nightly)), {_base('price', 'rhr', 1.0, 1).replace('@SRC', 'src')}, {_base('n', 'tst', 0.5, -1).replace('@SRC', 'rhr3')}"
_BASE_DOUBLES = ("price", "n", *(f"{p}_{c}" for p in ("rhr", "tst") for c in ("base_center", "base_spread", "mean7", "z")))
SQL["trailing_baseline"] = _BASELINE + f" SELECT * REPLACE ({_round(*_BASE_DOUBLES)}) FROM tst3"
_PHI = """(0.5::DOUBLE + exp(-x * x / 2) / sqrt(2 * pi()) * list_reduce(list_prepend([x, x], list_transform(range(1, 81), lambda n: [n::DOUBLE, 0.0])),
  lambda a, b: [a[1] * x * x / (2 * b[1] + 1), a[2] + a[1] * x * x / (2 * b[1] + 1)])[2])"""
_RECOVERY = f"""{_BASELINE}, z AS (
  SELECT *, CASE WHEN rhr_base_status = 'ok' THEN greatest(-3.0, least(3.0, -rhr_z)) END AS zr, CASE WHEN tst_base_status = 'ok' THEN greatest(-3.0, least(3.0, tst_z)) END AS zs,
         lag(n) OVER (PARTITION BY person ORDER BY date) AS load_yesterday, CASE WHEN day(date) % 2 = 0 THEN day(date) / 15.0::DOUBLE END AS acwr FROM tst3
), ok AS (SELECT *, zr IS NOT NULL AND zs IS NOT NULL AS ok, 0.5 * coalesce(zr, 0) + 0.5 * coalesce(zs, 0) AS total FROM z),
xs AS (SELECT *, total / sqrt(0.5::DOUBLE) AS x FROM ok),
sc AS (SELECT *, CASE WHEN ok THEN 100 * {_PHI} END AS recovery FROM xs),
rec AS (
  SELECT *, CASE WHEN ok THEN CASE WHEN total = 0 THEN 0.0 ELSE (recovery - 50) * 0.5 * zr / total END END AS recovery_pts_rhr,
         CASE WHEN ok THEN CASE WHEN total = 0 THEN 0.0 ELSE (recovery - 50) * 0.5 * zs / total END END AS recovery_pts_sleep,
         CASE WHEN recovery <= 33 THEN 'low' WHEN recovery >= 67 THEN 'high' WHEN recovery IS NOT NULL THEN 'moderate' END AS recovery_band,
         CASE WHEN ok THEN 'ok' WHEN rhr_base_status = 'warming_up' OR tst_base_status = 'warming_up' THEN 'warming_up' ELSE 'insufficient_data' END AS recovery_status FROM sc
)"""
SQL["recovery"] = f"""{_RECOVERY} SELECT person, date, round(zr, 6) AS recovery_z_rhr, round(zs, 6) AS recovery_z_sleep, {_round("recovery", "recovery_pts_rhr", "recovery_pts_sleep")},
  recovery_band, recovery_status, CASE recovery_status WHEN 'ok' THEN NULL WHEN 'warming_up' THEN 'baseline needs 14 valid nights on this device'
  ELSE 'resting HR or sleep missing for this night' END AS recovery_reason FROM rec"""
SQL["readiness"] = f"""{_RECOVERY}, r AS (
  SELECT *, CASE WHEN recovery_status <> 'ok' THEN 0 WHEN rhr_z >= 2 AND tst_flag THEN 1 WHEN recovery < 34 THEN 2 WHEN acwr > 1.5 THEN 3 WHEN recovery >= 67 AND acwr < 0.8 THEN 4 ELSE 5 END AS rule FROM rec
) SELECT person, date, load_yesterday, rule::INTEGER AS readiness_rule,
  [{", ".join(f"'{r['say']}'" for r in default_rules())}][rule + 1] AS readiness,
  concat_ws(', ', 'recovery.status=' || recovery_status, CASE WHEN rule > 0 THEN 'rhr.z=' || coalesce(printf('%.3f', rhr_z), 'None') END,
    CASE WHEN rule > 0 AND rhr_z >= 2 THEN 'sleep.flag=' || tst_flag::VARCHAR END, CASE WHEN rule NOT IN (0, 1) THEN 'recovery.score=' || printf('%.3f', recovery) END,
    CASE WHEN rule > 2 THEN 'acwr.value=' || coalesce(printf('%.3f', acwr), 'None') END) AS readiness_inputs FROM r"""
SQL["circular_sd"] = f"SELECT person, context, round({_csd('((ts % 86400) // 60)')}, 6) AS csd FROM (@B(hr)) GROUP BY ALL"

# --- changes of tables -----------------------------------------------------------------------------

SQL["upsert_points"] = """
WITH s AS (SELECT person, source, device_id, ts // 3600 * 3600 AS ts, max(steps) AS steps FROM (@B(steps)) GROUP BY ALL)
SELECT person, source, device_id, ts, (steps + CASE WHEN ts // 3600 % 2 = 1 OR ts // 3600 % 3 = 0 THEN 1000 ELSE 0 END)::INTEGER AS steps FROM s"""
SQL["replace_intervals"] = """
WITH s AS (
  SELECT *, row_number() OVER (PARTITION BY person, source, device_id ORDER BY start_ts DESC, end_ts DESC) AS n FROM (SELECT DISTINCT person, source, device_id, start_ts, end_ts FROM (@B(sessions)))
), w AS (SELECT person, source, min(start_ts) AS lo, max(end_ts) AS hi FROM s WHERE n = 1 GROUP BY ALL)
SELECT s.person, s.source, s.device_id, s.start_ts, s.end_ts FROM s LEFT JOIN w USING (person, source) WHERE n = 1 OR NOT (s.start_ts < hi AND s.end_ts > lo)"""
SQL["contained_sessions"] = """
WITH s AS (SELECT DISTINCT person, source, device_id, start_ts, end_ts FROM (@B(sessions)))
SELECT i.*, o.device_id AS outer_device_id, o.start_ts AS outer_start_ts, o.end_ts AS outer_end_ts FROM s i JOIN s o
ON i.person = o.person AND i.source = o.source AND i.start_ts >= o.start_ts AND i.end_ts <= o.end_ts WHERE i.end_ts - i.start_ts < 7200 AND o.end_ts - o.start_ts >= 7200"""

from . import serving_oracle, source_oracle  # noqa: E402

SQL |= serving_oracle.SQL | source_oracle.SQL

# dates come out as ISO text
_DATES = {
    "zone_clock": ["day"], "eu_switches": ["spring", "autumn"], "resolve_sources": ["wake_date"], "episodes": ["wake_date"], "sleep_wake_grid": ["day"], "day_pairs": ["day"],
} | {
    q: ["date"]
    for q in (
        "wear_daily daily_steps plan_workouts plan_nights nightly_sleep nightly_rhr regularity hrmax_by_date workout_loads detect_sessions banister_daily calendar_fill acute_chronic tau_strain "
        "daily_load trailing_baseline recovery readiness"
    ).split()
} | serving_oracle.DATES


def _text(name: str, sql: str) -> str:
    casts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in _DATES.get(name, []))
    return f"SELECT * REPLACE ({casts}) FROM ({sql})" if casts else sql


SQL = {name: _text(name, duck(sql)) for name, sql in SQL.items()}
