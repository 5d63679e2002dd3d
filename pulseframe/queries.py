"""Registered queries over the sensor operators; their SQL is in :mod:`pulseframe.oracle`."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bindings import bind
from .config import Config
from .functions import clock, scores
from .operators import intervals as I
from .operators import load as L
from .operators import nights as N
from .operators import recovery as R
from .operators import series as S
from .operators import wear as W
from .operators.ranges import range_stats
from .store import replace_window, stored, upsert

P = ["person"]
CFG = Config()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    """Register a query; its dates come out as ISO text."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        df = f(spark, d)
        return df.select(*[F.col(c).cast("string").alias(c) if t == "date" else F.col(c) for c, t in df.dtypes])

    run.__doc__ = f.__doc__
    QUERIES[f.__name__] = run
    return run


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to so many places, so that engines that add in another order agree."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- wear ------------------------------------------------------------------------------------------


@query
def valid_hr(spark, d):
    return W.valid_hr(bind(spark, d, "hr"), P)


@query
def local_cadence(spark, d):
    return W.local_cadence(W.valid_hr(bind(spark, d, "hr"), P).select("person", "ts"), P)


@query
def worn_intervals(spark, d):
    return W.worn_intervals(W.valid_hr(bind(spark, d, "hr"), P), P)


def _wear(spark, d):
    hr = stored(W.valid_hr(bind(spark, d, "hr"), P), "hr")
    worn = stored(W.worn_intervals(hr, P), "worn")
    days = S.calendar(hr.select("person", clock.local_date(F.col("ts")).alias("date")), P)
    noon = F.unix_date("date").cast("long") * 86_400 + 43_200
    return hr, worn, W.day_wear(days.withColumn("offset_min", clock.zone_offset(noon, CFG.timezone)), worn, P).drop("offset_min")


@query
def wear_daily(spark, d):
    return rounded(_wear(spark, d)[2])


# --- time ------------------------------------------------------------------------------------------


def _timeline(spark, d):
    return N.offset_timeline(bind(spark, d, "sessions"), None, P)


@query
def nearest_offsets(spark, d):
    hr = bind(spark, d, "hr").withColumn("person", F.col("person") * 5).select("person", "device_id", "ts", "bpm", "context").distinct()
    return N.local_offsets(hr, _timeline(spark, d), CFG.timezone, "ts", "offset_min", P)


@query
def zone_clock(spark, d):
    ts = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86_400
    o = table(spark, d, "orders").select("o_orderkey", ts.alias("ts"))
    off = clock.zone_offset(F.col("ts"), "Europe/Berlin")
    return o.select(
        "o_orderkey", off.alias("offset_min"), clock.local_date(F.col("ts"), off).alias("day"), clock.clock_minute(F.col("ts"), off).alias("minute"),
        clock.format_clock(clock.clock_minute(F.col("ts"), off)).alias("clock"),
    )


@query
def eu_switches(spark, d):
    day = F.col("o_orderdate").cast("date")
    ts = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    return table(spark, d, "orders").select(
        "o_orderkey", clock.last_sunday(F.year(day), 3).alias("spring"), clock.last_sunday(F.year(day), 10).alias("autumn"),
        clock.in_eu_summer(ts).alias("summer"), clock.near_eu_switch(day).alias("near_switch"),
    )


@query
def record_offsets(spark, d):
    s = bind(spark, d, "sessions").select("person", "source", "device_id", "start_ts", "end_ts", "tz_offset_min").distinct()
    return N.record_offsets(s, _timeline(spark, d), CFG.timezone, "end_ts", "offset_end", P)


@query
def offset_timeline(spark, d):
    return _timeline(spark, d)


# --- nights ----------------------------------------------------------------------------------------


def _dated(spark, d):
    s = bind(spark, d, "sessions").withColumn("wake_date", clock.local_date(F.col("end_ts"), F.coalesce("tz_offset_min", F.lit(60))))
    return I.one_each(s, ["person", "source", "device_id", "start_ts"])


@query
def resolve_sources(spark, d):
    s = _dated(spark, d).select("person", "source", "device_id", "start_ts", "end_ts", "wake_date")
    return N.resolve_sources(s, CFG.sources.priority, "wake_date", P)


@query
def drop_overlaps(spark, d):
    s = bind(spark, d, "sessions").select("person", "source", "device_id", "start_ts", "end_ts").distinct()
    return I.drop_overlaps(s, ["person", "source"])


def _episodes(spark, d):
    sessions = stored(I.one_each(bind(spark, d, "sessions"), ["person", "source", "device_id", "start_ts"]), "sessions")
    timeline = stored(N.offset_timeline(sessions, None, P), "timeline")
    return sessions, timeline, stored(N.build_episodes(sessions, timeline, CFG, P), "episodes")


@query
def episodes(spark, d):
    return _episodes(spark, d)[2].withColumn("n_members", F.size("members")).drop("members")


def _nights(spark, d):
    sessions, timeline, ep = _episodes(spark, d)
    seg = stored(N.episode_segments(ep, bind(spark, d, "segments").distinct(), P), "segments")
    return timeline, ep, seg, stored(N.nightly_sleep(ep, seg, sessions, P), "nights")


@query
def nightly_sleep(spark, d):
    return rounded(_nights(spark, d)[3])


@query
def nightly_rhr(spark, d):
    hr = stored(bind(spark, d, "dense_hr"), "hr")
    span = hr.groupBy("person").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    nights = span.select("person", F.explode(F.expr("sequence(a, b, 14400)")).alias("onset_ts"))
    nights = nights.select("person", clock.local_date(F.col("onset_ts") * 12).alias("date"), "onset_ts", (F.col("onset_ts") + 12_000).alias("wake_ts"))
    return rounded(N.nightly_rhr(nights, hr, W.worn_intervals(hr, P), P))


def _grid(spark, d):
    timeline, ep, seg, nights = _nights(spark, d)
    worn = ep.select("person", (F.col("start_ts") - 7200).alias("start_ts"), (F.col("end_ts") + 36_000).alias("end_ts"))
    return nights, stored(N.sleep_wake_maps(ep, seg, worn, timeline, CFG.timezone, P), "maps")


@query
def sleep_wake_grid(spark, d):
    weighted = F.aggregate(N.map_minutes(F.col("asleep")), F.lit(0).cast("long"), lambda n, m: n + m)
    counted = _grid(spark, d)[1].withColumn("weighted", weighted)
    return counted.withColumns({c: N.set_minutes(F.col(c)) for c in ("known", "asleep")})


@query
def day_pairs(spark, d):
    return N.day_pairs(_grid(spark, d)[1], P)


@query
def regularity(spark, d):
    nights, grid = _grid(spark, d)
    return rounded(N.regularity(nights, N.day_pairs(grid, P), P))


# --- training load ---------------------------------------------------------------------------------


@query
def interval_slice(spark, d):
    w = bind(spark, d, "workouts").select("person", "start_ts", "end_ts", "sport")
    each = range_stats(w, bind(spark, d, "dense_hr"), P)
    mean = F.try_divide(F.sum("total"), F.sum("known"))
    return rounded(each.groupBy("person", "start_ts", "sport").agg(F.sum("n").alias("n"), mean.alias("avg_bpm"), F.max("top").alias("max_bpm")))


def _hrmax(spark, d):
    w = bind(spark, d, "workouts")
    days = S.calendar(w.select("person", clock.local_date(F.col("start_ts")).alias("date")), P)
    return w, days, L.hrmax_by_date(days, w, P)


@query
def hrmax_by_date(spark, d):
    return rounded(_hrmax(spark, d)[2])


def _samples(spark, d):
    """Workouts, dense samples, maximal rates, the offset timeline and the numbers that load asks of samples."""
    w, days, hrmax = _hrmax(spark, d)
    hr = stored(bind(spark, d, "dense_hr"), "hr")
    return w, hr, stored(hrmax, "hrmax"), stored(N.offset_timeline(w, None, P), "timeline")


def _loads(spark, d):
    w, hr, hrmax, timeline = _samples(spark, d)
    return L.workout_loads(w, hr, hrmax, timeline, CFG, P)


@query
def workout_loads(spark, d):
    return rounded(_loads(spark, d))


@query
def sustained_peaks(spark, d):
    return L.sustained_peaks(bind(spark, d, "workouts"), bind(spark, d, "dense_hr"), P).select("person", "start_ts", "end_ts", "sport", "max_hr")


def _detected(spark, d, masked=True):
    w, hr, hrmax, timeline = _samples(spark, d)
    wide = hrmax.withColumn("date", F.explode(F.array(F.col("date"), F.date_add("date", 1)))).groupBy("person", "date").agg(F.max("hr_max").alias("hr_max"))
    return L.detect_sessions(L.dated_samples(hr, wide, timeline, CFG, P), bind(spark, d, "bunched_workouts") if masked else None, CFG, P)


@query
def detect_sessions(spark, d):
    return rounded(_detected(spark, d))


@query
def detector_recall(spark, d):
    return L.detector_recall(_loads(spark, d), _detected(spark, d, masked=False), P)


@query
def banister_daily(spark, d):
    w, hr, hrmax, timeline = _samples(spark, d)
    rest = hrmax.select("person", "date", F.lit(65.0).alias("hr_rest"))
    return rounded(L.banister_daily(L.dated_samples(hr, hrmax, timeline, CFG, P), rest, CFG, P))


@query
def daily_steps(spark, d):
    _, _, wear = _wear(spark, d)
    none = spark.createDataFrame([], "person long, ts long, offset_min int")
    return L.daily_steps(wear, bind(spark, d, "steps"), none, CFG, P)


@query
def daily_load(spark, d):
    """Workouts by day with known and unknown loads, on a calendar with worn and unworn days."""
    loads = bind(spark, d, "daily").select("person", "date", F.when(F.col("load") > 0, F.col("load")).alias("load"), F.lit("hr_ours").alias("method"))
    days = S.calendar(loads, P).withColumn("day_wear", (F.dayofmonth("date") % 10) / 10)
    banister = days.where(F.dayofmonth("date") % 3 > 0).select("person", "date", (F.dayofmonth("date") * 3).cast("double").alias("banister"))
    return rounded(L.daily_load(days, loads, banister, CFG, P).withColumn("day_wear", F.round("day_wear", 6)))


# --- series ----------------------------------------------------------------------------------------


@query
def calendar_fill(spark, d):
    gaps = bind(spark, d, "daily").withColumn("load", F.when(F.dayofmonth("date") % 4 > 0, F.col("load")))
    wide = S.on_calendar(gaps, P)
    return wide.withColumns({"filled": S.forward_fill("load", P), "mean7": F.round(S.trailing_mean("load", 7, 4, P), 6)})


@query
def acute_chronic(spark, d):
    return rounded(S.acute_chronic(S.on_calendar(bind(spark, d, "daily"), P), P))


@query
def tau_strain(spark, d):
    wide = bind(spark, d, "daily")
    return rounded(wide.join(S.tau(wide, P), P).withColumn("strain", scores.strain(F.col("load"), F.col("tau"))))


def _baseline(spark, d):
    wide = bind(spark, d, "nightly")
    wide = S.trailing_baseline(wide, "price", "era", P, 1.0, 1, "rhr")
    return S.trailing_baseline(wide, "n", "era", P, 0.5, -1, "tst")


@query
def trailing_baseline(spark, d):
    return rounded(_baseline(spark, d))


def _recovered(spark, d):
    wide = _baseline(spark, d).withColumns({"tst_min": F.col("n") * 60, "acwr": F.when(F.dayofmonth("date") % 2 == 0, F.dayofmonth("date") / 15), "acwr_status": F.lit("ok"), "load": F.col("n")})
    return R.add_recovery_and_readiness(wide, keys=P)


@query
def recovery(spark, d):
    names = ["recovery_z_rhr", "recovery_z_sleep", "recovery", "recovery_pts_rhr", "recovery_pts_sleep", "recovery_band", "recovery_status", "recovery_reason"]
    return rounded(_recovered(spark, d).select("person", "date", *names))


@query
def readiness(spark, d):
    return _recovered(spark, d).select("person", "date", "load_yesterday", "readiness_rule", "readiness", "readiness_inputs")


@query
def circular_sd(spark, d):
    c = bind(spark, d, "hr").withColumn("minute", clock.clock_minute(F.col("ts"), F.lit(0)))
    return rounded(c.groupBy("person", "context").agg(S.circular_sd("minute").alias("csd")))


# --- changes of tables -----------------------------------------------------------------------------


@query
def upsert_points(spark, d):
    s = bind(spark, d, "steps").groupBy("person", "source", "device_id", (F.floor(F.col("ts") / 3600) * 3600).alias("ts")).agg(F.max("steps").alias("steps"))
    # hours of odd number come anew, every third hour is new; together the sides hold every row
    new = s.where("ts div 3600 % 2 = 1 OR ts div 3600 % 3 = 0").withColumn("steps", F.col("steps") + 1000)
    return upsert(s.where("ts div 3600 % 3 > 0"), new, ["person", "source", "device_id", "ts"])


@query
def replace_intervals(spark, d):
    s = bind(spark, d, "sessions").select("person", "source", "device_id", "start_ts", "end_ts").distinct()
    # each device's latest session comes anew, the others are old: together they are all rows
    newest = F.row_number().over(Window.partitionBy("person", "source", "device_id").orderBy(F.desc("start_ts"), F.desc("end_ts")))
    s = s.withColumn("n", newest)
    return replace_window(s.where("n > 1").drop("n"), s.where("n = 1").drop("n"), ["person", "source"])


@query
def contained_sessions(spark, d):
    s = bind(spark, d, "sessions").select("person", "source", "device_id", "start_ts", "end_ts").distinct()
    inner = s.where("end_ts - start_ts < 7200")
    return I.contained(inner, s.where("end_ts - start_ts >= 7200"), ["person", "source"])


def entry(spark: SparkSession) -> DataFrame:
    return wear_daily(spark, os.environ.get("ENTRY_SF_DIR", "/root/testdata/sf0.001"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import serving_queries, source_queries  # noqa: F401  register more

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from .oracle import SQL

    return dict(SQL)
