"""Queries over result tables and profiles (registered on import)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .bindings import bind
from .functions import clock, privacy, scores
from .operators import ranks as K
from .operators import series as S
from .plans import json_values as J
from .plans import profiling as PR
from .plans import serving as SV
from .queries import P, query, rounded, table
from .sources import exports as X

METRICS = ("activity.steps", "strain.load", "recovery.score", "rhr.z", "sleep.sri_7d")


@query
def serve_range(spark, d):
    return SV.date_range(bind(spark, d, "long"), P, "2024-01-28")


@query
def serve_day(spark, d):
    return SV.day(bind(spark, d, "long"), "2024-01-15", P)


@query
def serve_series(spark, d):
    return SV.series(bind(spark, d, "long"), "2024-02-03", 28, keys=P)


@query
def workout_totals(spark, d):
    return rounded(SV.workout_totals(bind(spark, d, "workout_metrics"), "2024-01-05", "2024-01-20"))


@query
def by_sport(spark, d):
    return rounded(SV.by_sport(bind(spark, d, "workout_metrics"), "2024-01-05", "2024-01-20"))


@query
def daily_totals(spark, d):
    return rounded(SV.daily_totals(bind(spark, d, "long"), "2024-01-05", "2024-01-28", keys=P))


@query
def period_change(spark, d):
    return SV.period(bind(spark, d, "workout_metrics"), "2024-01-25", 7)


@query
def latest_sessions(spark, d):
    return SV.latest_sessions(bind(spark, d, "workout_metrics"), "2024-01-01", "2024-01-28").select("start_ts", "sport", "end_ts", "method", "load")


@query
def gap_notes(spark, d):
    return SV.gap_notes(bind(spark, d, "long"), "activity.steps", P)


@query
def pivot_wide(spark, d):
    return SV.wide(bind(spark, d, "long"), METRICS, P)


@query
def last_days(spark, d):
    return SV.last_days(SV.wide(bind(spark, d, "long"), METRICS, P), 8, P, "2024-01-25")


@query
def table_view(spark, d):
    return SV.table_view(bind(spark, d, "long"), METRICS, P)


@query
def trailing_week(spark, d):
    return rounded(SV.trailing_week(bind(spark, d, "long"), "strain.load", P))


@query
def baseline_band(spark, d):
    b = S.trailing_baseline(bind(spark, d, "nightly"), "n", "era", ["person"], 0.5, 1, "rhr")
    return rounded(b.select("person", "date", *SV.baseline_band(F.col("n"), F.col("rhr_base_center"), F.col("rhr_base_spread"), F.col("rhr_flag"), F.col("rhr_base_status"))))


@query
def durations(spark, d):
    return SV.durations(bind(spark, d, "workout_metrics"))


@query
def column_profile(spark, d):
    return PR.column_stats(table(spark, d, "customer"))


@query
def value_counts(spark, d):
    return PR.value_counts(table(spark, d, "customer"), "c_mktsegment")


@query
def cadence_profile(spark, d):
    return PR.cadence(bind(spark, d, "hr"), "ts", ["person"])


@query
def covered_minutes(spark, d):
    return PR.covered_minutes(bind(spark, d, "spring_hr"), "ts", "Europe/Berlin", ["person"])


@query
def quantiles_exclusive(spark, d):
    points = (0.01, 0.25, 0.5, 0.75, 0.99)
    per = K.quantiles(table(spark, d, "customer"), "c_acctbal", ["c_mktsegment"], points)
    whole = K.quantiles(table(spark, d, "lineitem"), "l_extendedprice", [], points).withColumn("c_mktsegment", F.lit("all lines"))
    return rounded(per.unionByName(whole))


@query
def quartiles(spark, d):
    q = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.expr("percentile(c_acctbal, array(0.25, 0.75))").alias("q"), F.expr("stddev_pop(c_acctbal) / avg(c_acctbal)").alias("cv"))
    return rounded(q.select("c_mktsegment", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q75"), "cv"))


@query
def rank_correlation(spark, d):
    per = K.spearman(table(spark, d, "part"), "p_size", "p_retailprice", ["p_brand"])
    whole = K.spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice").withColumn("p_brand", F.lit("all lines"))
    return rounded(per.unionByName(whole))


@query
def epoch_units(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * F.lit(10).cast("double") ** (F.col("o_orderkey") % 16)).alias("v"))
    return o.select("o_orderkey", clock.epoch_unit(F.col("v")).alias("unit"))


@query
def redacted(spark, d):
    c = table(spark, d, "customer")
    raw = F.concat_ws(" ", F.col("c_name"), F.lit("aa:bb:cc:dd:ee:0f"), F.concat(F.lit("52."), (F.col("c_custkey") + 10_000).cast("string")), (F.col("c_custkey") + 123_456_789).cast("string"))
    return c.select("c_custkey", scores.redact(raw).alias("text"), scores.short_hash(F.col("c_name")).alias("id"))


@query
def keyed_json(spark, d):
    e = table(spark, d, "events").select("event_id", F.from_json("props", "k long").alias("p"))
    return e.select("event_id", F.col("p.k").alias("k"), scores.without_placeholder(F.col("p.k").cast("double")).alias("known_k"))


def _nested(spark, d):
    """Records of unknown layout from lines dealt out: parsing is long work on a table of few files."""
    return bind(spark, d, "nested", int(spark.conf.get("spark.sql.shuffle.partitions")))


@query
def json_paths(spark, d):
    return J.json_paths(table(spark, d, "events").select("props").unionByName(_nested(spark, d).select(F.col("doc").alias("props"))), "props")


@query
def json_value_stats(spark, d):
    return rounded(J.value_stats(_nested(spark, d), "doc", keys=["key"]))


@query
def scrubbed_json(spark, d):
    n = _nested(spark, d)
    name = F.concat(F.lit("20240131_"), (F.col("l_orderkey") + 10**9).cast("string"), F.lit("_MiFitness_1234_x.csv"))
    return n.select("l_orderkey", "l_linenumber", privacy.scrub_json(F.col("doc")).alias("doc"), privacy.mask_account(name).alias("file"))


@query
def redacted_samples(spark, d):
    n = bind(spark, d, "nested").withColumns({"user_id": F.col("l_orderkey"), "LATITUDE": F.lit(52.5), "note": F.concat(F.lit("call "), F.col("l_orderkey") + 100_000_000)})
    return PR.redacted_samples(n, ["l_orderkey", "l_linenumber", "doc"], 4)


@query
def dst_naive_devices(spark, d):
    return X.dst_naive(_offset_records(spark, d))


@query
def dst_corrected(spark, d):
    r = _offset_records(spark, d)
    return X.correct_dst_naive(r, X.dst_naive(r)).select("device_id", "start_ts", "n", "tz_offset_min")


def _offset_records(spark, d):
    """Orders as records of devices, some of which know summer time."""
    ts = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + 3600 * 12
    device = (F.col("o_custkey") % 4).cast("string")
    offset = F.when((device != "0") & (device != "1") & clock.in_eu_summer(ts), 120).otherwise(60)
    return table(spark, d, "orders").select(device.alias("device_id"), ts.alias("start_ts"), F.col("o_orderkey").alias("n"), offset.alias("tz_offset_min"))


@query
def two_level_max(spark, d):
    s = bind(spark, d, "steps").groupBy("person", (F.floor(F.col("ts") / 86_400)).alias("day"), "device_id").agg(F.sum("steps").alias("s"))
    return s.groupBy("person", "day").agg(F.max("s").alias("steps"))


@query
def methods_by_year(spark, d):
    return PR.by_year_and_method(bind(spark, d, "workout_metrics"))


@query
def key_profile(spark, d):
    e = table(spark, d, "events").select("event_type", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), (F.col("user_id") % 3).alias("device"), "props")
    return PR.key_profile(e, "event_type", "t", "device", "props")


@query
def device_timeline(spark, d):
    e = table(spark, d, "events").select("event_type", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), F.concat(F.lit("band "), F.col("user_id") % 17).alias("device"))
    return PR.device_timeline(e, "event_type", "t", "device", "Europe/Berlin")


@query
def code_counts(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("STATE"), (F.col("o_custkey") % 45).alias("RAW_KIND"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 7).alias("sleep_stage"))
    return PR.code_counts(o)


@query
def sleep_tail(spark, d):
    return PR.sleep_tail(bind(spark, d, "sessions"), "Europe/Berlin", 5, P)


@query
def load_reconciliation(spark, d):
    """Loads of workouts beside what their zone minutes would say."""
    w = bind(spark, d, "workout_metrics").withColumns({"load_ours": F.col("load"), "load_device": sum((F.col(f"z{i}_min") * i for i in range(2, 6)), F.col("z1_min"))})
    return rounded(PR.load_reconciliation(w))


@query
def regularity_report(spark, d):
    w = bind(spark, d, "wide").withColumns({"day_wear": F.col("steps") / 1000, "reg_n": F.col("n_workouts"), "sri_pairs": F.col("n_workouts")})
    return rounded(PR.regularity_report(w, 6, P, "2001-06-30"))


@query
def signed_numbers(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 > 0, F.col("c_acctbal") * 8 + 0.03125).alias("v"))
    return c.select("c_custkey", clock.format_signed(F.col("v")).alias("whole"), clock.format_signed(F.col("v"), 1).alias("tenths"))


@query
def top_steps(spark, d):
    return PR.top_steps(bind(spark, d, "hr"), "ts", 5)


@query
def hr_sanity(spark, d):
    return rounded(PR.hr_sanity(bind(spark, d, "hr"), "bpm", ["person"]))


@query
def first_and_last(spark, d):
    return PR.first_and_last(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], 4)


@query
def implied_hr_max(spark, d):
    w = bind(spark, d, "workouts").withColumn("zone1_s", F.col("end_ts") - F.col("start_ts"))
    return rounded(PR.implied_hr_max(w))


@query
def night_table(spark, d):
    return rounded(PR.night_table(*_reconciled(spark, d), ["person"]))


@query
def missing_nights(spark, d):
    nights, sessions, _ = _reconciled(spark, d)
    return PR.missing_nights(nights, sessions, "Europe/Berlin", ["person"])


def _reconciled(spark, d):
    """Long sessions as nights, all sessions with device totals, and a daily device rate."""
    s = bind(spark, d, "sessions").groupBy("person", "source", "start_ts").agg(F.max("end_ts").alias("end_ts"))
    s = s.withColumns({"dev_duration_min": F.floor((F.col("end_ts") - F.col("start_ts")) / 60).cast("double"), "dev_min_hr": (F.lit(40) + F.col("start_ts") % 30).cast("double")})
    day = clock.local_date(F.col("end_ts"), 60)
    long = s.where("end_ts - start_ts >= 18000").withColumn("date", day)
    one = long.groupBy("person", "date").agg(F.min_by(F.struct("source", "start_ts", "end_ts"), "start_ts").alias("n")).select("person", "date", "n.*")
    nights = one.select(
        "person", "source", "date", F.col("start_ts").alias("onset_ts"), F.col("end_ts").alias("wake_ts"),
        ((F.col("end_ts") - F.col("start_ts")) / 60).alias("tst_min"), (F.lit(45) + F.col("end_ts") % 20).cast("double").alias("rhr"),
    )
    rates = nights.select("person", "date", (F.col("rhr") + 3).alias("value"))
    return nights, s, rates
