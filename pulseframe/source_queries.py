"""Queries over sources, the store, the daily plan and its long table (registered on import)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from . import schema
from .bindings import bind
from .functions import clock
from .operators.intervals import one_each
from .plans.daily import compute_daily, compute_nights, compute_workouts, to_long
from .queries import CFG, P, query, rounded, table
from .sources import exports as X
from .store import Store, shared_dir, stored

_exported: dict[tuple[str, str], dict] = {}


def _export(spark, d):
    """The events written as an export and read back, once per application and folder."""
    own = (spark.sparkContext.applicationId, d)
    if own not in _exported:
        given = {"hr_samples": "x_hr", "step_samples": "x_steps", "sleep_sessions": "x_sessions", "sleep_segments": "x_segments", "workouts": "x_workouts"}
        folder = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
        X.write_export({t: schema.conform(bind(spark, d, b), t) for t, b in given.items()}, folder)
        _exported[own] = X.read_export(spark, folder, now=1_800_000_000)[0]
    return _exported[own]


@query
def export_hr(spark, d):
    return _export(spark, d)["hr_samples"]


@query
def export_steps(spark, d):
    return _export(spark, d)["step_samples"]


@query
def export_sessions(spark, d):
    return _export(spark, d)["sleep_sessions"].select("source", "device_id", "start_ts", "end_ts", "is_nap", "tz_offset_min", "dev_duration_min", "dev_rem_min")


@query
def export_segments(spark, d):
    return _export(spark, d)["sleep_segments"]


@query
def export_workouts(spark, d):
    return _export(spark, d)["workouts"].select("source", "device_id", "start_ts", "end_ts", "sport", "tz_offset_min", "avg_hr", "zone2_s", "zone5_s")


@query
def export_resting(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), F.floor("value").alias("v"))
    value = F.to_json(F.struct(F.col("t").alias("date_time"), F.col("v").cast("double").alias("bpm")))
    rows = e.select((F.col("user_id") % 5).cast("string").alias("Sid"), F.lit("resting_heart_rate").alias("Key"), value.alias("Value"), F.col("event_id").alias("_seq"))
    return X.resting(rows)


@query
def table_violations(spark, d):
    hr = bind(spark, d, "hr").withColumn("context", F.when(F.col("bpm") % 17 == 0, "odd").otherwise(F.col("context")))
    return schema.violations(hr.withColumn("ts", F.when(F.col("ts") % 13 > 0, F.col("ts"))), "hr_samples", "s", P)


def _ingested(spark, d):
    """Steps by hour in two batches that overlap."""
    s = bind(spark, d, "x_steps").groupBy("source", "device_id", (F.floor(F.col("ts") / 3600) * 3600).alias("ts")).agg(F.max("steps").cast("int").alias("steps"))
    s = stored(s, "hours")
    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    store.ingest({"step_samples": s.where("ts div 3600 % 3 > 0")}, X.SOURCE, "first")
    store.ingest({"step_samples": s.where("ts div 3600 % 2 = 1 OR ts div 3600 % 3 = 0").withColumn("steps", F.col("steps") + 1000)}, X.SOURCE, "second")
    return store


@query
def ingested_points(spark, d):
    return _ingested(spark, d).read("step_samples")


@query
def ingest_log(spark, d):
    store = _ingested(spark, d)
    return spark.read.parquet(f"{store.folder}/ingest_log").select("source", "file_sha256", "tbl", "rows", "min_ts", "max_ts")


@query
def daily_long(spark, d):
    """The long table of days whose columns are drawn from the orders."""
    return rounded(to_long(bind(spark, d, "wide"), P))


@query
def local_iso(spark, d):
    ts = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86_400
    return table(spark, d, "orders").select("o_orderkey", clock.local_iso(ts, "Europe/Berlin").alias("iso"))


def _persons(spark, d):
    """All tables of five persons."""
    sessions = one_each(bind(spark, d, "plan_sessions"), ["person", "source", "device_id", "start_ts"])
    tables = {"hr_samples": bind(spark, d, "hr"), "step_samples": bind(spark, d, "steps"), "sleep_sessions": sessions}
    return tables | {"sleep_segments": bind(spark, d, "plan_segments"), "workouts": bind(spark, d, "workouts")}


@query
def plan_daily(spark, d):
    return to_long(compute_daily(_persons(spark, d), CFG, P)[0], P)


@query
def plan_workouts(spark, d):
    return rounded(compute_workouts(_persons(spark, d), CFG, P))


@query
def plan_nights(spark, d):
    """What the plan says of each night and of the days without one."""
    columns = "person date source onset_clock wake_clock spt_min tst_min waso_min sme tst_basis deep_min light_min rem_min nap_min tz_change hr_max hr_max_basis n_workouts load_method".split()
    return rounded(compute_nights(_persons(spark, d), CFG, P).select(*columns))


#: Queries without SQL: the whole plan, whose parts have SQL of their own and which planted wearers test.
WITHOUT_SQL = ("plan_daily",)
