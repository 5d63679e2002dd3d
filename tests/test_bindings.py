"""Bindings cover the whole tables that they stand for."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe.bindings import bind
from tests.conftest import DATA

FOLDER = str(DATA / "sf0.01")


def test_long_covers_all_events(spark):
    e = spark.read.parquet(f"{FOLDER}/events.parquet")
    days = e.groupBy("user_id", F.to_date("ts").cast("string").alias("date"), "event_type").agg(F.sum(F.floor("value")).alias("s"))
    want = [(r["user_id"], r["date"], float(r["s"]) if r["s"] % 7 else None) for r in days.collect()]
    got = sorted(((r["person"], r["date"], r["value"]) for r in bind(spark, FOLDER, "long").collect()), key=str)
    assert got == sorted(want, key=str)


def test_workouts_cover_all_purchases(spark):
    n = spark.read.parquet(f"{FOLDER}/events.parquet").where("event_type = 'purchase'").count()
    assert bind(spark, FOLDER, "workouts").count() == n


def test_every_session_has_its_segments(spark):
    assert bind(spark, FOLDER, "segments").count() == 5 * bind(spark, FOLDER, "sessions").count()
