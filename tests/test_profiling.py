"""Roles of columns, verdicts by name, JSON paths and a wearer without keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe.operators.load import hrmax_by_date
from pulseframe.plans import profiling as PR
from pulseframe.plans import serving as SV


def test_roles(spark):
    rows = [("u", "d1", "heart_rate", 1_772_404_200 + i, '{"time":1,"bpm":60}', 1_772_404_300) for i in range(20)]
    df = spark.createDataFrame(rows, "Uid string, Sid string, Key string, Time long, Value string, UpdateTime long")
    assert PR.detect_roles(df) == {"time": "Time", "key": "Key", "value": "Value", "device": "Sid"}
    odd = spark.createDataFrame([("[1,2]", "x")] * 3, "blob string, other string")
    assert PR.detect_roles(odd) == {"time": None, "key": None, "value": "blob", "device": None}


def test_names():
    assert [PR.role(n) for n in ("HEART_RATE", "LATITUDE", "RR_INTERVALS", "TIMESTAMP", "RAW_KIND", "device_id", "x")] == ["hr", "geo", "hrv", "time", "code", "id", None]
    assert "RR_INTERVALS" in PR.hrv_verdict(["HR", "RR_INTERVALS"]) and PR.hrv_verdict(["HR"]).startswith("no ")


def test_observed_maximum_without_keys(spark):
    day = 86_400
    peaks = [196.0, 197.0, 198.0, 240.0]
    w = spark.createDataFrame([(20_500 * day + i * day, p) for i, p in enumerate(peaks)], "start_ts long, max_hr double")
    days = spark.createDataFrame([(20_510,), (22_000,)], "n int").select(F.date_from_unix_date("n").alias("date"))
    got = [(r["hr_max"], r["hr_max_basis"]) for r in hrmax_by_date(days, w).orderBy("date").collect()]
    assert got[0] == (197.0, "observed") and got[1][1] == "age"


def test_limits(spark):
    import pytest

    long = spark.createDataFrame([], "date string, metric string, value double, status string, reason string")
    with pytest.raises(ValueError, match="days must be"):
        SV.series(long, "2026-01-01", 3)
    with pytest.raises(ValueError):
        SV.day(long, "not a date")
    assert SV.date_range(long).first()["shown"] is None
