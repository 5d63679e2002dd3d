"""What the plan is asked for and no more: offsets in force, maximal rates of many equal peaks, workouts and nights by themselves."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pulseframe.operators import intervals as I
from pulseframe.operators import load as L
from pulseframe.operators import nights as N
from pulseframe.plans import daily
from pulseframe.store import stored
from tests.synthetic import Wearer, event, generate

from .conftest import rows_of


def test_anchors_that_agree_are_one_stretch(spark):
    """A thousand anchors of which every hundred agree, with one hole; the same answers as from the anchors."""
    anchors = spark.range(1000).selectExpr("1 AS person", "id * 60 + IF(id < 500, 0, 400000) AS ts", "CAST(60 * (id div 100) AS INT) AS offset_min")
    made = N.offset_stretches(anchors, ["person"])
    spans = {(r["_lo"], r["_near"]["until"], r["_near"]["value"]) for r in made.collect()}
    assert len(spans) <= 10 + 2 * 8  # ten runs, and a piece per midnight
    samples = spark.range(6000).selectExpr("1 AS person", "id * 97 - 150000 AS ts")
    raw, ready = (N.local_offsets(samples, a, "Europe/Berlin", "ts", "o", ["person"]).toArrow() for a in (anchors, stored(made, "stretches")))
    assert rows_of(raw) == rows_of(ready) and raw.num_rows == 6000
    known = I.nearest_before_or_after(samples, anchors, "offset_min", ["person"]).where("offset_min IS NOT NULL")
    every = [(k * 60 + (0 if k < 500 else 400_000), 60 * (k // 100)) for k in range(1000)]
    for r in known.where("ts % 11 = 0").collect():
        assert r["offset_min"] == min((abs(r["ts"] - t), t, v) for t, v in every)[2]


def test_offsets_of_one_instant(spark):
    """Of anchors at one instant sessions come before workouts, starts before ends, then the least offset, negative ones too."""
    s = spark.createDataFrame([(0, 100, -300), (0, 50, 60), (200, 300, None)], "start_ts long, end_ts long, tz_offset_min int")
    w = spark.createDataFrame([(100, 200, -720), (200, 210, 840)], "start_ts long, end_ts long, tz_offset_min int")
    got = N.offset_timeline(s, w)
    assert dict(got.dtypes)["offset_min"] == "int"
    assert dict(map(tuple, got.select("ts", "offset_min").collect())) == {0: -300, 50: 60, 100: -300, 200: 840, 210: 840}


def test_equal_peaks_go_on_as_few(spark):
    """Ten thousand equal spans are three by the time they are put into the tree, and the top three stay the same."""
    spans = spark.range(10_000).selectExpr("0L AS _from", "90L AS _to", "CAST(IF(id < 2, 200 + id, 180) AS DOUBLE) AS _peak")
    top = L.top_inside(spark.range(5).select(F.col("id").alias("_d")), spans, "_peak", 91)
    assert sorted(r["_peak"] for r in top.where("_d = 3").collect()) == [180, 200, 201] and top.count() == 15
    assert "array_repeat" in top._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def wearer(spark):
    first = dt.date(2024, 3, 1)
    trained = tuple(event("workout", first + dt.timedelta(days=i), at=dt.time(17), minutes=45, bpm=150) for i in range(0, 12, 3))
    return {name: stored(df, name) for name, df in generate(spark, Wearer(first=first, nights=12, events=trained)).items()}


def test_parts_equal_the_whole_plan(spark, wearer):
    wide, loads = daily.compute_daily(wearer)
    assert rows_of(daily.compute_workouts(wearer).toArrow()) == rows_of(loads.toArrow()) and loads.count() >= 4
    nights = daily.compute_nights(wearer)
    assert rows_of(nights.toArrow()) == rows_of(wide.select(*nights.columns).toArrow()) and nights.where("n_workouts > 0").count() >= 4


@pytest.mark.parametrize("part", ["compute_workouts", "compute_nights"])
def test_parts_leave_out_what_only_days_need(spark, wearer, part, monkeypatch):
    def unasked(*_, **__):
        raise AssertionError("not asked for")

    for name in ("worn_intervals", "day_wear", "compute_nightly", "add_recovery_and_readiness"):
        monkeypatch.setattr(daily, name, unasked)
    assert getattr(daily, part)(wearer).count() > 0
