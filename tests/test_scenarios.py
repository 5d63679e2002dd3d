"""Planted events with known answers, through the whole daily plan."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pulseframe.config import Config, Readiness, Recovery, Strain, build
from pulseframe.operators.recovery import readiness, recovery
from pulseframe.plans.daily import compute_daily, to_long
from tests.synthetic import Spread, Wearer, event, generate, truth

D = dt.date


@pytest.fixture(scope="module")
def planted(spark):
    sc = Wearer(
        nights=35,
        events=(
            event("awake", D(2026, 3, 5), minutes=30), event("sleep", D(2026, 3, 20), hours=5), event("rate", D(2026, 3, 25), bpm=8), event("no_night", D(2026, 3, 10)),
            event("nap", D(2026, 3, 6), at=dt.time(15), minutes=40), event("workout", D(2026, 3, 12), at=dt.time(17), minutes=90, bpm=150),
        ),
    )
    wide, loads = compute_daily(generate(spark, sc))
    return {str(r["date"]): r for r in wide.collect()}, loads.collect(), to_long(wide).toPandas()


def test_ordinary_night(planted):
    n = planted[0]["2026-03-02"]
    assert (n["tst_min"], n["spt_min"], n["waso_min"], n["onset_clock"], n["wake_clock"]) == (450, 450, 0, 1410, 420)
    assert (n["deep_min"], n["light_min"], n["rem_min"], n["rhr"]) == (125, 225, 100, 52)


def test_awake_bout_and_nap(planted):
    n = planted[0]["2026-03-05"]
    assert (n["spt_min"], n["tst_min"], n["waso_min"]) == (450, 420, 30) and n["sme"] == pytest.approx(420 / 450)
    assert planted[0]["2026-03-06"]["nap_min"] == 40 and planted[0]["2026-03-06"]["tst_min"] == 450


def test_missing_night_is_not_imputed(planted):
    assert planted[0]["2026-03-10"]["tst_min"] is None
    long = planted[2]
    gap = long[(long.date == "2026-03-10") & (long.metric == "sleep.tst_min")].iloc[0]
    assert gap.status == "insufficient_data" and gap.value != gap.value and "no main sleep" in gap.reason


def test_warm_up_illness_and_short_night(planted):
    days = planted[0]
    assert days["2026-03-15"]["rhr_base_status"] == "warming_up" and days["2026-03-16"]["rhr_base_status"] == "ok"
    ill = days["2026-03-25"]
    assert (ill["rhr"], ill["rhr_z"], ill["rhr_flag"]) == (60, 8, True) and not days["2026-03-26"]["rhr_flag"]
    short = days["2026-03-20"]
    assert short["tst_min"] == 300 and short["tst_z"] == (300 - 450) / 20 and short["tst_flag"] and short["recovery_z_sleep"] == -3
    assert ill["recovery"] < 5 and ill["recovery_band"] == "low" and ill["readiness"] == "Take it slow and recover today"


def test_neutral_recovery_and_exact_points(planted):
    assert planted[0]["2026-03-26"]["recovery"] == pytest.approx(50)
    for r in planted[0].values():
        if r["recovery_status"] == "ok":
            assert r["recovery_pts_rhr"] + r["recovery_pts_sleep"] == pytest.approx(r["recovery"] - 50, abs=1e-9)


def test_summer_time_night(planted):
    n = planted[0]["2026-03-29"]
    assert (n["onset_clock"], n["wake_clock"], n["spt_min"], n["tz_change"]) == (1410, 480, 450, False)


def test_load(planted):
    days, loads, long = planted
    assert [(r["method"], r["load"], r["z3_min"]) for r in loads] == [("hr_ours", 270, 90)]
    assert days["2026-03-12"]["load"] == 270 and days["2026-03-13"]["load"] == 0 and days["2026-03-13"]["steps"] == 8000
    assert long.metric.nunique() == 46 and set(long.status) <= {"ok", "insufficient_data", "not_available", "warming_up"}
    assert (long[long.status != "ok"].value.isna()).all()


def test_unrecorded_session_is_detected(spark):
    sc = Wearer(nights=3, events=(event("workout", D(2026, 3, 2), at=dt.time(17), minutes=60, bpm=165),))
    tables = generate(spark, sc)
    tables["workouts"] = tables["workouts"].limit(0)
    wide, loads = compute_daily(tables)
    found = loads.collect()
    assert [r["method"] for r in found] == ["detected"] and found[0]["load"] == pytest.approx(240, abs=8)
    tables = generate(spark, sc)
    tables["workouts"] = tables["workouts"].limit(0)
    wide, _ = compute_daily(tables, Config(strain=Strain(detect_sessions=False)))
    day = {str(r["date"]): r for r in wide.collect()}["2026-03-02"]
    assert day["unrecorded_hint"] and day["load"] == 0


def test_rules(spark):
    row = spark.sql("SELECT 20.0D AS recovery, 'ok' AS recovery_status, CAST(NULL AS DOUBLE) AS acwr, true AS tst_flag, 2.5D AS rhr_z")
    assert readiness(row).first()["readiness"].startswith("Your pulse at rest is far above")
    with pytest.raises(ValueError, match="cannot read"):
        readiness(row, Readiness(rules=({"when": [{"field": "nope", "op": "<", "value": 1}], "say": "x"},)))
    with pytest.raises(ValueError, match="without a weight"):
        recovery(row, Recovery(weights={"rhr": 1.0}, required=("rhr", "sleep")))


def test_config():
    assert build(Config, {"strain": {"tau": 100}, "recovery": {"weights": {"rhr": 0.7}}}).recovery.weights == {"rhr": 0.7, "sleep": 0.5}
    with pytest.raises(ValueError, match="unknown keys"):
        build(Config, {"strain": {"taau": 1}})
    with pytest.raises(ValueError, match="sex"):
        build(Config, {"person": {"sex": "x"}})


def test_normal_cdf(spark):
    import math

    from pulseframe.functions.scores import normal_cdf

    for x, y in spark.range(-30, 31).select((F.col("id") / 7).alias("x")).select("x", normal_cdf(F.col("x"))).collect():
        assert y == pytest.approx(0.5 * math.erfc(-x / math.sqrt(2)), abs=1e-12)


def test_truth_of_uneven_nights(spark):
    uneven = Wearer(nights=6, spread=Spread(hours=0.5, to_bed_min=20, lowest_rate=2, awake_min=25, stage_min=8), seed=4)
    tables = generate(spark, uneven)
    rows = {r["date"]: r for r in truth(spark, uneven).collect()}
    wide = {r["date"]: r for r in compute_daily(tables)[0].collect()}
    assert len({r["spt_min"] for r in rows.values()}) > 3
    for day, r in rows.items():
        got = wide[day]
        assert (got["tst_min"], got["spt_min"], got["onset_clock"]) == (pytest.approx(r["tst_min"], abs=1), pytest.approx(r["spt_min"], abs=1), r["onset_clock"])
        assert got["rhr"] == pytest.approx(r["rhr"], abs=1.5)
    with pytest.raises(ValueError, match="no event"):
        event("nap", D(2026, 3, 1), bpm=3)
