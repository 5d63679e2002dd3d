"""Slices, scans, trees and day maps: the same results as plain loops, however long a history is."""

from __future__ import annotations

import datetime as dt
import random
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pulseframe.config import Config, Person, Strain
from pulseframe.operators import intervals as I
from pulseframe.operators import load as L
from pulseframe.operators import nights as N
from pulseframe.operators import series as S
from pulseframe.operators import slices as C
from pulseframe.operators import wear as W

T0 = 1_772_323_200


def uneven(rng, n, person=0):
    """Samples with steps of a minute, of hours, and runs without any step under an hour."""
    out, t = [], T0 + rng.randint(0, 50_000)
    for i in range(n):
        t += rng.choice([60, 60, 60, 61, 300, 700]) if (i // 60) % 3 else rng.choice([3600, 3601, 7200, 60_000])
        out.append((person, t, float(rng.randint(60, 190))))
    return out


def test_numbers_and_halos(spark):
    rng = random.Random(1)
    rows = [r for p in range(3) for r in uneven(rng, 150, p)]
    df = spark.createDataFrame(rows, "person int, ts long, bpm double").repartition(4)
    got = defaultdict(list)
    for r in C.sliced(df, ["person"], halo=3, rows=20).collect():
        got[r["person"], r["_slice"]].append((r["_rn"], r["_own"], r["ts"]))
    for p in range(3):
        times = sorted(t for q, t, _ in rows if q == p)
        for k in range(8):
            held = sorted(got[p, k])
            first, last = k * 20, min(150, (k + 1) * 20)
            assert [n for n, _, _ in held] == list(range(max(0, first - 3), min(150, last + 3)))
            assert all(times[n] == t and own == (first <= n < last) for n, own, t in held)


@pytest.mark.parametrize("rows", [1, 17, 50, 64, 100_000])
def test_cadence_and_wear_with_and_without_slices(spark, rows):
    rng = random.Random(2)
    data = [r for p in range(2) for r in uneven(rng, 400, p)] + [(7, T0, 60.0), (8, T0, 60.0), (8, T0 + 9000, 60.0)]
    df = spark.createDataFrame(data, "person int, ts long, bpm double").repartition(3)
    cadence = {(r["person"], r["ts"]): r["cadence"] for r in W.local_cadence(df.select("person", "ts"), ["person"], rows=rows).collect()}
    worn = {(r["person"], r["start_ts"], r["end_ts"]) for r in W.worn_intervals(df, ["person"], rows=rows).collect()}
    want_worn = set()
    for p in {d[0] for d in data}:
        t = sorted(x for q, x, _ in data if q == p)
        gaps = [b - a for a, b in zip(t, t[1:])]
        gaps = [*gaps, gaps[-1]] if gaps else [None]
        gaps = [g if g is not None and g <= 3600 else None for g in gaps]
        medians = [statistics.median(near) if (near := [g for g in gaps[max(0, i - 15) : i + 16] if g is not None]) else None for i in range(len(t))]
        filled = [next((m for m in medians[i:] if m is not None), next((m for m in reversed(medians[:i]) if m is not None), 60.0)) for i in range(len(t))]
        assert [cadence[p, x] for x in t] == filled
        start = 0
        for i in range(1, len(t) + 1):
            if i == len(t) or t[i] - t[i - 1] > max(3 * filled[i - 1], 600):
                want_worn.add((p, t[start] - int(filled[start] // 2), t[i - 1] + int(filled[i - 1] // 2)))
                start = i
    assert worn == want_worn


def test_no_task_gets_a_history(spark):
    df = spark.range(30_000).select((F.col("id") * 60 + T0).alias("ts"), F.lit(70.0).alias("bpm"))
    sizes = [r["n"] for r in C.sliced(df, halo=16, rows=1000).groupBy("_slice").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 31 and max(sizes) <= 1032  # the last one holds nothing but its halo
    assert [tuple(r) for r in W.worn_intervals(df, rows=1000).collect()] == [(T0 - 30, T0 + 29_999 * 60 + 30)]


@pytest.mark.parametrize("masked", [True, False])
def test_detection_with_and_without_slices(spark, masked):
    rng = random.Random(3)
    samples, t = [], T0
    for i in range(1500):
        t += 60 if rng.random() < 0.98 else rng.choice([100, 130, 700])
        samples.append((t, float(rng.randint(130, 170) if (i // 70) % 4 == 1 else rng.randint(60, 90))))
    hr = spark.createDataFrame(samples, "ts long, bpm double").repartition(3)
    days = spark.range(5).select(F.date_add(F.lit("2026-02-28").cast("date"), F.col("id").cast("int")).alias("date"), F.lit(185.0).alias("hr_max"))
    timeline = spark.createDataFrame([], "ts long, offset_min int")
    busy = spark.createDataFrame([(samples[400][0], samples[420][0])], "start_ts long, end_ts long") if masked else None
    found = []
    for rows in (3, 40, 71, 100_000):
        dated = L.dated_samples(hr, days, timeline, Config(), rows=rows)
        found.append((sorted(map(tuple, L.detect_sessions(dated, busy).collect())), sorted((r["ts"], r["_gap"], r["_step"], r["_smooth"]) for r in dated.collect())))
    assert len(found[0][0]) >= 3 and all(f == found[-1] for f in found)
    share = [b / 185 for _, b in samples]
    part, parts = 0, []
    for i, (x, _) in enumerate(samples):
        part += i > 0 and x - samples[i - 1][0] > Strain().workout_max_cadence_s
        parts.append(part)
    for i, (_, _, _, smooth) in enumerate(found[0][1]):
        five = [share[j] for j in range(max(0, i - 2), min(len(share), i + 3)) if parts[j] == parts[i]]
        assert smooth == (pytest.approx(statistics.median(five)) if len(five) >= 3 else None)


def test_impulse_does_not_depend_on_slices(spark):
    rows = [(p, t, b) for p, t, b in uneven(random.Random(4), 500)]
    hr = spark.createDataFrame(rows, "person int, ts long, bpm double").drop("person")
    days = spark.range(900).select(F.date_add(F.lit("2026-02-20").cast("date"), F.col("id").cast("int")).alias("date"), F.lit(190.0).alias("hr_max"), F.lit(55.0).alias("hr_rest"))
    timeline = spark.createDataFrame([], "ts long, offset_min int")
    got = [sorted((r["date"], r["banister"]) for r in L.banister_daily(L.dated_samples(hr, days.drop("hr_rest"), timeline, rows=n), days.drop("hr_max")).collect()) for n in (9, 100_000)]
    assert [d for d, _ in got[0]] == [d for d, _ in got[1]] and all(a == pytest.approx(b, rel=1e-12) if a is not None else b is None for (_, a), (_, b) in zip(*got))


# --- nearest anchors -------------------------------------------------------------------------------


def test_nearest_anchors_match_a_search(spark):
    rng = random.Random(5)
    anchors = [(p, T0 + rng.randint(0, 900_000), i) for p in "ab" for i in range(25)] + [("a", T0 + 100, 90), ("a", T0 + 100, 91), ("a", T0 + 300, 92)]
    samples = [(p, T0 + rng.randint(-300_000, 1_200_000), i) for p in "abc" for i in range(300)] + [("a", T0 + 200, 1000), ("a", T0 + 100, 1001), (None, T0, 1002)]
    a = spark.createDataFrame(anchors, "person string, ts long, v int")
    s = spark.createDataFrame(samples, "person string, ts long, i int")
    for tolerance in (36 * 3600, 500):
        got = {r["i"]: r["v"] for r in I.nearest_before_or_after(s.where("person = 'a' OR person IS NULL"), a, "v", ["person"], tolerance_s=tolerance).collect()}
        for p, t, i in samples:
            if p in ("a", None):
                near = min(((abs(t - x), x, v) for q, x, v in anchors if q == p and abs(t - x) <= tolerance), default=(0, 0, None))
                assert got[i] == near[2], (t, near)


# --- exponential averages --------------------------------------------------------------------------


@pytest.mark.parametrize("block", [1, 7, 64])
def test_averages_match_a_loop(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK_DAYS", block)
    rng = random.Random(6)
    rows = []
    for p in "xy":
        first = dt.date(2015, 12, 20)
        holes = range(200, 420) if p == "x" else range(0, 90)  # longer than any block: the average holds
        rows += [(p, first + dt.timedelta(days=i), None if i in holes or rng.random() < 0.3 else rng.choice([0.0, rng.uniform(0, 900)])) for i in range(1200)]
    df = spark.createDataFrame(rows, "person string, date date, load double").repartition(3)
    got = {(r["person"], r["date"]): (r["a"], r["b"]) for r in S.running_averages(df, "load", {"a": 2 / 8, "b": 2 / 29}, ["person"]).collect()}
    for p in "xy":
        value = None
        for q, day, x in rows:
            if q != p:
                continue
            if x is not None:
                value = tuple((1 - r) * v + r * x for r, v in zip((2 / 8, 2 / 29), value or (0.0, 0.0)))
            assert got[p, day] == ((None, None) if value is None else pytest.approx(value, rel=1e-9, abs=1e-12))


def test_averages_keep_no_arrays(spark):
    df = spark.createDataFrame([(dt.date(2026, 1, 1), 1.0)], "date date, load double")
    wide = S.acute_chronic(df)
    assert not [t for _, t in wide.dtypes if t.startswith("array")] and not [c for c in wide.columns if c.startswith("_")]


# --- the largest of a look-back --------------------------------------------------------------------


def test_top_of_spans_matches_a_search(spark):
    rng = random.Random(7)
    spans = [("k", a := rng.randint(-50, 400), a + rng.randint(-2, 90), float(rng.randint(1, 60))) for _ in range(300)] + [("k", 5, 5, 99.0), ("j", -7, 56, 1.0)]
    df = spark.createDataFrame(spans, "key string, _from long, _to long, v double")
    dates = spark.createDataFrame([(k, d) for k in "kj" for d in range(-60, 500)], "key string, _d long")
    got = defaultdict(list)
    for r in L.top_inside(dates, df, "v", 91, 3, ["key"]).collect():
        got[r["key"], r["_d"]].append(r["v"])
    for k in "kj":
        for d in range(-60, 500):
            assert sorted(got[k, d], reverse=True) == sorted((v for q, a, b, v in spans if q == k and a <= d <= b), reverse=True)[:3]


def test_joined_rows_grow_with_days_plus_spans(spark):
    n = 4000
    spans = spark.range(n).select(F.col("id").alias("_from"), (F.col("id") + 1459).alias("_to"), (F.col("id") % 97).cast("double").alias("v"))
    dates = spark.range(n).select(F.col("id").alias("_d"))
    assert L.top_inside(dates, spans, "v", 1460).count() == 3 * n - 3
    nodes = 0
    for a in (0, 1, 731, 1459):  # each span is made up of at most two stretches a level
        one = spark.createDataFrame([(a, a + 1459, 1.0)], "_from long, _to long, v double")
        nodes = max(nodes, L.top_inside(spark.range(3000).select(F.col("id").alias("_d")), one, "v", 1460).count())
    assert nodes == 1460


@pytest.mark.parametrize("lookback", [3, 30, 1460])
def test_maximal_rate_matches_a_search(spark, lookback):
    rng = random.Random(8)
    person, s = Person(), Strain(hrmax_lookback_days=lookback)
    day0 = dt.date(2024, 1, 1)
    base = (day0 - dt.date(1970, 1, 1)).days
    predicted = lambda d: 220.0 - (person.age - (dt.date.fromisoformat(str(person.age_as_of)) - d).days / 365.25)
    top = predicted(day0) + s.hrmax_artifact_margin
    workouts = [((base + rng.randint(-40, 700)) * 86_400 + rng.randint(0, 86_399), top + rng.choice([-0.5, -1.0, -2.0, -1.37, 0.0, 1.0, -15.0])) for _ in range(250)]
    df = spark.createDataFrame(workouts, "start_ts long, max_hr double")
    days = spark.range(700).select(F.date_add(F.lit(day0), F.col("id").cast("int")).alias("date"))
    got = {r["date"]: (r["hr_max"], r["hr_max_basis"]) for r in L.hrmax_by_date(days, df, person=person, s=s).collect()}
    for i in range(700):
        d = day0 + dt.timedelta(days=i)
        age = predicted(d)
        seen = sorted((p for t, p in workouts if 0 <= base + i - t // 86_400 < lookback and p <= age + s.hrmax_artifact_margin), reverse=True)[:3]
        want = (seen[1], "observed") if len(seen) == 3 and seen[1] > age else (age, "age")
        assert got[d] == (pytest.approx(want[0], abs=1e-9), want[1])


# --- day maps --------------------------------------------------------------------------------------


def test_day_maps_match_minutes(spark):
    rng = random.Random(9)
    span = lambda longest: (a := T0 + rng.randint(0, 6 * 86_400), a + rng.randint(-5, longest))
    worn, episodes, awake = [span(200_000) for _ in range(5)], [span(40_000) for _ in range(6)], [span(4000) for _ in range(20)]
    frame = lambda rows: spark.createDataFrame(rows, "start_ts long, end_ts long")
    timeline = spark.createDataFrame([(T0 + 2 * 86_400, -300), (T0 + 3 * 86_400, 90)], "ts long, offset_min int")
    maps = N.sleep_wake_maps(frame(episodes), frame(awake).withColumn("stage", F.lit("awake")), frame(worn), timeline, "UTC").collect()

    def offset(t):
        near = min((abs(t - x), x, o) for x, o in ((T0 + 2 * 86_400, -300), (T0 + 3 * 86_400, 90)))
        return near[2] if near[0] <= 36 * 3600 else 0

    state = {}
    for level, rows in enumerate((worn, episodes, awake)):
        for a, b in rows:
            for m in range((a + offset(a) * 60) // 60, -(-(b + offset(b) * 60) // 60)):
                state[m] = max(state.get(m, -1), level)
    got = {(r["day"] - dt.date(1970, 1, 1)).days * 1440 + m: (r["asleep"][m // 60] >> m % 60) & 1 for r in maps for m in range(1440) if (r["known"][m // 60] >> m % 60) & 1}
    assert got == {m: int(level == 1) for m, level in state.items()}
    frames = N.sleep_wake_maps(frame(episodes), frame(awake).withColumn("stage", F.lit("awake")), frame(worn), timeline, "UTC")
    pairs = {r["day"]: (r["known"], r["agree"]) for r in N.day_pairs(frames).collect()}
    want = defaultdict(lambda: [0, 0])
    for m, s in got.items():
        if m - 1440 in got:
            day = dt.date(1970, 1, 1) + dt.timedelta(days=m // 1440)
            want[day][0] += 1
            want[day][1] += s == got[m - 1440]
    assert pairs == {d: tuple(v) for d, v in want.items()}
    first = frames.orderBy("day").select("day", N.map_minutes(F.col("asleep")).alias("m"), N.set_minutes(F.col("asleep")).alias("n")).first()
    assert len(first["m"]) == first["n"] and frames.count() == len({m // 1440 for m in got})
