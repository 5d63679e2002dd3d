"""Numbers of samples inside intervals against plain pairs, masks and nearest anchors against brute force, and no plan with pairs."""

from __future__ import annotations

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from pulseframe.operators import intervals as I
from pulseframe.operators import load as L
from pulseframe.operators.ranges import range_stats


def brute(inside, end, hr_max, times):
    """What the samples inside one interval say, each repeated so many times."""
    s = [x for x in sorted(inside) for _ in range(times)]
    ts, bpm = [t for t, _ in s], [b for _, b in s]
    steps = [b - a for a, b in zip(ts, ts[1:])]
    c = median(steps) if steps else None
    triples = [sorted(bpm[i - 2 : i + 1])[1] for i in range(2, len(s)) if None not in bpm[i - 2 : i + 1]]
    minutes = [0.0] * 5
    for i, (t, b) in enumerate(s):
        hold = ts[i + 1] - t if i + 1 < len(s) else max(end - t, 0)
        hold = hold if c is None else min(hold, 2 * c)
        z = None if b is None or hr_max is None else sum(b / hr_max >= e for e in (0.5, 0.6, 0.7, 0.8, 0.9))
        if z:
            minutes[z - 1] += hold / 60
    known = [b for b in bpm if b is not None]
    return (len(s), len(known), sum(known), max(known, default=None), c, max(triples, default=None), *[round(m, 6) for m in minutes])


@pytest.mark.parametrize("spread", [40, 4000])
def test_ranges_against_pairs(spark, spread):
    rng = random.Random(spread)
    times = {p: sorted(rng.sample(range(20 * spread), 300)) for p in ("a", "b")}
    samples = [(p, t, None if rng.random() < 0.05 else float(rng.randint(60, 200))) for p, ts in times.items() for t in ts]
    spans = [(p, s := rng.randint(-100, 20 * spread), s + rng.choice([-5, 0, 1, 60, spread, 9 * spread]), f"s{i}", rng.choice([180.0, 190.0, None])) for i, p in enumerate("abc" * 40)]
    spans += spans[:9] + spans[:3]
    df = spark.createDataFrame(spans, "person string, start_ts long, end_ts long, sport string, hr_max double").repartition(5)
    own = ["person", "start_ts", "end_ts", "sport"]
    got = range_stats(df, spark.createDataFrame(samples, "person string, ts long, bpm double"), ["person"], "hr_max", own).collect()
    want = []
    for x in spans:
        inside = [(t, b) for p, t, b in samples if p == x[0] and x[1] <= t < x[2]]
        if inside:
            want.append((*x, *brute(inside, x[2], x[4], spans.count(x))))
    told = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    assert sorted(map(told, got), key=str) == sorted(map(told, want), key=str) and len(want) > 30


def test_load_makes_no_pairs(spark):
    """A thousand workouts over the same thousand samples."""
    w = spark.range(1000).selectExpr("1L AS person", "id AS start_ts", "id + 3000 AS end_ts", "concat('s', id) AS sport", "0.0D AS max_hr")
    hr = spark.range(1000).selectExpr("1L AS person", "id * 4 AS ts", "CAST(100 + id % 50 AS DOUBLE) AS bpm")
    peaks = L.sustained_peaks(w, hr, ["person"])
    plan = peaks._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "ts#" in plan
    assert peaks.where("max_hr = 148").count() == 1000


def test_outside(spark):
    rng = random.Random(1)
    samples = [(p, rng.randint(-90_000, 200_000)) for p in "ab" for _ in range(400)] + [(None, 5)]
    spans = [(rng.choice("ab"), s := rng.randint(-100_000, 200_000), s + rng.choice([-3, 0, 1, 500, 90_000]) // rng.randint(1, 40)) for _ in range(120)] + [(None, 0, 100)]
    got = I.outside(spark.createDataFrame(samples, "person string, ts long"), spark.createDataFrame(spans, "person string, start_ts long, end_ts long"), ["person"]).collect()
    want = [(p, t) for p, t in samples if not any(q == p and p is not None and a <= t < b for q, a, b in spans)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and 100 < len(want) < len(samples)


def test_nearest_anchors_meet_no_sample_twice(spark):
    anchors = spark.range(500).selectExpr("1 AS person", "id * 100 AS ts", "CAST(id AS INT) AS offset")
    samples = spark.range(3000).selectExpr("1 AS person", "id * 17 - 100 AS ts", "id").unionByName(spark.createDataFrame([(None, 7, 9999)], "person int, ts long, id long"))
    out = I.nearest_before_or_after(samples, anchors, "offset", ["person"], tolerance_s=1000)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    for r in out.collect():
        near = [] if r["person"] is None else sorted((abs(r["ts"] - k * 100), k) for k in range(500) if abs(r["ts"] - k * 100) <= 1000)
        assert r["offset"] == (near[0][1] if near else None)
