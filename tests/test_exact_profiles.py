"""Profiles count exactly."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe.plans import profiling as PR


def test_distinct_values_are_exact(spark):
    df = spark.range(20_000).select((F.col("id") % 10_007).alias("a"), F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("b"), F.lit(None).cast("string").alias("none"), F.array("id").alias("list"))
    assert {r["column"]: r["distinct"] for r in PR.column_stats(df).collect()} == {"a": 10_007, "b": 10_000, "none": 0, "list": 20_000}


def test_steps_within_ranges_and_across_borders(spark):
    import random
    from collections import Counter

    rng = random.Random(3)
    times = sorted({rng.randint(0, 100) * 7 + 1_000_000 * (i % 3) for i in range(200)})
    want = Counter(b - a for a, b in zip(times, times[1:], strict=False))
    df = spark.createDataFrame([(t,) for t in times + times[:9] + [None]], "ts long")
    got = PR.top_steps(df, "ts", 50)
    assert {int(r["value"]): r["n"] for r in got.collect()} == want
    # no window over all instants: the only one without a key is over the ranges' ends
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "lag(_t" in plan and "_range" in plan and "lag(ts" not in plan
    empty = PR.top_steps(df.where("ts < 0"), "ts")
    assert empty.collect() == [] and PR.top_steps(df.where("ts IS NULL OR ts = 0").limit(1), "ts").collect() == []


def test_quantiles_without_arrays_of_values(spark):
    import statistics

    values = {"a": [5.0, 1.0, 1.0, 9.0, 2.0, 2.0, 2.0], None: [3.0, 4.0]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("a", None)], "k string, v double")
    got = PR.quantiles(df, "v", ["k"], (0.25, 0.5, 0.75))
    assert {r["k"]: [r["q25"], r["q50"], r["q75"]] for r in got.collect()} == {k: statistics.quantiles(vs, n=4) for k, vs in values.items()}
    assert PR.quantiles(df.where("v = 9"), "v", ["k"], (0.5,)).first()["q50"] is None  # a single value has no neighbours
    assert PR.quantiles(df.where("k = 'a'"), "v", [], (0.5,)).first()["q50"] == 2.0
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_ranks_of_one_large_key(spark):
    """Without keys, and with a null one: ties at their means, nothing in one partition."""
    import random
    import statistics

    from pulseframe.operators import ranks

    rng = random.Random(12)
    rows = [(rng.choice(["a", None]), float(rng.randint(0, 40)), float(rng.randint(0, 9))) for _ in range(900)] + [("a", None, 1.0), ("b", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(6)

    def mean_ranks(values):
        order = sorted(values)
        return [order.index(v) + (order.count(v) + 1) / 2 for v in values]

    got = {r["k"]: (r["rho"], r["n"]) for r in ranks.spearman(df, "x", "y", ["k"]).collect()}
    for k in ("a", None):
        own = [(x, y) for q, x, y in rows if q == k and x is not None]
        assert abs(got[k][0] - statistics.correlation(*(mean_ranks(c) for c in zip(*own)))) < 1e-12 and got[k][1] == len(own)
    assert got["b"] == (None, 1)
    whole = [x for _, x, _ in rows if x is not None]
    assert {r["_v"]: r["_rank"] for r in ranks.mean_ranks(df, "x").collect()} == dict(zip(whole, mean_ranks(whole)))
    points = ranks.quantiles(df, "x", [], (0.25, 0.5, 0.75))
    assert list(points.first()) == statistics.quantiles(whole, n=4)
    plan = ranks.running_counts(df, "x")._jdf.queryExecution().optimizedPlan().toString()
    assert "_range" in plan and plan.count("Window") == 2
