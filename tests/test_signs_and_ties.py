"""Signed numbers as printf writes them, and samples that tie."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe.functions import clock
from pulseframe.operators import wear as W
from tests.conftest import duck

NUMBERS = [-0.3, -0.04, 0.0, -0.0, 0.5, 1.5, 2.5, -2.5, 0.25, 0.35, 1e15, 123.456, -0.05, float("nan"), None]


def test_signed_numbers_as_printf_has_them(spark):
    df = spark.createDataFrame(list(enumerate(NUMBERS)), "i int, v double").repartition(3)
    got = df.select("i", clock.format_signed(F.col("v")).alias("a"), clock.format_signed(F.col("v"), 1).alias("b")).collect()
    rows = ", ".join(f"({i}, CAST('{v}' AS DOUBLE))" if v is not None else f"({i}, NULL)" for i, v in enumerate(NUMBERS))
    want = duck(f"SELECT i, printf('%+.0f', v) AS a, printf('%+.1f', v) AS b FROM (VALUES {rows}) t(i, v) WHERE v IS NOT NULL", "", arrow=True).to_pylist()
    assert {r["i"]: (r["a"], r["b"]) for r in got} == {r["i"]: (r["a"], r["b"]) for r in want} | {len(NUMBERS) - 1: (None, None)}


def test_samples_that_differ_in_context_only(spark):
    rows = [(1, "s", "0", t, 60, c) for t in range(50) for c in (("workout", "background") if t % 2 else ("background", "workout"))]
    df = spark.createDataFrame(rows, "person long, source string, device_id string, ts long, bpm int, context string")
    for n in (1, 3):
        assert {r["context"] for r in W.valid_hr(df.coalesce(1).repartition(n), ["person"]).collect()} == {"background"}
