"""Wear time from the continuity of heart-rate samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import DAY
from ..store import stored
from .intervals import covered_seconds, islands
from .slices import run_window, slice_window, sliced, stitched

# The valid range of heart rates, the longest gap that says something about cadence
# (seconds), the span of its running median and its value where nothing is known.
VALID_BPM = (25, 230)
LONGEST_GAP = 3600
CADENCE_ROWS = 15
NO_CADENCE = 60.0


def _by(keys: Sequence[str]):
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def valid_hr(hr: DataFrame, keys: Sequence[str] = (), placed: bool = False) -> DataFrame:
    """Background and workout samples in the valid range, one per instant (by source, device, rate, then context), bpm as double.

    Days are sorted one by one; ``placed`` keeps each sample's place in its day as ``_inside``, from which
    :func:`~pulseframe.operators.slices.numbered` needs no other sort.
    """
    ok = hr.where(F.col("context").isin("background", "workout") & F.col("bpm").between(*VALID_BPM))
    w = Window.partitionBy(*keys, F.floor(F.col("ts") / DAY)).orderBy("ts", "source", "device_id", "bpm", "context")
    new = F.coalesce(F.lag("ts").over(w) != F.col("ts"), F.lit(True))
    first = ok.withColumn("_new", new)
    if placed:
        first = first.withColumn("_inside", F.sum(F.col("_new").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return first.where("_new").drop("_new").withColumn("bpm", F.col("bpm").cast("double"))


def _with_cadence(samples: DataFrame, keys: Sequence[str], ts: str, rows: int | None) -> DataFrame:
    """Samples with ``_slice`` and ``cadence``."""
    parts = sliced(samples, keys, CADENCE_ROWS + 1, rows, ts)
    w = slice_window(keys, ts)
    step = F.lead(ts).over(w) - F.col(ts)
    gap = F.coalesce(step, F.col(ts) - F.lag(ts).over(w)).cast("double")
    known = parts.withColumn("_gap", F.when(gap <= LONGEST_GAP, gap))
    middle = F.expr(f"percentile(_gap, 0.5) OVER (PARTITION BY {', '.join([*keys, '_slice'])} ORDER BY {ts} ROWS BETWEEN {CADENCE_ROWS} PRECEDING AND {CADENCE_ROWS} FOLLOWING)")
    own = stored(known.withColumn("_median", middle).where("_own").drop("_own", "_gap", "_rn"), "cadence")
    if own.where("_median IS NULL").isEmpty():  # nothing to fill
        return own.withColumnRenamed("_median", "cadence")
    so_far = lambda order: F.last("_median", ignorenulls=True).over(Window.partitionBy(*keys, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    # what other slices know: their first and last medians, a row per slice
    ends = own.where("_median IS NOT NULL").groupBy(*keys, "_slice").agg(F.min_by("_median", ts).alias("_first"), F.max_by("_median", ts).alias("_last"))
    every = own.select(*keys, "_slice").distinct().join(ends, [*keys, "_slice"], "left")
    others = lambda c, order: F.last(c, ignorenulls=True).over(Window.partitionBy(*keys, F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    around = every.select(*keys, "_slice", others("_first", F.desc("_slice")).alias("_after"), others("_last", F.col("_slice")).alias("_before"))
    out = own.join(around, [*keys, "_slice"])
    cadence = F.coalesce(so_far(F.desc(ts)), F.col("_after"), so_far(F.col(ts)), F.col("_before"), F.lit(NO_CADENCE))
    return out.withColumn("cadence", cadence).drop("_median", "_after", "_before")


def local_cadence(samples: DataFrame, keys: Sequence[str] = (), ts: str = "ts", rows: int | None = None) -> DataFrame:
    """Add ``cadence``: the median of the 31 gaps around a sample, in seconds.

    A gap is the time to the next sample; gaps over an hour count as unknown, and the last sample
    repeats the gap before it. Where no gap nearby is known, the next known cadence holds, then the
    last, then 60 s. A key's history is cut into slices of ``rows`` samples.
    """
    return _with_cadence(samples, keys, ts, rows).drop("_slice")


def worn_intervals(samples: DataFrame, keys: Sequence[str] = (), floor_min: float = 10, rows: int | None = None) -> DataFrame:
    """Worn intervals: samples no further apart than three cadences (at least the floor), half a cadence added at both ends.

    Runs are found inside slices and stitched where they meet.
    """
    place = [c for c in samples.columns if c == "_rn"]
    with_cadence = _with_cadence(samples.select(*keys, "ts", *place), keys, "ts", rows)
    w = slice_window(keys)
    allowed = lambda c: F.greatest(3 * F.col(c), F.lit(floor_min * 60.0))
    gap = with_cadence.withColumns({"_gap": F.col("ts") - F.lag("ts").over(w), "_allowed": F.lag(allowed("cadence")).over(w)})
    inside = islands(gap, F.col("_gap") > F.col("_allowed"), [*keys, "_slice"], ["ts"])
    part = inside.groupBy(*keys, "_slice", "island").agg(
        F.min("ts").alias("first_ts"), F.min_by("cadence", "ts").alias("_c1"), F.max("ts").alias("last_ts"), F.max_by("cadence", "ts").alias("_c2")
    )
    earlier = run_window(keys)
    whole = stitched(part, F.col("first_ts") - F.lag("last_ts").over(earlier) > F.lag(allowed("_c2")).over(earlier), keys)
    half = lambda c: F.floor(F.col(c) / 2)
    ends = whole.groupBy(*keys, "_run").agg(F.min_by(F.col("first_ts") - half("_c1"), "first_ts").alias("start_ts"), F.max_by(F.col("last_ts") + half("_c2"), "last_ts").alias("end_ts"))
    return ends.drop("_run")


def day_wear(days: DataFrame, worn: DataFrame, keys: Sequence[str] = (), window: tuple[int, int] = (8, 22)) -> DataFrame:
    """Add ``day_wear``: the share of the local hours of each ``date`` that is worn; needs ``offset_min`` (at noon)."""
    midnight = F.unix_date("date").cast("long") * 86_400 - F.col("offset_min") * 60
    own = days.withColumns({"lo": midnight + window[0] * 3600, "hi": midnight + window[1] * 3600})
    out = covered_seconds(own, worn, ["date"], keys)
    return out.withColumn("day_wear", F.col("covered") / (F.col("hi") - F.col("lo"))).drop("lo", "hi", "covered")
