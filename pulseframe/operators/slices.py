"""Windows over one key's long history, cut into slices that any task can take.

Rows of a key are numbered in order: places inside a day come from that day's own rows, and what lies
before a day from a count per day. Slices are runs of so many numbers. A row near a border also goes to
the slice next to it, as part of its halo, so that a frame of fewer rows than the halo sees the same rows
with and without slices. Runs that go on over a border are stitched afterwards, from one row per run and
slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import DAY

#: Rows of a slice.
ROWS = 100_000


def numbered(samples: DataFrame, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Add ``_rn``: the row's place from 0 in its key, by ``ts``; rows that tie are interchangeable.

    Rows that know their places in their days (``_inside``, from 1) are not sorted again.
    """
    day = F.floor(F.col(ts) / DAY)
    counts = samples.groupBy(*keys, day.alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys, F.lit(0)).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*keys, "_day", F.coalesce(before, F.lit(0)).alias("_start"))  # a row per key and day
    placed = samples.withColumn("_day", day).join(starts, [*keys, "_day"])
    inside = F.col("_inside") if "_inside" in samples.columns else F.row_number().over(Window.partitionBy(*keys, "_day").orderBy(ts))
    return placed.withColumn("_rn", F.col("_start") + inside - 1).drop("_day", "_start", "_inside")


def sliced(samples: DataFrame, keys: Sequence[str] = (), halo: int = 1, rows: int | None = None, ts: str = "ts") -> DataFrame:
    """Add ``_slice``, and ``_own``: false for the up to ``halo`` rows on either side that belong to other slices.

    Numbers rows first if they have no ``_rn``.
    """
    size = max(rows or ROWS, halo)
    with_place = samples if "_rn" in samples.columns else numbered(samples, keys, ts)
    at = lambda n: F.floor(n / size)
    near = F.sequence(F.greatest(at(F.col("_rn") - halo), F.lit(0)), at(F.col("_rn") + halo))
    return with_place.withColumn("_slice", F.explode(near)).withColumn("_own", F.col("_slice") == at(F.col("_rn")))


def slice_window(keys: Sequence[str] = (), ts: str = "ts"):
    """The window of one slice, in order."""
    return Window.partitionBy(*keys, "_slice").orderBy(ts)


def stitched(runs: DataFrame, breaks: Column, keys: Sequence[str], name: str = "_run") -> DataFrame:
    """Number runs over slices: a run for which ``breaks`` holds begins a new one, any other goes on.

    ``runs`` has a row per run and slice with ``first_ts``; ``breaks`` may look at the run before it through
    ``F.lag(...).over(run_window(keys))``. What is sorted per key here are runs, not samples.
    """
    return runs.withColumn("_break", F.coalesce(breaks, F.lit(False))).withColumn(
        name, F.sum(F.col("_break").cast("int")).over(run_window(keys).rowsBetween(Window.unboundedPreceding, 0))
    ).drop("_break")


def run_window(keys: Sequence[str] = ()):
    return Window.partitionBy(*keys, F.lit(0)).orderBy("first_ts")
