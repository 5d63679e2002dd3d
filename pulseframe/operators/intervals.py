"""Joins of instants and intervals, and folds over intervals.

``keys`` are columns (a person, say) that every join and window is confined to. Interval joins
match on keys and calendar day first: an interval is repeated once per day it touches, so that the
join is an equi-join that Spark can shuffle, broadcast or split, whatever the sizes of its sides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import DAY


def _day(ts: Column) -> Column:
    return F.floor(ts / DAY)


def one_each(df: DataFrame, ident: Sequence[str]) -> DataFrame:
    """One row per identity: the greatest by its other columns in order, nulls last."""
    rest = [F.desc_nulls_last(c) for c in df.columns if c not in ident]
    first = F.row_number().over(Window.partitionBy(*ident).orderBy(*rest))
    return df.withColumn("_first", first).where("_first = 1").drop("_first")


def by_day(intervals: DataFrame, start: str, end: str, name: str = "_day") -> DataFrame:
    """Each interval [start, end) once per UTC day that it touches; empty ones not at all."""
    days = F.sequence(_day(F.col(start)), _day(F.col(end) - 1))
    return intervals.where(F.col(end) > F.col(start)).withColumn(name, F.explode(days))


def slice_join(intervals: DataFrame, samples: DataFrame, keys: Sequence[str] = (), start: str = "start_ts", end: str = "end_ts", ts: str = "ts") -> DataFrame:
    """Pairs of an interval and a sample with start <= ts < end."""
    right = samples.withColumn("_day", _day(F.col(ts)))
    return by_day(intervals, start, end).join(right, [*keys, "_day"]).where((F.col(ts) >= F.col(start)) & (F.col(ts) < F.col(end))).drop("_day")


def outside(samples: DataFrame, intervals: DataFrame, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Samples that no interval [start_ts, end_ts) holds.

    Intervals are cut at midnight. In a day a sample is inside where the latest end of the intervals begun by
    then lies after it, so a sample meets one number and not each interval over it.
    """
    cut = by_day(intervals.select(*keys, "start_ts", "end_ts"), "start_ts", "end_ts")
    for k in keys:
        cut = cut.where(F.col(k).isNotNull())  # a null key equals none
    begun = cut.groupBy(*keys, "_day", F.greatest(F.col("start_ts"), F.col("_day") * DAY).alias("_at")).agg(F.max("end_ts").alias("_end"))
    both = samples.withColumns({"_day": _day(F.col(ts)), "_at": F.col(ts)}).unionByName(begun, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_day").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    marked = both.withColumn("_latest", F.max("_end").over(w)).where(F.col("_end").isNull() & ~F.coalesce(F.col("_latest") > F.col(ts), F.lit(False)))
    return marked.select(*samples.columns)


def covered_seconds(windows: DataFrame, cover: DataFrame, ident: Sequence[str], keys: Sequence[str] = (), lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Per window ``covered``: seconds of [lo, hi) under the intervals (start_ts, end_ts), each counted by itself.

    ``ident`` names the columns that identify a window. Windows under nothing get 0.
    """
    parts = by_day(windows.select(*dict.fromkeys([*keys, *ident, lo, hi])), lo, hi)
    own = by_day(cover.select(*keys, "start_ts", "end_ts"), "start_ts", "end_ts")
    from_, to = F.greatest(F.col(lo), F.col("start_ts"), F.col("_day") * DAY), F.least(F.col(hi), F.col("end_ts"), (F.col("_day") + 1) * DAY)
    sums = parts.join(own, [*keys, "_day"]).groupBy(*dict.fromkeys([*keys, *ident])).agg(F.sum(F.greatest(to - from_, F.lit(0))).alias("covered"))
    out = windows.join(sums, list(dict.fromkeys([*keys, *ident])), "left")
    return out.withColumn("covered", F.coalesce("covered", F.lit(0)).cast("long"))


def overlap_share(windows: DataFrame, found: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per interval of ``windows`` the share that intervals of ``found`` overlap, as ``share``."""
    own = windows.withColumns({"lo": F.col("start_ts"), "hi": F.col("end_ts")})
    out = covered_seconds(own, found, ["lo", "hi"], keys)
    return out.withColumn("share", F.col("covered") / (F.col("hi") - F.col("lo"))).drop("lo", "hi", "covered")


def contained(inner: DataFrame, outer: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner intervals that lie within an outer one with equal keys; outer columns come prefixed ``outer_``."""
    o = outer.withColumnsRenamed({c: f"outer_{c}" for c in outer.columns if c not in keys})
    days = by_day(o, "outer_start_ts", "outer_end_ts")
    i = inner.withColumn("_day", _day(F.col("start_ts")))
    return i.join(days, [*keys, "_day"]).where("start_ts >= outer_start_ts AND end_ts <= outer_end_ts").drop("_day")


def _beside_span(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old intervals with ``_hit``: whether they overlap the span of the new ones with equal keys."""
    span = new.groupBy(*keys).agg(F.min("start_ts").alias("_lo"), F.max("end_ts").alias("_hi"))
    return old.join(span, list(keys), "left").withColumn("_hit", F.coalesce(F.expr("start_ts < _hi AND end_ts > _lo"), F.lit(False))).drop("_lo", "_hi")


def anti_overlap(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("source",)) -> DataFrame:
    """Old intervals that do not overlap the span of the new ones with equal keys."""
    return _beside_span(old, new, keys).where("NOT _hit").drop("_hit")


def overlapping(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("source",)) -> DataFrame:
    """Old intervals that do."""
    return _beside_span(old, new, keys).where("_hit").drop("_hit")


def stretches(anchors: DataFrame, value: str, keys: Sequence[str] = (), tolerance_s: int = 36 * 3600) -> DataFrame:
    """(keys, _day, _lo, _near): by day, from when on which value is that of the nearest anchor (ts, value), and until when.

    An anchor is the nearest from half-way to the one before it until half-way to the next, as far as the
    tolerance goes: a stretch of time. Stretches do not overlap; those that adjoin and say the same are one.
    Times are whole seconds. Of anchors at one instant the one with the least value counts.
    """
    one = anchors.groupBy(*keys, F.col("ts").alias("_at")).agg(F.min(value).alias(value))
    for k in keys:
        one = one.where(F.col(k).isNotNull())  # a null key equals none
    w = Window.partitionBy(*keys, F.lit(0)).orderBy("_at")
    half = lambda other: F.floor((F.col("_at") + other.over(w)) / 2)
    lo = F.greatest(half(F.lag("_at")) + 1, F.col("_at") - tolerance_s)  # greatest and least pass over nulls
    hi = F.least(half(F.lead("_at")), F.col("_at") + tolerance_s) + 1
    cut = by_day(one.select(*keys, F.col(value).alias("_value"), lo.alias("_lo"), hi.alias("_hi")), "_lo", "_hi")
    day = Window.partitionBy(*keys, "_day")
    d = day.orderBy("_lo")
    beside = cut.withColumns({"_same": F.lag("_value").over(d).eqNullSafe(F.col("_value")), "_ended": F.lag("_hi").over(d), "_end": F.max("_hi").over(day)})
    first = beside.where(~F.coalesce(F.col("_same") & (F.col("_ended") >= F.col("_lo")), F.lit(False)))
    until = F.coalesce(F.lead("_ended").over(d), F.col("_end"))
    return first.select(*keys, "_day", "_lo", F.struct(F.col("_value").alias("value"), until.alias("until")).alias("_near"))


def nearest_before_or_after(samples: DataFrame, anchors: DataFrame, value: str, keys: Sequence[str] = (), ts: str = "ts", tolerance_s: int = 36 * 3600) -> DataFrame:
    """Add the value of the nearest anchor (ts, value); of two equally near the earlier. Null beyond the tolerance.

    The stretch that may hold a sample is the latest begun by then. Samples and stretches are sorted
    together by key and day, as a join by day would look at each stretch of a day for each sample of it.
    Anchors that are asked often may come as their :func:`stretches`, which are then not made again.
    """
    near = anchors if "_near" in anchors.columns else stretches(anchors, value, keys, tolerance_s)
    both = samples.withColumns({"_day": _day(F.col(ts)), "_lo": F.col(ts), "_sample": F.lit(1)}).unionByName(near.withColumn("_sample", F.lit(0)), allowMissingColumns=True)
    latest = F.last("_near", ignorenulls=True).over(Window.partitionBy(*keys, "_day").orderBy("_lo", "_sample").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_latest", latest).where("_sample = 1")
    return found.select(*samples.columns, F.when(F.col("_latest.until") > F.col(ts), F.col("_latest.value")).alias(value))


def islands(df: DataFrame, breaks: Column, keys: Sequence[str], order: Sequence[str], name: str = "island") -> DataFrame:
    """Number runs of rows: a row with ``breaks`` true begins a new one."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(*order)
    return df.withColumn(name, F.sum(F.when(breaks, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def runs(df: DataFrame, keys: Sequence[str], gap: int = 0, name: str = "_run") -> DataFrame:
    """Number runs of intervals: one that begins ``gap`` or more after the latest end so far begins a new run."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("start_ts", "end_ts", "device_id")
    latest = F.max("end_ts").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return islands(df.withColumn("_latest", latest), F.col("start_ts") - F.col("_latest") >= gap, keys, ["start_ts", "end_ts", "device_id"], name).drop("_latest")


def drop_overlaps(sessions: DataFrame, keys: Sequence[str] = ("source",)) -> DataFrame:
    """Of overlapping sessions keep the longer: a fold in order of start.

    The session at hand is replaced by a strictly longer one that begins before it ends, which
    drops out shorter ones; a session that begins later is kept and becomes the one at hand. Rows
    that tie in start go by end, then device. The fold runs inside of runs of overlapping sessions;
    nothing reaches from one run into the next.
    """
    cells = F.struct("start_ts", "end_ts", "device_id", F.struct(*[c for c in sessions.columns if c not in keys]).alias("row"))
    grouped = runs(sessions, keys).groupBy(*keys, "_run").agg(F.sort_array(F.collect_list(cells)).alias("_s"))
    kind = grouped.schema["_s"].dataType.simpleString()
    long = lambda s: s["end_ts"] - s["start_ts"]

    def step(kept: Column, s: Column) -> Column:
        last = F.element_at(kept, -1)
        joined = (F.size(kept) > 0) & (s["start_ts"] < last["end_ts"])
        shorter = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
        return (
            F.when(joined & (long(s) > long(last)), F.concat(shorter, F.array(s)))
            .when(joined, kept)
            .otherwise(F.concat(kept, F.array(s)))
        )

    folded = grouped.select(*keys, F.explode(F.aggregate("_s", F.array().cast(kind), step)).alias("_k"))
    return folded.select(*keys, "_k.row.*").select(*sessions.columns)
