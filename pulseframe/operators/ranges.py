"""Numbers of the samples inside each interval, without a row per pair of interval and sample.

Intervals that begin in one hour and the samples that they reach meet in one group, which is sorted
once; every interval is then a range of places. Counts, sums and extremes of a range come from running sums
and from a table of maxima over 1, 2, 4, ... places, medians from a wavelet matrix (running counts by
bit), and times in zones from running sums per threshold and cap. So the work grows with intervals plus
samples, however many intervals lie over a sample.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import ZONE_EDGES

#: Seconds of a stretch: intervals that begin in the same one are handled together.
STRETCH = 3600


def range_max(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The greatest of ``values[lo:hi]`` per query; minus infinity where that is empty."""
    out = np.full(len(lo), -np.inf)
    level, table = 0, values
    size = hi - lo
    exponent = np.frexp(np.maximum(size, 1))[1] - 1
    while len(table):
        here = np.flatnonzero((exponent == level) & (size > 0))
        if len(here):
            out[here] = np.maximum(table[lo[here]], table[hi[here] - (1 << level)])
        step = 1 << level
        table = np.maximum(table[:-step], table[step:]) if len(table) > step else table[:0]
        level += 1
    return out


def range_rank(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, ranks: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Per query the values at each rank (from 0) of ``values[lo:hi]`` in order; values are whole and not negative."""
    state = [[lo.copy(), hi.copy(), r.copy(), np.zeros(len(lo), np.int64)] for r in ranks]
    for bit in reversed(range(int(values.max(initial=0)).bit_length())):
        ones = (values >> bit) & 1
        zeros = np.concatenate([[0], np.cumsum(1 - ones)])
        total = zeros[-1]
        for s in state:
            a, b, r, found = s
            za, zb = zeros[a], zeros[b]
            up = r >= zb - za
            s[0], s[1] = np.where(up, total + a - za, za), np.where(up, total + b - zb, zb)
            s[2], s[3] = np.where(up, r - (zb - za), r), found | np.where(up, 1 << bit, 0)
        values = np.concatenate([values[ones == 0], values[ones == 1]])
    return [s[3] for s in state]


def measured(ts: np.ndarray, bpm: np.ndarray, start: np.ndarray, end: np.ndarray, hr_max: np.ndarray | None) -> dict[str, np.ndarray]:
    """What :func:`range_stats` tells, of samples in order of time; bpm and hr_max are NaN where unknown."""
    lo, hi = np.searchsorted(ts, start), np.searchsorted(ts, end)
    hi = np.maximum(lo, hi)
    n = hi - lo
    known = np.concatenate([[0], np.cumsum(~np.isnan(bpm))])
    total = np.concatenate([[0.0], np.cumsum(np.nan_to_num(bpm))])
    top = range_max(np.where(np.isnan(bpm), -np.inf, bpm), lo, hi)
    step = np.diff(ts, prepend=ts[:1])  # until a sample from the one before
    m = np.maximum(n - 1, 0)
    low, high = range_rank(step, np.minimum(lo + 1, hi), hi, [np.maximum(m - 1, 0) // 2, m // 2])
    cadence = np.where(m > 0, (low + high) / 2, np.nan)
    three = np.full(len(ts), -np.inf)
    if len(ts) > 2:
        middle = np.sort(np.stack([bpm[:-2], bpm[1:-1], bpm[2:]]), axis=0)[1]
        three[2:] = np.where(np.isnan(bpm[:-2] + bpm[1:-1] + bpm[2:]), -np.inf, middle)
    peak = range_max(three, np.minimum(lo + 2, hi), hi)
    out = {"n": n, "known": known[hi] - known[lo], "total": total[hi] - total[lo], "top": top, "cadence": cadence, "peak": peak}
    if hr_max is None:
        return out
    minutes = np.zeros((5, len(lo)))
    hold = np.diff(ts, append=ts[-1:])
    # seconds count double, so that caps, which are medians of whole steps times two, and sums are whole numbers
    groups = np.flatnonzero((n > 0) & ~np.isnan(hr_max))
    order = groups[np.lexsort((cadence[groups], hr_max[groups]))]
    cuts = np.flatnonzero((np.diff(hr_max[order]) != 0) | ~((np.diff(cadence[order]) == 0) | (np.isnan(cadence[order][1:]) & np.isnan(cadence[order][:-1])))) + 1
    for q in np.split(order, cuts) if len(groups) else []:
        a, b = lo[q].min(), hi[q].max()
        share = bpm[a:b] / hr_max[q[0]]
        zone = np.where(np.isnan(share), -1, np.searchsorted(ZONE_EDGES, share, side="right"))
        c = cadence[q[0]]
        cap = np.iinfo(np.int64).max if np.isnan(c) else int(4 * c)
        held = np.minimum(2 * hold[a:b], cap)
        last = np.minimum(2 * np.maximum(end[q] - ts[hi[q] - 1], 0), cap)  # the last sample holds until the end
        for z in range(5):
            sums = np.concatenate([[0], np.cumsum(np.where(zone == z + 1, held, 0))])
            minutes[z, q] = (sums[hi[q] - 1 - a] - sums[lo[q] - a] + np.where(zone[hi[q] - 1 - a] == z + 1, last, 0)) / 120
    return out | {f"z{z + 1}_min": minutes[z] for z in range(5)}


COLUMNS = "n long, known long, total double, top double, cadence double, peak double"
ZONES = "".join(f", z{i}_min double" for i in range(1, 6))


def range_stats(intervals: DataFrame, samples: DataFrame, keys: Sequence[str] = (), hr_max: str | None = None, same: Sequence[str] = ()) -> DataFrame:
    """Intervals (start_ts, end_ts) that hold samples (ts, bpm), with what these say; others are left out.

    ``n`` samples, ``known`` of them with a rate, their ``total`` and ``top``, the median step as ``cadence``, the
    highest median of three consecutive known rates as ``peak``, and with ``hr_max``, a column of the
    intervals, minutes in zones 1 to 5: a sample holds until the next, the last until the end, none longer
    than two cadences. Each interval is judged for itself, but with ``same`` those equal in these columns are one
    group of pairs, in which each sample stands once per interval.
    """
    own = intervals.columns
    rated = hr_max is not None
    hour = lambda c: F.floor(F.col(c) / STRETCH)
    times = F.count(F.lit(1)).over(Window.partitionBy(*same)) if same else F.lit(1).cast("long")
    asked = intervals.where("end_ts > start_ts").withColumns({"_times": times, "_from": hour("start_ts")})
    reach = asked.groupBy(*keys, "_from").agg(F.max(F.floor((F.col("end_ts") - 1) / STRETCH)).alias("_to"))
    wanted = reach.select(*keys, "_from", F.explode(F.sequence("_from", "_to")).alias("_hour"))
    near = samples.select(*keys, "ts", F.col("bpm").cast("double").alias("bpm"), hour("ts").alias("_hour")).join(wanted, [*keys, "_hour"])
    near = near.select(*[F.col(k).alias(k) for k in keys], F.col("_from").alias("_begun"), "ts", "bpm")  # columns of its own, also in self-joins

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kept = left.select(own)
        number = lambda t, c: t.column(c).to_numpy()
        ts, bpm = number(right, "ts"), number(right, "bpm").astype(float)
        order = np.lexsort((bpm, ts))
        ts, bpm = ts[order].astype(np.int64), bpm[order]
        start, end, times = (number(left, c).astype(np.int64) for c in ("start_ts", "end_ts", "_times"))
        most = number(left, hr_max).astype(float) if rated else None
        got = measured(ts, bpm, start, end, most) if len(ts) else {"n": np.zeros(len(start), np.int64)}
        for i in np.flatnonzero((times > 1) & (got["n"] > 0)):
            inside = (ts >= start[i]) & (ts < end[i])
            one = measured(np.repeat(ts[inside], times[i]), np.repeat(bpm[inside], times[i]), start[i : i + 1], end[i : i + 1], most[i : i + 1] if rated else None)
            for c in got:
                got[c][i] = one[c][0]
        here = got["n"] > 0
        arrays = [kept.column(c).filter(pa.array(here)) for c in own]
        for c in names:
            v = got[c][here] if c in got else np.zeros(0)
            arrays.append(pa.array(v, pa.int64()) if c in ("n", "known") else pa.array(v, pa.float64(), mask=~np.isfinite(v)))
        return pa.table(arrays, names=[*own, *names])

    names = [c.split()[0] for c in (COLUMNS + (ZONES if rated else "")).split(", ")]
    ddl = ", ".join(f"`{c}` {intervals.schema[c].dataType.simpleString()}" for c in own) + ", " + COLUMNS + (ZONES if rated else "")
    return asked.groupBy(*keys, "_from").cogroup(near.groupBy(*keys, "_begun")).applyInArrow(run, ddl)
