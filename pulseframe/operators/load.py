"""Training load: maximal heart rate, zone minutes, workouts, detected sessions, daily load and steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config, Person, Strain
from ..functions.clock import age_on, local_date
from ..functions.scores import edwards, impulse, strain, zone
from .intervals import islands, outside, slice_join
from ..store import stored
from .nights import local_offsets, record_offsets
from .ranges import range_stats
from .series import acute_chronic, tau
from .slices import run_window, slice_window, sliced, stitched

ZONES = [f"z{i}_min" for i in range(1, 6)]


def _by(keys: Sequence[str]):
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def _levels(days: int) -> int:
    return max(1, days).bit_length()


def top_inside(dates: DataFrame, spans: DataFrame, value: str, longest: int, n: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, _d, value): for each day number ``_d`` the ``n`` largest values whose spans [_from, _to] of days hold it.

    Days form a tree of aligned stretches of 1, 2, 4, ... days. A span of up to ``longest`` days is made up
    of at most two stretches per level, each stretch keeps its own top, and a day looks at the one
    stretch of each level that holds it. So joined rows grow with days plus spans, not with their product.
    Spans of equal days and value are counted first, and go on as no more than ``n``.
    """
    levels = _levels(longest)
    # the stretches that make up a span, from the finest level on: an odd first one, and an even last one
    node = lambda k, at: F.struct(F.lit(k).alias("_level"), at.alias("_node"))
    lo, hi = F.col("_from"), F.col("_to") + 1
    parts = []
    for k in range(levels):
        left, right = F.pmod(lo, F.lit(2)) == 1, F.pmod(hi, F.lit(2)) == 1
        parts += [F.when((lo < hi) & left, node(k, lo)), F.when((lo + left.cast("long") < hi) & right, node(k, hi - 1))]
        lo, hi = F.ceil(lo / 2), F.floor(hi / 2)
        parts += [F.when(F.lit(k == levels - 1) & (lo < hi), node(k + 1, lo))]
    alike = spans.where("_to >= _from").groupBy(*keys, "_from", "_to", value).agg(F.count(F.lit(1)).alias("_times"))
    few = alike.select(*keys, "_from", "_to", F.explode(F.array_repeat(value, F.least("_times", F.lit(n)).cast("int"))).alias(value))
    placed = few.select(*keys, value, F.explode(F.array_compact(F.array(*parts))).alias("e")).select(*keys, value, "e.*")
    best = lambda df, by: df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys, *by).orderBy(F.desc(value)))).where(F.col("_place") <= n).drop("_place")
    held = best(placed, ["_level", "_node"])
    above = F.array(*[F.struct(F.lit(k).alias("_level"), F.floor(F.col("_d") / (1 << k)).alias("_node")) for k in range(levels + 1)])
    paths = dates.select(*keys, "_d", F.explode(above).alias("e")).select(*keys, "_d", "e.*")
    return best(paths.join(held, [*keys, "_level", "_node"]).select(*keys, "_d", value), ["_d"])


def hrmax_by_date(days: DataFrame, workouts: DataFrame, keys: Sequence[str] = (), person: Person = Person(), s: Strain = Strain(), peak: str = "max_hr") -> DataFrame:
    """Maximal heart rate per date: configured, else the larger of what age predicts and what was observed.

    Observed is the median of the three highest workout peaks of the look-back, without those too
    far above the prediction. Workouts count by UTC day. Predictions fall with age, so a peak counts from
    its day until the look-back ends or it is too far above, whichever comes first: a span of days.
    """
    if person.hr_max:
        return days.select(*keys, "date", F.lit(float(person.hr_max)).alias("hr_max"), F.lit("config").alias("hr_max_basis"))
    age = lambda day: 220.0 - age_on(day, person.age, str(person.age_as_of))
    predicted = days.select(*keys, "date").distinct().withColumns({"_age": age(F.col("date")), "_d": F.unix_date("date").cast("long")})
    known = workouts.where(F.col(peak).isNotNull()).select(*keys, F.unix_date(local_date(F.col("start_ts"))).cast("long").alias("_from"), F.col(peak).alias("_peak"))
    credible = lambda d: F.col("_peak") <= age(F.date_from_unix_date(d.cast("int"))) + s.hrmax_artifact_margin
    # the last day by the line, and next to it as the comparison itself has it, rounding and all
    about = F.unix_date(F.lit(str(person.age_as_of)).cast("date")) + F.floor((220.0 + s.hrmax_artifact_margin - person.age - F.col("_peak")) * 365.25)
    near = [F.least(F.greatest(about, F.col("_from") - 3), F.col("_from") + s.hrmax_lookback_days + 1).cast("long") + i for i in (1, 0, -1)]
    until = F.coalesce(*[F.when(credible(d), d) for d in near], near[-1] - 1)
    spans = known.select(*keys, "_peak", "_from", F.least(until, F.col("_from") + s.hrmax_lookback_days - 1).alias("_to"))
    top = top_inside(predicted, spans, "_peak", s.hrmax_lookback_days, 3, keys)
    middle = top.groupBy(*keys, "_d").agg(F.count(F.lit(1)).alias("_n"), F.expr("percentile(_peak, 0.5)").alias("_seen"))
    out = predicted.join(middle.where("_n = 3"), [*keys, "_d"], "left")
    better = F.coalesce(F.col("_seen") > F.col("_age"), F.lit(False))
    return out.select(*keys, "date", F.when(better, F.col("_seen")).otherwise(F.col("_age")).alias("hr_max"), F.when(better, "observed").otherwise("age").alias("hr_max_basis"))


def sustained_peaks(workouts: DataFrame, hr: DataFrame, keys: Sequence[str] = (), s: Strain = Strain()) -> DataFrame:
    """Workouts with ``max_hr`` replaced by the highest median of three samples, where samples are dense."""
    own = [*keys, "start_ts", "end_ts", "sport"]
    seen = range_stats(workouts.select(*own), hr.select(*keys, "ts", "bpm"), keys, same=own)
    peaks = seen.where(f"n >= 5 AND cadence <= {s.workout_max_cadence_s}").groupBy(*own).agg(F.max("peak").alias("max_hr"))
    return workouts.drop("max_hr").join(peaks, own, "left")


def zone_minutes(samples: DataFrame, own: Sequence[str], hr_max: str, end: str, cap: str) -> DataFrame:
    """Minutes in zones 1 to 5 per group: a sample holds until the next, the last until the end, none longer than the cap (seconds)."""
    hold = F.coalesce(F.lead("ts").over(Window.partitionBy(*own).orderBy("ts")), F.greatest(F.col(end), F.col("ts"))) - F.col("ts")
    timed = samples.withColumns({"_min": F.least(hold.cast("double"), F.col(cap).cast("double")) / 60, "_zone": zone(F.col("bpm"), F.col(hr_max))})
    return timed.groupBy(*own).agg(*[F.sum(F.when(F.col("_zone") == i, F.col("_min")).otherwise(0.0)).alias(f"z{i}_min") for i in range(1, 6)])


def workout_loads(workouts: DataFrame, hr: DataFrame, hrmax: DataFrame, timeline: DataFrame, cfg: Config = Config(), keys: Sequence[str] = ()) -> DataFrame:
    """Zone load of each workout: from dense samples, else from the device's zones, else unknown."""
    s = cfg.strain
    own = [*keys, "start_ts", "end_ts", "sport"]
    dated = record_offsets(workouts, timeline, cfg.timezone, "start_ts", "_off", keys).withColumn("date", local_date(F.col("start_ts"), F.col("_off"))).drop("_off")
    rated = dated.join(hrmax.select(*keys, "date", "hr_max"), [*keys, "date"], "left")
    inside = range_stats(rated.select(*own, "hr_max"), hr.select(*keys, "ts", "bpm"), keys, "hr_max", own)
    seen = inside.groupBy(*own).agg(F.first("n").alias("_n"), F.first("cadence").alias("_c"), F.max("peak").alias("_peak"), *[F.sum(F.when(F.col("hr_max").isNotNull(), F.col(z))).alias(z) for z in ZONES])
    wide = rated.join(seen, own, "left")
    cadence = F.when(F.col("_n") > 2, F.col("_c"))
    duration = F.col("end_ts") - F.col("start_ts")
    wide = wide.withColumn("cadence_s", cadence).withColumn(
        "coverage", F.when(F.col("cadence_s").isNotNull() & (duration > 0), F.least(F.lit(1.0), F.col("_n") * F.col("cadence_s") / duration)).otherwise(F.lit(0.0))
    )
    dense = (F.col("cadence_s") <= s.workout_max_cadence_s) & (F.col("coverage") >= s.workout_min_coverage) & F.col("hr_max").isNotNull()
    device_zones = [F.col(f"zone{i}_s") for i in range(1, 6)]
    total = sum(device_zones[1:], device_zones[0])  # null if any is
    wide = wide.withColumns(
        {
            "load_ours": F.when(dense, edwards(*[F.col(z) for z in ZONES])),
            "load_device": F.when(total > 0, edwards(*[z / 60 for z in device_zones])),
        }
    )
    peaky = (F.col("cadence_s") <= s.workout_max_cadence_s) & (F.col("_n") >= 5)
    ours, device = F.col("load_ours").isNotNull(), F.col("load_device").isNotNull()
    return wide.select(
        *own, "date", F.coalesce("load_ours", "load_device").alias("load"), F.when(ours, "hr_ours").when(device, "device_zones").otherwise("low_resolution").alias("method"),
        "load_ours", "load_device", "hr_max", "cadence_s", "coverage", "avg_hr", F.when(F.coalesce(peaky, F.lit(False)), F.col("_peak")).otherwise(F.col("max_hr")).alias("peak_hr"),
        *[F.when(ours, F.col(f"z{i}_min")).when(device, F.col(f"zone{i}_s") / 60).alias(f"z{i}_min") for i in range(1, 6)],
    )


def dated_samples(hr: DataFrame, hrmax: DataFrame, timeline: DataFrame, cfg: Config = Config(), keys: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """Samples with what load asks of their neighbours, written once: (ts, bpm, date, hr_max, _gap, _step, _smooth, _slice).

    ``_gap`` is the time since the sample before (60 s at the first), ``_step`` that until the next (60 s at
    the last), ``_smooth`` the median of five shares of the maximal rate, where at least three of them lie
    between the same wide gaps. A key's history is cut into slices of ``rows`` samples.
    """
    place = [c for c in hr.columns if c == "_rn"]
    dated = local_offsets(hr.select(*keys, "ts", "bpm", *place), timeline, cfg.timezone, "ts", "_off", keys).withColumn("date", local_date(F.col("ts"), F.col("_off")))
    rated = dated.join(hrmax.select(*keys, "date", "hr_max"), [*keys, "date"], "left").withColumn("_share", F.col("bpm") / F.col("hr_max")).drop("_off")
    cut = sliced(rated, keys, 3, rows)  # a sample looks two to either side, and one further for the gap there
    w = slice_window(keys)
    timed = cut.withColumns({"_gap": F.coalesce(F.col("ts") - F.lag("ts").over(w), F.lit(60)), "_step": F.coalesce(F.lead("ts").over(w) - F.col("ts"), F.lit(60))})
    part = islands(timed, F.col("_gap") > cfg.strain.workout_max_cadence_s, [*keys, "_slice"], ["ts"], "_part")
    near = F.array(*[F.when(F.lag("_part", k).over(w) == F.col("_part"), F.lag("_share", k).over(w)) for k in (2, 1, -1, -2)], F.col("_share"))
    five = part.withColumn("_five", F.sort_array(F.array_compact(near)))
    n = F.size("_five")
    at = lambda i: F.get("_five", i.cast("int"))
    smooth = F.when(n >= 3, (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2)
    return stored(five.withColumn("_smooth", smooth).where("_own").select(*keys, "ts", "bpm", "date", "hr_max", "_gap", "_step", "_smooth", "_slice"), "smooth")


def detect_sessions(samples: DataFrame, workouts: DataFrame | None, cfg: Config = Config(), keys: Sequence[str] = ()) -> DataFrame:
    """Sessions nobody recorded: dense stretches whose smoothed heart rate stays above the threshold.

    ``samples`` are those of :func:`dated_samples`. Samples within five minutes of a recorded workout do not
    count; pass None to keep them. Runs are found inside slices and stitched where slices meet.
    """
    s = cfg.strain
    within = [*keys, "_slice"]
    smooth = samples
    active = (F.col("_smooth") >= s.detect_threshold) & (F.col("_gap") <= s.workout_max_cadence_s)
    hot = smooth.where(active)
    if workouts is not None:
        around = workouts.select(*keys, (F.col("start_ts") - 300).alias("start_ts"), (F.col("end_ts") + 300).alias("end_ts"))
        hot = outside(hot, around, keys)
    merge = s.detect_merge_gap_min * 60
    local = islands(hot.withColumn("_since", F.col("ts") - F.lag("ts").over(slice_window(keys))), F.col("_since") > merge, within, ["ts"], "_part")
    part = local.groupBy(*within, "_part").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    whole = stitched(part, F.col("first_ts") - F.lag("last_ts").over(run_window(keys)) > merge, keys)
    runs = whole.groupBy(*keys, "_run").agg(F.min("first_ts").alias("start_ts"), F.max("last_ts").alias("last_ts"))
    long = runs.where(F.col("last_ts") - F.col("start_ts") >= s.detect_min_minutes * 60).withColumn("end_ts", F.col("last_ts") + 1)
    own = [*keys, "start_ts"]
    samples = slice_join(long.select(*keys, "start_ts", "last_ts", "end_ts"), smooth.select(*keys, "ts", "bpm", "date", "hr_max"), keys)
    part = Window.partitionBy(*own)
    names = ", ".join(own)
    samples = samples.withColumn("_step", F.col("ts") - F.lag("ts").over(part.orderBy("ts")))
    three = f"OVER (PARTITION BY {names} ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
    samples = samples.withColumns(
        {
            "_cadence": F.expr(f"percentile(_step, 0.5) OVER (PARTITION BY {names})"),
            "_median3": F.expr(f"CASE WHEN count(bpm) {three} = 3 THEN percentile(bpm, 0.5) {three} END"),
            "_date": F.first("date").over(part.orderBy("ts")),
            "_max": F.first("hr_max").over(part.orderBy("ts")),
        }
    ).withColumns({"_end": F.floor(F.col("last_ts") + F.col("_cadence")), "_cap": 2 * F.col("_cadence")})
    minutes = zone_minutes(samples, own, "_max", "_end", "_cap")
    seen = samples.groupBy(*own).agg(
        F.first("_end").alias("end_ts"), F.first("_date").alias("date"), F.first("_max").alias("hr_max"), F.first("_cadence").alias("cadence_s"), F.avg("bpm").alias("avg_hr"), F.max("_median3").alias("peak_hr")
    )
    out = seen.join(minutes, own).withColumn("load", edwards(*[F.col(z) for z in ZONES]))
    return out.select(
        *keys, "start_ts", "end_ts", F.lit("detected").alias("sport"), "date", "load", F.lit("detected").alias("method"), F.col("load").alias("load_ours"),
        F.lit(None).cast("double").alias("load_device"), "hr_max", "cadence_s", F.lit(1.0).alias("coverage"), "avg_hr", "peak_hr", *ZONES,
    )


def banister_daily(samples: DataFrame, rest: DataFrame, cfg: Config = Config(), keys: Sequence[str] = ()) -> DataFrame:
    """Exponential training impulse per local day over all samples of :func:`dated_samples`; null where they are sparse. ``rest``: (date, hr_rest)."""
    s = cfg.strain
    wide = samples.withColumn("_step", F.col("_step").cast("double")).join(rest, [*keys, "date"], "left")
    minutes = F.least(F.col("_step"), F.lit(2.0 * s.banister_max_cadence_s)) / 60
    reserve = F.try_divide(F.col("bpm") - F.col("hr_rest"), F.col("hr_max") - F.col("hr_rest"))
    summed = wide.groupBy(*keys, "date").agg(F.expr("percentile(_step, 0.5)").alias("_c"), F.sum(impulse(minutes, reserve, cfg.person.sex, s.hrr_floor)).alias("_b"))
    return summed.select(*keys, "date", F.when(F.col("_c") <= s.banister_max_cadence_s, F.col("_b")).alias("banister"))


def daily_steps(days: DataFrame, steps: DataFrame, timeline: DataFrame, cfg: Config = Config(), keys: Sequence[str] = ()) -> DataFrame:
    """Steps per date of the device that counted most; needs ``day_wear``. A worn day without rows is 0, an unworn one unknown."""
    dated = local_offsets(steps.select(*keys, "device_id", "ts", "steps"), timeline, cfg.timezone, "ts", "_off", keys).withColumn("date", local_date(F.col("ts"), F.col("_off")))
    most = dated.groupBy(*keys, "date", "device_id").agg(F.sum(F.col("steps").cast("double")).alias("_s")).groupBy(*keys, "date").agg(F.max("_s").alias("_s"))
    out = days.select(*keys, "date", "day_wear").join(most, [*keys, "date"], "left")
    has, worn = F.col("_s").isNotNull(), F.coalesce(F.col("day_wear") >= cfg.strain.day_wear_min, F.lit(False))
    return out.select(
        *keys, "date", F.when(has, F.col("_s")).when(worn, F.lit(0.0)).alias("steps"), F.when(has | worn, "ok").otherwise("insufficient_data").alias("steps_status"),
        F.when(has & ~worn, "band off for part of 08-22: steps may be undercounted").when(~has & ~worn, "band not worn: steps unknown").alias("steps_reason"),
    )


def loads_by_day(days: DataFrame, loads: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Add per date how many workouts there are, by which methods, their load (``_load``), and whether one is unknown (``_unknown``)."""
    per_day = loads.groupBy(*keys, "date").agg(
        F.count(F.lit(1)).alias("n_workouts"), F.bool_or(F.col("load").isNull()).alias("_unknown"), F.sum("load").alias("_load"),
        F.array_join(F.sort_array(F.collect_set("method")), ",").alias("load_method"),
    )
    return days.join(per_day, [*keys, "date"], "left").withColumn("n_workouts", F.coalesce("n_workouts", F.lit(0).cast("long")))


def daily_load(days: DataFrame, loads: DataFrame, banister: DataFrame, cfg: Config = Config(), keys: Sequence[str] = ()) -> DataFrame:
    """Load per date with status and reason, strain, hint and the acute:chronic ratio; ``days`` has ``day_wear`` and the maximal rate.

    A day without workouts is a real 0 only if the band was worn; one unknown workout makes its day unknown.
    """
    wide = loads_by_day(days, loads, keys).join(banister, [*keys, "date"], "left")
    rest, worn, bad = F.col("n_workouts") == 0, F.coalesce(F.col("day_wear") >= cfg.strain.day_wear_min, F.lit(False)), F.coalesce("_unknown", F.lit(False))
    wide = wide.withColumns(
        {
            "load": F.when(bad, None).when(rest & worn, F.lit(0.0)).otherwise(F.col("_load")),
            "load_status": F.when(bad | (rest & ~worn), "insufficient_data").otherwise("ok"),
            "load_reason": F.when(rest & worn & F.col("banister").isNull(), "no workout recorded; HR too sparse to rule out an unrecorded session")
            .when(bad, "a workout has neither dense HR nor band zone data")
            .when(rest & ~worn, "no workout recorded and band worn < 70 % of 08-22"),
            "unrecorded_hint": F.coalesce(rest & (F.col("banister") >= cfg.strain.unrecorded_hint_banister), F.lit(False)),
        }
    ).drop("_unknown", "_load")
    scale = tau(wide, keys, "load", cfg.strain.tau)
    scaled = wide.join(scale, list(keys)) if keys else wide.join(F.broadcast(scale))  # without keys one row
    return acute_chronic(scaled.withColumn("strain", strain(F.col("load"), F.col("tau"))), keys, "load", cfg.strain)


def detector_recall(loads: DataFrame, found: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """How many densely sampled recorded workouts the detector would have found, by half their time."""
    from .intervals import overlap_share

    dense = loads.where("method = 'hr_ours'").select(*keys, "start_ts", "end_ts")
    return overlap_share(dense, found, keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("share") >= 0.5).alias("found"))
