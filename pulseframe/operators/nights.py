"""Sleep: offsets, sources, episodes, nights, resting heart rate, day maps and regularity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..config import Config, Physiology, Sleep
from ..functions.clock import clock_minute, local_date, near_eu_switch, zone_offset
from .intervals import covered_seconds, drop_overlaps, nearest_before_or_after, one_each, runs, stretches
from .series import circular_sd

HOURS = 24


def _by(keys: Sequence[str]):
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def offset_timeline(sessions: DataFrame, workouts: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Anchors (ts, offset_min) where a record tells its UTC offset.

    Of several at one instant: sessions before workouts, starts before ends, then the smaller offset.
    """
    parts, rank = None, 0
    for df in [sessions, *([workouts] if workouts is not None else [])]:
        ends = F.explode(F.array(*[F.struct(F.col(end).alias("ts"), F.lit(rank + i).alias("_rank")) for i, end in enumerate(("start_ts", "end_ts"))]))
        own = df.where("tz_offset_min IS NOT NULL").select(*keys, F.col("tz_offset_min").alias("offset_min"), ends.alias("_e")).select(*keys, "_e.*", "offset_min")
        parts = own if parts is None else parts.unionByName(own)
        rank += 2
    if parts.schema["offset_min"].dataType != IntegerType():
        first = F.min(F.struct("_rank", "offset_min"))["offset_min"]
    else:  # rank and offset as one number, as the least number is found without a sort
        least = F.min(F.col("_rank") * F.lit(1 << 32) + F.col("offset_min"))
        first = (least - F.shiftleft(F.shiftright(least + F.lit(1 << 31), 32), 32)).cast("int")
    return parts.groupBy(*keys, "ts").agg(first.alias("offset_min"))


def offset_stretches(timeline: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The timeline as :func:`local_offsets` asks it: which offset is in force from when until when."""
    return stretches(timeline, "offset_min", keys)


def local_offsets(df: DataFrame, timeline: DataFrame, zone: str, ts: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Add the offset in force at ``ts``: of the nearest anchor within 36 hours, else of the home zone."""
    found = nearest_before_or_after(df, timeline.withColumnRenamed("offset_min", "_offset"), "_offset", keys, ts)
    return found.withColumn(name, F.coalesce("_offset", zone_offset(F.col(ts), zone)).cast("int")).drop("_offset")


def record_offsets(df: DataFrame, timeline: DataFrame, zone: str, column: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Add the offset at one end of each record.

    The record's own offset holds; where it is the home zone's at the record's start or end, the
    home zone's at this end does; where there is none, that of the timeline.
    """
    near = local_offsets(df, timeline, zone, column, "_near", keys)
    own = F.col("tz_offset_min")
    at_home = (own == zone_offset(F.col("start_ts"), zone)) | (own == zone_offset(F.col("end_ts"), zone))
    value = F.when(own.isNull(), F.col("_near")).when(at_home, zone_offset(F.col(column), zone)).otherwise(own)
    return near.withColumn(name, value.cast("int")).drop("_near")


def resolve_sources(sessions: DataFrame, priority: Sequence[str], wake_date: str = "wake_date", keys: Sequence[str] = ()) -> DataFrame:
    """Per wake date only the sessions of the source that comes first in ``priority``; sources not in it come last."""
    rank = F.lit(len(priority))
    for i, source in reversed(list(enumerate(priority))):
        rank = F.when(F.col("source") == source, i).otherwise(rank)
    best = F.min("_rank").over(_by([*keys, wake_date]))
    return sessions.withColumn("_rank", rank).withColumn("_best", best).where("_rank = _best").drop("_rank", "_best")


def build_episodes(sessions: DataFrame, timeline: DataFrame, cfg: Config = Config(), keys: Sequence[str] = ()) -> DataFrame:
    """Episodes of sleep with their member sessions, wake date and role.

    Sessions of one source that follow within the merge gap, naps among naps, are one episode. The
    fold runs in order of start: whether a session joins depends on the latest end so far. It runs
    inside of runs of sessions that lie within the gap; nothing reaches from one run into the next.
    """
    dated = record_offsets(sessions, timeline, cfg.timezone, "end_ts", "_off", keys).withColumn("wake_date", local_date(F.col("end_ts"), F.col("_off")))
    chosen = resolve_sources(dated, cfg.sources.priority, "wake_date", keys).drop("wake_date").withColumnRenamed("_off", "off_end")
    alone = drop_overlaps(chosen, [*keys, "source"])
    placed = record_offsets(alone, timeline, cfg.timezone, "start_ts", "off_start", keys)
    nap = F.coalesce(F.col("is_nap") == 1, F.lit(False))
    cell = F.struct("start_ts", "end_ts", "source", "device_id", nap.alias("nap"), "off_start", "off_end")
    gap = cfg.sufficiency.episode_merge_gap_min * 60
    grouped = runs(placed, keys, gap).groupBy(*keys, "_run").agg(F.sort_array(F.collect_list(cell)).alias("_s"))

    def opened(s: Column) -> Column:
        member = F.struct(s["source"].alias("source"), s["device_id"].alias("device_id"), s["start_ts"].alias("start_ts"))
        return F.struct(
            s["source"].alias("source"), s["device_id"].alias("device_id"), s["start_ts"].alias("start_ts"), s["end_ts"].alias("end_ts"),
            s["off_start"].alias("offset_start"), s["off_end"].alias("offset_end"), s["nap"].alias("is_nap"),
            (s["end_ts"] - s["start_ts"]).alias("longest"), F.array(member).alias("members"),
        )

    def joined(e: Column, s: Column) -> Column:
        later, longer = s["end_ts"] > e["end_ts"], s["end_ts"] - s["start_ts"] > e["longest"]
        return F.struct(
            e["source"].alias("source"), F.when(longer, s["device_id"]).otherwise(e["device_id"]).alias("device_id"), e["start_ts"].alias("start_ts"),
            F.when(later, s["end_ts"]).otherwise(e["end_ts"]).alias("end_ts"), e["offset_start"].alias("offset_start"),
            F.when(later, s["off_end"]).otherwise(e["offset_end"]).alias("offset_end"), e["is_nap"].alias("is_nap"),
            F.greatest(e["longest"], s["end_ts"] - s["start_ts"]).alias("longest"), F.concat(e["members"], opened(s)["members"]).alias("members"),
        )

    kind = grouped.select(F.transform("_s", opened).alias("e")).schema["e"].dataType.simpleString()

    def step(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        same = (F.size(done) > 0) & (last["source"] == s["source"]) & (last["is_nap"] == s["nap"]) & (s["start_ts"] - last["end_ts"] < gap)
        rest = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(same, F.concat(rest, F.array(joined(last, s)))).otherwise(F.concat(done, F.array(opened(s))))

    folded = grouped.select(*keys, "_run", F.posexplode(F.aggregate("_s", F.array().cast(kind), step)).alias("_place", "_e"))
    number = F.row_number().over(_by(keys).orderBy("_run", "_place")) - 1
    out = folded.select(*keys, number.cast("long").alias("episode"), "_e.*").drop("longest")
    out = out.withColumns({"wake_date": local_date(F.col("end_ts"), F.col("offset_end")), "duration_h": (F.col("end_ts") - F.col("start_ts")) / 3600})
    eligible = ~F.col("is_nap") & (F.col("duration_h") >= cfg.sufficiency.main_sleep_min_hours)
    order = _by([*keys, "wake_date"]).orderBy(F.desc(eligible), F.desc("duration_h"), "start_ts", "episode")
    return out.withColumn("role", F.when(eligible & (F.row_number().over(order) == 1), "main").otherwise("nap"))


def episode_segments(episodes: DataFrame, segments: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The segments of every episode's member sessions."""
    members = episodes.select(*keys, "episode", F.col("start_ts").alias("_from"), F.col("end_ts").alias("_to"), F.explode("members").alias("m"))
    link = members.select(*keys, "episode", "_from", "_to", F.col("m.source").alias("source"), F.col("m.device_id").alias("device_id"), F.col("m.start_ts").alias("session_start_ts"))
    return segments.join(link, [*keys, "source", "device_id", "session_start_ts"])


def nightly_sleep(episodes: DataFrame, ep_segments: DataFrame, sessions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per wake date with a main episode: times asleep, awake and in stages, naps, and changes of time zone."""
    main = episodes.where("role = 'main'")
    inside = lambda c: F.least(F.greatest(F.col(c), F.col("_from")), F.col("_to"))
    minutes = (inside("end_ts") - inside("start_ts")) / 60
    by_stage = {s: F.sum(F.when(F.col("stage") == s, minutes).otherwise(0.0)).alias(f"_{s}") for s in ("light", "deep", "rem", "asleep")}
    staged = ep_segments.groupBy(*keys, "episode").agg(*by_stage.values())
    member = main.select(*keys, "episode", F.explode("members").alias("m")).select(*keys, "episode", "m.*")
    awake = F.coalesce(F.col("dev_awake_min"), F.lit(0.0))
    # an id holds one session, so a repeated row counts once
    one = one_each(sessions.select(*keys, "source", "device_id", "start_ts", "end_ts", "dev_awake_min"), [*keys, "source", "device_id", "start_ts"])
    envelope = (
        member.join(one, [*keys, "source", "device_id", "start_ts"])
        .groupBy(*keys, "episode")
        .agg(F.sum((F.col("end_ts") - F.col("start_ts")) / 60 - awake).alias("_envelope"))
    )
    naps = episodes.where("role = 'nap'").groupBy(*keys, "wake_date").agg(F.sum((F.col("end_ts") - F.col("start_ts")) / 60).alias("_nap"))
    wide = main.join(staged, [*keys, "episode"], "left").join(envelope, [*keys, "episode"], "left").join(naps, [*keys, "wake_date"], "left")
    spt = (F.col("end_ts") - F.col("start_ts")) / 60
    wide = wide.withColumns(
        {
            "spt_min": spt,
            "tst_min": F.coalesce(F.col("_light") + F.col("_deep") + F.col("_rem") + F.col("_asleep"), F.col("_envelope")),
            "tst_basis": F.when(F.col("_light").isNotNull(), "segments").otherwise("envelope"),
            "stages_available": F.coalesce(F.col("_rem") > 0, F.lit(False)),
            "onset_clock": clock_minute(F.col("start_ts"), F.col("offset_start")),
            "wake_clock": clock_minute(F.col("end_ts"), F.col("offset_end")),
            "_before": F.lag("offset_end").over(_by(keys).orderBy("episode")),
        }
    )
    moved = F.abs(F.col("offset_end") - F.col("_before"))
    switch = (moved == 60) & near_eu_switch(F.col("wake_date"))
    stage = lambda s: F.when(F.col("stages_available"), F.col(f"_{s}")).alias(f"{s}_min")
    return wide.select(
        *keys, F.col("wake_date").alias("date"), "episode", "source", "device_id", F.col("start_ts").alias("onset_ts"), F.col("end_ts").alias("wake_ts"),
        "offset_start", "offset_end", "onset_clock", "wake_clock", "spt_min", "tst_min",
        F.greatest(F.col("spt_min") - F.col("tst_min"), F.lit(0.0)).alias("waso_min"),
        F.when(F.col("spt_min") > 0, F.col("tst_min") / F.col("spt_min")).alias("sme"), "tst_basis",
        stage("deep"), stage("light"), stage("rem"), "stages_available", F.coalesce("_nap", F.lit(0.0)).alias("nap_min"),
        F.coalesce((moved > 0) & ~switch, F.lit(False)).alias("tz_change"),
    )


def nightly_rhr(nights: DataFrame, hr: DataFrame, worn: DataFrame, keys: Sequence[str] = (), coverage_min: float = 0.8, p: Physiology = Physiology()) -> DataFrame:
    """Resting heart rate: the lowest mean over a time window inside the main sleep, and how well samples cover the night."""
    spans = nights.select(*keys, "date", "onset_ts", "wake_ts")
    covered = covered_seconds(spans.withColumns({"lo": F.col("onset_ts"), "hi": F.col("wake_ts")}), worn, ["date"], keys)
    share = F.when(F.col("hi") > F.col("lo"), F.col("covered") / (F.col("hi") - F.col("lo"))).otherwise(F.lit(0.0))
    night = covered.select(*keys, "date", share.alias("hr_coverage"), (F.col("onset_ts") + p.rhr_skip_onset_min * 60).alias("start_ts"), F.col("wake_ts").alias("end_ts"))
    from .intervals import slice_join

    inside = slice_join(night.select(*keys, "date", "start_ts", "end_ts"), hr.select(*keys, "ts", "bpm"), keys)
    per_night = [*keys, "date"]
    part = Window.partitionBy(*per_night)
    step = F.col("ts") - F.lag("ts").over(part.orderBy("ts"))
    known = inside.withColumn("_step", step).withColumns({"_cadence": F.expr(f"percentile(_step, 0.5) OVER (PARTITION BY {', '.join(per_night)})"), "_n": F.count(F.lit(1)).over(part)})
    width = F.floor(F.greatest(F.lit(p.rhr_window_min * 60.0), 3 * F.col("_cadence")))
    exact = F.greatest(F.lit(p.rhr_window_min * 60.0), 3 * F.col("_cadence"))
    timed = known.withColumns(
        {
            "_window": exact,
            "_least": F.greatest(F.lit(2), F.ceil(p.rhr_window_min_fill * exact / F.col("_cadence"))),
            # in units of the night's own window, so that one frame fits all nights
            "_x": (F.col("ts") - F.col("start_ts")) / width,
        }
    )
    frame = f"OVER (PARTITION BY {', '.join(per_night)} ORDER BY _x RANGE BETWEEN 0.9999999D PRECEDING AND CURRENT ROW)"
    rolled = timed.withColumns({"_mean": F.expr(f"avg(bpm) {frame}"), "_held": F.expr(f"count(bpm) {frame}")})
    counts = (F.col("_held") >= F.col("_least")) & (F.col("ts") >= F.col("start_ts") + F.col("_window") - F.col("_cadence"))
    sums = rolled.groupBy(*per_night).agg(
        F.min(F.when(counts, F.col("_mean"))).alias("_rhr"), F.avg("bpm").alias("_mean_hr"), F.first("_cadence").alias("_c"), F.first("_window").alias("_w"), F.count(F.lit(1)).alias("_n")
    )
    out = night.select(*per_night, "hr_coverage").join(sums, per_night, "left")
    usable = (F.col("hr_coverage") >= coverage_min) & F.coalesce(F.col("_n") >= 3, F.lit(False))
    ok = usable & F.col("_rhr").isNotNull()
    thin = F.when(F.col("hr_coverage") > 0, F.concat(F.lit("HR covers "), F.bround(F.col("hr_coverage") * 100).cast("int").cast("string"), F.lit("% of the sleep period")))
    return out.select(
        *per_night, "hr_coverage",
        F.when(usable, F.col("_rhr")).alias("rhr"), F.when(usable, F.col("_mean_hr")).alias("sleep_hr_mean"),
        F.when(usable, F.col("_w") / 60).alias("rhr_window_min"), F.when(usable, F.col("_c")).alias("hr_cadence_s"),
        F.when(ok, "ok").otherwise("insufficient_data").alias("phys_status"),
        F.when(ok, None).when(usable, "no window with enough samples")
        .otherwise(F.coalesce(thin, F.lit("no HR samples during this night (band off, or not in this export yet)"))).alias("phys_reason"),
    )


def sleep_wake_maps(episodes: DataFrame, ep_segments: DataFrame, worn: DataFrame, timeline: DataFrame, zone: str, keys: Sequence[str] = ()) -> DataFrame:
    """Local days as maps of 1,440 bits: (day, known, asleep), each map 24 words of 60 minutes.

    Worn time is awake, an episode over it asleep, an awake segment over that awake. Ends are
    converted with the offsets in force at each, starts to the minute they are in, ends up. Intervals
    are cut at midnight and painted hour by hour; words of one day unite by OR before and after the
    shuffle, so no minute is ever a row.
    """

    worn, slept, awake = (
        df.select(*keys, "start_ts", "end_ts", F.lit(level).alias("_level")) for level, df in enumerate((worn, episodes, ep_segments.where("stage = 'awake'")))
    )
    ends = local_offsets(worn.unionByName(slept).unionByName(awake), timeline, zone, "start_ts", "_o1", keys)
    ends = local_offsets(ends, timeline, zone, "end_ts", "_o2", keys)
    first = F.floor((F.col("start_ts") + F.col("_o1") * 60) / 60)
    last = F.ceil((F.col("end_ts") + F.col("_o2") * 60) / 60) - 1
    every = ends.select(*keys, first.alias("_a"), last.alias("_b"), "_level").where("_b >= _a")
    days = every.withColumn("_d", F.explode(F.sequence(F.floor(F.col("_a") / 1440), F.floor(F.col("_b") / 1440))))
    inside = days.select(*keys, "_d", "_level", F.greatest(F.col("_a") - F.col("_d") * 1440, F.lit(0)).alias("_a"), F.least(F.col("_b") - F.col("_d") * 1440, F.lit(1439)).alias("_b"))
    hours = range(HOURS)
    lo, hi = "greatest(CAST(_a - {h} AS INT), 0)", "least(CAST(_b - {h} AS INT), 59)"
    word = f"CASE WHEN {lo} <= {hi} THEN shiftleft(shiftleft(1L, {hi} - {lo} + 1) - 1, {lo}) ELSE 0L END AS _w"
    painted = inside.selectExpr(*keys, "_d", "_level", *[word.format(h=60 * h) + str(h) for h in hours])
    united = painted.groupBy(*keys, "_d").agg(*[F.expr(f"coalesce(bit_or(CASE WHEN _level = {level} THEN _w{h} END), 0L) AS _{level}_{h}") for level in range(3) for h in hours])
    known, asleep = ", ".join(f"_0_{h} | _1_{h} | _2_{h}" for h in hours), ", ".join(f"_1_{h} & ~_2_{h}" for h in hours)
    return united.selectExpr(*keys, "date_from_unix_date(CAST(_d AS INT)) AS day", f"array({known}) AS known", f"array({asleep}) AS asleep")


def set_minutes(words: Column) -> Column:
    """How many minutes of a day's map are set."""
    return F.aggregate(F.transform(words, F.bit_count), F.lit(0).cast("long"), lambda n, x: n + x)


def map_minutes(words: Column) -> Column:
    """The minutes of the day that are set in a map, in order."""
    return F.filter(F.sequence(F.lit(0), F.lit(1439)), lambda m: F.getbit(F.get(words, F.floor(m / 60).cast("int")), m % 60) == 1)


def day_pairs(maps: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per day: minutes known on it and on the day before, and those in the same state; from day maps."""
    before = maps.select(*keys, F.date_add("day", 1).alias("day"), F.col("known").alias("_known"), F.col("asleep").alias("_asleep"))
    both = F.zip_with("known", "_known", lambda x, y: x.bitwiseAND(y))
    same = F.zip_with("_both", F.zip_with("asleep", "_asleep", lambda x, y: F.bitwise_not(x.bitwiseXOR(y))), lambda x, y: x.bitwiseAND(y))
    joined = maps.join(before, [*keys, "day"]).withColumn("_both", both)
    return joined.select(*keys, "day", set_minutes(F.col("_both")).alias("known"), set_minutes(same).alias("agree")).where("known > 0")


def regularity(nights: DataFrame, pairs: DataFrame, keys: Sequence[str] = (), s: Sleep = Sleep()) -> DataFrame:
    """Sleep regularity index and circular deviations of onset and wake over the trailing week, per night."""
    by_night = _by(keys).orderBy("date").rowsBetween(1 - s.tz_change_exclude_nights, 0)
    marked = nights.select(*keys, "date", "onset_clock", "wake_clock", F.max("tz_change").over(by_night).alias("_out"))
    week = _by(keys).orderBy(F.unix_date("date")).rangeBetween(1 - s.regularity_window_days, 0)
    used = marked.withColumns({"_onset": F.when(~F.col("_out"), F.col("onset_clock")), "_wake": F.when(~F.col("_out"), F.col("wake_clock"))})
    clocks = used.select(
        *keys, "date", "_out", F.count("_onset").over(week).alias("reg_n"), circular_sd("_onset", week).alias("_onset_csd"), circular_sd("_wake", week).alias("_wake_csd")
    )
    excluded = marked.where("_out").select(*keys, F.col("date").alias("day"))
    touched = excluded.unionByName(excluded.withColumn("day", F.date_add("day", 1)))
    good = pairs.where(F.col("known") >= s.sri_min_pair_coverage * 1440).join(touched, [*keys, "day"], "left_anti")
    # each day pair counts for the nights of the week that ends with them
    shifted = good.withColumn("date", F.explode(F.sequence(F.col("day"), F.date_add("day", s.regularity_window_days - 1), F.expr("INTERVAL 1 DAY"))))
    pooled = shifted.groupBy(*keys, "date").agg(F.count(F.lit(1)).alias("_pairs"), F.sum("known").alias("_known"), F.sum("agree").alias("_agree"))
    out = clocks.join(pooled, [*keys, "date"], "left")
    enough = F.col("reg_n") >= s.regularity_min_nights
    n_pairs = F.when(enough, F.coalesce("_pairs", F.lit(0))).otherwise(F.lit(0))
    share = f"{s.sri_min_pair_coverage:.0%}"
    few_nights = F.format_string(f"only %d usable nights in the {s.regularity_window_days}-day window (need {s.regularity_min_nights})", "reg_n")
    few_pairs = F.concat(F.lit("only "), n_pairs.cast("string"), F.lit(f" day pairs with >= {share} of minutes known on both days (need {s.regularity_min_nights}): band off for long stretches"))
    rated = enough & (n_pairs >= s.regularity_min_nights)
    return out.select(
        *keys, "date", "reg_n", F.when(rated, 200.0 * F.col("_agree") / F.col("_known") - 100.0).alias("sri"),
        F.when(enough, F.col("_onset_csd")).alias("onset_csd"), F.when(enough, F.col("_wake_csd")).alias("wake_csd"),
        F.when(enough, "ok").otherwise("insufficient_data").alias("reg_status"), n_pairs.cast("long").alias("sri_pairs"),
        F.when(~enough, few_nights).when(~rated, few_pairs).alias("sri_reason"),
    )
