"""Profiles of unknown exports: column statistics, value counts, cadence, and checks against the device."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import epoch_unit, format_duration, local_date, local_iso, zone_offset
from ..functions.privacy import scrub_json
from ..functions.scores import redact, short_hash
from ..operators.ranks import quantiles, spearman
from .json_values import DISTINCT_KEPT

# What names of columns say about them.
ROLES = {
    "id": r"(?i)(^|_)(id|uid|sid|did|uuid|mac|imei|serial|identifier|address)$",
    "geo": r"(?i)(lat|lon|latitude|longitude|altitude)",
    "hrv": r"(?i)(hrv|rr_?interval|rmssd|ibi)",
    "hr": r"(?i)(heart|bpm|hrm|(^|_)hr($|_))",
    "time": r"(?i)(time|date|(^|_)ts($|_)|timestamp)",
    "code": r"(?i)(kind|type|stage|state|code|category)",
}
#: Days of 1,440 minutes in one bitmap of 32,768 bits.
MAP_DAYS = 22


def role(name: str) -> str | None:
    return next((r for r, pattern in ROLES.items() if re.search(pattern, name)), None)


def column_stats(df: DataFrame) -> DataFrame:
    """One row per column: nulls, zeros, distinct values, extremes as text, mean length.

    Distinct values are counted exactly: all columns' values are dealt out in one shuffle, equal ones
    combined before it.
    """
    aggs, cells = [], []
    for c, kind in df.dtypes:
        col = F.col(f"`{c}`")
        number = kind in ("int", "bigint", "double", "float", "smallint", "tinyint") or kind.startswith("decimal")
        zero = F.count_if(col == 0) if number else F.lit(0).cast("long")
        simple = not kind.startswith(("array", "map", "struct"))
        text = F.to_json(col) if not simple else col.cast("string")
        cells.append(F.struct(F.lit(c).alias("column"), text.alias("value")))
        aggs.append(
            F.struct(
                F.lit(c).alias("column"), F.lit(kind).alias("type"), F.count(F.lit(1)).alias("rows"), F.count_if(col.isNull()).alias("nulls"), zero.alias("zeros"),
                (F.min(col).cast("string") if simple else F.lit(None).cast("string")).alias("least"),
                (F.max(col).cast("string") if simple else F.lit(None).cast("string")).alias("most"), F.round(F.avg(F.char_length(text)), 6).alias("mean_length"),
            )
        )
    values = df.select(F.explode(F.array(*cells)).alias("v")).select("v.*").where("value IS NOT NULL").groupBy("column", "value").agg(F.lit(1))
    counts = values.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))
    stats = df.agg(F.array(*aggs).alias("_s")).select(F.explode("_s").alias("s")).select("s.*")
    return stats.join(counts, "column", "left").withColumn("distinct", F.coalesce("distinct", F.lit(0).cast("long")))


def value_counts(df: DataFrame, column: str, n: int = DISTINCT_KEPT) -> DataFrame:
    """The most frequent values; equals by value."""
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(n)


def cadence(df: DataFrame, ts: str, keys: Sequence[str] = ()) -> DataFrame:
    """Steps between consecutive distinct instants: their number and median, and repeated instants."""
    times = df.groupBy(*keys, F.col(ts).alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_t")
    stepped = times.withColumn("_step", F.col("_t") - F.lag("_t").over(w))
    return stepped.groupBy(*keys).agg(F.count("_step").alias("steps"), F.expr("percentile(_step, 0.5)").alias("median_step"), F.sum(F.col("_n") - 1).alias("repeated"))


def covered_minutes(df: DataFrame, ts: str, zone: str = "UTC", keys: Sequence[str] = ()) -> DataFrame:
    """Distinct minutes of the local clock with a sample, per local day.

    A bitmap of 32,768 bits holds 22 days of 1,440 minutes, 180 bytes each. Tasks set bits, bitmaps are
    united in the shuffle, and each day's bytes are counted; no minute is a row. A day of 25 hours has its
    repeated hour once, as the clock shows it; one of 23 hours can reach 1,380.
    """
    local = F.floor((F.col(ts) + zone_offset(F.col(ts), zone) * 60) / 60)
    day = F.floor(local / 1440)
    dated = df.where(F.col(ts).isNotNull()).select(*keys, F.floor(day / MAP_DAYS).alias("_map"), (F.pmod(day, F.lit(MAP_DAYS)) * 1440 + F.pmod(local, F.lit(1440))).alias("_bit"))
    maps = dated.groupBy(*keys, "_map").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    days = maps.select(*keys, "_map", "_bits", F.explode(F.sequence(F.lit(0), F.lit(MAP_DAYS - 1))).alias("_d"))
    counted = days.withColumn("minutes", F.bitmap_count(F.substring(F.col("_bits"), F.col("_d") * 180 + 1, F.lit(180))))
    return counted.where("minutes > 0").select(*keys, F.date_from_unix_date((F.col("_map") * MAP_DAYS + F.col("_d")).cast("int")).alias("date"), "minutes")


def epoch_share(df: DataFrame, columns: Sequence[str], seconds_from: float = 3e8) -> DataFrame:
    """Per column the share of values that look like instants, and their commonest unit."""
    units = {c: epoch_unit(F.col(c), seconds_from) for c in columns}
    cells = [F.struct(F.lit(c).alias("column"), F.avg(u.isNotNull().cast("double")).alias("share"), F.mode(u).alias("unit")) for c, u in units.items()]
    return df.agg(F.array(*cells).alias("_s")).select(F.explode("_s").alias("s")).select("s.*")


def load_reconciliation(workouts: DataFrame) -> DataFrame:
    """Own loads against the device's, by year and method: number, median ratio with quartiles, rank correlation."""
    both = workouts.where("load_ours > 0 AND load_device > 0").withColumns({"year": F.year(F.timestamp_seconds("start_ts")), "ratio": F.col("load_ours") / F.col("load_device")})
    rho = spearman(both, "load_ours", "load_device", ["year", "method"])
    spread = both.groupBy("year", "method").agg(F.expr("percentile(ratio, array(0.25, 0.5, 0.75))").alias("_q"), F.expr("stddev_pop(ratio) / avg(ratio)").alias("cv"))
    return spread.join(rho, ["year", "method"]).select("year", "method", "n", F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("q50"), F.col("_q")[2].alias("q75"), "cv", "rho")


def by_year_and_method(workouts: DataFrame, methods: Sequence[str] = ("hr_ours", "device_zones", "low_resolution", "detected")) -> DataFrame:
    """Sessions per year and method, 0 where there are none."""
    year = F.year(F.timestamp_seconds("start_ts")).alias("year")
    return workouts.groupBy(year).agg(*[F.count_if(F.col("method") == m).alias(m) for m in methods])


def night_reconciliation(nights: DataFrame, device: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Own time asleep against what devices report for the sessions inside a night: mean difference and share within 15 minutes."""
    from ..operators.intervals import contained

    spans = nights.select(*keys, "source", F.col("onset_ts").alias("start_ts"), F.col("wake_ts").alias("end_ts"), "tst_min")
    inside = contained(device.where("dev_duration_min IS NOT NULL"), spans, [*keys, "source"])
    per_night = inside.groupBy(*keys, "source", "outer_start_ts").agg(F.sum("dev_duration_min").alias("_d"), F.first("outer_tst_min").alias("_own"))
    away = F.col("_own") - F.col("_d")
    return per_night.agg(F.count(F.lit(1)).alias("nights"), F.avg(away).alias("mean_difference"), F.avg((F.abs(away) <= 15).cast("double")).alias("within_15"))


def missing_nights(nights: DataFrame, sessions: DataFrame, zone: str, keys: Sequence[str] = ()) -> DataFrame:
    """Dates between the first and last night without one, and how many sleep records end on each."""
    from ..functions.clock import local_date, zone_offset
    from ..operators.series import calendar

    gaps = calendar(nights, keys).join(nights.select(*keys, "date"), [*keys, "date"], "left_anti")
    ends = sessions.select(*keys, local_date(F.col("end_ts"), zone_offset(F.col("end_ts"), zone)).alias("date")).groupBy(*keys, "date").agg(F.count(F.lit(1)).alias("_n"))
    return gaps.join(ends, [*keys, "date"], "left").select(*keys, "date", F.coalesce("_n", F.lit(0)).alias("records"))


# --- exports of unknown layout ---------------------------------------------------------------------

PROBE_ROWS = 5000
KEY_NAMES, VALUE_NAMES = ("key", "type", "name"), ("value", "data", "json", "content")
DEVICE_NAMES = ("sid", "did", "device_id", "deviceid", "device")
HR_RANGE = (30, 230)


def detect_roles(df: DataFrame, rows: int = PROBE_ROWS) -> dict[str, str | None]:
    """Which columns hold time, key, JSON value and device, from a probe of the first rows.

    One aggregate over the probe tells, per column, how many values are JSON and how many look
    like instants.
    """
    lower = {c.lower(): c for c in df.columns}
    text = {c: F.col(f"`{c}`").cast("string") for c in df.columns}
    json = {c: F.count_if(t.rlike(r"^\s*[\[{]") & F.try_parse_json(t).isNotNull()) for c, t in text.items()}
    unit = {c: F.count_if(epoch_unit(F.try_to_number(t, F.lit("9999999999999999999"))).isNotNull()) for c, t in text.items()}
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(df.columns):
        aggs += [json[c].alias(f"j{i}"), unit[c].alias(f"u{i}"), F.count(text[c]).alias(f"k{i}")]
    found = df.limit(rows).agg(*aggs).first()
    n = max(found["n"], 1)
    share = {c: found[f"j{i}"] / n for i, c in enumerate(df.columns)}
    epoch = {c: found[f"u{i}"] / max(found[f"k{i}"], 1) for i, c in enumerate(df.columns)}
    value = next((lower[v] for v in VALUE_NAMES if v in lower and share[lower[v]] > 0.3), None)
    if value is None and share:
        best = max(share, key=share.get)
        value = best if share[best] > 0.5 else None
    times = [c for c in df.columns if role(c) == "time" and epoch[c] > 0.9]
    order = {c: (0 if c.lower() in ("time", "timestamp") else 1 if "update" not in c.lower() else 2, c) for c in times}
    return {
        "time": min(times, key=order.get, default=None),
        "key": next((lower[k] for k in KEY_NAMES if k in lower), None),
        "value": value,
        "device": next((c for c in df.columns if c.lower() in DEVICE_NAMES), None),
    }


def key_profile(df: DataFrame, key: str, ts: str, device: str, value: str | None = None) -> DataFrame:
    """Per key: rows, texts that are no JSON, devices, first and last instant, median step within a device, repeated instants, rows by year."""
    bad = F.count_if(F.col(value).isNotNull() & F.try_parse_json(value).isNull()) if value else F.lit(0).cast("long")
    w = Window.partitionBy(key, device).orderBy(ts)
    step = df.withColumn("_step", F.col(ts) - F.lag(ts).over(w))
    sums = step.groupBy(F.col(key).alias("key")).agg(
        F.count(F.lit(1)).alias("rows"), bad.alias("bad_json"), F.count_distinct(device).alias("devices"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
        F.expr("percentile(CASE WHEN _step > 0 THEN _step END, 0.5)").alias("median_step"), F.count_if(F.col("_step") == 0).alias("repeated"),
    )
    years = df.groupBy(F.col(key).alias("key"), F.year(F.timestamp_seconds(ts)).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    listed = years.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y", "n"))), lambda s: F.concat(s["y"].cast("string"), F.lit(":"), s["n"].cast("string"))), ",").alias("by_year"))
    return sums.join(listed, "key")


def device_timeline(df: DataFrame, key: str, ts: str, device: str, zone: str = "UTC") -> DataFrame:
    """Per device: its first and last local date, its rows, and the keys it wrote, comma-joined."""
    own = df.where(F.col(device).isNotNull())
    per_key = own.groupBy(F.col(device).alias("device"), F.col(key).alias("key")).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"), F.count(F.lit(1)).alias("_n"))
    day = lambda c: local_date(c, zone_offset(c, zone))
    return per_key.groupBy("device").agg(
        day(F.min("_a")).alias("first"), day(F.max("_b")).alias("last"), F.sum("_n").alias("rows"), F.array_join(F.sort_array(F.collect_set("key")), ",").alias("keys")
    )


def code_counts(df: DataFrame, columns: Sequence[str] | None = None, most: int = DISTINCT_KEPT) -> DataFrame:
    """(column, value, n, rank): the most frequent values of columns that hold codes, by name if none are given; equals by value.

    All columns are counted in one shuffle. A report of bounded length; ``rank`` counts from 1.
    """
    columns = [c for c in df.columns if role(c) == "code"] if columns is None else columns
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, value string, n long, rank int")
    counts = df.select(F.explode(cells).alias("e")).groupBy("e.column", "e.value").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), F.asc_nulls_first("value")))
    return counts.withColumn("rank", place).where(F.col("rank") <= most)


def sleep_tail(sessions: DataFrame, zone: str, n: int = 12, keys: Sequence[str] = ()) -> DataFrame:
    """The latest sessions of each key with local times and lengths."""
    latest = Window.partitionBy(*keys, F.lit(0)).orderBy(F.desc("start_ts"), F.desc("end_ts"), "source", "device_id")
    last = sessions.withColumn("rank", F.row_number().over(latest)).where(F.col("rank") <= n)
    minutes = (F.col("end_ts") - F.col("start_ts")) / 60
    return last.select(*keys, "rank", "source", "device_id", local_iso(F.col("start_ts"), zone).alias("start"), local_iso(F.col("end_ts"), zone).alias("end"), format_duration(minutes).alias("length"))


def top_steps(df: DataFrame, ts: str, n: int = 5) -> DataFrame:
    """The commonest steps between consecutive distinct instants; equals by step.

    Instants are cut into ranges at their quantiles; steps are taken within each range, and one more
    across each border from the ranges' ends.
    """
    times = df.select(F.col(ts).alias("_t")).where(F.col(ts).isNotNull()).distinct()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    cuts = times.agg(F.percentile_approx("_t", [i / parts for i in range(1, parts)], 10_000)).first()[0] if parts > 1 else None
    edges = F.array(*[F.lit(c) for c in sorted(set(cuts or []))])
    ranged = times.withColumn("_range", F.size(F.filter(edges, lambda e: e <= F.col("_t"))))
    inside = ranged.select((F.col("_t") - F.lag("_t").over(Window.partitionBy("_range").orderBy("_t"))).alias("step"))
    ends = ranged.groupBy("_range").agg(F.min("_t").alias("_a"), F.max("_t").alias("_b"))  # a row per range
    across = ends.select((F.col("_a") - F.lag("_b").over(Window.partitionBy(F.lit(0)).orderBy("_range"))).alias("step"))
    return value_counts(inside.unionByName(across).where("step IS NOT NULL"), "step", n)


def hr_sanity(df: DataFrame, bpm: str, keys: Sequence[str]) -> DataFrame:
    """Per key: rows, share of rates in the plausible range, extremes and exclusive percentiles of those."""
    ok = F.col(bpm).between(*HR_RANGE)
    sums = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.count_if(ok).alias("valid"), F.min(F.when(ok, F.col(bpm))).alias("least"), F.max(F.when(ok, F.col(bpm))).alias("most"))
    return sums.join(quantiles(df.where(ok), bpm, keys, (0.01, 0.05, 0.5, 0.95, 0.99)), list(keys), "left")


def hrv_verdict(names: Sequence[str]) -> str:
    """Whether any column or key is named like beat-to-beat intervals."""
    found = sorted(n for n in names if role(n) == "hrv")
    return f"candidates for heart-rate variability: {', '.join(found)}" if found else "no beat-to-beat data by name"


def first_and_last(df: DataFrame, order: Sequence[str], n: int = 3) -> DataFrame:
    """Some rows from both ends of an order."""
    front = df.orderBy(*order).limit(n).withColumn("end", F.lit("first"))
    return front.unionByName(df.orderBy(*[F.desc(c) for c in order]).limit(n).withColumn("end", F.lit("last")))


def redacted_samples(df: DataFrame, order: Sequence[str], n: int = 3) -> DataFrame:
    """Some rows from both ends of an order, with nothing that identifies: identifiers as short hashes, places
    masked, JSON scrubbed by key, and addresses, coordinates and long numbers masked in other texts."""
    rows, kinds = first_and_last(df, order, n), dict(df.dtypes)

    def shown(c: str) -> Column:
        col = F.col(f"`{c}`")
        if role(c) == "id":
            return short_hash(col.cast("string"))
        if role(c) == "geo":
            return F.when(col.isNotNull(), F.lit("<redacted>"))
        if kinds[c] == "string":
            return F.when(col.rlike(r"^\s*[\[{]"), scrub_json(col)).otherwise(redact(col))
        return col

    return rows.select("end", *[shown(c).alias(c) for c in df.columns])


# The middles of zones 1 to 5 as shares of the maximal heart rate.
ZONE_MIDDLES = (0.55, 0.65, 0.75, 0.85, 0.95)


def implied_hr_max(workouts: DataFrame) -> DataFrame:
    """The maximal heart rate that device zones imply: mean rate over the zones' mean middle, where zones cover 90 % of the time.

    A spread under 5 % says that the device's zones are shares of one maximal rate.
    """
    zones = [F.col(f"zone{i}_s") for i in range(1, 6)]
    total = sum(zones[1:], zones[0])
    share = sum((z * m for z, m in zip(zones[1:], ZONE_MIDDLES[1:], strict=True)), zones[0] * ZONE_MIDDLES[0]) / total
    ok = workouts.where((total > 0) & (total >= 0.9 * (F.col("end_ts") - F.col("start_ts"))) & F.col("avg_hr").isNotNull()).withColumn("_max", F.col("avg_hr") / share)
    out = ok.agg(F.count(F.lit(1)).alias("n"), F.expr("percentile(_max, 0.5)").alias("hr_max"), F.try_divide(F.stddev_pop("_max"), F.avg("_max")).alias("cv"))
    return out.withColumn("consistent", (F.col("n") >= 5) & (F.col("cv") < 0.05))


def night_table(nights: DataFrame, sessions: DataFrame, device_rhr: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per night: own time asleep and resting rate beside what the device reports for the sessions inside it and for the date."""
    from ..operators.intervals import contained

    spans = nights.select(*keys, "source", "date", F.col("onset_ts").alias("start_ts"), F.col("wake_ts").alias("end_ts"))
    inside = contained(sessions.select(*keys, "source", "start_ts", "end_ts", "dev_duration_min", "dev_min_hr"), spans, [*keys, "source"])
    device = inside.groupBy(*keys, "source", F.col("outer_date").alias("date")).agg(F.sum("dev_duration_min").alias("device_tst"), F.min("dev_min_hr").alias("device_sleep_min_hr"))
    daily = device_rhr.groupBy(*keys, "date").agg(F.avg("value").alias("device_rhr"))
    out = nights.select(*keys, "source", "date", "tst_min", "rhr").join(device, [*keys, "source", "date"], "left").join(daily, [*keys, "date"], "left")
    return out.withColumn("tst_difference", F.col("tst_min") - F.col("device_tst"))


def regularity_report(wide: DataFrame, days: int = 14, keys: Sequence[str] = (), as_of: str | None = None) -> DataFrame:
    """Wear and regularity of the last days, up to a date if one is given, with the reason where there is no index."""
    from .serving import last_days

    return last_days(wide.select(*keys, "date", "day_wear", "reg_n", "sri_pairs", "sri", "sri_reason"), days, keys, as_of)
