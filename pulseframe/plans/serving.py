"""Read-only queries over the result tables, one frame each."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Readiness
from ..functions.clock import format_duration

# What the series and the period views show, and their limits.
SERIES = (
    "recovery.score", "rhr.z", "phys.rhr", "sleep.tst_min", "sleep.sri_7d", "strain.load", "strain.strain", "acwr.ewma", "activity.steps",
    "rhr.base28", "rhr.spread28", "tst.base28", "tst.spread28",
)
SERIES_DAYS, PERIOD_DAYS, SESSIONS = (7, 3660), (1, 3660), 500
ZONES = [f"z{i}_min" for i in range(1, 6)]


def _checked(days: int, limits: tuple[int, int]) -> None:
    if not limits[0] <= days <= limits[1]:
        raise ValueError(f"days must be between {limits[0]} and {limits[1]}, not {days}")


def until(df: DataFrame, as_of: str | None) -> DataFrame:
    """Rows up to a date, as they would have been shown on it; all without one."""
    if as_of is None:
        return df
    datetime.date.fromisoformat(as_of)
    return df.where(F.col("date").cast("string") <= as_of)


def date_range(long: DataFrame, keys: Sequence[str] = (), as_of: str | None = None) -> DataFrame:
    """First and last date, and the one to show: the last with a recovery score, else the last."""
    scored = F.max(F.when((F.col("metric") == "recovery.score") & (F.col("status") == "ok"), F.col("date")))
    return until(long, as_of).groupBy(*keys).agg(F.min("date").alias("first"), F.max("date").alias("last"), F.coalesce(scored, F.max("date")).alias("shown"))


def day(long: DataFrame, date: str, keys: Sequence[str] = ()) -> DataFrame:
    """All metrics of one date."""
    datetime.date.fromisoformat(date)
    return long.where(F.col("date") == date).select(*keys, "metric", "value", "status", "reason")


def series(long: DataFrame, end: str, days: int, metrics: Sequence[str] = SERIES, keys: Sequence[str] = ()) -> DataFrame:
    """Every metric on every date of the window; missing ones are null."""
    _checked(days, SERIES_DAYS)
    whose = long.select(*keys).distinct() if keys else long.sparkSession.range(1)
    dates = F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda i: F.date_sub(F.lit(end).cast("date"), i).cast("string"))
    grid = whose.select(*keys, F.explode(dates).alias("date")).select(*keys, "date", F.explode(F.array(*[F.lit(m) for m in metrics])).alias("metric"))
    own = long.where(F.col("metric").isin(*metrics) & (F.col("date") <= end) & (F.col("date") > F.date_sub(F.lit(end).cast("date"), days).cast("string")))
    return grid.join(own.select(*keys, "date", "metric", "value", "status"), [*keys, "date", "metric"], "left")


def _between(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.where(F.col("date").between(start, end))


def workout_totals(workouts: DataFrame, start: str, end: str) -> DataFrame:
    """One row of totals over the sessions of a period."""
    known = F.sum(F.when(F.col("avg_hr").isNotNull(), F.col("duration_min")))
    return _between(workouts, start, end).agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("method") != "detected").alias("recorded"), F.count_if(F.col("method") == "detected").alias("detected"),
        F.count_if(F.col("load").isNull()).alias("unknown_load"), (F.coalesce(F.sum("duration_min"), F.lit(0.0)) / 60).alias("hours"),
        (F.sum(F.col("avg_hr") * F.col("duration_min")) / F.nullif(known, F.lit(0.0))).alias("avg_hr"), F.max("peak_hr").alias("peak_hr"),
        *[F.coalesce(F.sum(z), F.lit(0.0)).alias(z) for z in ZONES],
    )


def by_sport(workouts: DataFrame, start: str, end: str) -> DataFrame:
    return (
        _between(workouts, start, end)
        .groupBy("sport")
        .agg(F.count(F.lit(1)).alias("n"), (F.sum("duration_min") / 60).alias("hours"), F.sum("load").alias("load"))
        .orderBy(F.desc("hours"), "sport")
    )


def daily_totals(long: DataFrame, start: str, end: str, metrics: Sequence[str] = ("activity.steps", "strain.load"), keys: Sequence[str] = ()) -> DataFrame:
    """Per metric: known days, total, mean per known day and week, and the best day (the earliest of equals)."""
    ok = _between(long, start, end).where((F.col("status") == "ok") & F.col("metric").isin(*metrics))
    best = F.max_by("date", F.struct(F.col("value"), -F.unix_date(F.col("date").cast("date"))))
    return ok.groupBy(*keys, "metric").agg(
        F.count(F.lit(1)).alias("known_days"), F.sum("value").alias("total"), (F.sum("value") / F.count(F.lit(1))).alias("per_day"),
        (F.sum("value") / F.count(F.lit(1)) * 7).alias("per_week"), F.max("value").alias("max"), best.alias("max_date"),
    )


def period(workouts: DataFrame, end: str, days: int) -> DataFrame:
    """Totals of the window that ends at a date, of the one before, and their differences."""
    _checked(days, PERIOD_DAYS)
    at = F.lit(end).cast("date")
    which = F.when(F.col("date") > F.date_sub(at, days).cast("string"), "current").when(F.col("date") > F.date_sub(at, 2 * days).cast("string"), "previous")
    inside = workouts.where(F.col("date") <= end).withColumn("_w", which).where("_w IS NOT NULL")
    side = lambda c, w: F.sum(F.when(F.col("_w") == w, c))
    out = {}
    for name, value in (("sessions", F.lit(1)), ("minutes", F.col("duration_min")), ("load", F.col("load"))):
        now, before = (F.coalesce(side(value, w), F.lit(0)).cast("double") for w in ("current", "previous"))
        out |= {name: now, f"{name}_before": before, f"{name}_change": now - before}
    return inside.agg(*[v.alias(k) for k, v in out.items()])


def latest_sessions(workouts: DataFrame, start: str, end: str, limit: int = SESSIONS) -> DataFrame:
    """The latest sessions of a period, at most so many: a report of bounded length."""
    return _between(workouts, start, end).orderBy(F.desc("start_ts"), "sport", "end_ts").limit(limit)


def gap_notes(long: DataFrame, metric: str, keys: Sequence[str] = ()) -> DataFrame:
    """How many days lack a metric, by reason."""
    return long.where((F.col("metric") == metric) & (F.col("status") != "ok")).groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("days"))


def wide(long: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One row per date: value, status and reason of each metric. The list of metrics is given, so no pass is needed to find them."""
    cells = {}
    for m in metrics:
        name = m.replace(".", "_")
        for part in ("value", "status", "reason"):
            cells[f"{name}_{part}"] = F.max(F.when(F.col("metric") == m, F.col(part)))
    return long.where(F.col("metric").isin(*metrics)).groupBy(*keys, "date").agg(*[v.alias(k) for k, v in cells.items()])


def last_days(df: DataFrame, n: int, keys: Sequence[str] = (), as_of: str | None = None) -> DataFrame:
    """The latest dates, up to a date if one is given."""
    own = until(df, as_of)
    if not keys:
        return own.orderBy(F.desc("date")).limit(n)
    return own.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("date")))).where(F.col("_n") <= n).drop("_n")


def baseline_band(value: Column, center: Column, spread: Column, flag: Column, status: Column) -> list[Column]:
    """The band around a baseline, and the value where it is flagged and known."""
    return [(center - spread).alias("low"), (center + spread).alias("high"), F.when(flag & (status == "ok"), value).alias("marker")]


def table_view(long: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Per date the metrics' values, blank where not ok, and the distinct reasons for blanks."""
    values = [F.max(F.when((F.col("metric") == m) & (F.col("status") == "ok"), F.col("value"))).alias(m.replace(".", "_")) for m in metrics]
    why = F.array_join(F.sort_array(F.collect_set(F.when(F.col("status") != "ok", F.col("reason")))), "; ").alias("reasons")
    return long.where(F.col("metric").isin(*metrics)).groupBy(*keys, "date").agg(*values, why)


def trailing_week(long: DataFrame, metric: str, keys: Sequence[str] = ()) -> DataFrame:
    """A metric with the mean of its last seven rows, where four or more are known."""
    w = Window.partitionBy(*keys, "metric").orderBy("date").rowsBetween(-6, 0)
    own = long.where(F.col("metric") == metric)
    return own.select(*keys, "date", "value", F.when(F.count("value").over(w) >= 4, F.avg("value").over(w)).alias("mean7"))


def durations(workouts: DataFrame) -> DataFrame:
    return workouts.select("start_ts", "sport", format_duration(F.col("duration_min")).alias("duration"))


def readiness_rules(spark: SparkSession, cfg: Readiness = Readiness()) -> DataFrame:
    """The rules in force: (rule, place of the term, field, comparison, value, what the rule says)."""
    rows = [
        (i, j if rule.get("when") else None, t.get("field"), t.get("op"), None if not t else str(t["value"]), rule["say"])
        for i, rule in enumerate(cfg.rules)
        for j, t in enumerate(rule.get("when") or [{}])
    ]
    return spark.createDataFrame(rows, "rule int, term int, field string, op string, value string, say string")
