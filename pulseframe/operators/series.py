"""Daily series: calendars, baselines, exponential averages, circular statistics."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Baselines, Strain

#: Days that an exponential average is scanned over at once.
BLOCK_DAYS = 64


def _by(keys: Sequence[str]):
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def calendar(df: DataFrame, keys: Sequence[str] = (), date: str = "date") -> DataFrame:
    """Every date from the first to the last, per key."""
    span = df.groupBy(*keys).agg(F.min(date).alias("_a"), F.max(date).alias("_b")).where("_a IS NOT NULL")
    return span.select(*keys, F.explode(F.sequence("_a", "_b", F.expr("INTERVAL 1 DAY"))).alias(date))


def on_calendar(df: DataFrame, keys: Sequence[str] = (), date: str = "date") -> DataFrame:
    """The rows on a calendar without gaps; missing dates have nulls, nothing is imputed."""
    return calendar(df, keys, date).join(df, [*keys, date], "left")


def forward_fill(column: str, keys: Sequence[str] = (), order: str = "date") -> Column:
    return F.last(column, ignorenulls=True).over(_by(keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def trailing_mean(column: str, rows: int, least: int, keys: Sequence[str] = (), order: str = "date") -> Column:
    """Mean of the last rows where enough of them are known."""
    w = _by(keys).orderBy(order).rowsBetween(1 - rows, 0)
    return F.when(F.count(column).over(w) >= least, F.avg(column).over(w))


def trailing_baseline(df: DataFrame, value: str, era: str, keys: Sequence[str], floor: float, bad_direction: int, prefix: str, b: Baselines = Baselines()) -> DataFrame:
    """Add median, spread, z-score, flag and short mean of the days before each date, within its era.

    The date itself is left out, so it cannot hide its own deviation. The spread is the median
    absolute deviation, scaled to a normal's standard deviation and no less than the floor.
    """
    part = ", ".join([*keys, era])
    frame = lambda days: f"OVER (PARTITION BY {part} ORDER BY unix_date(date) RANGE BETWEEN {days} PRECEDING AND 1 PRECEDING)"
    wide = df.withColumns(
        {
            "_n": F.expr(f"count({value}) {frame(b.long_days)}"),
            "_center": F.expr(f"percentile({value}, 0.5) {frame(b.long_days)}"),
            "_all": F.expr(f"collect_list({value}) {frame(b.long_days)}"),
            "_short_n": F.expr(f"count({value}) {frame(b.short_days)}"),
            "_short": F.expr(f"avg({value}) {frame(b.short_days)}"),
        }
    )
    enough = F.col("_n") >= b.long_min_n
    away = F.sort_array(F.transform("_all", lambda x: F.abs(x - F.col("_center"))))
    n = F.size("_all")
    at = lambda i: F.get(away, i.cast("int"))
    deviation = (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2
    out = wide.withColumns(
        {
            f"{prefix}_base_n": F.col("_n"),
            f"{prefix}_base_center": F.when(enough, F.col("_center")),
            f"{prefix}_base_spread": F.when(enough, F.greatest(1.4826 * deviation, F.lit(float(floor)))),
            f"{prefix}_base_status": F.when(enough, "ok").otherwise("warming_up"),
            f"{prefix}_mean7": F.when(F.col("_short_n") >= b.short_min_n, F.col("_short")),
        }
    ).drop("_n", "_center", "_all", "_short_n", "_short")
    z = (F.col(value) - F.col(f"{prefix}_base_center")) / F.col(f"{prefix}_base_spread")
    return out.withColumn(f"{prefix}_z", z).withColumn(f"{prefix}_flag", F.coalesce(F.col(f"{prefix}_z") * bad_direction >= b.flag_sd, F.lit(False)))


def running_averages(df: DataFrame, load: str, rates: Mapping[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """Add exponential averages of the known values so far, from 0; a null leaves them as they were.

    A known value x takes an average a to (1 - r) a + r x. Such steps compose to steps of the same
    form, so the series is cut into blocks of :data:`BLOCK_DAYS` calendar days: each block is scanned
    by itself from 0, the blocks' own steps are composed in order, one per block, and what comes into
    a block is added with the weight that is left of it. Null before the first known value.
    """
    block = df.withColumn("_block", F.floor(F.unix_date("date") / BLOCK_DAYS))
    inside = Window.partitionBy(*keys, "_block").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    known = block.withColumn("_k", F.count(load).over(inside))
    # from 0, values before a row weigh r (1 - r)**(steps since): a running sum of x / (1 - r)**k, scaled back
    sums = {f"_s_{name}": F.coalesce(F.sum(F.lit(r) * F.col(load) * F.pow(F.lit(1 - r), -F.col("_k"))).over(inside), F.lit(0.0)) * F.pow(F.lit(1 - r), F.col("_k")) for name, r in rates.items()}
    local = known.withColumns(sums)
    ends = local.groupBy(*keys, "_block").agg(F.max("_k").alias("k"), *[F.max_by(f"_s_{n}", "date").alias(n) for n in rates])
    cell = F.struct(F.col("_block").alias("block"), "k", *rates)
    zero = F.struct(F.lit(0).cast("long").alias("seen"), *[F.lit(0.0).alias(n) for n in rates])
    carried = F.struct(F.col("_block").alias("block"), F.lit(0).cast("long").alias("seen"), *[F.lit(0.0).alias(n) for n in rates])
    kind = ends.select(F.array(carried).alias("c")).schema["c"].dataType.simpleString()

    def step(done: Column, b: Column) -> Column:
        new = F.struct((done["at"]["seen"] + b["k"]).alias("seen"), *[(F.pow(F.lit(1 - r), b["k"]) * done["at"][n] + b[n]).alias(n) for n, r in rates.items()])
        into = F.struct(b["block"].alias("block"), done["at"]["seen"].alias("seen"), *[done["at"][n].alias(n) for n in rates])
        return F.struct(new.alias("at"), F.concat(done["into"], F.array(into)).alias("into"))

    folded = F.aggregate(F.sort_array(F.collect_list(cell)), F.struct(zero.alias("at"), F.array().cast(kind).alias("into")), step, lambda d: d["into"])
    into = ends.groupBy(*keys).agg(folded.alias("_c")).select(*keys, F.explode("_c").alias("_c"))
    into = into.select(*keys, F.col("_c.block").alias("_block"), F.col("_c.seen").alias("_seen"), *[F.col(f"_c.{n}").alias(f"_in_{n}") for n in rates])
    joined = local.join(into, [*keys, "_block"])
    return joined.withColumns(
        {n: F.when(F.col("_seen") + F.col("_k") > 0, F.col(f"_s_{n}") + F.pow(F.lit(1 - r), F.col("_k")) * F.col(f"_in_{n}")) for n, r in rates.items()}
    ).drop("_block", "_k", "_seen", *[f"_s_{n}" for n in rates], *[f"_in_{n}" for n in rates])


def acute_chronic(df: DataFrame, keys: Sequence[str] = (), load: str = "load", s: Strain = Strain()) -> DataFrame:
    """Add acute and chronic loads, their ratios, how many days are unknown, and a status with its reason.

    Expects one row per date without gaps; a null load is an unknown day.
    """
    w = _by(keys).orderBy("date")
    last = lambda n: w.rowsBetween(1 - n, 0)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    missing = lambda n: F.sum(F.col(load).isNull().cast("int")).over(last(n))
    started = F.min(F.when(F.col(load).isNotNull(), F.col("date"))).over(so_far)
    short, long = s.acwr_acute_days, s.acwr_chronic_days
    wide = running_averages(df, load, {"acute": 2.0 / (short + 1), "chronic": 2.0 / (long + 1)}, keys).withColumns(
        {
            "missing_7": missing(7).cast("long"),
            "missing_28": missing(28).cast("long"),
            "_age": F.datediff("date", started) + 1,
            "_rolling": F.try_divide(F.avg(load).over(last(7)), F.avg(load).over(last(28))),
        }
    )
    young = F.coalesce(F.col("_age") < long, F.lit(True))
    holes = (F.col("missing_7") > s.acwr_max_missing_7) | (F.col("missing_28") > s.acwr_max_missing_28)
    small = F.col("chronic") < s.acwr_min_chronic
    ok = ~young & ~holes & ~small
    return wide.withColumns(
        {
            "acwr": F.when(ok, F.col("acute") / F.col("chronic")),
            "acwr_rolling": F.when(ok, F.col("_rolling")),
            "acwr_status": F.when(young, "warming_up").when(holes | small, "insufficient_data").otherwise("ok"),
            "acwr_reason": F.when(young, "needs 28 days of load history")
            .when(holes, F.format_string("%d unknown days in last 7, %d in last 28", "missing_7", "missing_28"))
            .when(small, "chronic load too small for a stable ratio"),
        }
    ).drop("_age", "_rolling")


def tau(df: DataFrame, keys: Sequence[str] = (), load: str = "load", setting: float | str = "auto") -> DataFrame:
    """Per key the scale ``tau`` of the strain score: the median positive load of the last 365 days scores 12 of 21."""
    if setting != "auto":
        return df.select(*keys).distinct().withColumn("tau", F.lit(float(setting)))
    newest = F.row_number().over(_by(keys).orderBy(F.desc("date")))
    recent = df.withColumn("_n", newest).withColumn("_x", F.when((F.col("_n") <= 365) & (F.col(load) > 0), F.col(load)))
    return recent.groupBy(*keys).agg(F.coalesce(F.expr("percentile(_x, 0.5)") / -math.log(1 - 12 / 21), F.lit(150.0)).alias("tau"))


def circular_sd(minutes: str, window=None) -> Column:
    """Circular standard deviation of clock minutes, over a window or as an aggregate."""
    angle = F.col(minutes) / 1440 * 2 * math.pi
    mean = (lambda c: F.avg(c).over(window)) if window is not None else F.avg
    r = F.hypot(mean(F.cos(angle)), mean(F.sin(angle)))
    return F.sqrt(-2 * F.ln(F.greatest(F.lit(1e-12), F.least(F.lit(1.0), r)))) * 1440 / (2 * math.pi)
