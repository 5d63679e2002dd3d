"""The canonical tables: columns, natural keys, how new data replace old, and validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Table:
    ddl: str
    key: tuple[str, ...]
    strategy: str  # point: upsert by key; interval: replace by window

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.ddl)

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()


_ID = "source string, device_id string, "
TABLES: Mapping[str, Table] = {
    "hr_samples": Table(_ID + "ts long, bpm int, context string", ("source", "device_id", "ts"), "point"),
    "step_samples": Table(_ID + "ts long, steps int", ("source", "device_id", "ts"), "point"),
    "sleep_sessions": Table(
        _ID + "start_ts long, end_ts long, is_nap int, in_bed_start_ts long, in_bed_end_ts long, tz_offset_min int, dev_duration_min double, "
        "dev_deep_min double, dev_light_min double, dev_rem_min double, dev_awake_min double, dev_min_hr double, dev_avg_hr double",
        ("source", "device_id", "start_ts"),
        "interval",
    ),
    "sleep_segments": Table(
        _ID + "session_start_ts long, start_ts long, end_ts long, stage string", ("source", "device_id", "start_ts", "session_start_ts"), "interval"
    ),
    "workouts": Table(
        _ID + "start_ts long, end_ts long, sport string, tz_offset_min int, avg_hr double, max_hr double, min_hr double, zone1_s double, "
        "zone2_s double, zone3_s double, zone4_s double, zone5_s double, dev_train_load double",
        ("source", "device_id", "start_ts"),
        "interval",
    ),
    "rr_intervals": Table(_ID + "ts_ms long, rr_ms int", ("source", "device_id", "ts_ms"), "point"),
    "device_daily": Table(_ID + "date string, metric string, value double", ("source", "device_id", "date", "metric"), "point"),
}
STAGES = ("awake", "light", "deep", "rem", "asleep")
CONTEXTS = ("background", "workout", "spot", "unknown")
STATUSES = ("ok", "insufficient_data", "not_available", "warming_up")


def empty(spark: SparkSession, table: str) -> DataFrame:
    """No rows, with the declared columns."""
    return spark.createDataFrame([], TABLES[table].schema)


def conform(df: DataFrame, table: str) -> DataFrame:
    """The declared columns in their order and types; columns the frame lacks, and values that are no number, are null."""
    return without_nan(df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[table].schema]))


def without_nan(df: DataFrame) -> DataFrame:
    """Null in the place of NaN, which would spoil every sum that it gets into."""
    numbers = [c for c, kind in df.dtypes if kind in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in numbers})


def violations(df: DataFrame, table: str, source: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """One row of counts: what is wrong with a table's rows. ``keys`` extend the natural key."""
    t = TABLES[table]
    own = [*keys, *t.key]
    checks = {"null_key": F.greatest(*[F.col(c).isNull() for c in own])}
    if source is not None:
        checks["foreign_source"] = F.col("source") != source
    if t.strategy == "interval":
        checks["empty_interval"] = F.col("end_ts") <= F.col("start_ts")
    if "stage" in t.columns:
        checks["bad_stage"] = ~F.col("stage").isin(*STAGES)
    if "context" in t.columns:
        checks["bad_context"] = ~F.col("context").isin(*CONTEXTS)
    per_key = df.groupBy(*own).agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(c).alias(n) for n, c in checks.items()])
    sums = [F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in checks]
    return per_key.agg(*sums, F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_key"))


def validate(batch: Mapping[str, DataFrame], source: str | None = None) -> None:
    """Raise ValueError for the first thing that is wrong with a batch of tables."""
    for name, df in batch.items():
        if name not in TABLES:
            raise ValueError(f"unknown table {name}")
        want, have = set(TABLES[name].columns), set(df.columns)
        if want != have:
            raise ValueError(f"{name}: missing columns {sorted(want - have)}, extra columns {sorted(have - want)}")
        found = violations(df, name, source).first().asDict()
        for what, n in found.items():
            if n:
                raise ValueError(f"{name}: {n} rows with {what}")
