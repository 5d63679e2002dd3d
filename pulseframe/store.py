"""Intermediate tables, and stored ones: partitions by month, upserts, replacement by window, the ingest log."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import schema
from .operators.intervals import anti_overlap, overlapping

T = TypeVar("T")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one for a single-machine session without it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


_noted: list[list[str]] = []


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back, which cuts its lineage."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for paths in _noted[-1:]:
        paths.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def remove_folder(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Remove intermediate tables that :func:`stored` wrote and that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "stored_path", None):
            remove_folder(t.sparkSession, path)


def finished(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """The table that ``make`` returns, written and read back; what was stored on the way to it is removed."""
    _noted.append([])
    try:
        out = make()
        written = stored(out, label)
    finally:
        on_the_way = _noted.pop()
    for path in on_the_way:
        if path != written.stored_path:
            remove_folder(written.sparkSession, path)
    for paths in _noted[-1:]:
        paths.append(written.stored_path)
    return written


def together(*steps: Callable[[], T]) -> list[T]:
    """Run steps that do not need each other at the same time, so that their jobs fill the cluster; the first error is raised once all ended."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return [f.result() for f in [pool.submit(step) for step in steps]]


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """New rows win over old ones with the same key; of repeated new rows the one that is last by its other columns."""
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    rest = [c for c in old.columns if c not in key]
    order = [F.desc("_age"), *[F.desc_nulls_last(c) for c in rest]]
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return both.withColumn("_n", first).where("_n = 1").drop("_n", "_age")


def replace_window(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("source",)) -> DataFrame:
    """Old intervals of the new ones' sources that overlap their span go, whatever their device; then the new ones come."""
    return anti_overlap(old, new, keys).unionByName(new)


def month_of(columns: Sequence[str]) -> Column:
    """The UTC month that a row belongs to, as ``yyyy-MM``; one for all rows where a table has no time."""
    for c, per_second in (("ts", 1), ("start_ts", 1), ("ts_ms", 1000)):
        if c in columns:
            return F.date_format(F.date_from_unix_date(F.floor(F.col(c) / (86_400 * per_second)).cast("int")), "yyyy-MM")
    return F.substring("date", 1, 7) if "date" in columns else F.lit("all")


class Store:
    """Canonical and result tables under one folder, which any Hadoop file system may hold.

    A table is a Parquet folder with a partition per month. What a batch changes is merged month by month:
    only months that it reaches are read and overwritten, by Spark's dynamic partition overwrite.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _rows(self, table: str) -> DataFrame | None:
        """The table with its column ``_month``; None before anything was written."""
        where = f"{self.folder}/{table}"
        if not self._fs.exists(self._path(where)):
            return None
        known = schema.TABLES.get(table)
        reader = self.spark.read
        return (reader.schema(f"{known.ddl}, _month string") if known else reader).parquet(where)

    def read(self, table: str, where: str | None = None) -> DataFrame:
        df = self._rows(table)
        if df is None:
            if table not in schema.TABLES:
                raise ValueError(f"no table {table}")
            return schema.empty(self.spark, table)
        return (df.where(where) if where else df).drop("_month")

    def _overwrite(self, table: str, merged: DataFrame, months: Sequence[str]) -> None:
        """Put ``merged`` in the place of these months' rows; months left without rows go."""
        target = f"{self.folder}/{table}"
        held = {r["_month"] for r in merged.select("_month").distinct().collect()}  # a row per month
        if held:
            merged.hint("rebalance", "_month").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("_month").parquet(target)
        for month in set(months) - held:
            remove_folder(self.spark, f"{target}/_month={month}")

    def replace(self, table: str, df: DataFrame) -> None:
        """These rows, and no others, are the table's from now on."""
        old = self._rows(table)
        months = [] if old is None else [r["_month"] for r in old.select("_month").distinct().collect()]
        new = stored(schema.without_nan(df).withColumn("_month", month_of(df.columns)), f"replace-{table}")
        self._overwrite(table, new, months)
        discard(new)

    def _merged(self, table: str, new: DataFrame) -> tuple[DataFrame, list[str]]:
        """The rows of all months that new ones reach, after the merge, and these months."""
        t, old = schema.TABLES[table], self._rows(table)
        dated = new.withColumn("_month", month_of(t.columns))
        reached = dated.select("_month")
        if old is not None and t.strategy != "point":
            # an old interval may have begun in a month before those of the new ones
            reached = reached.unionByName(overlapping(old, new, ["source"]).select("_month"))
        months = sorted(r["_month"] for r in reached.distinct().collect())
        if old is None:
            return stored(upsert(schema.empty(self.spark, table), new, t.key).withColumn("_month", month_of(t.columns)) if t.strategy == "point" else dated, f"merged-{table}"), months
        there = old.where(F.col("_month").isin(months)).drop("_month")
        merged = upsert(there, new, t.key) if t.strategy == "point" else replace_window(there, new)
        return stored(merged.withColumn("_month", month_of(t.columns)), f"merged-{table}"), months

    def merge(self, table: str, new: DataFrame) -> None:
        """Merge canonical rows into a table."""
        given = stored(schema.conform(new, table), f"batch-{table}")
        merged, months = self._merged(table, given)
        self._overwrite(table, merged, months)
        discard(given, merged)

    def ingest(self, batch: Mapping[str, DataFrame], source: str, file_hash: str | None = None, notes: str = "") -> dict[str, int]:
        """Validate a batch, merge it into the tables, and log it. Returns rows per table.

        All merged months are worked out before any of them is put in place. Ingesting a batch again
        changes nothing.
        """
        schema.validate(batch, source)
        made, log, ready = {}, [], {}
        ident = uuid.uuid4().hex
        for table, new in batch.items():
            t = schema.TABLES[table]
            new = stored(schema.conform(new, table), f"batch-{table}")
            first, last = ("ts", "ts") if "ts" in t.columns else ("start_ts", "end_ts") if "start_ts" in t.columns else (None, None)
            counted = new.agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("a") if first else F.lit(None).alias("a"), F.max(last).alias("b") if last else F.lit(None).alias("b")).first()
            made[table] = counted["n"]
            log.append((ident, source, file_hash, table, counted["n"], counted["a"], counted["b"], notes))
            if counted["n"]:
                ready[table] = self._merged(table, new)
            discard(new)
        for table, (merged, months) in ready.items():
            self._overwrite(table, merged, months)
            discard(merged)
        columns = "batch_id string, source string, file_sha256 string, tbl string, rows long, min_ts long, max_ts long, notes string"
        entries = self.spark.createDataFrame(log, columns).withColumn("ingested_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))
        entries.write.mode("append").parquet(f"{self.folder}/ingest_log")
        return made

    def already_ingested(self, file_hash: str) -> bool:
        log = self._path(f"{self.folder}/ingest_log")
        return self._fs.exists(log) and not self.spark.read.parquet(f"{self.folder}/ingest_log").where(F.col("file_sha256") == file_hash).isEmpty()

    def write_daily(self, long: DataFrame) -> None:
        """Replace all daily metrics, stamped with the time of writing; without rows the old ones stay."""
        if not long.isEmpty():
            self.replace("daily_metrics", long.withColumn("computed_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")))

    def write_workouts(self, loads: DataFrame) -> None:
        """Replace all workout metrics; of rows with one start and sport the first by end stays."""
        first = F.row_number().over(Window.partitionBy("start_ts", "sport").orderBy("end_ts"))
        own = loads.withColumn("_n", first).where("_n = 1").drop("_n")
        self.replace("workout_metrics", own.withColumn("duration_min", (F.col("end_ts") - F.col("start_ts")) / 60))


def file_sha256(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()
