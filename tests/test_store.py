"""Ingestion, the export layout, streams and the SQLite source."""

from __future__ import annotations

import datetime as dt
import sqlite3

import pytest
from pyspark.sql import functions as F

from pulseframe import schema
from pulseframe.sources import exports as X
from pulseframe.sources.sqlite import SqliteSource, tables
from tests.synthetic import SOURCE, Wearer, event, generate
from pulseframe.store import Store, file_sha256
from pulseframe.streaming import ingest


@pytest.fixture(scope="module")
def batch(spark):
    return generate(
        spark,
        Wearer(nights=3, events=(event("workout", dt.date(2026, 3, 2), at=dt.time(17), minutes=60, bpm=150), event("nap", dt.date(2026, 3, 3), at=dt.time(15), minutes=40))),
    )


def test_ingest_is_idempotent(spark, batch, tmp_path):
    store = Store(spark, str(tmp_path))
    first = store.ingest(batch, SOURCE, "abc")
    counts = {t: store.read(t).count() for t in batch}
    assert counts == first and store.already_ingested("abc") and not store.already_ingested("other")
    store.ingest(batch, SOURCE, "abc")
    assert {t: store.read(t).count() for t in batch} == counts
    later = {"sleep_segments": batch["sleep_segments"].withColumn("end_ts", F.col("end_ts") - 60).where("stage <> 'rem'")}
    store.ingest(later, SOURCE)
    assert store.read("sleep_segments").where("stage = 'rem'").count() == 0 and store.read("rr_intervals").count() == 0


def files(folder, table):
    return {str(f.relative_to(folder)): f.stat().st_mtime_ns for f in (folder / table).rglob("*.parquet")}


def by_month(found, month):
    return {k: v for k, v in found.items() if f"_month={month}/" in k}


def test_points_touch_their_months_only(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    at = lambda day: int(dt.datetime.fromisoformat(day + "T12:00+00:00").timestamp())
    frame = lambda rows: spark.createDataFrame([("s", "d", at(day), n) for day, n in rows], "source string, device_id string, ts long, steps int")
    store.ingest({"step_samples": frame([("2025-12-31", 1), ("2026-01-01", 2), ("2026-02-15", 3), ("2026-03-01", 4)])}, "s")
    before = files(tmp_path, "step_samples")
    assert {k.split("/")[1] for k in before} == {"_month=2025-12", "_month=2026-01", "_month=2026-02", "_month=2026-03"}
    for _ in range(2):
        store.ingest({"step_samples": frame([("2026-02-15", 30), ("2026-02-16", 5)])}, "s")
        after = files(tmp_path, "step_samples")
        for month in ("2025-12", "2026-01", "2026-03"):
            assert by_month(after, month) == by_month(before, month)
        assert by_month(after, "2026-02") != by_month(before, "2026-02")
        assert sorted((r["ts"], r["steps"]) for r in store.read("step_samples").collect()) == [(at(d), n) for d, n in [("2025-12-31", 1), ("2026-01-01", 2), ("2026-02-15", 30), ("2026-02-16", 5), ("2026-03-01", 4)]]
    assert store.read("step_samples", "steps > 4").columns == schema.TABLES["step_samples"].columns and store.read("step_samples", "steps > 4").count() == 2


def test_intervals_touch_what_they_overlap(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    at = lambda text: int(dt.datetime.fromisoformat(text + "+00:00").timestamp())
    frame = lambda rows: schema.conform(spark.createDataFrame([(s, "d", at(a), at(b)) for s, a, b in rows], "source string, device_id string, start_ts long, end_ts long"), "workouts")
    old = [("s", "2026-01-31T23:00", "2026-02-01T01:00"), ("s", "2025-11-01T00:00", "2025-11-01T01:00"), ("other", "2026-02-01T00:10", "2026-02-01T00:20"), ("s", "2026-03-05T00:00", "2026-03-05T01:00")]
    store.merge("workouts", frame(old))
    before = files(tmp_path, "workouts")
    new = [("s", "2026-02-01T00:30", "2026-02-01T02:00")]
    for _ in range(2):
        store.merge("workouts", frame(new))
        got = sorted((r["source"], r["start_ts"]) for r in store.read("workouts").collect())
        assert got == sorted((s, at(a)) for s, a, _ in [*old[1:], *new])
        after = files(tmp_path, "workouts")
        assert not by_month(after, "2026-01")  # its only row is gone, and so is the month
        for month in ("2025-11", "2026-03"):
            assert by_month(after, month) == by_month(before, month)


def test_replacing_all_rows(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for months in (("2026-01", "2026-02"), ("2026-02", "2026-03")):
        store.replace("daily_metrics", spark.createDataFrame([(f"{m}-05", float("nan")) for m in months], "date string, value double"))
        assert sorted(map(tuple, store.read("daily_metrics").select("date", "value").collect())) == [(f"{m}-05", None) for m in months]
    assert len({k.split("/")[1] for k in files(tmp_path, "daily_metrics")}) == 2
    with pytest.raises(ValueError, match="no table"):
        store.read("nothing")


def test_validation(spark, batch):
    for broken, what in (
        (batch["hr_samples"].withColumn("context", F.lit("x")), "bad_context"),
        (batch["hr_samples"].unionByName(batch["hr_samples"]), "duplicate_key"),
        (batch["hr_samples"].withColumn("ts", F.lit(None).cast("long")), "null_key"),
        (batch["hr_samples"].drop("bpm"), "missing columns"),
    ):
        with pytest.raises(ValueError, match=what):
            schema.validate({"hr_samples": broken}, SOURCE)
    with pytest.raises(ValueError, match="empty_interval"):
        schema.validate({"workouts": batch["workouts"].withColumn("end_ts", F.col("start_ts"))})
    with pytest.raises(ValueError, match="unknown table"):
        schema.validate({"nope": batch["workouts"]})
    with pytest.raises(ValueError, match="foreign_source"):
        schema.validate({"workouts": batch["workouts"]}, "someone")


def test_export_round_trip(spark, batch, tmp_path):
    X.write_export(batch, str(tmp_path))
    got, notes = X.read_export(spark, str(tmp_path), now=1_800_000_000)
    for name in ("hr_samples", "step_samples", "sleep_sessions", "sleep_segments", "workouts"):
        key = [c for c in schema.TABLES[name].key if c != "source"]
        assert sorted(map(tuple, got[name].select(*key).collect())) == sorted(map(tuple, batch[name].select(*key).collect())), name
    assert any("(code 2)" in n for n in notes)
    assert [r["is_nap"] for r in got["sleep_sessions"].collect()] == [None] * 4


def test_export_rejects(spark, tmp_path):
    with pytest.raises(X.ExportError, match="holds no file"):
        X.read_export(spark, str(tmp_path))
    file = tmp_path / "x_MiFitness_hlth_center_fitness_data.csv"
    value = '"{""bedtime"":1772404200,""wake_up_time"":1772431200,""timezone"":8,""items"":[{""start_time"":1772404200,""end_time"":1772431200,""state"":9}]}"'
    file.write_text("Uid,Sid,Key,Time,Value,UpdateTime\n1,d,sleep,1," + value + ",1\n")
    with pytest.raises(X.ExportError, match="without a meaning"):
        X.read_export(spark, str(tmp_path))
    file.write_text(
        "﻿Uid,Sid,Key,Time,Value,UpdateTime\n"
        '1,d,heart_rate,1,"{""time"":5,""bpm"":60}",1\n1,d,heart_rate,1,"{""time"":1772404200,""bpm"":60}",1\n1,d,heart_rate,1,"{""time"":1772404200,""bpm"":61}",1\n'
        '1,d,resting_heart_rate,1,"{""date_time"":1772409600,""bpm"":55}",1\n1,d,sleep,1,' + value.replace(":9}", ":3}") + ",1\n"
    )
    got, _ = X.read_export(spark, str(tmp_path))
    assert [r["bpm"] for r in got["hr_samples"].collect()] == [61]
    assert got["sleep_sessions"].first()["tz_offset_min"] == 120 and got["device_daily"].first()["date"] == "2026-03-02"
    assert len(file_sha256(str(file))) == 64


def test_streams(spark, batch, tmp_path):
    batch["hr_samples"].repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema.TABLES["hr_samples"].schema).parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "store"))
    ingest.ingest_points(stream, store, "hr_samples", str(tmp_path / "cp")).awaitTermination()
    assert store.read("hr_samples").count() == batch["hr_samples"].count()
    query = ingest.wear_sessions(stream).writeStream.format("memory").queryName("worn").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("worn").count() >= 0
    means = ingest.minute_means(spark.read.schema(schema.TABLES["hr_samples"].schema).parquet(str(tmp_path / "in")))
    assert means.count() == batch["hr_samples"].count()


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "g.db")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE S (TIMESTAMP INTEGER, HR, RAW BLOB)")
    con.executemany("INSERT INTO S VALUES (?, ?, ?)", [(i, i % 200 if i % 3 else "x", b"\x01\x02") for i in range(50)])
    con.commit(), con.close()
    spark.dataSource.register(SqliteSource)
    df = spark.read.format("sqlite").option("path", path).option("table", "S").option("types", "true").load()
    assert tables(path) == [("S", 50)] and df.count() == 50
    assert {r["HR_type"] for r in df.select("HR_type").distinct().collect()} == {"text", "integer"} and df.first()["RAW"] == "0102"
