"""JSON paths and value statistics, scrubbing, and minutes of local days, against plain Python."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import random
from collections import Counter, defaultdict
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from pulseframe.functions import privacy
from pulseframe.plans import json_values as J
from pulseframe.plans import profiling as PR

# --- paths and values ------------------------------------------------------------------------------


def flat(node, path="", level=0, limit=8):
    """Values of a parsed text, straight from the definition."""
    if level > limit:
        return []
    if isinstance(node, dict):
        return [x for k, v in node.items() for x in flat(v, f"{path}.{k}" if path else k, level + 1, limit)]
    if isinstance(node, list):
        return [(f"{path}[].#len", len(node))] + [x for v in node for x in flat(v, f"{path}[]", level + 1, limit)]
    return [(path, node)]


def grown(rng, level=0):
    kind = rng.choice("oolls") if level < 11 else "s"
    if kind == "o":
        return {rng.choice("abcd"): grown(rng, level + 1) for _ in range(rng.randint(0, 3))}
    if kind == "l":
        return [grown(rng, level + 1) for _ in range(rng.randint(0, 3))]
    return rng.choice([1, -7, 2.5, True, False, None, "", "x", "12", "1e3", "é\n\"q\""])


@pytest.mark.parametrize("depth", [0, 1, 3, 8])
def test_paths_at_any_depth(spark, depth):
    rng = random.Random(depth)
    docs = [grown(rng) for _ in range(200)]
    docs = [d for d in docs if isinstance(d, (dict, list))]
    texts = [json.dumps(d) for d in docs] + [None, "", "17", '"text"', "no json", "{broken"]
    got = J.json_values(spark.createDataFrame([(t,) for t in texts], "v string").repartition(3), "v", depth).collect()
    want = Counter(p for d in docs for p, _ in flat(d, limit=depth))
    assert Counter(r["path"] for r in got) == want
    assert Counter(r["path"] for r in got if r["value"] is None) == Counter(p for d in docs for p, v in flat(d, limit=depth) if v is None)


def test_source_is_read_once(spark, tmp_path):
    spark.createDataFrame([('{"a":[1]}',)], "v string").write.parquet(str(tmp_path / "t"))
    plan = J.json_paths(spark.read.parquet(str(tmp_path / "t")), "v")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_value_statistics_do_not_depend_on_the_split(spark):
    docs = [{"code": i % 30, "many": i % 31, "t": 1_700_000_000 + i, "s": ["x", "", None, "3"][i % 4], "f": i % 5 == 0} for i in range(2000)]
    df = spark.createDataFrame([("k", json.dumps(d)) for d in docs], "key string, doc string")
    got = [sorted(map(tuple, J.value_stats(df.repartition(n), "doc", keys=["key"]).collect()), key=lambda r: r[1]) for n in (1, 7)]
    assert got[0] == got[1]
    by_path = {r[1]: r[2:] for r in got[0]}
    assert by_path["code"][:5] == (2000, 0, "BIGINT:2000", 0.0, 29.0) and by_path["code"][5] == 30 and by_path["code"][6].startswith("0:67, 1:67, 10:67")
    assert by_path["many"][5:] == (None, None) and by_path["t"][3:] == (1_700_000_000.0, 1_700_001_999.0, None, None)
    assert by_path["s"] == (2000, 1000, "NUMSTR:500,STRING:500", 3.0, 3.0, 2, "3:500, x:500")
    assert by_path["f"][2:] == ("BOOLEAN:2000", None, None, 2, "false:1600, true:400")


def test_each_task_sees_other_values(spark):
    """Ten values in each of seven tasks are more than thirty together; fifteen shared by all are not."""
    rows = [(p, json.dumps({"own": p * 10 + i % 10, "shared": i % 15})) for p in range(7) for i in range(60)]
    df = spark.createDataFrame(rows, "p int, doc string").repartitionByRange(7, "p")
    got = {r["path"]: r["distinct"] for r in J.value_stats(df, "doc").collect()}
    assert got == {"own": None, "shared": 15}


def test_only_empty_values_and_empty_tables(spark):
    df = spark.createDataFrame([('{"a":null,"b":""}',), (None,)], "doc string")
    assert sorted(map(tuple, J.value_stats(df, "doc").collect())) == [("a", 1, 1, "", None, None, 0, ""), ("b", 1, 1, "", None, None, 0, "")]
    assert J.value_stats(df.where("false"), "doc").count() == 0 == J.json_paths(df.where("false"), "doc").count()


# --- scrubbing -------------------------------------------------------------------------------------


def short(text):
    return "id:" + hashlib.sha256(text.encode()).hexdigest()[:8]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"lat" : 52.1,\n "lon":"x\\"y", "bpm":60}', '{"lat" : "<redacted>",\n "lon":"<redacted>", "bpm":60}'),
        ('{"a":[{"Device_ID":"q\\u00e9"},{"uid":17},{"sn":true}]}', f'{{"a":[{{"Device_ID":"{short("qé")}"}},{{"uid":"{short("17")}"}},{{"sn":"{short("true")}"}}]}}'),
        ('{"gpsTrack":{"p":[[1,2],{"x":"}]"}]},"k":[1 ,2]}', '{"gpsTrack":"<redacted>","k":[1 ,2]}'),
        ('{"user_id":["a",{"b":1}] }', f'{{"user_id":"{short(json.dumps(["a", {"b": 1}], separators=(",", ":")))}" }}'),
        ('{"x.mac":"m","macro":"m","uid2":1}', f'{{"x.mac":"{short("m")}","macro":"m","uid2":1}}'),
        ('{"note":"\\"lat\\":1, uid","v":"lat"}', '{"note":"\\"lat\\":1, uid","v":"lat"}'),
        ('{"lat":{"a":1', '"<redacted>"'),
        ("plain text", "plain text"),
        ("", ""),
        (None, None),
    ],
)
def test_scrubbing(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(privacy.scrub_json(F.col("t"))).first()[0] == want


def test_scrubbing_of_deep_and_long_texts(spark):
    deep = '{"location":' + "[" * 30 + "7" + "]" * 30 + ',"k":1}'
    wide = '{"k":[' + ",".join(['{"lat":1.25,"hr":"a b"}'] * 20_000) + '],"sid":"' + "z" * 300_000 + '"}'
    got = [r[0] for r in spark.createDataFrame([(deep,), (wide,)], "t string").select(privacy.scrub_json(F.col("t"))).collect()]
    assert got[0] == '"<redacted>"'
    assert got[1] == wide.replace("1.25", '"<redacted>"').replace('"' + "z" * 300_000 + '"', f'"{short("z" * 300_000)}"')


def test_untouched_texts_come_back_byte_for_byte(spark):
    rng = random.Random(4)
    texts = [json.dumps(grown(rng), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1, 3])) for _ in range(200)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", privacy.scrub_json(F.col("t")).alias("t")).collect()
    assert {r["i"]: r["t"] for r in got} == dict(enumerate(texts))


def test_account_in_file_names(spark):
    names = ["20240131_1234567_MiFitness_x.csv", "x_1234567_y.csv", "20240131_12_34_x"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(privacy.mask_account(F.col("n"))).collect()]
    assert got == ["20240131_<account>_MiFitness_x.csv", "x_1234567_y.csv", "20240131_<account>_34_x"]


# --- minutes of local days -------------------------------------------------------------------------


@pytest.mark.parametrize("zone", ["Europe/Berlin", "UTC", "America/New_York"])
def test_minutes_of_short_and_long_days(spark, zone):
    rng, tz = random.Random(6), ZoneInfo(zone)
    starts = [int(dt.datetime.fromisoformat(day + "T00:00+00:00").timestamp()) for day in ("2024-03-30", "2024-10-26", "1969-12-31")]
    seconds = [s + rng.randint(0, 59) for t in starts for s in range(t, t + 3 * 86_400, 60) if rng.random() < 0.95]
    want = defaultdict(set)
    for s in seconds:
        local = dt.datetime.fromtimestamp(s, tz)
        want[local.date()].add((local.hour, local.minute))
    df = spark.createDataFrame([(s,) for s in seconds] + [(None,)], "ts long").repartition(4)
    got = {r["date"]: r["minutes"] for r in PR.covered_minutes(df, "ts", zone).collect()}
    assert got == {d: len(m) for d, m in want.items()}
    if zone == "Europe/Berlin":
        full = spark.range(1_711_753_200, 1_711_753_200 + 2 * 86_400, 60).withColumnRenamed("id", "ts")
        assert PR.covered_minutes(full, "ts", zone).where("date = '2024-03-31'").first()["minutes"] == 1380
