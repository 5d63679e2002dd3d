"""JSON texts are parsed once and scrubbed in few pieces, with the results of Spark's variants."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pulseframe.functions import privacy
from pulseframe.plans import json_values as J


def test_statistics_parse_each_text_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(t):
        seen.add(1)
        return t

    df = spark.createDataFrame([(f'{{"a":{i},"b":"x"}}',) for i in range(50)], "doc string")
    assert J.value_stats(df.select(counted.asNondeterministic()("doc").alias("doc")), "doc").count() == 2
    assert seen.value == 50


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"a":-0}', [("a", "BIGINT", "0")]),
        ('{"a":-0.0,"b":100.0}', [("a", "DECIMAL", "0"), ("b", "DECIMAL", "100")]),
        ('{"a":9223372036854775808}', [("a", "DECIMAL", "9223372036854775808")]),
        ('{"a":1e-5,"b":1E+2}', [("a", "DOUBLE", "1.0E-5"), ("b", "DOUBLE", "100.0")]),
        ('{"a":1,"a":2}', []),
        ('{"a":NaN}', []),
        ('{"a":01}', []),
        ('{"":{"":1,"b":2}} x', [("", "BIGINT", "1"), ("b", "BIGINT", "2")]),
    ],
)
def test_odd_texts(spark, text, want):
    rows = J.json_values(spark.createDataFrame([(text,)], "t string"), "t").collect()
    assert sorted(map(tuple, rows)) == want


def test_few_pieces(spark):
    text = "{" + ",".join(f'"k{i}":"v {i}"' for i in range(400)) + ',"lat":1,"x":"lat","lon": }'
    df = spark.createDataFrame([(text,)], "t string").select(privacy.scrub_json(F.col("t")).alias("t"))
    assert df.first()[0] == text.replace('"lat":1', '"lat":"<redacted>"')
    assert df._jdf.queryExecution().executedPlan().toString().count("regexp_extract_all") == 1
