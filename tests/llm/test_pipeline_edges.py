"""Odd rows through every stage of the corpus pipeline."""

from __future__ import annotations

import os

import pytest

import corpus_pipeline as P
from tests.llm.test_edges import empty, odd  # noqa: F401  fixtures


@pytest.mark.parametrize("name,stage", P.STAGES)
def test_odd_rows(spark, odd, name, stage):  # noqa: F811
    folder, n = odd
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clash = docs.selectExpr("*", "1 AS _row", "2 AS _key", "3 AS _own", "4 AS root", "5 AS items", "6 AS n_hit", "7 AS found", "8 AS key", "9 AS hash", "10 AS _hash", "11 AS _label")
    out = stage(spark, clash, folder)
    rows = out.collect()
    if name == "packing":
        assert len(rows) >= n
        return
    assert out.columns == clash.columns
    given = [str(r) for r in clash.collect()]
    assert all(str(r) in given for r in rows)
    kept = [(r["doc_id"], r["text"]) for r in rows]
    if name == "toxicity":
        assert (200, None) in kept and (201, "") in kept and kept.count((209, "same")) == 2
    if name == "language":
        gone = {(r["doc_id"], r["text"]) for r in clash.collect()} - set(kept)
        assert gone == {(200, None), (201, ""), (202, " \n\t "), (203, "12345 !!! ???"), (None, None)}
    if name == "near_duplicates":
        assert kept.count((209, "same")) == 1 and (209, "other text of five words here") in kept and (200, None) in kept and (None, None) in kept
    if name == "decontamination":
        assert (200, None) in kept and (207, clash.where("doc_id = 207").first()["text"]) not in kept


@pytest.mark.parametrize("name,stage", P.STAGES)
def test_empty_tables(spark, empty, name, stage):  # noqa: F811
    assert stage(spark, spark.read.parquet(f"{empty}/documents.parquet"), empty).count() == 0


def test_nothing_but_the_result_is_left(spark, odd):  # noqa: F811
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    rows = P.run(spark, odd[0]).collect()
    left = sorted(x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before)
    assert rows and "stage-near_duplicates" not in left and len(left) <= 4
