"""Disguises by signs at any place, spacing with signs, and letters beyond ASCII."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pulseframe.llm import toxicity
from pulseframe.llm.common import crc_fold
from tests.conftest import DATA

PLAIN = "we walked along the quiet river and talked about weather while old friends were reading books near stone houses under tall green trees".split()
HIDDEN = [
    "id10t", "a55hole", "n00b", "a$$hole", "l00ser", "sh1+", "1 d 1 0 t", "i.d.1.o.t", "i - d - i - o - t", "i  d  i  o  t", "d ä m l i c h", "d.ä.m.l.1.c.h", "dääääämlich",
    "friend,1d10t,weather", "(1d10t)", "friend.1d10t", "m0r0n-river", "id" + "i" * 60 + "ot", "asssshole", "A$$$hole", "nooooob", "n000b", "river" * 9 + ".1d10t",
    "i d 1 0 t", "i   d   i   o   t", "i\nd\ni\no\nt", "i/d/i/o/t", "ïd1öt", "https://example.org/a/very/long/address/of/some/page/1d10t", "i d i o t " * 1 + "x y z " * 60,
    # a space inside, and other marks between
    "id iot", "mor on", "i,d,i;o:t", "i)d)i)o)t", "[i][d][i][o][t]",
    # a letter that goes on and on, joined and apart
    *["id" + "d" * n + "iot" for n in (3, 20, 70)], *["i " + "d " * n + "i o t" for n in (3, 20, 70, 400)], *["x y z " * n + "i d i o t" + " x y z" * n for n in (1, 20, 200)],
]
CLEAN = [
    "number 10 and 3d or a b, 4x4 and $5", "1 2 3 a 4 - 5", "river! trees!!! **stone** 10:30am v1.0 2024-01-05", "9f8a7c3e0b1d4a5e6f708192a3b4c5d6e7f80912", "日本語ーーー 10 b - c - d",
    # letters that are not drawn out count as they are: no asshole, no noob
    "we went ashore*** and nobody!!! saw the ashes$$$ there",
    # inside other letters a listed word is none, however long they are
    "snoob1est", "riverriverriverriverriversnoob1est", "x" + "river" * 9 + "1d10t", "9f8a7c3e0b1d1d10t4a5e6f708192a3b4c5d6e7f80912",
    "mid iota", "the id\niot", "id, iot", "the period iotas",
]


def test_more_disguised_words_are_restored(spark):
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choices(PLAIN, k=n))
    clean = [(i, prose(40)) for i in range(60)]
    toxic = [(100 + i, " ".join([prose(10), "idiot", prose(8), "moron", prose(6), "asshole", prose(5), "noob shit", prose(3), "looser dämlich"])) for i in range(40)]
    test = [(200 + i, f"the weather was nice, {h} walked along the river") for i, h in enumerate(HIDDEN)] + [(300 + i, t) for i, t in enumerate(CLEAN)]
    # runs end with their text
    test += [(400, "1d1"), (401, "0t"), (402, "i d i"), (403, "o t"), (404, None), (405, "")]
    schema = "doc_id long, text string"
    # nor does the length of a text decide
    padded = {500 + i: n for i, n in enumerate((10, 119, 120, 121, 122, 2000))}
    test += [(i, f"{prose(n)} n00b {prose(n)} 1d10t") for i, n in padded.items()]
    train, rows = spark.createDataFrame(clean + toxic, schema), spark.createDataFrame(test, schema).coalesce(1)
    labels = spark.createDataFrame([(i, 0) for i, _ in clean] + [(i, 1) for i, _ in toxic], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(rows, toxicity.fit(train.unionByName(rows), labels)).collect()}
    assert [h for i, h in enumerate(HIDDEN) if got[200 + i]["score"] < 0.7] == []
    assert len({got[i]["score"] for i in padded}) == 1 and got[500]["score"] > 0.7
    assert [t for i, t in test if 300 <= i < 500 and got[i]["score"] >= 0.5] == []


def test_evidence_adds_up():
    words = toxicity.WordList({1: [(1, 2.0, 0, "one")], 2: [(1, 2.0, 0, "two"), (3, 4.0, 0, "two")], 3: [(1, 1.5, 4, "onen")]}, 0.01, -2.0)
    chance = lambda x: 1 / (1 + 2.718281828459045**-x)
    assert words.score({}) == (0.01, [])
    assert words.score({1: 5}) == (pytest.approx(chance(0.0)), ["one"])
    assert words.score({1: 1, 2: 1}) == (pytest.approx(chance(2.0)), ["one", "two"])
    assert words.score({1: 1, 2: 3}) == (pytest.approx(chance(4.0)), ["one", "two"])  # the more telling of one word's counts
    assert words.score({1: 1, 3: 9}) == (pytest.approx(chance(0.0)), ["one"])  # a word and its beginning are one
    assert words.score({3: 1}) == (pytest.approx(chance(-0.5)), ["onen"])


def test_repeats_apart_are_folded():
    text = "i d D d d\td d.i"
    places = [i for i, c in enumerate(text) if c.isalpha()]
    assert toxicity._apart(text, places) == "i d D d.i"


def test_settings_are_judged_on_rows_that_may_train_only(spark):
    """Labels of held-out rows, turned round, change nothing."""
    docs = spark.read.parquet(str(DATA / "sf0.01/documents.parquet"))
    labels = spark.read.parquet(str(DATA / "sf0.01/labels.parquet"))
    held_out = crc_fold(F.col("doc_id"), 3) == 1
    turned = labels.withColumn("toxic", F.when(held_out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (toxicity.fold_report(docs, t.where(~held_out), [toxicity.SETTING]) for t in (labels, turned))
    assert one == two and one[0][1] > 0 and one[0][4] <= 0.05 * one[0][3]
